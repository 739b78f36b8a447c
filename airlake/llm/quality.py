"""Document quality: a classifier's evidence with host and path posteriors shrunk by empirical Bayes."""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.llm import shingles as S
from airlake.llm.common import Scratch, empty_if_null, held_out, lean, slices

#: Measures of a text's shape, and the bins that follow them among the features: half for hashed words, half for word pairs.
SHAPES = ("length", "word_length", "distinct", "symbols", "digits", "capitals", "bars", "stops", "lines")
BINS = 1 << 16


@cache
def _classes() -> np.ndarray:
    """Of every code point: 1 symbol, 2 digit, 3 capital, 4 bar, 5 stop, 6 line end, 0 anything else."""
    kinds = {"N": 2, "P": 1, "S": 1, "C": 1, "M": 1}
    out = np.array([3 if (c := unicodedata.category(chr(i))) == "Lu" else kinds.get(c[0], 0) for i in range(sys.maxunicode + 1)], np.uint8)
    for chars, kind in ((" \t\r,", 0), ("|", 4), (".!?", 5), ("\n", 6)):
        out[[ord(c) for c in chars]] = kind
    return out


def features(texts: list[str], words: S.WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shapes, owner, bin, value) of texts: a row of SHAPES each, and hashed words and neighbouring pairs of them.

    A value is the logarithm of one plus the count in the text, over the norm of the text's values.
    """
    n = len(texts)
    found = [S.WORD.findall(text) for text in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    flat = np.fromiter((words[w] for f in found for w in f), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(n), sizes)
    pair = owner[1:] == owner[:-1]
    pairs = S.mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:])[pair]
    key = np.concatenate([owner << 16, owner[1:][pair] << 16 | 1 << 15]) | (np.concatenate([S.mix(flat), pairs]) >> np.uint64(49)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    single = key >> 15 & 1 == 0
    value, who = np.log1p(count), key >> 16
    norm = np.sqrt(np.bincount(who, value * value, minlength=n))
    chars = np.array([len(t) for t in texts], np.int64)
    kinds = _classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    table = np.bincount(np.repeat(np.arange(n), chars) * 8 + kinds, minlength=8 * n).reshape(n, 8)[:, 1:7]
    distinct = np.bincount(who[single], minlength=n)
    shapes = np.column_stack([np.log1p(chars), chars / np.maximum(sizes, 1), distinct / np.maximum(sizes, 1), table / np.maximum(chars, 1)[:, None]])
    return shapes, who, key & (BINS - 1), value / np.maximum(norm[who], 1e-12)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrunk(prior: Column, strength: float) -> Column:
    return (F.col("k") + strength * prior) / (F.col("n") + strength)


def strength_of_prior(groups: DataFrame, parent: str | None = None) -> float:
    """Prior observations of the groups (n, k) by the method of moments: how much their rates vary around their parent's beyond
    sampling error. 2 to 1000; 50 where the groups cannot tell.
    """
    n, k = F.col("n"), F.col("k")
    of = groups.groupBy(parent) if parent else groups.groupBy()
    sums = of.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")).where("n > 0")
    var = k / n * (1 - k / n)
    row = sums.agg(
        F.sum(F.col("kk") - k * k / n).alias("ss"), F.sum((F.col("g") - 1) * var).alias("noise"), F.sum(n - F.col("nn") / n).alias("d"),
        (F.sum(n * var) / F.sum(n)).alias("within"), F.sum(F.col("g") - 1).alias("free"),
    ).first()
    if not row["free"] or not row["d"]:
        return 50.0
    between = (row["ss"] - row["noise"]) / row["d"]
    return min(1000.0, max(2.0, row["within"] / between - 1)) if between > 0 else 1000.0


def _fit(docs: DataFrame, chosen: DataFrame):
    """(coefficients of shapes and bins, intercept) of a logistic regression on the rows of ``docs`` that ``chosen`` (doc_id, _y) names."""

    def run(batches):
        words = S.WordHashes()
        for batch in batches:
            for part in slices(batch, 1_500_000):
                shapes, owner, bins, value = features(part.column("text").to_pylist(), words)
                n, width = shapes.shape
                ends = np.cumsum(np.concatenate([[0], np.bincount(owner, minlength=n)])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_y"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(shapes.reshape(-1))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(bins.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(value)),
                    ],
                    ["_y", "shapes", "bins", "value"],
                )

    size = len(SHAPES)
    vector = F.udf(lambda s, b, v: Vectors.sparse(size + BINS, [*range(size), *(size + i for i in b)], [*s, *v]), VectorUDT())
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "_y").mapInArrow(
        run, "_y double, shapes array<double>, bins array<int>, value array<double>"
    )
    train = rows.select("_y", vector("shapes", "bins", "value").alias("_x"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-3, maxIter=40).fit(train)
    return model.coefficients.toArray(), float(model.intercept)


def _evidence(docs: DataFrame, coefficients: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, _host, _path, evidence) of docs (doc_id, _host, _path, text)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    size = len(SHAPES)

    def run(batches):
        words = S.WordHashes()
        for batch in batches:
            for part in slices(batch, 1_500_000):
                shapes, owner, bins, value = features(part.column("text").to_pylist(), words)
                total = intercept + shapes @ coefficients[:size] + np.bincount(owner, coefficients[size + bins] * value, minlength=len(shapes))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "_host", "_path")), pa.array(total)], ["doc_id", "_host", "_path", "evidence"])

    return docs.select("doc_id", "_host", "_path", "text").mapInArrow(run, f"{schema}, evidence double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality", max_rows: int = 50_000
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence, host_posterior, path_posterior.

    score is the probability of ``label`` 1; predicted is 1 from 0.5. A logistic regression over the shape of whole
    texts and their hashed words and word pairs (``features``) is fitted to about ``max_rows`` labelled rows at most, picked by a hash
    of the id, none of them held out (CRC-32 of the id divisible by 5). Its evidence is the log odds beyond the base rate. The rates of
    hosts and of paths in a host come from all labelled rows that are not held out: a host's rate is shrunk toward the global
    one, a path's toward its host's, each by a strength estimated from the spread of the groups around what they are shrunk
    to (``strength_of_prior``), so a site with few labels says little. The score adds the evidence and the path's log odds.

    A null text counts as empty; a null host or path and one without labels take the posterior above them.
    Rows are scored one by one: null or repeated doc_ids are documents of their own (a null id is never
    labelled). With labels of one class or none, evidence is 0 and the posterior alone is the score, 0.5
    without any. An empty table gives an empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    base = lean(docs).select("doc_id", empty_if_null("text").alias("text"), F.col(host).alias("_host"), F.col(path).alias("_path"))
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
    )
    # One row for each site; written, as every posterior comes from it.
    by_path = scratch.keep(
        base.select("doc_id", "_host", "_path").join(known, "doc_id").groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("k"))
    )
    total = by_path.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    n, k = total["n"] or 0, total["k"] or 0.0
    mean = (k + 1) / (n + 2)
    by_host = by_path.where("_host IS NOT NULL").groupBy("_host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    named = by_path.where("_host IS NOT NULL AND _path IS NOT NULL")
    host_strength, path_strength = strength_of_prior(by_host), strength_of_prior(named, "_host")
    # Written: their size is then known, and Spark broadcasts them below its threshold and splits large hosts above it.
    hosts = scratch.keep(by_host.select("_host", _shrunk(F.lit(mean), host_strength).alias("host_posterior")))
    paths = scratch.keep(named.join(hosts, "_host").select("_host", "_path", _shrunk(F.col("host_posterior"), path_strength).alias("path_posterior")))

    if 0 < k < n:
        share = math.ceil(min(1.0, max_rows / n) * (1 << 20))
        # About max_rows ids, so they can be broadcast, and no text is shuffled.
        chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
        scored = _evidence(base, *_fit(base, chosen)).withColumn("evidence", F.col("evidence") - math.log(mean / (1 - mean)))
    else:
        scored = base.select("doc_id", "_host", "_path", F.lit(0.0).alias("evidence"))
    joined = scored.join(hosts, "_host", "left").join(paths, ["_host", "_path"], "left")
    host_rate = F.coalesce("host_posterior", F.lit(mean))
    path_rate = F.coalesce("path_posterior", "host_posterior", F.lit(mean))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(path_rate))))
    return joined.select(
        "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "evidence",
        host_rate.alias("host_posterior"), path_rate.alias("path_posterior"),
    )
