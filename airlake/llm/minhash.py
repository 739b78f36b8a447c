"""Near-duplicate documents by BagMinHash signatures of weighted word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm import shingles as S
from airlake.llm.common import Scratch, empty_if_null, lean, slices, tune_bands
from airlake.llm.near import near_classes

ROWS = 5


def signatures(docs: DataFrame, bands: int, rows: int = ROWS, width: int = 5) -> DataFrame:
    """(doc_id, key, buckets, sig) of every document, see ``shingles.bag_minhash``."""

    registers = bands * rows
    # A text takes about 8 points for each register, however short it is: a million points at once.
    most = max(1, 125_000 // registers)

    def run(batches):
        cache = S.WordHashes()
        for batch in batches:
            for part in slices(batch, 2_000_000, most):
                n = part.num_rows
                owner, value, count = S.shingle_sets(part.column("text").to_pylist(), cache, width)
                sig = S.bag_minhash(owner, value, count, n, registers)
                at = np.cumsum(np.concatenate([[0], np.where(np.isin(np.arange(n), owner), bands, 0)]))
                buckets = S.band_hashes(sig, bands, rows)[np.diff(at) > 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(S.content_keys(owner, value, count, n), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(buckets.reshape(-1))),
                        S.fixed_cells(sig.astype(np.uint8)),
                    ],
                    ["doc_id", "key", "buckets", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(
        run, f"doc_id {kind}, key binary, buckets array<bigint>, sig binary"
    )


def contents(rows: DataFrame, width: int = 5) -> DataFrame:
    """(key, shingles) of rows (key, text): the packed multisets whose key is the expected one."""

    def run(batches):
        cache = S.WordHashes()
        for batch in batches:
            for part in slices(batch):
                keys, n = part.column("key").to_pylist(), part.num_rows
                sets = S.shingle_sets(part.column("text").to_pylist(), cache, width)
                found = S.content_keys(*sets, n)
                out = [(k, p) for k, f, p in zip(keys, found, S.pack(*sets, n), strict=True) if k == f]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                    ["key", "shingles"],
                )

    return rows.select("key", "text").mapInArrow(run, "key binary, shingles binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, miss: float = 1e-4) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Documents are linked when the weighted Jaccard similarity of their word ``width``-shingles (lower-cased
    runs of letters, digits and underscores; counted with their frequency) is ``threshold`` or more; a class
    is a component of links and takes the smallest doc_id in it, which is the one kept. A shorter text
    is one shingle, its whole word sequence; texts without words (null, empty) form one class. Rows that
    repeat a doc_id in one class share its fate. A row whose doc_id is null is a class of its own: class_id
    null, class_size 1, kept. An empty table gives an empty result; further columns are not read.

    Documents with the same shingle multiset collapse to one node first, so copies cost one row. The bands
    (``rows`` = 5 registers each) are as many as lose at most ``miss`` of the pairs just at the threshold;
    every surviving pair is counted exactly (see ``near.near_classes``).
    """
    scratch = Scratch(docs.sparkSession)
    bands = tune_bands(threshold, ROWS, miss)
    docs = lean(docs).select("doc_id", "text")
    table = scratch.keep(signatures(docs.where("doc_id IS NOT NULL"), bands, ROWS, width))
    nodes = scratch.keep(
        table.groupBy("key").agg(
            F.count(F.lit(1)).alias("mult"), F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig")
        )
    )

    def fetch(keys: DataFrame) -> DataFrame:
        reps = nodes.join(keys, "key").select("key", F.col("rep").alias("doc_id"))
        return contents(docs.join(reps, "doc_id").select("key", empty_if_null("text").alias("text")), width).dropDuplicates(["key"])

    classes = near_classes(nodes, fetch, threshold, bands * ROWS, scratch)
    member = nodes.join(classes, "key", "left").select("key", "mult", "rep", F.coalesce("root", "key").alias("root"))
    # Written before the join, whose partition of a very large class can then be split.
    named = scratch.keep(member.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("mult").alias("class_size")))
    lookup = scratch.keep(member.join(named, "root").select("key", "class_id", "class_size"))
    result = table.select("doc_id", "key").join(lookup, "key").select(
        "doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept")
    )
    lone = docs.where("doc_id IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    )
    return result.unionByName(lone)


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with a doc_id that ``near_duplicates`` keeps in some class, with all their columns."""
    lost = (
        near_duplicates(docs, threshold).groupBy(F.col("doc_id").alias("_lost")).agg(F.max("kept").alias("_kept"))
        .where("NOT _kept").select("_lost")
    )
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")
