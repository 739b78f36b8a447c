"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import empty_if_null, held_out, lean, slices

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "ѵ": "v", "ү": "y", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ı": "i", "ɑ": "a", "ɡ": "g", "ɢ": "g",
    "ɩ": "i", "ɪ": "i", "ɴ": "n", "ʀ": "r", "ʏ": "y", "ʙ": "b", "ʜ": "h", "ʟ": "l", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d",
    "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
#: Digits and signs that stand for letters inside a word.
DIGITS = dict(zip("0134578@$!|", "oieastbasil", strict=True))
_LOOKS = str.maketrans(HOMOGLYPHS)
_LEET = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|\b[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+(?!\w)")
#: Combining marks, soft hyphens, zero-width and direction signs.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
_LEET_MAP = str.maketrans(DIGITS)
_GAP = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Words of a text in lower case, homoglyphs and digit substitutions replaced, each after one blank.

    Compatibility forms (full width, ligatures, letter-like signs) become plain letters; marks and unseen signs go.
    """
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_LOOKS)
    text = text.lower()
    text = _LEET.sub(lambda m: m.group().translate(_LEET_MAP), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Word beginnings with weights, phrases that excuse them, and the score of each band of evidence."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bands: tuple[float, ...] = field(default=())
    scores: tuple[float, ...] = field(default=(0.0,))

    def score(self, evidence: float) -> float:
        at = sum(evidence > b for b in self.bands)
        return self.scores[at]


def automaton(lexicon: Lexicon):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for stem, weight in lexicon.weights.items():
        machine.add_word(" " + stem, (len(stem) + 1, weight, False))
    for phrase in lexicon.exceptions:
        machine.add_word(" " + phrase + " ", (len(phrase) + 2, 0.0, True))
    machine.make_automaton()
    return machine


def evidence(text: str, machine) -> float:
    """Sum of the weights of matched stems outside exception phrases, over the logarithm of the text's length."""
    if not len(machine):
        return 0.0
    folded = fold(text)
    hits, excused = [], []
    for end, (length, weight, excuse) in machine.iter(folded):
        (excused if excuse else hits).append((end - length + 1, end, weight))
    excused.sort()
    starts, reach = [a for a, _, _ in excused], list(accumulate((b for _, b, _ in excused), max))
    total = 0.0
    for s, e, w in hits:
        before = bisect_right(starts, s)
        if not before or reach[before - 1] < e:
            total += w
    return total / math.log2(2 + folded.count(" "))


def _training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, each text once."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", F.col(label).alias("_label")
    )
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return (
        docs.select("doc_id", empty_if_null("text").alias("text")).join(known, "doc_id")
        .groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("_label").alias("label"))
        .select("text", "label")
    )


def _counted(counts: Counter, name: str) -> pa.RecordBatch:
    columns = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [name, "toxic", "n"])


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, size: int = 256, exceptions: tuple[str, ...] = ()
) -> Lexicon:
    """A lexicon from the labelled documents outside the held-out fold.

    At most about ``max_rows`` labelled rows are used (a hash of the id picks them), whole texts, each once.
    Candidates are whole words and word beginnings of 4 to 7 letters of the folded texts; their weight is the smoothed
    log odds of toxic against other documents. A candidate stays if it is in at least 3 toxic documents and
    1 % of them and at least 20 times as frequent there; one that only repeats a shorter candidate is left
    out, and the ``size`` most telling ones make the lexicon. Word pairs around a match that only other documents
    have, three at least, become exception phrases, beside the given ``exceptions``. The scores are the
    smoothed share of toxic documents in bands of evidence, made to rise with it. Without toxic rows the
    lexicon is empty and every score 0.
    """

    def candidates(batches):
        for part in (p for batch in batches for p in slices(batch)):
            counts: Counter = Counter()
            for text, toxic in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                words = set(fold(text).split())
                found = {w for w in words if 3 <= len(w) <= 24}
                for n in (4, 5, 6, 7):
                    found.update(w[:n] for w in words if len(w) > n)
                for w in found:
                    counts[w, toxic] += 1
            yield _counted(counts, "stem")

    rows = _training_rows(lean(docs), labels, label, max_rows).persist()
    try:
        sums = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, clean = sums.get(1, 0), sums.get(0, 0)
        if not toxic:
            return Lexicon({})
        table = (
            rows.mapInArrow(candidates, "stem string, toxic int, n bigint").groupBy("stem")
            .agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("c"))
        )
        odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
        least = max(3, math.ceil(0.01 * toxic))
        best = (
            table.where((F.col("t") >= least) & (F.col("t") * clean >= 20 * F.col("c") * toxic)).withColumn("w", odds)
            .where("w > 1").orderBy((F.col("t") * F.col("w")).desc(), F.length("stem"), "stem").limit(8 * size).collect()
        )
        weights: dict[str, float] = {}
        support: dict[str, int] = {}
        for r in best:
            if len(weights) < size and not any(r["stem"].startswith(k) or (k.startswith(r["stem"]) and r["t"] <= support[k]) for k in weights):
                weights[r["stem"]], support[r["stem"]] = r["w"], r["t"]
        plain = Lexicon(weights, exceptions)
        stems = automaton(plain)

        def contexts(batches):
            for part in (p for batch in batches for p in slices(batch)):
                counts: Counter = Counter()
                for text, toxic in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    folded = fold(text)
                    found = set()
                    for end, (length, _, excuse) in stems.iter(folded) if len(stems) else ():
                        if not excuse:
                            start = end - length + 1
                            words = folded[folded.rfind(" ", 0, start) + 1 : start].split()
                            # up to the end of the word after the match
                            here, *after = folded[start : folded.find(" ", folded.find(" ", end + 1) + 1) + 1 or None].split()[:2]
                            found.update({" ".join([*words, here]), " ".join([here, *after])} if words else {" ".join([here, *after])})
                    for phrase in found:
                        counts[phrase, toxic] += 1
                yield _counted(counts, "phrase")

        excuses = (
            rows.mapInArrow(contexts, "phrase string, toxic int, n bigint").groupBy("phrase")
            .agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("c"))
            .where("t = 0 AND c >= 3").orderBy(F.desc("c"), "phrase").limit(size).collect()
        )
        lexicon = Lexicon(weights, (*exceptions, *(r["phrase"] for r in excuses)))
        cuts = tuple(round(0.05 * 2**k, 4) for k in range(8))
        machine = automaton(lexicon)

        def bands(batches):
            for batch in batches:
                values = [sum(x > c for c in (0.0, *cuts)) for x in (evidence(t, machine) for t in batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), batch.column("label").cast(pa.int32())], ["band", "label"])

        shares = rows.mapInArrow(bands, "band int, label int").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).collect()
        by = {r["band"]: (r["n"], r["t"]) for r in shares}
        scores, low, prior = [], 0.0, toxic / (toxic + clean)
        for band in range(len(cuts) + 2):
            n, t = by.get(band, (0, 0))
            low = max(low, (t + 2 * prior) / (n + 2))
            scores.append(low)
        return Lexicon(lexicon.weights, lexicon.exceptions, (0.0, *cuts), tuple(scores))
    finally:
        rows.unpersist()


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every document: 0 to 1, higher is more likely toxic.

    A null text counts as empty and has the score of no evidence. Rows are scored one by one, so null or repeated
    doc_ids stay as they are; only doc_id and text are read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = automaton(lexicon)
        for batch in batches:
            for part in slices(batch):
                scores = [lexicon.score(evidence(text.as_py(), machine)) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return lean(docs).select("doc_id", empty_if_null("text").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with all their columns, whatever their doc_id.

    A null or empty text has the score of no evidence. Rows are judged one by one, so repeated rows go or stay
    together. An empty table gives an empty result.
    """

    def run(batches):
        machine = automaton(lexicon)
        for batch in batches:
            for part in slices(batch):
                keep = [lexicon.score(evidence(text.as_py() or "", machine)) < least for text in part.column("text")]
                yield part.filter(pa.array(keep, pa.bool_()))

    return lean(docs).mapInArrow(run, docs.schema)
