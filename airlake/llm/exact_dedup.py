"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import Scratch, empty_if_null

#: The white space that normalisation deletes.
SPACE = " \t\n\x0b\f\r"

_BEST = "struct(-n AS n, doc_id IS NULL AS no_id, doc_id, row)"


def normal_text(text: str | Column = "text") -> Column:
    return F.translate(empty_if_null(text), SPACE, "")


def digest_runs(docs: DataFrame) -> DataFrame:
    """(run, row, doc_id, digest, check, n): one row per document; a run is a partition of the input.

    ``check`` is a second hash with the normalised length: two digests are merged only where it agrees, too.
    """
    return docs.select(
        "doc_id", normal_text().alias("plain"), F.char_length(empty_if_null("text")).cast("long").alias("n")
    ).select(
        F.spark_partition_id().cast("long").alias("run"),
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.xxhash64("plain", F.octet_length("plain")).alias("check"),
        "n",
    )


def exact_groups(docs: DataFrame, fan_in: int = 8) -> tuple[DataFrame, DataFrame]:
    """(table of documents with their run, table of winners per run), see ``exact_dedup``."""
    scratch = Scratch(docs.sparkSession)
    leaves = scratch.keep(digest_runs(docs))
    merged = leaves.groupBy("run", "digest", "check").agg(
        F.min(F.expr(_BEST)).alias("best"), F.count(F.lit(1)).alias("size")
    )
    levels = [scratch.keep(merged)]
    runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        merged = levels[-1].groupBy(F.floor(F.col("run") / fan_in).alias("run"), "digest", "check").agg(
            F.min("best").alias("best"), F.sum("size").alias("size")
        )
        levels.append(scratch.keep(merged))
        runs = -(-runs // fan_in)
    # Back down the tree: a run learns its winners from the one run it was merged into, so no digest,
    # however frequent, meets more than fan_in rows of any level.
    known = levels.pop()
    while levels:
        below = levels.pop()
        here = below.select("run", "digest", "check", F.floor(F.col("run") / fan_in).alias("up"))
        told = known.select(F.col("run").alias("up"), "digest", "check", "best", "size")
        after = scratch.keep(here.join(told, ["up", "digest", "check"]).drop("up"))
        scratch.drop(known, below)
        known = after
    return leaves, known


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]; a null text counts
    as empty, and empty texts are equal. The longest original stays (code points), then the smallest
    doc_id; a null id comes after all others. Of rows that repeat both, exactly one stays. An empty
    table gives an empty result; further columns are not read.

    Each partition sorts its digests into a run. Runs are exchanged in binomial rounds of radix
    ``fan_in``: run r goes to run r // fan_in, which merges its sorted runs and keeps, for every digest whose
    check agrees, the best row and the number of rows (Spark sorts both sides of such a grouping and merges
    them in order). A hot digest is one row of each run from the first level on. Winners then travel
    the same way back. Every level is a table, so a lost executor repeats one merge.
    """
    leaves, winners = exact_groups(docs, fan_in)
    return leaves.join(winners, ["run", "digest", "check"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    A row is found again by its id, digest and length; rows that repeat all three leave one.
    """
    leaves, winners = exact_groups(docs, fan_in)
    best = leaves.join(winners, ["run", "digest", "check"]).where(F.col("row") == F.col("best.row"))
    best = best.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("n").alias("_n"))
    twice = (
        leaves.groupBy("doc_id", "digest", "n").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
        .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("n").alias("_n"), F.lit(True).alias("_twice"))
    )
    keys = ["_id", "_digest", "_n"]
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]
    best = (
        best.alias("_l").join(twice.alias("_r"), same, "left")
        .select(*[F.col(f"_l.{c}").alias(c) for c in keys], F.coalesce("_twice", F.lit(False)).alias("_twice"))
    )
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("doc_id").alias("_id"),
        F.unhex(F.sha2(normal_text(), 256)).alias("_digest"),
        F.char_length(empty_if_null("text")).cast("long").alias("_n"),
    )
    found = marked.alias("_l").join(best.alias("_r"), same).select(
        "_l._doc", *[F.col(f"_l.{c}").alias(c) for c in keys], "_twice"
    )
    once = found.where("NOT _twice").select("_doc")
    many = found.where("_twice").groupBy(*keys).agg(F.first("_doc").alias("_doc")).select("_doc")
    return once.unionByName(many).select("_doc.*")
