"""Sharding by a k-d tree over metadata: leaves of nearly equal bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.llm.common import Scratch, empty_if_null
from airlake.operators.selection import narrow, sortable

#: Bytes of a string that count in its dimension, after what all strings share at their start.
LEAD = 7


def _dimensions(docs: DataFrame, names: list[str]) -> list[Column]:
    """Each dimension as a long of the same order; nulls count as -1."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    strings = [c for c in names if kinds[c] == "string"]
    ends = docs.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in strings for f in (F.min, F.max)]).first() if strings else {}
    out = []
    for c in names:
        if kinds[c] == "string":
            low, high = ((ends[f"{f}_{c}"] or "").encode() for f in ("min", "max"))
            shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            lead = F.rpad(F.substring(F.hex(F.encode(c, "utf-8")), 2 * shared + 1, 2 * LEAD), 2 * LEAD, "0")
            out.append(F.coalesce(F.conv(lead, 16, 10).cast("long"), F.lit(-1)))
        elif kinds[c] in ("double", "float"):
            out.append(sortable(F.coalesce(F.nanvl(c, F.lit(None)), F.lit(-1.0))))
        else:
            out.append(F.coalesce(F.col(c).cast("long"), F.lit(-1)))
    return out


def _spans(rows: DataFrame, n: int) -> dict[int, tuple[int, list[int]]]:
    """node -> (bytes, extent of each dimension)."""
    ends = [f(F.get("d", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(n) for f in (F.min, F.max)]
    return {r["node"]: (r["w"], [r[f"max{i}"] - r[f"min{i}"] for i in range(n)]) for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}


def _at_weight(rows: DataFrame, wanted: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """node -> (key, weight before it, weight at it) where the running weight by _key passes ``wanted``."""
    spark, done = rows.sparkSession, {}
    ends = rows.groupBy("node").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"), F.sum("_w").alias("_at"))
    found = [{**r.asDict(), "_below": 0} for r in ends.collect()]
    while True:
        done |= {r["node"]: (r["_lo"], r["_below"], r["_at"]) for r in found if r["_lo"] == r["_hi"]}
        state = [(r["node"], 0, wanted[r["node"]], r["_lo"], r["_hi"], r["_below"]) for r in found if r["_lo"] != r["_hi"]]
        if not state:
            return done
        # a row for each node, fewer than shards
        asked = F.broadcast(spark.createDataFrame(state, "node long, _want int, _t long, _lo long, _hi long, _below long"))
        found = [r.asDict() for r in narrow(rows, asked, ["node"]).collect()]


def _medians(rows: DataFrame, wanted: dict[int, int]) -> dict[int, tuple[list[int], int, int]]:
    """node -> (keys of the row in which the running size by ``keys`` passes ``wanted``, size before it, its own size).

    Rows that are equal in the first key are told apart by the next one; the last one has no ties.
    """
    found: dict[int, tuple[list[int], int, int]] = {n: ([], 0, 0) for n in wanted}
    for k in range(3):
        near = rows.sparkSession.createDataFrame([(n, (keys + [0, 0])[:2]) for n, (keys, _, _) in found.items()], "node long, near array<long>")
        ties = rows.join(F.broadcast(near), "node").where(F.slice("keys", 1, k) == F.slice("near", 1, k)) if k else rows
        weighed = ties.select("node", F.get("keys", F.lit(k)).alias("_key"), F.col("size").alias("_w"), F.lit(None).cast("double").alias("_value"))
        for n, (key, below, at) in _at_weight(weighed, {n: wanted[n] - found[n][1] for n in wanted}).items():
            found[n] = ([*found[n][0], key], found[n][1] + below, at)
    return found


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Column slot: the number of a row in its shard, by order and row, from 0 on. Ranges of rows are numbered apart and moved behind each other."""

    def run(batches):
        last, count = None, 0
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            if not len(shard):
                continue
            start = np.r_[True, shard[1:] != shard[:-1]]
            at = np.arange(len(shard)) - np.maximum.accumulate(np.where(start, np.arange(len(shard)), 0))
            if shard[0] == last:
                first = np.flatnonzero(start)[1] if start.sum() > 1 else len(shard)
                at[:first] += count
            last, count = shard[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    dealt = rows.repartitionByRange("shard", "order", "row").sortWithinPartitions("shard", "order", "row")
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("part"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    counted = scratch.keep(dealt.mapInArrow(run, schema + ", at bigint"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = scratch.keep(parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return counted.join(offset, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("offset")).alias("slot"))


def kd_shards(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = ("source", "lang", "size", "doc_id"), target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot. Shards are the leaves of a k-d tree, numbered from 0 in its order.

    size is the text's length in UTF-8 and 1 more; a null text has no bytes and the checksum of an empty one. ``target_bytes``, where given, sets the number
    of shards: one for each of these bytes that the table has. A node of k shards is split along its widest dimension, in which its rows span the largest
    share of what all rows span (ties: the first one), at the weighted median: the bytes before it are floor(k/2) of k parts. Rows that are equal in that dimension follow by doc_id (an integer), then by place in the table, so a
    hot source, a group of copies or a repeated row is cut as finely as others; the row on the boundary goes where the larger part of it lies. So each cut misses its share by
    half a document at most. ``dimensions`` are columns, or size; strings count by 7 bytes after what they have in common, nulls as -1. slot numbers the rows of a shard by
    doc_id, nulls first, then by place. An empty table gives an empty result; if rows are fewer than shards, some of these stay empty.

    Texts are read once. No row moves to find a cut: tasks add up bytes by leading bits of the key, for all nodes of a level at once, in a few scans of narrow rows, and the driver holds
    a few numbers for each node. Rows are dealt out by ranges once, to number them.
    """
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    sized = docs.withColumn("size", F.octet_length(empty_if_null("text")).cast("long") + 1)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = scratch.keep(
        sized.select(
            "doc_id", "size", F.crc32(empty_if_null("text").cast("binary")).alias("text_crc32"), F.array(*_dimensions(sized, list(dimensions))).alias("d"),
            order.alias("order"), F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("node"),
        )
    )
    whole, extents = _spans(rows, len(dimensions)).get(0, (0, [0] * len(dimensions)))
    if target_bytes:
        shards = max(1, -(-whole // target_bytes))
    leaves = {0: (0, shards)}  # node -> (first shard, number of shards)
    while parted := {n: x for n, x in leaves.items() if x[1] > 1}:
        spans = {n: x for n, x in _spans(rows, len(dimensions)).items() if n in parted}
        axis = {n: max(range(len(dimensions)), key=lambda i: (s[i] / max(1, extents[i]), -i)) for n, (_, s) in spans.items()}
        axes = F.broadcast(spark.createDataFrame(list(axis.items()), "node long, axis int"))
        keyed = rows.join(axes, "node").select("node", "size", F.array(F.get("d", F.col("axis")), "order", "row").alias("keys"))
        medians = _medians(keyed, {n: w * (parted[n][1] // 2) // parted[n][1] for n, (w, _) in spans.items()}) if spans else {}
        cuts = []
        for n, (keys, before, at) in medians.items():
            k, w = parted[n][1], spans[n][0]
            cuts.append((n, axis[n], keys, (2 * before + at) * k < 2 * w * (k // 2)))
        marks = F.broadcast(spark.createDataFrame(cuts, "node long, axis int, cut array<long>, into boolean"))
        keys = F.array(F.get("d", F.col("axis")), "order", "row")
        first = (keys < F.col("cut")) | ((keys == F.col("cut")) & F.col("into"))
        moved = scratch.keep(
            rows.join(marks, "node", "left")
            .withColumn("node", F.when(F.col("axis").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(first, 1).otherwise(2))).select(*rows.columns)
        )
        scratch.drop(rows)
        rows = moved
        for n, (start, k) in parted.items():
            del leaves[n]
            leaves[2 * n + 1], leaves[2 * n + 2] = (start, k // 2), (start + k // 2, k - k // 2)
    shard = F.broadcast(spark.createDataFrame([(n, s) for n, (s, _) in leaves.items()], "node long, shard int"))
    return _numbered(rows.join(shard, "node").select("doc_id", "size", "text_crc32", "order", "row", "shard"), scratch)
