"""Near-duplicate vectors: an exact range join by angle over pivot cells."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import Scratch, connected_components

#: Vectors on one side of a block.
BLOCK = 4096


def _keys(vectors: DataFrame, single: bool) -> DataFrame:
    """(vec_id, key, vec): vec holds the components as bytes, null where a vector links with nothing."""
    dtype = np.dtype("<f4" if single else "<f8")
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("embedding"):
                row = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) if x.is_valid else np.zeros(0)
                top = np.abs(row).max() if len(row) else 0.0  # NaN if any component is
                if not 0 < top < math.inf:
                    out.append(None)
                    continue
                if not 1e-100 < top < 1e100:
                    # squares would leave the range of doubles; a power of two leaves the direction as it is
                    row = np.ldexp(row, -np.frexp(top)[1])
                out.append(row.astype(dtype).tobytes())
            keys = [None if v is None else hashlib.md5(v).digest() for v in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "key", "vec"]
            )

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, key binary, vec binary")


def _unit_rows(cells: list[bytes], dtype) -> np.ndarray:
    rows = np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1).astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _link_block(table: pa.Table, dtype, least: float) -> pa.Table:
    """(key, n, peer) of one block: linked copies on the other side, and the local component's first key."""
    keys, mult = table.column("key").to_pylist(), table.column("mult").to_numpy()
    side, same = table.column("side").to_numpy(), table.column("same")[0].as_py()
    rows = _unit_rows(table.column("vec").to_pylist(), dtype)
    left = np.arange(len(keys)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    count, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for k in range(0, len(left), 512):
        part = left[k : k + 512]
        hit = rows[part] @ rows[right].T >= least
        if same:
            hit[np.arange(len(part)), np.arange(k, k + len(part))] = False
        count[part] += hit @ mult[right]
        if not same:
            count[right] += mult[part] @ hit
        i, j = np.nonzero(hit)
        i, j = part[i], right[j]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    found = np.flatnonzero(count)
    return pa.table(
        {
            "key": pa.array([keys[f] for f in found], pa.binary()),
            "n": pa.array(count[found], pa.int64()),
            "peer": pa.array([keys[root[f]] for f in found], pa.binary()),
        }
    )


def embedding_links(vectors: DataFrame, least: float = 0.9, per_cell: int = 8000, max_pivots: int = 1024) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked when the cosine of their components, in double precision, is ``least`` or more.
    n_links counts the other vectors linked directly, copies included; component_id is the smallest vec_id in
    reach. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths or rows whose vec_id is null. Rows that repeat a
    vec_id are vectors of their own. An empty table gives an empty result; further columns are not read.

    Identical vectors are one node. A hash-ordered sample of nodes, one for every ``per_cell`` and at most
    ``max_pivots``, serves as pivots; a node lives in the cell of the pivot at the least angle. Angles are a metric, so
    a partner of x within r of it can only live in cell q if angle(x, q) <= angle(x, own pivot) + 2r and
    min_q - r <= angle(x, q) <= max_q + r, with the least and largest angle in q; x visits these cells (those
    of a higher number than its own, which is enough as links are mutual). Cells are joined
    independently, in blocks of bounded size, which return a count and one link for each vector and no pairs.
    """
    scratch = Scratch(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    dtype, reach = np.dtype("<f4" if single else "<f8"), math.acos(least) + 1e-9
    table = scratch.keep(_keys(vectors, single))
    usable = table.where("key IS NOT NULL AND vec_id IS NOT NULL")
    nodes = scratch.keep(
        usable.groupBy("key").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("rep"), F.first("vec").alias("vec"))
    )
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("key"), "key").limit(min(max_pivots, -(-total // per_cell))).select("vec").collect()
    pivots: dict[int, list] = {}
    for number, row in enumerate(sample):
        pivots.setdefault(len(row["vec"]), []).append((number, bytes(row["vec"])))
    pivot_rows = {size: ([n for n, _ in p], _unit_rows([v for _, v in p], dtype)) for size, p in pivots.items()}

    def settle(batches):
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            cell, angle = np.zeros(len(vecs), np.int64), np.zeros(len(vecs))
            sizes = np.array([len(v) for v in vecs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size in pivot_rows:
                    numbers, rows = pivot_rows[size]
                    apart = _angles(_unit_rows([vecs[i] for i in at], dtype), rows)
                    best = apart.argmin(1)
                    cell[at], angle[at] = np.array(numbers)[best], apart[np.arange(len(at)), best]
                else:
                    cell[at] = -size
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("mult"), batch.column("vec"), pa.array(cell), pa.array(angle)],
                ["key", "mult", "vec", "cell", "angle"],
            )

    homes = scratch.keep(
        nodes.select("key", "mult", "vec").mapInArrow(settle, "key binary, mult bigint, vec binary, cell bigint, angle double")
    )
    rings = homes.groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count(F.lit(1)).alias("k"))
    ring = {r["cell"]: (r["near"], r["far"]) for r in rings.where("cell >= 0").collect()}  # max_pivots rows at most

    def visit(batches):
        for batch in batches:
            vecs, cells = batch.column("vec").to_pylist(), batch.column("cell").to_numpy()
            angles = batch.column("angle").to_numpy()
            sizes, rows_at, cells_at = np.array([len(v) for v in vecs]), [], []
            for size in np.unique(sizes):
                if size not in pivot_rows:
                    continue
                at = np.flatnonzero(sizes == size)
                numbers, rows = pivot_rows[size]
                low, high = (np.array([ring.get(n, (9.0, -9.0))[k] for n in numbers]) for k in (0, 1))
                apart = _angles(_unit_rows([vecs[i] for i in at], dtype), rows)
                go = (
                    (apart <= angles[at][:, None] + 2 * reach) & (apart <= high + reach) & (apart >= low - reach)
                    & (np.array(numbers) > cells[at][:, None])
                )
                i, j = np.nonzero(go)
                rows_at.append(at[i])
                cells_at.append(np.array(numbers)[j])
            if rows_at:
                take = pa.array(np.concatenate(rows_at))
                for k in range(0, len(take), 20_000):
                    part = batch.take(take[k : k + 20_000])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key"), part.column("mult"), part.column("vec"), pa.array(np.concatenate(cells_at)[k : k + 20_000])],
                        ["key", "mult", "vec", "cell"],
                    )

    visitors = homes.mapInArrow(visit, "key binary, mult bigint, vec binary, cell bigint")
    sized = rings.select("cell", F.ceil(F.col("k") / BLOCK).cast("int").alias("b"))
    own = F.pmod(F.xxhash64("key"), "b").cast("int")
    lived = homes.join(sized, "cell").select("cell", "key", "mult", "vec", "b", own.alias("o"))
    until = F.sequence(F.lit(0), F.col("b") - 1)
    # (i, j): block i of the cell's own vectors against its block j > i, itself (i), or a block of visitors (-1 - j)
    twins = lived.select("cell", F.col("o").alias("i"), F.col("o").alias("j"), F.lit(0).alias("side"), F.lit(True).alias("same"), "key", "mult", "vec")
    across = lived.withColumn("p", F.explode(until)).where("p <> o").select(
        "cell", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), (F.col("o") > F.col("p")).cast("int").alias("side"),
        F.lit(False).alias("same"), "key", "mult", "vec",
    )
    groups = scratch.keep(visitors)
    crowd = groups.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("v"))
    guest = (
        groups.join(sized, "cell").join(crowd, "cell").withColumn("i", F.explode(until))
        .select("cell", "i", (-1 - F.pmod(F.xxhash64("key"), "v")).cast("int").alias("j"), F.lit(1).alias("side"), F.lit(False).alias("same"), "key", "mult", "vec")
    )
    host = (
        lived.join(crowd, "cell").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("v") - 1)))
        .select("cell", F.col("o").alias("i"), (-1 - F.col("q")).cast("int").alias("j"), F.lit(0).alias("side"), F.lit(False).alias("same"), "key", "mult", "vec")
    )
    cells = twins.unionByName(across).unionByName(guest).unionByName(host)
    found = scratch.keep(
        cells.groupBy("cell", "i", "j").applyInArrow(lambda t: _link_block(t, dtype, least), "key binary, n bigint, peer binary")
    )
    scratch.drop(groups, homes)
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("peer").alias("b")), scratch)
    member = (
        nodes.select("key", "mult", "rep").join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "mult", "rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "key").alias("root"))
    )
    member = scratch.keep(member)
    named = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    lookup = scratch.keep(member.join(named, "root").select("key", (F.col("n") + F.col("mult") - 1).alias("n_links"), "component_id"))
    linked = usable.select("vec_id", "key").join(lookup, "key").select("vec_id", "n_links", "component_id")
    alone = table.where("key IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
