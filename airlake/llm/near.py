"""Classes of near-duplicate texts: colliding bands, exact checks, components of the links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import Scratch, connected_components
from airlake.llm.shingles import similarity

#: Rows of one side of a block when members of a crowded bucket are compared, and members that one copy of a hub serves.
BLOCK = 256


def hub_similarities(members: DataFrame, content: DataFrame) -> DataFrame:
    """(hub, key, sim): the exact similarity of every member (bucket, key, hub, n) to the hub of its bucket, each pair once.

    Members are dealt out in groups of about BLOCK; a hub's shingles are sent once to each group and stay in
    memory while its members stream by.
    """
    pairs = members.where("key <> hub").groupBy("hub", "key").agg(F.max(F.struct("n", "bucket")).alias("m")).select(
        "hub", "m.bucket", F.pmod(F.xxhash64("key", F.lit(3)), F.ceil(F.col("m.n") / BLOCK)).cast("int").alias("part"), "key"
    )
    told = pairs.select(F.col("hub"), "bucket", "part", F.col("hub").alias("key")).distinct()
    rows = pairs.unionByName(told).join(content, "key").select("hub", "bucket", "part", (F.col("key") != F.col("hub")).alias("member"), "key", "shingles")

    def run(batches):
        now, head = None, b""
        for batch in batches:
            hubs, buckets, parts, member, keys = (batch.column(c).to_pylist() for c in ("hub", "bucket", "part", "member", "key"))
            sims, at = [], []
            for i, cell in enumerate(batch.column("shingles")):
                if not member[i]:
                    now, head = (hubs[i], buckets[i], parts[i]), cell.as_py()
                elif now == (hubs[i], buckets[i], parts[i]):
                    at.append(i)
                    sims.append(similarity(head, cell.as_py()))
                else:
                    raise RuntimeError("a hub does not precede its members")
            yield pa.RecordBatch.from_arrays(
                [pa.array([hubs[i] for i in at], pa.binary()), pa.array([keys[i] for i in at], pa.binary()), pa.array(sims, pa.float64())],
                ["hub", "key", "sim"],
            )

    return (
        rows.repartition("hub", "bucket", "part").sortWithinPartitions("hub", "bucket", "part", "member")
        .mapInArrow(run, "hub binary, key binary, sim double")
    )


def _crowded(cells: DataFrame, registers: int, threshold: float) -> DataFrame:
    """(a, b) of links between different components, from queries and members of every block.

    ``cells`` holds (bucket, q, m, query, key, root, sim, sig, buckets, shingles); a block has a bounded number of rows.
    A pair is looked at in the first bucket that it shares. Passed over are pairs that the triangle inequality of the
    Jaccard distance rules out (their similarities to the hub are too different), and pairs whose signatures agree less than
    four standard deviations below the threshold. Of the others, those most alike are counted exactly first, and a pair
    whose components are joined by then is passed over; so a block returns fewer links than it has rows.
    """
    least = threshold - 4 * (threshold * (1 - threshold) / registers) ** 0.5
    apart = 1 - threshold + 1e-9

    def blocks(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            ids = np.stack([table.column(c).to_numpy() for c in ("bucket", "q", "m")], 1)
            cut = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            edges = [0, *cut.tolist()]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                yield table.slice(i, j - i)
            rest = table.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches):
        for table in blocks(batches):
            query = table.column("query").to_numpy(zero_copy_only=False)
            if query.all() or not query.any():
                continue
            keys, roots, sets = (table.column(c).to_pylist() for c in ("key", "root", "shingles"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(keys), registers)
            bands, sims = np.array(table.column("buckets").to_pylist()), table.column("sim").to_numpy()
            band = int(np.flatnonzero(bands[0] == table.column("bucket")[0].as_py())[0])
            root = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
            qs, ms = np.flatnonzero(query), np.flatnonzero(~query)
            pairs = []
            for k in range(0, len(qs), 64):
                part = qs[k : k + 64]
                same = (sig[part][:, None, :] == sig[ms][None, :, :]).mean(2)
                alike = (same - 1 / 256) / (1 - 1 / 256)
                fresh = (bands[part][:, None, :] == bands[ms][None, :, :]).argmax(2) == band
                near = np.abs(sims[part][:, None] - sims[ms][None, :]) <= apart
                i, j = np.nonzero(near & (alike >= least) & fresh & (root[part][:, None] != root[ms][None, :]))
                pairs.append((alike[i, j], part[i], ms[j]))
            alike, left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
            joined = list(range(int(root.max()) + 1))

            def find(x: int, joined=joined) -> int:
                while joined[x] != x:
                    joined[x] = joined[joined[x]]
                    x = joined[x]
                return x

            out, done = [], set()
            for k in np.argsort(-alike, kind="stable").tolist():
                a, b = keys[left[k]], keys[right[k]]
                x, y = find(int(root[left[k]])), find(int(root[right[k]]))
                if x != y and (min(a, b), max(a, b)) not in done:
                    done.add((min(a, b), max(a, b)))
                    if similarity(sets[left[k]], sets[right[k]]) >= threshold:
                        joined[x] = y
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return (
        cells.repartition("bucket", "q", "m").sortWithinPartitions("bucket", "q", "m")
        .mapInArrow(run, "a binary, b binary")
    )


def near_classes(
    nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float, registers: int, scratch: Scratch
) -> DataFrame:
    """(key, root) of every node that is linked to another one.

    ``nodes`` has one row per distinct text: key binary, mult long (its copies), buckets array<long>,
    sig binary (one byte per register). ``fetch`` turns a table of keys into (key, shingles).

    1. In every bucket of several nodes, the node with most copies is the hub; the others are compared
       with it. This takes one pair for each member, however large the bucket is, and joins most of a
       group of near copies at once.
    2. A bucket is still open if it holds loose members, whose component is not the hub's. They are compared with each
       other and, where one of them is within twice the distance of a link to the hub, with the hub's
       followers (the triangle inequality excludes the rest), in blocks of bounded size (``_crowded``). A link that
       joins two components is not missed for its bucket's size.
    """
    order = F.shiftleft(F.least("mult", F.lit(1 << 30)), 32) + F.pmod(F.xxhash64("key"), F.lit(1 << 32))
    rows = nodes.select("key", "mult", F.explode("buckets").alias("bucket"))
    # Most buckets hold one node: counts, which need no sort, leave them out before hubs are sought.
    # Grouped tables are written before a join on their group: its partitions can then be split where one bucket is large.
    often = scratch.keep(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = scratch.keep(rows.join(often, "bucket"))
    scratch.sweep()
    heads = scratch.keep(shared.groupBy("bucket").agg(F.max_by("key", order).alias("hub")))
    members = scratch.keep(shared.join(heads, "bucket").select("bucket", "key", "hub", "n"))
    scratch.drop(often, shared, heads)
    content = scratch.keep(fetch(members.select("key").distinct()))
    scratch.sweep()
    compared = scratch.keep(hub_similarities(members, content))
    links = compared.where(F.col("sim") >= threshold).select(F.col("hub").alias("a"), F.col("key").alias("b"))
    first = scratch.keep(connected_components(links, scratch))

    judged = (
        compared.join(first.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        .join(first.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
        .select("hub", "key", "sim", "root", (F.col("root") != F.coalesce("hub_root", "hub")).alias("query"))
    )
    rooted = scratch.keep(members.where("n > 2 AND key <> hub").join(judged, ["hub", "key"]).select("bucket", "key", "sim", "root", "query"))
    spread = scratch.keep(
        rooted.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("loose"), F.max(F.when(F.col("query"), F.col("sim"))).alias("top"))
        .withColumn("wide", F.col("top") >= 2 * threshold - 1 - 1e-9)
        .where("loose > 1 OR loose = 1 AND wide AND n > 1")
        .select(
            "bucket", "wide", F.ceil(F.col("loose") / BLOCK).cast("int").alias("nq"),
            F.ceil(F.when(F.col("wide"), F.col("n")).otherwise(F.col("loose")) / BLOCK).cast("int").alias("nm"),
        )
    )
    open_rows = rooted.join(spread, "bucket").where("query OR wide").join(nodes.select("key", "sig", "buckets"), "key").join(content, "key")
    deal = F.xxhash64("key", F.lit(7))
    facts = ["key", "root", "sim", "sig", "buckets", "shingles"]
    queries = open_rows.where("query").select(
        "bucket", F.pmod(deal, "nq").cast("int").alias("q"),
        F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), "query", *facts,
    )
    others = open_rows.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"),
        F.pmod(deal, "nm").cast("int").alias("m"), F.lit(False).alias("query"), *facts,
    )
    more_links = scratch.keep(_crowded(queries.unionByName(others), registers, threshold))
    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more_links)
    classes = scratch.keep(connected_components(edges, scratch))
    scratch.drop(members, content, compared, first, rooted, spread, more_links)
    return classes.withColumnRenamed("node", "key")
