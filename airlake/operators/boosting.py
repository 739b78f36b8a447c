"""Boosted trees of many fits over one table, grown side by side: the jobs of a round serve every fit.

A fit by itself needs five short jobs a round, whose start outweighs their work on tables of some thousand rows. Here rows lie in blocks of bounded size, once for
every fit, as numbers of bins; tasks sum up histograms of blocks, Spark adds those of a fit together, and the driver learns a split for each node, no
rows: a job for each level, or one for the tree where the table is a single block. Trees are boosted as Spark ML does it: the first on the labels, further ones on twice the
residual, weighted by the step; a share of the rows for each tree, of the features for each node.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions import scalars as X
from airlake.sources.shared import file_system, shared_folder, staged

DEPTH, BINS, STEP = 5, 32, 0.05
#: Rounds after which the state is written and read again, so that no plan grows with the rounds; finished fits leave it then.
KEEP = 20
SIDES = {"train": 0, "val": 1, "test": 2}
PACKED = "fit int, block int, data binary"


class Tree(NamedTuple):
    """Nodes as in a heap; ``bins`` is -1 at leaves, ``means`` those of the training rows."""

    features: np.ndarray
    bins: np.ndarray
    means: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(x: np.ndarray, *salts: int) -> np.ndarray:
    """Pseudorandom numbers of the values and salts, the same in every task."""
    for salt in salts:
        x = _mix(x + np.array([(salt + 1) % 2**64], "uint64") * np.uint64(0x9E3779B97F4A7C15))
    return x


def _places(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row has reached in a tree that may still grow."""
    at, rows = np.zeros(len(bins), "int64"), np.arange(len(bins))
    for _ in range(DEPTH):
        cut = tree.bins[at]
        if (cut < 0).all():
            break
        right = bins[rows, tree.features[at]] > cut
        at = np.where(cut < 0, at, 2 * at + 1 + right)
    return at


def _carved(table: DataFrame, sides: list[tuple[Column, int]], share: float = 0.1) -> DataFrame:
    """station_id and _val, the numbers of the sides for which ``dataset.val_carveout`` takes it, from sides with two training stations or more."""
    trained = table.groupBy("station_id").agg(*[F.max((side == "train").cast("int")).alias(f"_t{k}") for k, (side, _) in enumerate(sides)])
    entry = [F.when(F.col(f"_t{k}") == 1, F.struct(F.lit(k).alias("k"), X.draw(seed, "station_id").alias("draw"))) for k, (_, seed) in enumerate(sides)]
    long = trained.select("station_id", F.explode(F.array(*entry)).alias("e")).where("e IS NOT NULL").select("station_id", "e.k", "e.draw")
    n, rank = F.count(F.lit(1)).over(Window.partitionBy("k")), F.row_number().over(Window.partitionBy("k").orderBy("draw"))
    chosen = long.withColumn("_n", n).withColumn("_rank", rank).where((F.col("_n") > 1) & (F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))))
    return chosen.groupBy("station_id").agg(F.collect_set("k").alias("_val"))


def _thresholds(table: DataFrame, column: str, sides: list[int]) -> dict[tuple[str, int], list[np.ndarray]]:
    """(column, side) -> upper bounds of each feature's bins but the last: quantiles of the training rows."""
    marks = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    long = table.select(*[f"_s{k}" for k in sides], F.posexplode(column).alias("pos", "x"))
    found = long.groupBy("pos").agg(*[F.percentile_approx(F.when(F.col(f"_s{k}") == 0, F.col("x")), marks).alias(f"q{k}") for k in sides]).orderBy("pos").collect()
    clean = [[np.unique([v for v in r[f"q{k}"] or [] if v == v]) for r in found] for k in sides]
    return {(column, k): bounds for k, bounds in zip(sides, clean, strict=True)}


def _blocks(table: DataFrame, keys: list[str], fits: list[tuple[str, int, int]], bounds: dict, blocks: int) -> DataFrame:
    """The rows of each block for each fit, those of training first, in the order of their hash."""
    columns = list(dict.fromkeys(f[0] for f in fits))

    def pack(batches):
        import pandas as pd
        from pyspark import TaskContext

        parts = list(batches)
        if not sum(map(len, parts)):
            return
        rows = pd.concat(parts).sort_values("_id", kind="stable")
        ids, y = rows["_id"].to_numpy().astype("int64").view("uint64"), rows["pm25"].to_numpy("float64")
        values = {c: np.stack(rows[c].to_list()).astype("float64") for c in columns}
        found, data = {}, []
        for column, side, seed in fits:
            if (column, side) not in found:
                cuts = bounds[column, side]
                found[column, side] = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, values[column].T, strict=True)], 1).astype("uint8")
            sides = rows[f"_s{side}"].to_numpy()
            order = np.concatenate([np.flatnonzero(sides == s) for s in SIDES.values()])
            sizes = [int((sides == s).sum()) for s in SIDES.values()]
            tested = rows.iloc[np.flatnonzero(sides == SIDES["test"])]
            names = pickle.dumps([tested[k].tolist() for k in keys])
            zero = np.zeros(len(order))
            data.append(pickle.dumps((found[column, side][order], y[order], ids[order], sizes, seed, names, zero, zero)))
        yield pd.DataFrame({"fit": range(len(fits)), "block": TaskContext.get().partitionId(), "data": data})

    used = sorted({f[1] for f in fits})
    dealt = table.select(*keys, "pm25", "_id", *[f"_s{k}" for k in used], *columns).repartition(blocks, "_id")
    return dealt.mapInPandas(pack, PACKED)


def _state(rows: DataFrame, width: list[int], parts: int) -> RDD:
    """((fit, block), its rows); fits with many features are dealt out first, so that tasks are alike."""
    at = {fit: k for k, fit in enumerate(sorted(range(len(width)), key=lambda fit: -width[fit]))}
    keyed = rows.rdd.map(lambda r: ((r["fit"], r["block"]), bytes(r["data"])))
    return keyed.partitionBy(parts, lambda key: (at[key[0]] + key[1]) % parts).mapValues(pickle.loads).persist(StorageLevel.MEMORY_AND_DISK)


def _grown(first: bool, trees, improved: set[int]) -> Callable:
    """Adds the last tree of a fit to its rows' predictions; those that were the best so far are kept."""

    def run(item):
        (fit, block), (bins, y, ids, sizes, seed, names, score, best) = item
        tree = trees.value.get(fit)
        if tree is None:
            return item
        best = score if fit in improved else best
        score = score + (1.0 if first else STEP) * tree.means[_places(tree, bins)]
        return (fit, block), (bins, y, ids, sizes, seed, names, score, best)

    return run


def _empty() -> Tree:
    n = 2 ** (DEPTH + 1) - 1
    return Tree(np.zeros(n, "int32"), np.full(n, -1, "int16"), np.zeros(n))


def _extend(tree: Tree, level: int, feature, cut, left, right, mean) -> bool:
    """Adds a level's splits; whether there were any."""
    if level == 0:
        tree.means[0] = mean[0]
    split = np.flatnonzero(cut >= 0)
    node = 2**level - 1 + split
    tree.features[node], tree.bins[node] = feature[split], cut[split]
    tree.means[2 * node + 1], tree.means[2 * node + 2] = left[split], right[split]
    return len(split) > 0


def _sums(rows: tuple, tree: Tree, number: int, level: int, share: float) -> np.ndarray:
    """Counts and sums of a block's rows by node of a level, feature and bin."""
    bins, y, ids, sizes, seed, _, score, _ = rows
    n, d, low, nodes = sizes[0], bins.shape[1], 2**level - 1, 2**level
    bag = np.flatnonzero(_drawn(ids[:n], seed, number) <= np.uint64(min(int(share * 2**64), 2**64 - 1)))
    at = _places(tree, bins[bag]) - low
    bag, at = bag[at >= 0], at[at >= 0]
    goal = y[bag] if number == 0 else 2 * (y[bag] - score[bag])
    cells, size = ((at[:, None] * d + np.arange(d)) * BINS + bins[bag]).ravel(), nodes * d * BINS
    return np.stack([np.bincount(cells, minlength=size), np.bincount(cells, np.repeat(goal, d), size)]).reshape(2, nodes, d, BINS)


def _error(rows: tuple) -> np.ndarray:
    """Squared errors and number of a block's validation rows."""
    _, y, _, sizes, _, _, score, _ = rows
    held = slice(sizes[0], sizes[0] + sizes[1])
    return np.array([((y[held] - score[held]) ** 2).sum(), sizes[1]])


def _splits(sums: np.ndarray, seed: int, number: int, level: int, share: float) -> tuple:
    """Feature, bin (-1: a leaf), mean left and mean right of each node, mean of each node: the split that lowers the squared deviations most."""
    nodes, d = sums.shape[1:3]
    left = sums.cumsum(3)
    whole = left[:, :, :, -1:]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
        means = np.stack([left[1] / left[0], right[1] / right[0]])
        mean = np.nan_to_num(whole[1, :, 0, 0] / whole[0, :, 0, 0])
    gain[~((left[0] > 0) & (right[0] > 0))] = 0
    # A node considers a share of the features, at least one.
    name = np.arange(2**level - 1, 2**level - 1 + nodes, dtype="uint64")[:, None] * np.uint64(2**32) + np.arange(d, dtype="uint64")
    rank = _drawn(name, seed, number, 1).argsort(1, kind="stable").argsort(1, kind="stable")
    gain[rank >= -(-d * share // 1)] = 0
    flat = gain.reshape(nodes, -1)
    best, rows = flat.argmax(1), np.arange(nodes)
    cut = np.where(flat[rows, best] > 0, best % BINS, -1)
    sides = means.reshape(2, nodes, -1)[:, rows, best]
    return best // BINS, cut, sides[0], sides[1], mean


def _level(state: RDD, trees: dict[int, Tree], seeds: list[int], number: int, level: int, share: float, parts: int) -> dict[int, tuple]:
    """fit -> (splits of a level, errors before the tree): blocks' histograms are added by Spark."""

    def sums(items):
        for (fit, _), rows in items:
            if fit in trees:
                yield fit, (_sums(rows, trees[fit], number, level, share), _error(rows))

    added = state.mapPartitions(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), parts)
    return dict(added.map(lambda item: (item[0], (_splits(item[1][0], seeds[item[0]], number, level, share), item[1][1]))).collect())


def _whole(state: RDD, fits: set[int], seeds: list[int], number: int, share: float) -> dict[int, tuple]:
    """fit -> (tree, errors before it) where a fit's rows are one block, whose histograms need nothing added."""

    def grow(items):
        for (fit, _), rows in items:
            if fit in fits:
                tree = _empty()
                for level in range(DEPTH):
                    if not _extend(tree, level, *_splits(_sums(rows, tree, number, level, share), seeds[fit], number, level, share)):
                        break
                yield fit, (tree, _error(rows))

    return dict(state.mapPartitions(grow).collect())


def _tested(last: bool) -> Callable:
    """The test rows of a block with the predictions of the last tree or of the best number of them."""

    def run(item):
        _, y, _, sizes, _, names, score, best = item[1]
        start = sizes[0] + sizes[1]
        chosen = score if last else best
        return list(zip(*pickle.loads(names), y[start:].tolist(), chosen[start:].tolist(), strict=True))

    return run


def boost(
    table: DataFrame, keys: list[str], sides: list[tuple[Column, int]], fits: list[tuple[str, int]], done: Callable[[int, DataFrame], None],
    rounds: int = 2000, stale: int = 100, share: float = 0.8, blocks: int = 1, root: str | None = None, parallel: int = 8,
) -> list[int]:
    """Boosts every fit on the labelled rows and returns the fits' numbers of trees.

    ``sides`` has a column that says train, test or null for a row, and a seed; a fit is the name of an array column of features and the number of a side. ``done``
    gets a fit's number and its test rows (``keys``, y_true, y_pred; to be read before it returns) soon after it has ended: after ``rounds`` trees, or once ``stale`` of them have brought no
    lower squared error on a tenth of its training stations; predictions are then those of the best number. With one training station nothing is
    carved out, and all rounds count. ``blocks`` is the number of parts that the rows are cut into.
    """
    spark, context = table.sparkSession, table.sparkSession.sparkContext
    root = root or shared_folder(spark, "boosting")
    marks = []
    for k, (side, _) in enumerate(sides):
        held = F.coalesce(F.array_contains("_val", k), F.lit(False))
        marks.append(F.when(side == "train", F.when(held, SIDES["val"]).otherwise(SIDES["train"])).when(side == "test", SIDES["test"]).otherwise(-1).cast("int").alias(f"_s{k}"))
    columns = list(dict.fromkeys(column for column, _ in fits))
    marked = table.join(_carved(table, sides), "station_id", "left").select(*keys, "pm25", F.xxhash64(*keys).alias("_id"), *columns, *marks)
    marked = staged(marked, f"{root}/marked")
    bounds = {}
    for column in columns:
        bounds |= _thresholds(marked, column, sorted({side for c, side in fits if c == column}))
    width, seeds = [len(bounds[fit]) for fit in fits], [sides[side][1] for _, side in fits]
    parts = min(max(context.defaultParallelism, blocks), len(fits) * blocks)
    kind = ", ".join(f"{k} {marked.schema[k].dataType.simpleString()}" for k in keys) + ", y_true double, y_pred double"
    path = f"{root}/state-0"
    state = _state(staged(_blocks(marked, keys, [(c, k, sides[k][1]) for c, k in fits], bounds, blocks), path), width, parts)
    active, best, errors = set(range(len(fits))), [0] * len(fits), [np.inf] * len(fits)
    ended: dict[int, bool] = {}  # whether a fit's last trees are its best ones
    held, sent = [state], []  # what the plan since the last writing needs

    def turn(number: int) -> RDD | None:
        """Hands over the fits that have ended, then writes and reads again the state of the others."""
        nonlocal path
        one = lambda fit: done(fit, spark.createDataFrame(state.filter(lambda item: item[0][0] == fit).flatMap(_tested(ended[fit])), kind))
        with ThreadPoolExecutor(parallel) as pool:
            for job in [pool.submit(inheritable_thread_target(spark)(one), fit) for fit in ended]:
                job.result()
        ended.clear()
        before, path, going, after = path, f"{root}/state-{number}", frozenset(active), None
        if going:
            rows = state.filter(lambda item: item[0][0] in going).map(lambda item: (*item[0], bytearray(pickle.dumps(item[1]))))
            after = _state(staged(spark.createDataFrame(rows, PACKED), path), width, parts)
        for rdd in held:
            rdd.unpersist()
        for trees in sent:
            trees.destroy()
        held[:], sent[:] = [after], []
        fs, place = file_system(spark, before)
        fs.delete(place, True)
        return after

    for number in range(rounds + 1):
        # The job for a tree, or for its root, also tells the errors of the trees before it.
        if blocks == 1:
            found = _whole(state, set(active), seeds, number, share)
            trees = {fit: tree for fit, (tree, _) in found.items()}
        else:
            trees = {fit: _empty() for fit in active}
            for level in range(DEPTH):
                splits = _level(state, trees, seeds, number, level, share, parts)
                found = splits if level == 0 else found
                if not any([_extend(trees[fit], level, *split) for fit, (split, _) in splits.items()]):
                    break
        improved = set()
        for fit, (_, (squares, n)) in sorted(found.items()):
            if n and number and (number == 1 or squares / n < errors[fit]):
                best[fit], errors[fit] = number, squares / n
                improved.add(fit)
            if number == rounds or (n and number - best[fit] >= stale):
                ended[fit] = not n or fit in improved
                best[fit] = best[fit] if n else number
                active.remove(fit)
                del trees[fit]
        if not active:
            break
        sent.append(context.broadcast(trees))
        state = state.map(_grown(number == 0, sent[-1], improved)).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        if len(held) > 2:
            held.pop(0).unpersist()
        if number % KEEP == KEEP - 1:
            state = turn(number + 1)
    turn(rounds + 1)
    return best
