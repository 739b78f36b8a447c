"""Model tables, splits and sampling weights."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions import scalars as X
from airlake.operators import labels as L

BUCKETS = (6.0, 12.0, 35.0, 55.0)


def assemble(labels: DataFrame, embeddings: DataFrame, stations: DataFrame) -> DataFrame:
    joined = labels.withColumn("week_start", F.to_date("week_start")).join(
        embeddings.withColumn("week_start", F.to_date("week_start")), ["station_id", "week_start"]
    )
    joined = joined.join(stations.select("station_id", "lat", "lon", "region"), "station_id", "left")
    return joined.withColumn("year", F.year("week_start")).withColumn("week_of_year", X.iso_week("week_start"))


def assembly_report(labels: DataFrame, embeddings: DataFrame, table: DataFrame) -> DataFrame:
    one = labels.agg(F.count(F.lit(1)).alias("n_labels")).join(F.broadcast(embeddings.agg(F.count(F.lit(1)).alias("n_embeddings"))))
    one = one.join(F.broadcast(table.agg(F.count(F.lit(1)).alias("n_joined"), F.count_distinct("station_id").alias("n_stations"))))
    return one.withColumn("labels_without_patch", F.col("n_labels") - F.col("n_joined"))


def features(table: DataFrame, kind: str) -> DataFrame:
    place = F.array(F.col("lat"), F.col("lon"), F.col("week_of_year").cast("double"))
    image = F.transform("embedding", lambda v: v.cast("double"))
    chosen = {"image": image, "spacetime": place, "fused": F.concat(image, place)}[kind]
    return table.withColumn("features", chosen)


def labels_for(kind: str, daily: DataFrame, passes: DataFrame | None = None, scenes: DataFrame | None = None, hour_labels: DataFrame | None = None, **options) -> DataFrame:
    if kind == "weekly":
        return L.aggregate_weekly(daily, **options)
    if kind == "overpass":
        return L.overpass_labels(daily, passes)
    if kind == "scene":
        return L.scene_labels(scenes, daily)
    if kind == "scenehour":
        return L.scenehour_labels(scenes, hour_labels, **options)
    raise ValueError(f"unknown kind of labels: {kind}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def random_split(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 0) -> DataFrame:
    """Exactly floor(share * n) test rows, the first by a hash of the keys.

    Rows are counted for each hash prefix; only the rows of the one prefix in which the cut falls are ranked.
    """
    marked = df.withColumn("_h", X.draw(seed, *keys)).withColumn("_p", F.substring("_h", 1, 4))
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # 65,536 rows at most
    running = counts.withColumn("_until", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.agg(F.floor(F.sum("_n") * share).alias("_cut"))
    bound = running.join(F.broadcast(total)).select("_p", "_cut", (F.col("_until") - F.col("_n")).alias("_before"), "_until")
    placed = marked.join(bound, "_p")
    sure = placed.where("_until <= _cut OR _before >= _cut").withColumn("split", F.when(F.col("_until") <= F.col("_cut"), "test").otherwise("train"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *keys))
    edge = placed.where("_until > _cut AND _before < _cut").withColumn("split", F.when(F.col("_before") + rank <= F.col("_cut"), "test").otherwise("train"))
    return sure.unionByName(edge).select(*df.columns, F.lit(0).alias("fold"), "split")


def spatial_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """The station's test fold as column fold: stations by size are dealt in serpentine order."""
    sizes = df.groupBy("station_id").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.orderBy(F.desc("_n"), "station_id")) - 1
    at = rank % (2 * k)
    fold = sizes.select("station_id", F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int").alias("fold"))
    return df.join(fold, "station_id").select(*df.columns, "fold")


def explode_folds(df: DataFrame, k: int) -> DataFrame:
    """One copy of each row for every fold, test in its own and train in the others."""
    return df.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("split", F.when(F.col("_f") == F.col("fold"), "test").otherwise("train")).drop("fold").withColumnRenamed("_f", "fold")


def temporal_split(df: DataFrame, year: int, date: str = "week_start") -> DataFrame:
    y = F.year(date)
    return df.withColumn("fold", F.lit(0)).withColumn("split", F.when(y < year, "train").when(y == year, "test"))


def region_split(df: DataFrame) -> DataFrame:
    held = df.select(F.col("region").alias("fold")).where("fold IS NOT NULL").distinct()
    return df.join(F.broadcast(held)).withColumn("split", F.when(F.col("region") == F.col("fold"), "test").otherwise("train"))


def station_holdout(df: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """max(1, floor(share * stations)) test stations in every region."""
    stations = df.groupBy("station_id").agg(F.coalesce(F.min("region"), F.lit("")).alias("_r"))
    rank = F.row_number().over(Window.partitionBy("_r").orderBy(X.draw(seed, "station_id")))
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("_r")) * share))
    side = stations.select("station_id", F.when(rank <= n, "test").otherwise("train").alias("split"))
    return df.join(side, "station_id").select(*df.columns, F.lit(0).alias("fold"), "split")


def final_split(df: DataFrame) -> DataFrame:
    return df.withColumn("fold", F.lit(0)).withColumn("split", F.lit("train"))


def val_carveout(df: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """max(1, floor(share * stations)) of the training stations go to validation."""
    stations = df.where("split = 'train'").select("station_id").distinct()
    n = stations.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("_n"))
    ranked = stations.withColumn("_rn", F.row_number().over(Window.orderBy(X.draw(seed, "station_id"))))
    chosen = ranked.join(F.broadcast(n)).where("_rn <= _n").select("station_id", F.lit(True).alias("_val"))
    moved = F.when((F.col("split") == "train") & F.col("_val"), "val").otherwise(F.col("split"))
    return df.join(chosen, "station_id", "left").withColumn("split", moved).drop("_val")


def leakage_report(df: DataFrame, unit: str = "station_id") -> DataFrame:
    """Units that are on both sides of a fold, by fold."""
    sides = df.where("split IS NOT NULL").groupBy("fold", unit).agg(F.count_distinct("split").alias("_s"))
    return sides.groupBy("fold").agg(F.count(F.lit(1)).alias("units"), F.sum((F.col("_s") > 1).cast("int")).alias("leaks"))


def split_composition(df: DataFrame) -> DataFrame:
    return df.groupBy("fold", "region").agg(
        F.count_distinct(F.when(F.col("split") == "test", F.col("station_id"))).alias("test_stations"), F.count_distinct("station_id").alias("stations")
    ).withColumn("test_share", F.col("test_stations") / F.col("stations"))


def bucket(y: Column | str) -> Column:
    """0 to 4 for up to 6, 12, 35, 55 and above; null outside (-1, 1e9]."""
    y = F.col(y) if isinstance(y, str) else y
    inside = sum(((y > b).cast("int") for b in BUCKETS), F.lit(0))
    return F.when((y > -1) & (y <= 1e9), inside)


def weight_high(df: DataFrame, w: float) -> DataFrame:
    return df.withColumn("weight", F.when(F.col("pm25") > 35, w).when(F.col("pm25") > 20, w / 2).otherwise(1.0))


def weight_buckets(df: DataFrame, weights: list[float]) -> DataFrame:
    return df.withColumn("weight", F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in weights]), bucket("pm25")), F.lit(1.0)))


def weight_balanced(df: DataFrame, damped: bool = False) -> DataFrame:
    marked = df.withColumn("_b", bucket("pm25"))
    counts = marked.where("_b IS NOT NULL").groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    ratio = counts.join(F.broadcast(counts.agg(F.max("_n").alias("_m")))).select("_b", (F.col("_m") / F.col("_n")).alias("_w"))
    w = F.coalesce("_w", F.lit(1.0))
    return marked.join(F.broadcast(ratio), "_b", "left").withColumn("weight", F.sqrt(w) if damped else w).drop("_b", "_w")


def resample_offset(seed: int) -> float:
    """Where the first grid point of ``weighted_resample`` lies in its step: between a quarter and three quarters."""
    return 0.25 + int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16) / 2**33


def weighted_resample(df: DataFrame, keys: list[str], weight: str = "weight", seed: int = 0, draws: int | None = None) -> DataFrame:
    """Exactly ``draws`` rows (as many as the table has) by systematic resampling, numbered by column copy; each row comes n * w / sum(w) times, give or take one.

    In the order of a hash of the keys, which name a row, weights are laid end to end; a row comes once for each of n evenly spaced points in its stretch. Where a stretch begins
    is a sum of integers (2**-40 of the largest weight each), so neighbours agree and no point is lost or met twice: totals of 65,536 hash prefixes are added up first, then the rows
    within each. Null, NaN and negative weights count as 0; if no weight is left, there are no rows.
    """
    w = F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    hashed = df.withColumns({"_h": X.draw(seed, *keys), "_w": w}).withColumn("_p", F.substring("_h", 1, 4))
    top = hashed.agg(F.max("_w").alias("_top"), F.count(F.lit(1)).alias("_rows"))
    units = F.floor(F.coalesce(F.col("_w") / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0)) * 2.0**40).cast("decimal(38,0)")
    laid = hashed.join(F.broadcast(top)).withColumn("_u", units)
    totals = laid.groupBy("_p").agg(F.sum("_u").cast("decimal(38,0)").alias("_t"))  # 65,536 rows at most
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).cast("decimal(38,0)").alias("_from"))
    starts = starts.join(F.broadcast(totals.agg(F.sum("_t").cast("double").alias("_all"))))
    order = Window.partitionBy("_p").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.join(starts, "_p").withColumn("_to", (F.sum("_u").over(order) + F.col("_from")).cast("decimal(38,0)"))
    n = F.lit(draws) if draws is not None else F.col("_rows")

    def passed(place: Column) -> Column:
        """Points before a place; the same place always gives the same number."""
        return F.floor(place.cast("double") * (n.cast("double") / F.col("_all")) - resample_offset(seed))

    chosen = placed.where("_all > 0").withColumn("_n", (passed(F.col("_to")) - passed((F.col("_to") - F.col("_u")).cast("decimal(38,0)"))).cast("int")).where("_n > 0")
    return chosen.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))


def pos_weight(df: DataFrame, threshold: float) -> DataFrame:
    pos = F.sum((F.col("pm25") > threshold).cast("int"))
    neg = F.sum((F.col("pm25") <= threshold).cast("int"))
    return df.agg(pos.alias("pos"), neg.alias("neg"), (neg / F.greatest(pos, F.lit(1))).alias("pos_weight"))
