"""Job planning, resuming and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions import scalars as X

KEYS = ["station_id", "week_start", "product", "mode", "bands"]
DEFAULTS = {"mode": "median", "scene_date": "", "bands": "rgb"}
TERMINAL = ("ok", "too_cloudy", "no_images")


def with_defaults(manifest: DataFrame) -> DataFrame:
    """Columns that older manifests lack, or hold nulls in, get their defaults."""
    for name, value in DEFAULTS.items():
        column = F.coalesce(F.col(name), F.lit(value)) if name in manifest.columns else F.lit(value)
        manifest = manifest.withColumn(name, column)
    return manifest


def weeks_per_month(weekly: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("station_id", X.month_of("week_start")).orderBy("week_start")
    return weekly.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def _spread(values: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every max(1, rows // n)-th row of a dimension table, the first n of them."""
    ranked = values.withColumn("_rn", F.row_number().over(Window.orderBy(*order)) - 1)
    size = values.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n)).alias("_step"))
    return ranked.join(F.broadcast(size)).where("_rn % _step = 0").where(F.floor(F.col("_rn") / F.col("_step")) < n).drop("_rn", "_step")


def spread_stations(stations: DataFrame, n: int) -> DataFrame:
    return _spread(stations, ["lat", "station_id"], n)


def spread_weeks(weekly: DataFrame, n: int) -> DataFrame:
    return weekly.join(_spread(weekly.select("week_start").distinct(), ["week_start"], n), "week_start", "left_semi").select(*weekly.columns)


def limit_stations(df: DataFrame, n: int) -> DataFrame:
    return df.join(df.select("station_id").distinct().orderBy("station_id").limit(n), "station_id", "left_semi")


def scene_jobs(scenes: DataFrame) -> DataFrame:
    return scenes.select("station_id", "scene_date").dropDuplicates()


def plan_jobs(weekly: DataFrame, stations: DataFrame, max_stations: int | None = None, max_weeks: int | None = None, per_month: int | None = None) -> DataFrame:
    """Weeks to fetch: of the chosen stations, then the first ones of each month, then those spread over the weeks that are left."""
    if max_stations:
        stations = spread_stations(stations, max_stations)
    weekly = weekly.join(stations.select("station_id"), "station_id", "left_semi")
    if per_month:
        weekly = weeks_per_month(weekly, per_month)
    if max_weeks:
        weekly = spread_weeks(weekly, max_weeks)
    return weekly.join(stations.select("station_id", "lat", "lon"), "station_id").select("station_id", "week_start", "lat", "lon", X.utm_epsg("lon").alias("epsg"))


def keep_last(manifest: DataFrame, keys: list[str] | None = None, order: str = "ingest_seq") -> DataFrame:
    last = Window.partitionBy(*(keys or KEYS)).orderBy(F.desc(order))
    return manifest.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows, the last one of each key; write it to another path than the one read."""
    return keep_last(with_defaults(old.unionByName(new, allowMissingColumns=True)))


def pending_jobs(jobs: DataFrame, manifest: DataFrame, patches: DataFrame, product: str, mode: str, bands: str = "rgb") -> DataFrame:
    """Jobs without a terminal row and without a patch of this product, mode and set of bands; failed ones are tried again.

    ``patches`` that do not say what they are of count for every product.
    """
    for name, value in (("product", product), ("mode", mode), ("bands", bands)):
        if name in patches.columns:
            patches = patches.where(F.col(name) == value)
    done = with_defaults(manifest).where(
        (F.col("product") == product) & (F.col("mode") == mode) & (F.col("bands") == bands) & F.col("status").isin(*TERMINAL)
    )
    return jobs.join(done, ["station_id", "week_start"], "left_anti").join(patches, ["station_id", "week_start"], "left_anti")


def patch_status(df: DataFrame, min_valid: float = 0.3) -> DataFrame:
    return df.withColumn("status", F.when(F.col("n_images") == 0, "no_images").when(F.col("valid_fraction") < min_valid, "too_cloudy").otherwise("ok"))


def status_counts(manifest: DataFrame, product: str) -> DataFrame:
    return manifest.where(F.col("product") == product).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sample_errors(manifest: DataFrame, n: int = 3) -> DataFrame:
    """The first failures of all products."""
    return manifest.where(F.col("status") == "error").orderBy("ingest_seq").limit(n)


def purge_years(df: DataFrame, years: list[int], date: str = "week_start") -> DataFrame:
    return df.where(~F.coalesce(F.year(date).isin(*years), F.lit(False)))


def pending_runs(grid: DataFrame, predictions: DataFrame) -> DataFrame:
    return grid.join(predictions, [c for c in grid.columns if c in predictions.columns], "left_anti")


def with_patch(table: DataFrame, patches: DataFrame) -> DataFrame:
    return table.join(patches, ["station_id", "week_start"], "left_semi")


def extend_cache(cache: DataFrame, stations: DataFrame, compute) -> DataFrame:
    """The cache and what ``compute`` finds for the stations it lacks."""
    return cache.unionByName(compute(stations.join(cache, "station_id", "left_anti")))


#: A cell is this many finer ones wide.
FINER = 8


def _boxed(df: DataFrame, box: list[Column], when: Column, cell: float, tag: str) -> DataFrame:
    """A row for each cell (_x, _y) and period _t of each row, whose columns get the tag in front, with its box by the finer cells (_x0, _y0, _x1, _y1)."""
    fine = [F.floor(c / (cell / FINER)).alias(n) for c, n in zip(box, ("_x0", "_y0", "_x1", "_y1"), strict=True)]
    whole = df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns], *fine, when.alias("_t"))
    coarse = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / FINER), F.floor(F.col(hi) / FINER)))
    return whole.withColumn("_x", coarse("_x0", "_x1")).withColumn("_y", coarse("_y0", "_y1"))


def box_join(left: DataFrame, right: DataFrame, left_box: list[Column], right_box: list[Column], left_period: Column, right_period: Column, cell: float, most: int = 4_000_000) -> DataFrame:
    """Pairs, columns with l_ and r_ in front, whose boxes (west, south, east, north) may meet in the same period; each pair once, or once for each shared period.

    Rows meet on the cells that their boxes touch. A pair comes from the one cell that holds the lower left corner of what both boxes cover, so nothing is
    left to deduplicate. Cells with more than ``most`` pairs are split into finer ones, which far fewer rows share; which these are is counted first, before any pair is made.
    """
    sides = [_boxed(left, left_box, left_period, cell, "l"), _boxed(right, right_box, right_period, cell, "r")]
    keys = ["_x", "_y", "_t"]
    counts = [s.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{k}")) for k, s in enumerate(sides)]
    hot = counts[0].join(counts[1], keys).where(F.col("_n0") * F.col("_n1") > most).select(*keys, F.lit(True).alias("_hot"))

    def placed(side: DataFrame) -> DataFrame:
        marked = side.join(hot, keys, "left")
        inside = lambda c: F.sequence(F.greatest(F.col(f"_{c}0"), F.col(f"_{c}") * FINER), F.least(F.col(f"_{c}1"), F.col(f"_{c}") * FINER + FINER - 1))
        finer = lambda c: F.explode(F.when(F.col("_hot"), inside(c)).otherwise(F.array(F.lit(-1).cast("long"))))
        return marked.withColumn("_fx", finer("x")).withColumn("_fy", finer("y"))

    a, b = placed(sides[0]).alias("a"), placed(sides[1]).alias("b")
    on = [*keys, "_fx", "_fy"]
    met = a.join(b, on)
    own = F.lit(True)
    for c in ("x", "y"):
        corner = F.greatest(F.col(f"a._{c}0"), F.col(f"b._{c}0"))
        own = own & F.when(F.col("a._hot"), F.col(f"_f{c}") == corner).otherwise(F.col(f"_{c}") == F.floor(corner / FINER))
    return met.where(own).select(*[f"l_{c}" for c in left.columns], *[f"r_{c}" for c in right.columns])


def scenes_in(catalog: DataFrame, jobs: DataFrame, days: int, cell: float = 0.1, most: int = 4_000_000) -> DataFrame:
    """Scenes whose footprint meets a job's box within [start, start + days), by ``box_join`` and periods of days; jobs and scenes are taken to be distinct."""
    period = lambda day: F.floor(F.unix_date(F.to_date(day)) / days)
    boxed = jobs.select("station_id", "week_start", *X.bbox("lat", "lon"))
    boxed = boxed.withColumn("_p", F.explode(F.sequence(period("week_start"), period(F.date_add("week_start", days - 1)))))
    shots = catalog.select("scene_id", "scene_date", "west", "south", "east", "north")
    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    met = box_join(boxed, shots, sides, sides, F.col("_p"), period("scene_date"), cell, most)
    return met.where(
        "r_west <= l_east AND r_east >= l_west AND r_south <= l_north AND r_north >= l_south AND r_scene_date >= l_week_start "
        f"AND r_scene_date < date_add(l_week_start, {days})"
    ).selectExpr("l_station_id AS station_id", "l_week_start AS week_start", "r_scene_id AS scene_id", "r_scene_date AS scene_date")


def acquisitions(catalog: DataFrame, stations: DataFrame, first_year: int, last_year: int, cell: float = 0.1, most: int = 4_000_000) -> DataFrame:
    """Distinct acquisition times over each station, from the first year to the end of the last one; neighbouring scenes may share one."""
    shots = catalog.where(F.year("ts").between(first_year, last_year)).select("ts", "west", "south", "east", "north")
    points = stations.select("station_id", "lat", "lon")
    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    at = [F.col("lon"), F.col("lat")] * 2
    met = box_join(points, shots, at, sides, F.lit(0), F.lit(0), cell, most)
    inside = "l_lon BETWEEN r_west AND r_east AND l_lat BETWEEN r_south AND r_north"
    return met.where(inside).selectExpr("l_station_id AS station_id", "r_ts AS ts").dropDuplicates()


def link_quality(scenes: DataFrame, quality: DataFrame) -> DataFrame:
    return scenes.join(quality, "scene_id", "left")
