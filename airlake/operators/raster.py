"""Pixel operators over patch rows: flat row-major arrays, one column for each band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions import scalars as X

RGB = ["b4", "b3", "b2"]
#: Scene classes that are no ground (no data, defects, shadow, clouds, cirrus, snow).
MASKED = (0, 1, 3, 8, 9, 10, 11)
#: Channel means and deviations of the usual image normalisation.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def mask_by_class(df: DataFrame, classes: tuple[int, ...] = MASKED, bands: list[str] = RGB) -> DataFrame:
    drop = F.array(*[F.lit(c) for c in classes])
    return df.withColumns({b: F.zip_with(b, "scl", lambda p, c: F.when(~F.array_contains(drop, c), p)) for b in bands})


def mask_by_score(df: DataFrame, least: float = 0.6, bands: list[str] = RGB) -> DataFrame:
    return df.withColumns({b: F.zip_with(b, "score", lambda p, s: F.when(s >= least, p)) for b in bands})


#: Pixels of a tile, which is what a median over many scenes has in memory of each of them.
TILE = 1024


def median_composite(scenes: DataFrame, keys: list[str], bands: list[str] = RGB, tile: int = TILE) -> DataFrame:
    """Median of the unmasked pixels of each position in a group, 0 where there is none, and their number as cnt (of the first band).

    Arrays are cut into tiles of ``tile`` pixels; tiles, not pixels, are shuffled by group and position, reduced with numpy and put together again. Masked
    pixels are null. Arrays of a group may differ in length, a null array holds nothing; a group without any pixel has empty arrays. Ties and repeated scenes count each.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [*bands, "cnt"]
    length = F.greatest(F.lit(0), *[F.coalesce(F.size(b), F.lit(0)) for b in bands])
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(length / tile).cast("int") - 1))).alias("_tile")
    cut = scenes.select(*keys, *bands, at).select(*keys, "_tile", *[F.slice(b, F.col("_tile") * tile + 1, tile).alias(b) for b in bands])

    def middle(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(floored median, number of values) at each position, read from the arrays' child buffers."""
        lists = column.combine_chunks()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
        stack = np.full((len(size), size.max(initial=0)), np.nan)
        stack[np.arange(stack.shape[1]) < size[:, None]] = flat
        stack.sort(axis=0)  # NaN last
        count = np.isfinite(stack).sum(0)
        every, last = np.arange(stack.shape[1]), np.maximum(count - 1, 0)
        mid = (stack[last // 2, every] + stack[(last + 1) // 2, every]) / 2
        return np.floor(np.where(count > 0, mid, 0)).astype(np.int32), count.astype(np.int32)

    def run(table: pa.Table) -> pa.Table:
        out = {k: table.column(k).slice(0, 1) for k in [*keys, "_tile"]}
        for b in bands:
            mid, count = middle(table.column(b))
            out[b] = pa.array([mid], pa.list_(pa.int32()))
            if b == bands[0]:
                out["cnt"] = pa.array([count], pa.list_(pa.int32()))
        return pa.table(out)

    types = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in [*keys, "_tile"]), *(f"{n} array<int>" for n in names)])
    tiles = cut.groupBy(*keys, "_tile").applyInArrow(run, schema)
    packed = tiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_tile", *names))).alias("_p"))
    return packed.select(*keys, *[F.flatten(F.col(f"_p.{n}")).alias(n) for n in names])


def best_scene(scenes: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("cloudy_pct", "scene_date", "scene_id")
    return scenes.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def scene_patch(scenes: DataFrame, keys: list[str], classes: tuple[int, ...] = MASKED) -> DataFrame:
    """The least cloudy scene with its pixels unmasked; cnt tells which were valid, day the date as a number."""
    drop = F.array(*[F.lit(c) for c in classes])
    valid = F.transform("scl", lambda c: F.when(F.array_contains(drop, c), 0).otherwise(1))
    return best_scene(scenes, keys).withColumn("cnt", valid).withColumn("day", F.unix_date("scene_date"))


def patch_stats(df: DataFrame, mode: str = "median") -> DataFrame:
    """valid_fraction, n_images and scene_date; in scene mode n_images only tells whether there is a date."""
    share = F.size(F.filter("cnt", lambda c: c > 0)) / F.size("cnt")
    if mode == "scene":
        date = F.when(F.col("day") > 0, F.date_format(X.day_to_date("day"), "yyyy-MM-dd")).otherwise("")
        return df.withColumns({"valid_fraction": share, "n_images": (F.col("day") > 0).cast("int"), "scene_date": date})
    return df.withColumns({"valid_fraction": share, "n_images": F.array_max("cnt"), "scene_date": F.lit("")})


def zero_fraction(df: DataFrame, bands: list[str] = RGB) -> DataFrame:
    dark = F.size(F.filter(F.arrays_zip(*bands), lambda p: F.greatest(*[p[b] for b in bands]) == 0))
    return df.withColumn("zero_frac", dark / F.size(bands[0]))


def fill_invalid(df: DataFrame, bands: list[str] = RGB) -> DataFrame:
    """Invalid pixels, without a value in any band, get the mean of the band's valid ones; a patch without valid or invalid ones stays."""
    def filled(b: str) -> Column:
        good = F.filter(F.arrays_zip(F.col(b).alias("p"), F.col("_lit").alias("v")), lambda x: x["v"])
        mean = F.aggregate(good, F.lit(0.0), lambda a, x: a + F.coalesce(x["p"], F.lit(0)).cast("double")) / F.size(good)
        return F.when(F.size(good).between(1, F.size(b) - 1), F.zip_with(b, "_lit", lambda p, v: F.when(v, p.cast("double")).otherwise(mean))).otherwise(
            F.transform(b, lambda p: p.cast("double"))
        )

    lit = F.transform(F.arrays_zip(*bands), lambda p: F.greatest(*[F.coalesce(p[b], F.lit(0)) for b in bands]) > 0)
    return df.withColumn("_lit", lit).withColumns({b: filled(b) for b in bands}).drop("_lit")


def to_display(df: DataFrame, gain: float = 3.0, bands: list[str] = RGB) -> DataFrame:
    return df.withColumns({b: F.transform(b, lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p / 10000.0 * gain))) for b in bands})


def normalize(df: DataFrame, mean: tuple = MEAN, std: tuple = STD, bands: list[str] = RGB) -> DataFrame:
    """Column x: the normalised bands one after the other."""

    def scaled(b: str, m: float, s: float) -> Column:
        return F.transform(b, lambda p: (p - m) / s)

    parts = [scaled(*three) for three in zip(bands, mean, std, strict=True)]
    return df.withColumn("x", F.concat(*parts))


def preprocess(df: DataFrame, gain: float = 3.0, fill: bool = True) -> DataFrame:
    return normalize(to_display(fill_invalid(df) if fill else df, gain))


def band_stats(patches: DataFrame, keys: list[str], n: int = 300, seed: int = 0, bands: list[str] = RGB) -> DataFrame:
    """Mean and deviation (and 1e-6) of each band over all pixels of ``n`` patches that a hash of their keys picks; null pixels do not count.

    The keys are picked first, without pixels. Each array of a picked patch becomes its count, mean and sum of squared deviations, which are merged
    by how far its mean is from the mean of all; pixels are neither exploded nor squared as they are.
    """
    picked = patches.select(*keys).orderBy(X.draw(seed, *keys)).limit(n)
    chosen = patches.join(F.broadcast(picked), keys, "left_semi")  # n keys

    def moments(b: str) -> Column:
        """Count n, mean m and sum of squared deviations s of one array, in one pass over it."""
        zero = F.lit(0.0)

        def step(a: Column, p: Column) -> Column:
            n, apart = a["n"] + 1, p.cast("double") - a["m"]
            mean = a["m"] + apart / n
            return F.when(p.isNull(), a).otherwise(F.struct(n.alias("n"), mean.alias("m"), (a["s"] + apart * (p.cast("double") - mean)).alias("s")))

        return F.aggregate(b, F.struct(zero.alias("n"), zero.alias("m"), zero.alias("s")), step)

    parts = chosen.select(*[moments(b).alias(b) for b in bands])
    means = parts.agg(*[(F.sum(F.col(f"{b}.n") * F.col(f"{b}.m")) / F.nullif(F.sum(f"{b}.n"), F.lit(0.0))).alias(f"{b}_mean") for b in bands])

    def merged(b: str) -> Column:
        apart = F.col(f"{b}.m") - F.col(f"{b}_mean")
        return F.sqrt(F.sum(F.col(f"{b}.s") + F.col(f"{b}.n") * apart * apart) / F.nullif(F.sum(f"{b}.n"), F.lit(0.0))) + 1e-6

    out = [c for b in bands for c in (F.first(f"{b}_mean").alias(f"{b}_mean"), merged(b).alias(f"{b}_std"))]
    return parts.join(F.broadcast(means)).agg(*out)


def standardize(df: DataFrame, stats: DataFrame, bands: list[str] = RGB) -> DataFrame:
    """``stats`` is the one row of ``band_stats``."""
    joined = df.join(F.broadcast(stats))

    def scaled(b: str) -> Column:
        return F.transform(b, lambda p: (p - F.col(f"{b}_mean")) / F.col(f"{b}_std"))

    return joined.withColumns({b: scaled(b) for b in bands}).drop(*[f"{b}_{k}" for b in bands for k in ("mean", "std")])


def augment(df: DataFrame, keys: list[str], side: int, seed: int = 0, bands: list[str] = RGB) -> DataFrame:
    """One of the eight symmetries of a square patch of ``side`` pixels, chosen by a hash of the keys, as column turn."""
    turn = F.conv(F.substring(X.draw(seed, *keys), 1, 1), 16, 10).cast("int") % 8
    df = df.withColumn("turn", turn)

    def source(i: Column) -> Column:
        y, x = F.floor(i / side).cast("int"), (i % side).cast("int")
        x = F.when(F.col("turn") % 2 == 1, side - 1 - x).otherwise(x)
        y2 = F.when(F.floor(F.col("turn") / 2) % 2 == 1, side - 1 - y).otherwise(y)
        return F.when(F.col("turn") >= 4, x * side + y2).otherwise(y2 * side + x).cast("int")

    at = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), source)

    def moved(b: str) -> Column:
        return F.transform("_at", lambda i: F.get(F.col(b), i))

    return df.withColumn("_at", at).withColumns({b: moved(b) for b in bands}).drop("_at")


def brightness(df: DataFrame, bands: list[str] = RGB) -> DataFrame:
    flat = F.concat(*bands)
    return df.withColumn("brightness", F.aggregate(flat, F.lit(0.0), lambda a, p: a + p) / F.size(flat))


def brightness_probe(patches: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of a patch's brightness with the deviation of its label from the station's mean."""
    from airlake.operators.metrics import anomaly

    both = brightness(patches).select(*keys, "brightness").join(anomaly(labels, "pm25", "station_id"), keys)
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("brightness", "anomaly").alias("r"))


def select_bands(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    return df.select(*keys, *bands)


def patch_grid(stations: DataFrame, size: int = 224, scale: float = 10.0) -> DataFrame:
    """Corner of a station's patch, snapped outwards to the pixel grid, and the request grid as a struct."""
    east, north = X.to_utm("lat", "lon", "epsg")
    half = size * scale / 2
    placed = stations.withColumn("epsg", X.utm_epsg("lon"))
    placed = placed.withColumn("x0", F.floor((east - half) / scale) * scale).withColumn("y0", F.ceil((north + half) / scale) * scale)
    return placed.withColumn("grid", F.struct(
        F.lit(size).alias("width"), F.lit(size).alias("height"), F.lit(scale).alias("scale_x"), F.lit(-scale).alias("scale_y"),
        F.col("x0").alias("translate_x"), F.col("y0").alias("translate_y"), F.concat(F.lit("EPSG:"), F.col("epsg").cast("string")).alias("crs"),
    ))
