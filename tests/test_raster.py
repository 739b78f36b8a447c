"""Composites by tiles and band statistics by merged moments against numpy."""

import re

import numpy as np
import pytest

from airlake.operators import raster


@pytest.mark.parametrize("tile", [1, 7, 1024])
def test_composite_by_tiles(spark, tile):
    rng = np.random.default_rng(1)
    rows = []
    for g, n, size in (("a", 5, 20), (None, 4, 20), ("masked", 3, 20), ("one", 1, 3), ("empty", 2, 0)):
        for _ in range(n):
            band = [[None if g == "masked" or rng.random() < 0.4 else int(v) for v in rng.integers(0, 40, size)] for _ in range(3)]
            if g == "a":
                band = [[None if band[0][i] is None else x for i, x in enumerate(b)] for b in band]
            rows.append((g, *band))
    rows += [("a", *rows[0][1:]), ("a", None, None, None), ("a", [7], [7], [7])]
    scenes = spark.createDataFrame(rows, "g string, b4 array<int>, b3 array<int>, b2 array<int>")
    got = {r["g"]: r for r in raster.median_composite(scenes, ["g"], tile=tile).collect()}
    assert set(got) == {"a", None, "masked", "one", "empty"}
    for g, r in got.items():
        for k, b in enumerate(("b4", "b3", "b2"), 1):
            arrays = [x[k] for x in rows if x[0] == g and x[k] is not None]
            for i in range(max(map(len, arrays))):
                values = [x[i] for x in arrays if i < len(x) and x[i] is not None]
                assert r[b][i] == (int(np.floor(np.median(values))) if values else 0)
                assert k > 1 or r["cnt"][i] == len(values)
            assert len(r[b]) == max(map(len, arrays))


def test_composite_shuffles_tiles_not_pixels(spark):
    scenes = spark.createDataFrame([(k % 2, [1] * 3000, [2] * 3000, [3] * 3000) for k in range(6)], "g int, b4 array<int>, b3 array<int>, b2 array<int>")
    out = raster.median_composite(scenes, ["g"])
    assert [(r["b2"], r["cnt"]) for r in out.collect()] == [([3] * 3000, [3] * 3000)] * 2
    assert out._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 0
    assert raster.median_composite(scenes.where("false"), ["g"]).count() == 0


def test_band_statistics(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [int(v) for v in 10**9 + rng.integers(0, 50, rng.integers(1, 9))], [None if v < 10 else int(v) for v in rng.integers(0, 50, 6)], [] if k % 2 else [5, None]) for k in range(40)]
    patches = spark.createDataFrame(rows, "id int, b4 array<int>, b3 array<int>, b2 array<int>")
    stats = raster.band_stats(patches, ["id"], n=1000)
    got = stats.first()
    for k, b in enumerate(("b4", "b3", "b2"), 1):
        values = [v for r in rows for v in r[k] if v is not None]
        assert got[f"{b}_mean"] == pytest.approx(np.mean(values), rel=1e-14) and got[f"{b}_std"] == pytest.approx(np.std(values) + 1e-6, rel=1e-9, abs=1e-9)
    plan = raster.band_stats(patches, ["id"], n=5)._jdf.queryExecution().optimizedPlan().toString()
    # The keys are sorted without pixels.
    assert "Generate" not in plan and re.search(r"Sort \[md5[^\n]*\n[^\n]*Project \[id#\d+\]\n", plan)
    assert raster.band_stats(patches.where("false"), ["id"]).first()[:] == (None,) * 6
