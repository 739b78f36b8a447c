"""Boxes that meet, against all pairs, with hot cells."""

import random
from datetime import date, timedelta

import pytest

from airlake.operators import manifest


@pytest.mark.parametrize("most", [4_000_000, 50, 0])
def test_pairs_come_once_from_hot_and_cold_cells(spark, most):
    rng = random.Random(3)
    stations = [(f"s{k:03}", 30 + (rng.random() * 0.09 if k % 3 else rng.random() * 4), -120 + (rng.random() * 0.09 if k % 3 else rng.random() * 4)) for k in range(60)]
    jobs = [(s, date(2023, 12, 25) + timedelta(7 * w), lat, lon) for s, lat, lon in stations for w in range(3)]
    shots = []
    for k in range(150):
        x, y = (-120 + rng.random() * 0.1, 30 + rng.random() * 0.1) if k % 2 else (-120 + rng.random() * 4, 30 + rng.random() * 4)
        size = rng.choice([0.0, 0.01, 0.05, 0.7])
        shots.append((k, date(2023, 12, 20) + timedelta(rng.randrange(40)), x, y, x + size, y + size))
    catalog = spark.createDataFrame(shots, "scene_id int, scene_date date, west double, south double, east double, north double")
    half = 224 * 10.0 / 2 / 111000 * 1.5
    want = sorted(
        (s, w, k, d) for s, w, lat, lon in jobs for k, d, x0, y0, x1, y1 in shots
        if x0 <= lon + half and x1 >= lon - half and y0 <= lat + half and y1 >= lat - half and w <= d < w + timedelta(7)
    )
    frame = spark.createDataFrame(jobs, "station_id string, week_start date, lat double, lon double")
    out = manifest.scenes_in(catalog, frame, 7, most=most)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 300
    assert "Deduplicate" not in out._jdf.queryExecution().analyzed().toString()
    times = catalog.withColumnRenamed("scene_date", "ts")
    points = spark.createDataFrame(stations, "station_id string, lat double, lon double")
    got = sorted(map(tuple, manifest.acquisitions(times, points, 2024, 2024, most=most).collect()))
    assert got == sorted({(s, d) for s, lat, lon in stations for k, d, x0, y0, x1, y1 in shots if x0 <= lon <= x1 and y0 <= lat <= y1 and d.year == 2024})
    assert manifest.scenes_in(catalog.where("false"), frame, 7).count() == 0
