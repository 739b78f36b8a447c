"""Archives, patch files and versioned tables, written and read on disk."""

import io
import os
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.operators import clean, manifest, models, raster
from airlake.sources import archives, patches, tables, versioned

LINE = {"State Code": "06", "County Code": "037", "Site Num": "1103", "POC": "3", "Date Local": "2024-01-05", "Arithmetic Mean": "-1.5", "Sample Duration": "24 HOUR"}


def archive(path, head, lines, names=("daily.csv",)):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "not a table")
        for name in names:
            buffer = io.StringIO()
            buffer.write(",".join(["Extra", *reversed(head)]) + "\n")
            for line in lines:
                buffer.write(",".join(["z", *(line.get(c, "") for c in reversed(head))]) + "\n")
            z.writestr(name, buffer.getvalue())


def test_daily_archives(spark, tmp_path):
    head = list(archives.DAILY)
    archive(tmp_path / "a.zip", head, [LINE, LINE | {"State Code": "48"}], ("x.csv", "y.CSV"))
    archive(tmp_path / "b.zip", head, [LINE | {"Local Site Name": '"two\nlines, quoted"', "Date Local": "2024-01-06"}])
    raw = archives.read_daily_archives(spark, str(tmp_path), ["06"])
    assert raw.rdd.getNumPartitions() == 3 and raw.count() == 3
    assert archives.read_daily_archives(spark, str(tmp_path / "*.zip")).count() == 5 and archives.read_daily_archives(spark, str(tmp_path / "b.zip")).count() == 1
    assert {r["site_name"] for r in raw.collect()} == {None, "two\nlines, quoted"}
    row = clean.clean_daily(raw, tables.regions_df(spark, [("west", "06")])).orderBy("date").first()
    assert (row["station_id"], row["date"], row["pm25"], row["region"]) == ("06-037-1103", date(2024, 1, 5), 0.0, "west")
    # The state's filter has left the plan: the source applies it.
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "= 06" not in plan and "zipped_csv" in plan
    assert raw.where("county_code = '037' AND state_code <> '06'").count() == 0


def test_hourly_archives_and_empty_ones(spark, tmp_path):
    head = list(archives.HOURLY)
    line = {"State Code": "06", "County Code": "1", "Site Num": "2", "POC": "1", "Date GMT": "2024-01-01", "Time GMT": "05:00", "Sample Measurement": "7.5"}
    archive(tmp_path / "h.zip", head, [line, line | {"POC": "", "Sample Measurement": ""}])
    archive(tmp_path / "none.zip", head, [], ())
    rows = archives.read_hourly_archives(spark, str(tmp_path)).orderBy(F.col("poc").asc_nulls_last()).collect()
    assert [(r["poc"], r["sample_measurement"], r["time_gmt"]) for r in rows] == [(1, 7.5, "05:00"), (None, None, "05:00")]
    os.makedirs(tmp_path / "empty")
    assert archives.read_hourly_archives(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        archives.read_hourly_archives(spark, str(tmp_path / "broken")).count()


def test_archives_appear_together(spark, tmp_path):
    rows = spark.createDataFrame([("6", "1", "1", k, "2024-01-01", "05:00", k / 7 if k % 3 else None) for k in range(50)], "state_code string, county_code string, site_num string, poc int, date_gmt string, time_gmt string, sample_measurement double").repartition(4)
    archives.write_archives(rows, str(tmp_path / "out"), "hourly")
    assert len(list((tmp_path / "out").iterdir())) == 4
    same = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*archives.HOURLY.values()).collect())))
    assert same(archives.read_hourly_archives(spark, str(tmp_path / "out"))) == same(rows)
    bad = rows.withColumn("poc", F.when(F.col("poc") == 49, F.raise_error(F.lit("broken"))).otherwise(F.col("poc")))
    with pytest.raises(Exception):
        archives.write_archives(bad, str(tmp_path / "failed"), "hourly")
    assert not [f for f in (tmp_path / "failed").glob("*.zip")]


def test_patch_trees(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    arrays = {}
    for k, (h, w) in enumerate(((3, 4), (700, 300), (1, 1), (0, 5))):
        arrays[f"2024-01-0{k + 1}"] = rng.integers(0, 65536, (h, w, 13)).astype("uint16")
    (tmp_path / "t" / "06-037-1103").mkdir(parents=True)
    for key, a in arrays.items():
        np.save(tmp_path / "t" / "06-037-1103" / f"{key}.npy", np.asfortranarray(a) if key.endswith("1") else a)
    (tmp_path / "t" / "06-037-1103" / ".hidden.npy").write_bytes(b"half of a patch")
    root = str(tmp_path / "t")
    shapes = patches.scan_patches(spark, root).orderBy("key").collect()
    assert [(r["station_id"], r["key"], r["height"], r["width"], r["channels"]) for r in shapes] == [("06-037-1103", k, *a.shape) for k, a in arrays.items()]
    got = {r["key"]: r for r in patches.scan_patches(spark, root, ["b4", "b3", "b12"], per_task=2).collect()}
    for key, a in arrays.items():
        for band, at in (("b4", 3), ("b3", 2), ("b12", 12)):
            assert got[key][band] == a[:, :, at].ravel().tolist()
    with pytest.raises(ValueError):
        patches.scan_patches(spark, root, ["b13"])
    # Two-dimensional arrays are one band; three bands in the order of the red, green and blue products.
    (tmp_path / "two" / "s").mkdir(parents=True)
    np.save(tmp_path / "two" / "s" / "2024-02-01.npy", np.arange(6, dtype="int32").reshape(2, 3))
    assert patches.scan_patches(spark, str(tmp_path / "two"), ["b4"], order=["b4"]).first()["b4"] == list(range(6))
    with pytest.raises(Exception, match="3 bands"):
        patches.scan_patches(spark, str(tmp_path / "two"), ["b4"], order=patches.RGB).count()


def test_patches_that_are_asked_for_alone_are_decoded(tmp_path):
    """Of thirteen interleaved bands only the wanted ones become arrays, and shapes take the header alone."""
    a = np.arange(40 * 50 * 13, dtype="uint16").reshape(40, 50, 13)
    (tmp_path / "s").mkdir()
    np.save(tmp_path / "s" / "2024-01-01.npy", a)
    read = []

    class Handle(io.FileIO):
        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

    with Handle(tmp_path / "s" / "2024-01-01.npy") as f:
        shape, _, _ = patches.header(f)
        assert shape == (40, 50, 13) and sum(read) < 200
    with Handle(tmp_path / "s" / "2024-01-01.npy") as f:
        planes = patches.planes(f, [1, 7], rows=7)
        assert [p.tolist() for p in planes] == [a[:, :, k].ravel().tolist() for k in (1, 7)]


def test_patches_are_written_and_masked(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k % 2}", f"2024-01-{k + 1:02}", 2, 2, [k, 1, 2, 3], [4, 5, 6, 70000], None) for k in range(6)], "station_id string, key string, height int, width int, b4 array<int>, b3 array<int>, b2 array<int>")
    with pytest.raises(Exception):
        patches.write_patches(rows, str(tmp_path / "bad"), patches.RGB)
    good = rows.withColumn("b2", F.col("b4")).withColumn("b3", F.transform("b3", lambda p: F.least(p, F.lit(65535))))
    patches.write_patches(good, str(tmp_path / "out"), patches.RGB)
    back = patches.scan_patches(spark, str(tmp_path / "out"), ["b3", "b2"], order=patches.RGB)
    assert sorted((r["key"], r["b2"], r["b3"]) for r in back.collect()) == sorted((r["key"], r["b4"], r["b3"]) for r in good.collect())
    assert np.load(tmp_path / "out" / "s1" / "2024-01-02.npy").shape == (2, 2, 3) and not list((tmp_path / "bad").glob("*/*.npy"))
    assert raster.preprocess(patches.scan_patches(spark, str(tmp_path / "out"), patches.RGB, order=patches.RGB)).count() == 6


def test_snapshots_change_at_once(spark, tmp_path):
    table = versioned.Versioned(spark, str(tmp_path / "t"), keep=2)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(spark.range(3)) == 1 and table.update(lambda old: old.union(spark.range(10, 12))) == 2
    rows = lambda v=None: sorted(r[0] for r in table.read(v).collect())
    assert rows() == [0, 1, 2, 10, 11] and rows(1) == [0, 1, 2]
    before = table.read()
    broken = before.select(F.when(F.col("id") == 11, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        table.write(broken)
    assert rows() == [0, 1, 2, 10, 11] and table.versions() == [1, 2] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    # The pointer decides: a folder that was written, but not committed, is not read.
    spark.range(99).write.parquet(str(tmp_path / "t" / "data" / "orphan"))
    assert rows() == [0, 1, 2, 10, 11]
    with pytest.raises(versioned.Conflict):
        table.write(spark.range(1), after=1)
    assert table.write(before.where("id < 10")) == 3 and table.versions() == [2, 3] and rows() == [0, 1, 2]
    assert before.count() == 5
    assert table.write(spark.range(0)) == 4 and rows() == []


def test_manifest_versions(spark, tmp_path):
    schema = "station_id string, week_start date, product string, status string, ingest_seq long"
    d = date(2024, 1, 1)
    table = tables.manifest_table(spark, str(tmp_path / "m"))
    # The first rows lack the columns of later versions.
    tables.record_jobs(table, spark.createDataFrame([("a", d, "p", "error", 1), ("b", d, "p", "ok", 2)], schema))
    tables.record_jobs(table, spark.createDataFrame([("a", d, "p", "ok", 3, None, "all"), ("a", d, "p", "ok", 4, "median", None)], schema + ", mode string, bands string"))
    got = {(r["station_id"], r["bands"]): (r["status"], r["mode"], r["scene_date"]) for r in table.read().collect()}
    assert got == {("a", "rgb"): ("ok", "median", ""), ("a", "all"): ("ok", "median", ""), ("b", "rgb"): ("ok", "median", "")}
    table.read(1).drop("mode", "bands").write.parquet(str(tmp_path / "old"))
    loaded = tables.load_manifest(spark, str(tmp_path / "old"))
    assert set(f.split()[0] for f in tables.MANIFEST.split(", ")) <= set(loaded.columns) and {r["mode"] for r in loaded.collect()} == {"median"} and {r["n_images"] for r in loaded.collect()} == {None}
    assert manifest.with_defaults(tables.load_manifest(spark, str(tmp_path / "absent"))).count() == 0


def test_runs_are_replaced_by_partition(spark, tmp_path):
    preds = spark.createDataFrame([(f"s{k}", float(k), float(k), k % 3, None if k % 2 else "a/b") for k in range(12)], "station_id string, y_true double, y_pred double, fold int, region string")
    assert tables.write_run(preds, preds.groupBy("fold").count(), str(tmp_path), ["fold", "region"]) == 1
    assert tables.write_run(preds.where("fold = 1").withColumn("y_pred", F.lit(-1.0)), preds.where("fold = 1").groupBy("fold").count(), str(tmp_path), ["fold", "region"]) == 2
    got, results = tables.read_run(spark, str(tmp_path))
    assert sorted((r["station_id"], r["y_pred"]) for r in got.collect()) == sorted((r["station_id"], -1.0 if r["fold"] == 1 else r["y_pred"]) for r in preds.collect())
    assert [tuple(r) for r in results.collect()] == [(1, 4)] and len(list((tmp_path / "results_json").iterdir())) == 2
    assert set(versioned.partitions(spark, str(tmp_path / "predictions"), ["fold", "region"])) == {(str(f), r) for f in range(3) for r in (None, "a/b")}


def test_finished_runs_are_scored_not_fitted(spark, tmp_path):
    rows = [(f"s{k % 4}", float(k % 7), float(k % 5), k % 3, "ab"[k % 2]) for k in range(60)]
    preds = spark.createDataFrame(rows, "station_id string, y_true double, y_pred double, fold int, region string").select("station_id", "y_true", "y_pred", "region", "fold")
    grid = preds.select("region", "fold").distinct()
    asked = []

    def fit(todo):
        asked.append({tuple(r) for r in todo.collect()})
        return preds.join(todo, ["region", "fold"], "left_semi").select(*preds.columns)

    schema = "station_id string, y_true double, y_pred double, region string, fold int"
    near = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    run = lambda g: near(models.resume_metrics(g, str(tmp_path), fit, schema))
    first = run(grid.where("fold < 2"))
    assert len(first) == 4 and len(asked[0]) == 4
    every = run(grid)
    assert asked[1] == {("a", 2), ("b", 2)} and len(every) == 6 and set(first) <= set(every)
    assert run(grid) == every and len(asked) == 2
    from airlake.operators.metrics import score_runs

    assert every == near(score_runs(preds, ["region", "fold"]))
