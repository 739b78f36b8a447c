"""One registered query per operator over the logical tables, with the SQL that checks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.functions import scalars as X
from airlake.operators import clean as C
from airlake.operators import dataset as A
from airlake.operators import labels as L
from airlake.operators import manifest as M
from airlake.operators import metrics as E
from airlake.operators import models as N
from airlake.operators import raster as R
from airlake.plans.adapters import STATION, Views, sql
from airlake.sources import archives, patches, tables
from airlake.sources.shared import shared_folder, staged

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TRAIN_YEARS = [1995, 1996]


def _round(v: Column, digits: int = 6) -> Column:
    """As SQL rounds: the scaled double to the nearest integer, halves away from zero, and back; Spark's own rounding starts from the decimal text.

    Below a half, negative numbers become -0.0; numbers too large to scale stay.
    """
    near = F.signum(v) * (F.round(F.abs(v) * 10.0**digits) / 10.0**digits)
    return F.when(F.abs(v) < 1e300, near).otherwise(v)


def _rounded(df: DataFrame) -> DataFrame:
    """Fractions to six digits, as in the SQL."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out[f.name] = _round(F.col(f.name).cast("double"))
        elif kind in ("array<double>", "array<float>"):
            out[f.name] = F.transform(f.name, lambda v: _round(v.cast("double")))
    return df.withColumns(out) if out else df


def _positive_zeros(df: DataFrame, column: str) -> DataFrame:
    """The array column rounded, with -0.0 as 0.0, for SQL that adds 0.0 to what it has rounded."""
    return df.withColumn(column, F.transform(column, lambda v: _round(v.cast("double")) + F.lit(0.0)))


def q(name: str, body: str | None = None, *needs: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(Views(spark, sf_dir)))
        if body:
            ORACLE_SQL[name] = sql(body, *needs)
        return f

    return add


_OK = "CASE WHEN arithmetic_mean < 0 THEN 0 ELSE arithmetic_mean END"
_ST = STATION.format("state_code", "county_code", "site_num")
_W = "CAST(date_trunc('week', {}) AS DATE)"
_DAILY = "station_id, date, round(pm25, 6) AS pm25, obs_percent, round(lat, 6) AS lat, round(lon, 6) AS lon, site_name, region"



# sources: what Spark derives from the tables is written to the shared folder and read back
def _archived(v: Views, kind: str, states: list[str] | None = None) -> DataFrame:
    raw = v.readings_raw.withColumn("obs_count", F.col("line")) if kind == "daily" else v.hourly_raw
    path = shared_folder(v.spark, kind)
    archives.write_archives(raw, path, kind)
    return (archives.read_daily_archives if kind == "daily" else archives.read_hourly_archives)(v.spark, path, states)


q("s01_daily_archives", """SELECT state_code, county_code, site_num, CAST(poc AS INTEGER) AS poc, round(lat, 6) AS lat, round(lon, 6) AS lon, sample_duration, date_local, event_type,
 CAST(line AS INTEGER) AS obs_count, round(obs_percent, 6) AS obs_percent, round(arithmetic_mean, 6) AS arithmetic_mean, site_name FROM readings_raw WHERE state_code IN ('0', '2')""", "readings_raw")(
    lambda v: _archived(v, "daily", ["0", "2"]))
q("s02_hourly_archives", """SELECT CAST(user_id % 25 % 5 AS VARCHAR) AS state_code, CAST(user_id % 25 AS VARCHAR) AS county_code, '1' AS site_num, CAST(user_id // 25 AS INTEGER) AS poc,
 strftime(ts, '%Y-%m-%d') AS date_gmt, strftime(ts, '%H:00') AS time_gmt, round(CASE WHEN event_id % 11 <> 0 THEN value - 5 END, 6) AS sample_measurement FROM events WHERE event_type <> 'view'""")(
    lambda v: _archived(v, "hourly"))


def _patch_files(v: Views) -> str:
    """Patch files of all thirteen bands: the three of the table, and others made from one of them."""
    cap = lambda c: F.transform(c, lambda p: F.least(p, F.lit(65535)))
    made = v.patches.select(
        "station_id", F.concat_ws("_", F.date_format("scene_date", "yyyy-MM-dd"), "scene_id").alias("key"), F.lit(4).alias("height"), F.lit(4).alias("width"),
        *[cap(b if b in R.RGB else F.zip_with("b2", "cnt", _shifted(k))).alias(b) for k, b in enumerate(patches.ALL)],
    )
    root = shared_folder(v.spark, "patches")
    patches.write_patches(made, root)
    return root


def _shifted(k: int):
    return lambda p, c: p + c * k


# cleaning
q("s03_table_scan", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem WHERE l_quantity > 45")(
    lambda v: v.table("lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity"))
q("s05_regions", "SELECT * FROM regions", "regions")(lambda v: v.regions)
q("c01_filter_states", "SELECT region, count(*) AS n, count(arithmetic_mean) AS values FROM readings_raw WHERE state_code IN ('0', '2') GROUP BY region", "readings_raw")(
    lambda v: C.filter_states(v.readings_raw, v.regions.where("state_code IN ('0', '2')")).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count("arithmetic_mean").alias("values")))
q("c02_filter_duration", "SELECT seq, line, sample_duration FROM readings_raw WHERE contains(sample_duration, '24')", "readings_raw")(
    lambda v: C.filter_duration(v.readings_raw).select("seq", "line", "sample_duration"))
q("c03_drop_excluded", "SELECT seq, line, event_type FROM readings_raw WHERE event_type IS DISTINCT FROM 'Excluded'", "readings_raw")(
    lambda v: C.drop_excluded(v.readings_raw).select("seq", "line", "event_type"))
q("c04_station_id", f"SELECT seq, line, {_ST} AS station_id FROM readings_raw", "readings_raw")(lambda v: C.with_station(v.readings_raw).select("seq", "line", "station_id"))
q("c05_parse_times", "SELECT seq, ts FROM hourly_all", "hourly_all")(lambda v: v.hourly_raw.select("seq", X.utc_time("date_gmt", "time_gmt").alias("ts")))
q("c06_dedupe_lowest_poc", "SELECT station_id, date, poc, seq, line FROM ranked WHERE rn = 1", "ranked")(
    lambda v: C.dedupe_lowest_poc(C.with_station(C.drop_excluded(C.filter_duration(v.readings_raw))).withColumn("date", F.col("date_local"))).select("station_id", "date", "poc", "seq", "line"))
q("c07_dedupe_hourly", "SELECT station_id, ts, poc, seq FROM hourly_first WHERE rn = 1", "hourly_first")(
    lambda v: C.dedupe_hourly(C.with_station(v.hourly_raw).withColumn("ts", X.utc_time("date_gmt", "time_gmt"))).select("station_id", "ts", "poc", "seq"))
q("c08_clip_lower", f"SELECT seq, line, round({_OK}, 6) AS pm25 FROM readings_raw", "readings_raw")(lambda v: v.readings_raw.select("seq", "line", X.clip_lower("arithmetic_mean").alias("pm25")))
q("c09_drop_incomplete", "SELECT seq, line, site_name FROM readings_raw WHERE arithmetic_mean IS NOT NULL AND site_name IS NOT NULL", "readings_raw")(
    lambda v: C.drop_incomplete(v.readings_raw.select("seq", "line", "site_name", "arithmetic_mean")).drop("arithmetic_mean"))
q("c10_project_daily", f"SELECT {_ST} AS station_id, date_local AS date, round(arithmetic_mean, 6) AS pm25 FROM readings_raw", "readings_raw")(
    lambda v: C.with_station(v.readings_raw).select("station_id", F.col("date_local").alias("date"), F.col("arithmetic_mean").alias("pm25")))
q("c11_filter_complete", f"SELECT {_DAILY} FROM daily WHERE obs_percent >= 75", "daily")(lambda v: C.filter_complete(v.daily))
q("c12_clean_daily", f"SELECT {_DAILY} FROM daily", "daily")(lambda v: v.daily)
q("c13_clean_hourly", "SELECT station_id, ts, round(pm25, 6) AS pm25 FROM hourly", "hourly")(lambda v: v.hourly)
q("c14_select_scenes", "SELECT station_id, scene_date FROM scenes", "scenes")(
    lambda v: M.scene_jobs(C.select_scenes(v.manifest, "l1c", "single").withColumn("scene_date", F.to_date("scene_date"))))


def _scenes(v: Views) -> DataFrame:
    return M.scene_jobs(C.select_scenes(v.manifest, "l1c", "single").withColumn("scene_date", F.to_date("scene_date")))


def _quality_input(v: Views) -> DataFrame:
    fractions = v.manifest.where("mode = 'single' AND product = 'l1c'").groupBy("station_id", F.to_date("scene_date").alias("scene_date")).agg(F.min("valid_fraction").alias("valid_fraction"))
    rows = v.hour_labels.join(fractions, ["station_id", "scene_date"], "left")
    return rows.withColumn("zero_frac", F.dayofmonth("scene_date") / 100.0)


_QUALITY = """, fractions AS (SELECT station_id, CAST(scene_date AS DATE) AS scene_date, min(valid_fraction) AS valid_fraction FROM manifest
 WHERE mode = 'single' AND product = 'l1c' GROUP BY ALL), kept AS (SELECT h.station_id, h.scene_date, h.pm25, CASE WHEN coalesce(valid_fraction, 1) < 0.5 AND pm25 <= 20 THEN 'cloud_low_label'
 WHEN n_hours = 1 THEN 'single_hour_label' WHEN day(h.scene_date) / 100.0 > 0.25 THEN 'tile_edge_zeros' WHEN pm25 < 2.5 THEN 'pm_below_2.5' ELSE '' END AS reason
 FROM hour_labels h LEFT JOIN fractions f ON h.station_id = f.station_id AND h.scene_date = f.scene_date) """
q("c15_scene_keep")(lambda v: C.scene_keep(_quality_input(v)).select("station_id", "scene_date", "pm25", "reason", "keep"))
ORACLE_SQL["c15_scene_keep"] = sql("", "hour_labels", "manifest") + _QUALITY.strip() + " SELECT station_id, scene_date, round(pm25, 6) AS pm25, reason, reason = '' AS keep FROM kept"
q("c16_regime", """SELECT station_id, date, round(pm25, 6) AS pm25, CASE WHEN year(date) < 1997 THEN 'train' ELSE 'test' END AS split FROM daily
 WHERE year(date) >= 1997 OR (pm25 > 5 AND pm25 <= 60)""", "daily")(
    lambda v: C.regime(v.daily.withColumn("split", F.when(F.year("date") < 1997, "train").otherwise("test")), 5, 60).select("station_id", "date", "pm25", "split"))
q("c17_filter_years", "SELECT station_id, week_start, round(pm25, 6) AS pm25, n_days FROM weekly WHERE year(week_start) IN (1995, 1996)", "weekly")(lambda v: C.filter_years(v.weekly, TRAIN_YEARS))

# scalars
q("d01_week_start", f"SELECT event_id, {_W.format('ts')} AS week_start FROM events")(lambda v: v.table("events").select("event_id", X.week_start("ts").alias("week_start")))
q("d02_day_hour", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour FROM events")(lambda v: v.table("events").select("event_id", F.to_date("ts").alias("day"), X.hour_of("ts").alias("hour")))
q("d03_iso_week", "SELECT station_id, week_start, CAST(weekofyear(week_start) AS INTEGER) AS week_of_year, CAST(year(week_start) AS INTEGER) AS year FROM weekly", "weekly")(
    lambda v: v.weekly.select("station_id", "week_start", X.iso_week("week_start").alias("week_of_year"), F.year("week_start").alias("year")))
q("d04_local_date", "SELECT event_id, CAST(timezone('America/Los_Angeles', timezone('UTC', make_timestamp(epoch_ms(ts) * 1000))) AS DATE) AS day FROM events")(
    lambda v: v.table("events").select("event_id", X.local_date(X.millis_to_utc(F.unix_millis(F.col("ts").cast("timestamp")))).alias("day")))
q("d05_day_numbers", "SELECT scene_id, CAST(scene_date - DATE '1970-01-01' AS INTEGER) AS day, scene_date AS back FROM patches", "patches")(
    lambda v: v.patches.select("scene_id", F.unix_date("scene_date").alias("day")).withColumn("back", X.day_to_date("day")))
q("d06_expected_weeks", """SELECT y AS year, count(*) AS weeks FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem), range(0, 366) t(i)
 WHERE year(make_date(y, 1, 1) + CAST(i AS INTEGER)) = y AND isodow(make_date(y, 1, 1) + CAST(i AS INTEGER)) = 1 GROUP BY y""")(
    lambda v: v.table("lineitem").select(F.year("l_shipdate").alias("year")).distinct().withColumn(
        "weeks", F.size(F.filter(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))), lambda d: F.weekday(d) == 0)).cast("long")))
q("d07_date_key", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")(lambda v: v.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")))
q("d08_month", "SELECT station_id, week_start, CAST(date_trunc('month', week_start) AS DATE) AS month FROM weekly", "weekly")(lambda v: v.weekly.select("station_id", "week_start", X.month_of("week_start").alias("month")))
q("d09_log_target", f"SELECT seq, line, round(ln(1 + {_OK}), 6) AS y, round(exp(ln(1 + {_OK})) - 1, 6) AS back FROM readings_raw", "readings_raw")(
    lambda v: v.readings_raw.select("seq", "line", X.log_target("arithmetic_mean").alias("y")).withColumn("back", F.expm1("y")))
q("d10_exceeds", "SELECT station_id, date, CAST(pm25 > 35 AS INTEGER) AS over FROM daily", "daily")(lambda v: v.daily.select("station_id", "date", X.exceeds("pm25", 35).alias("over")))
q("d11_logistic", "SELECT station_id, date, round(1 / (1 + exp(-(router - 20) / 3)), 6) AS p FROM predictions", "predictions")(lambda v: v.predictions.select("station_id", "date", X.logistic("router", 20, 3).alias("p")))
_MSG = """event_type || ': ' || CASE event_id % 10 WHEN 0 THEN 'Request TIMEOUT' WHEN 1 THEN 'Quota exceeded' WHEN 2 THEN 'Parameter "image" is required'
 WHEN 3 THEN 'HTTP 503' WHEN 4 THEN 'the generated image has no bands' WHEN 5 THEN 'Deadline exceeded' WHEN 6 THEN 'Internal error' WHEN 7 THEN 'too many requests: Timed Out'
 WHEN 8 THEN 'bad band' ELSE '' END"""
q("d12_error_status", f"""SELECT event_id, CASE WHEN contains(m, 'has no bands') OR contains(m, 'Parameter ''image'' is required') THEN 'no_images'
 WHEN regexp_matches(lower(m), '429|quota|rate|unavailable|deadline|timeout|internal|500|503') THEN 'retry' ELSE 'error' END AS status, substr(m, 1, 12) AS short
 FROM (SELECT event_id, replace({_MSG}, chr(34), chr(39)) AS m FROM events)""")(
    lambda v: v.table("events").select("event_id", F.expr(f"replace({_MSG}, chr(34), chr(39))").alias("m")).select("event_id", X.error_status("m").alias("status"), X.short_message("m", 12).alias("short")))

# labels
q("l01_build_stations", "SELECT station_id, round(lat, 6) AS lat, round(lon, 6) AS lon, n_days, region FROM stations", "stations")(lambda v: v.stations.drop("site_name"))
q("l02_aggregate_weekly", "SELECT station_id, week_start, round(pm25, 6) AS pm25, n_days FROM weekly", "weekly")(lambda v: v.weekly)
q("l03_station_coverage", """SELECT station_id, week_start, round(pm25, 6) AS pm25, n_days FROM weekly WHERE station_id IN (
 SELECT station_id FROM weekly WHERE year(week_start) IN (1995, 1996) GROUP BY station_id HAVING count(DISTINCT week_start) >= 0.3 * 105)""", "weekly")(
    lambda v: L.filter_station_coverage(v.weekly, TRAIN_YEARS, 0.3))
q("l04_restrict_stations", "SELECT station_id, n_days FROM stations WHERE station_id IN (SELECT station_id FROM weekly WHERE n_days >= 4)", "stations", "weekly")(
    lambda v: L.restrict_stations(v.stations, v.weekly.where("n_days >= 4")).select("station_id", "n_days"))
q("l05_daily_labels", "SELECT station_id, date, round(pm25, 6) AS pm25 FROM daily WHERE obs_percent >= 75 AND station_id IN (SELECT station_id FROM stations WHERE n_days > 300)", "daily", "stations")(
    lambda v: L.daily_labels(v.daily, v.stations.where("n_days > 300")))
q("l06_label_summary", "SELECT round(quantile_cont(pm25, 0.5), 6) AS median, round(quantile_cont(pm25, 0.95), 6) AS p95, round(max(pm25), 6) AS max FROM weekly", "weekly")(lambda v: L.label_summary(v.weekly))
_OVER = f"""SELECT d.station_id, {_W.format('d.date')} AS week_start, round(avg(d.pm25), 6) AS pm25, count(DISTINCT d.date) AS n_days
 FROM hour_days d JOIN (SELECT DISTINCT station_id, CAST(ts AS DATE) AS date FROM pass_times) p USING (station_id, date) GROUP BY ALL"""


def _pass_dates(v: Views) -> DataFrame:
    return v.pass_times.select("station_id", F.to_date("ts").alias("date"))


for _name in ("l07_overpass_labels", "j01_inner_join"):
    q(_name, _OVER, "hour_days", "pass_times")(lambda v: L.overpass_labels(v.hour_days, _pass_dates(v)))
_HL = "SELECT station_id, scene_date, round(pm25, 6) AS pm25, n_hours, week_start FROM hour_labels"
for _name in ("l08_overpass_hour_labels", "j02_band_join"):
    q(_name, _HL, "hour_labels")(lambda v: v.hour_labels)
q("l09_scene_labels", f"SELECT s.station_id, s.scene_date AS date, round(d.pm25, 6) AS pm25, {_W.format('s.scene_date')} AS week_start FROM scenes s JOIN hour_days d ON s.station_id = d.station_id AND s.scene_date = d.date", "scenes", "hour_days")(
    lambda v: L.scene_labels(_scenes(v), v.hour_days))
q("l10_scenehour_labels")(lambda v: L.scenehour_labels(_scenes(v), v.hour_labels, C.scene_keep(_quality_input(v))))
ORACLE_SQL["l10_scenehour_labels"] = sql("", "hour_labels", "manifest", "scenes") + _QUALITY.strip() + """ SELECT h.station_id, h.scene_date, round(h.pm25, 6) AS pm25, n_hours, week_start
 FROM hour_labels h JOIN scenes s ON h.station_id = s.station_id AND h.scene_date = s.scene_date
 JOIN kept k ON h.station_id = k.station_id AND h.scene_date = k.scene_date AND k.reason = ''"""
_AGREE = f"""SELECT count(*) AS n, round(corr(a.pm25, b.pm25), 6) AS r, round(avg(abs(a.pm25 - b.pm25)), 6) AS mean_abs_diff
 FROM hour_days a JOIN hour_labels b ON a.station_id = b.station_id AND a.date = b.scene_date"""
for _name in ("l11_label_agreement", "j08_self_compare"):
    q(_name, _AGREE, "hour_days", "hour_labels")(lambda v: L.label_agreement(v.hour_days, v.hour_labels.withColumnRenamed("scene_date", "date"), ["station_id", "date"]))
q("l12_ingest_counts", "SELECT CAST(year(date) AS INTEGER) AS year, region, count(*) AS rows, count(DISTINCT station_id) AS stations FROM daily GROUP BY ALL", "daily")(lambda v: L.ingest_counts(v.daily))
q("l13_pass_hours", "SELECT CAST(min(hour(ts)) AS INTEGER) AS first_hour, CAST(max(hour(ts)) AS INTEGER) AS last_hour FROM pass_times", "pass_times")(lambda v: L.pass_hour_range(v.pass_times))

# joins, windows, sets
q("j06_semi_join", "SELECT station_id, week_start FROM weekly WHERE station_id IN (SELECT station_id FROM stations WHERE region = 'ASIA')", "weekly", "stations")(
    lambda v: v.weekly.join(v.stations.where("region = 'ASIA'"), "station_id", "left_semi").select("station_id", "week_start"))
q("j07_anti_join", "SELECT station_id, n_days FROM stations WHERE station_id NOT IN (SELECT station_id FROM weekly WHERE n_days >= 4)", "stations", "weekly")(
    lambda v: v.stations.join(v.weekly.where("n_days >= 4"), "station_id", "left_anti").select("station_id", "n_days"))
q("j07_labels_without_patch", "SELECT station_id, week_start FROM weekly WHERE (station_id, week_start) NOT IN (SELECT (station_id, week_start) FROM image_table)", "weekly", "image_table")(
    lambda v: v.weekly.join(v.embeddings, ["station_id", "week_start"], "left_anti").select("station_id", "week_start"))
_IN = f"""SELECT DISTINCT w.station_id, w.week_start, c.scene_id, c.scene_date FROM weekly w JOIN stations s USING (station_id) JOIN catalog c
 ON c.west <= s.lon + 0.01513513513513 AND c.east >= s.lon - 0.01513513513513 AND c.south <= s.lat + 0.01513513513513 AND c.north >= s.lat - 0.01513513513513
 AND c.scene_date >= w.week_start AND c.scene_date < w.week_start + 7"""


def _jobs(v: Views) -> DataFrame:
    return M.plan_jobs(v.weekly, v.stations)


for _name in ("s07_scenes_in", "j09_overlap_join"):
    q(_name, _IN, "weekly", "stations", "catalog")(lambda v: M.scenes_in(v.catalog, _jobs(v), 7))
q("s08_acquisitions", """SELECT DISTINCT s.station_id, c.scene_date AS ts FROM stations s JOIN catalog c ON s.lon BETWEEN c.west AND c.east AND s.lat BETWEEN c.south AND c.north
 WHERE year(c.scene_date) = 1995""", "stations", "catalog")(lambda v: M.acquisitions(v.catalog.withColumnRenamed("scene_date", "ts"), v.stations, 1995, 1995))
q("s09_extend_cache", "SELECT DISTINCT station_id, CAST(ts AS DATE) AS date FROM pass_times", "pass_times")(
    lambda v: M.extend_cache(_pass_dates(v).where("station_id < '02'").distinct(), _pass_dates(v).select("station_id").distinct(),
                             lambda missing: _pass_dates(v).join(missing, "station_id", "left_semi").distinct()))
q("j10_link_quality", "SELECT p.scene_id, p.station_id, q.item_id FROM patches p LEFT JOIN (SELECT item_id, item_id AS scene_id FROM benchmark) q USING (scene_id)", "patches")(
    lambda v: M.link_quality(v.patches.select("scene_id", "station_id"), v.table("benchmark").select("item_id", F.col("item_id").alias("scene_id"))))
q("w01_first_pass", "SELECT * FROM first_pass", "first_pass")(lambda v: L.first_pass_per_day(v.pass_times))
_MERGED = "SELECT station_id, week_start, product, mode, bands, status, scene_date, ingest_seq FROM merged"
for _name in ("w02_keep_last", "m02_merge_manifest", "u02_drift_union"):
    q(_name, _MERGED, "merged")(lambda v: M.merge_manifest(v.manifest.where("ingest_seq % 2 = 0"), v.manifest.where("ingest_seq % 2 = 1")).drop("valid_fraction"))
q("w03_weeks_per_month", """SELECT station_id, week_start FROM (SELECT *, row_number() OVER (PARTITION BY station_id, date_trunc('month', week_start) ORDER BY week_start) AS rn FROM weekly) WHERE rn <= 2""", "weekly")(
    lambda v: M.weeks_per_month(v.weekly, 2).select("station_id", "week_start"))
_SPREAD = "SELECT station_id FROM (SELECT station_id, row_number() OVER (ORDER BY lat, station_id) - 1 AS rn, greatest(1, count(*) OVER () // {n}) AS step FROM stations) WHERE rn % step = 0 AND rn // step < {n}"
_SPREAD_W = "SELECT week_start FROM (SELECT week_start, row_number() OVER (ORDER BY week_start) - 1 AS rn, greatest(1, count(*) OVER () // {n}) AS step FROM (SELECT DISTINCT week_start FROM weekly)) WHERE rn % step = 0 AND rn // step < {n}"
q("w04_spread_stations", _SPREAD.format(n=7), "stations")(lambda v: M.spread_stations(v.stations, 7).select("station_id"))
q("w05_spread_weeks", f"SELECT station_id, week_start FROM weekly WHERE week_start IN ({_SPREAD_W.format(n=10)})", "weekly")(lambda v: M.spread_weeks(v.weekly, 10).select("station_id", "week_start"))
q("w06_anomaly", "SELECT station_id, date, round(y_true - avg(y_true) OVER (PARTITION BY station_id), 6) AS anomaly FROM predictions", "predictions")(
    lambda v: E.anomaly(v.predictions, "y_true", "station_id").select("station_id", "date", "anomaly"))
q("w07_best_scene", "SELECT station_id, scene_id, scene_date, cloudy_pct FROM best", "best")(lambda v: R.best_scene(v.patches, ["station_id"]).select("station_id", "scene_id", "scene_date", "cloudy_pct"))
q("w08_limit_stations", "SELECT station_id, week_start FROM weekly WHERE station_id IN (SELECT DISTINCT station_id FROM weekly ORDER BY 1 LIMIT 5)", "weekly")(lambda v: M.limit_stations(v.weekly, 5).select("station_id", "week_start"))
for _name in ("w09_scene_jobs", "u03_distinct"):
    q(_name, "SELECT DISTINCT station_id, scene_date FROM manifest WHERE scene_date <> ''", "manifest")(lambda v: M.scene_jobs(v.manifest.where("scene_date <> ''")))
q("w10_sorted_rank", "SELECT station_id, week_start, row_number() OVER (PARTITION BY station_id ORDER BY week_start) AS rank FROM weekly", "weekly")(
    lambda v: v.weekly.selectExpr("station_id", "week_start", "cast(row_number() OVER (PARTITION BY station_id ORDER BY week_start) AS long) AS rank"))
q("u01_bag_union", "SELECT region, count(*) AS n FROM daily GROUP BY region", "daily")(
    lambda v: reduce(DataFrame.unionByName, [v.daily.where("year(date) < 1996"), v.daily.where("year(date) >= 1996")]).groupBy("region").agg(F.count(F.lit(1)).alias("n")))
q("u04_intersect_keys", "SELECT station_id FROM weekly WHERE year(week_start) = 1995 INTERSECT SELECT station_id FROM weekly WHERE year(week_start) = 1996", "weekly")(
    lambda v: v.weekly.where("year(week_start) = 1995").select("station_id").intersect(v.weekly.where("year(week_start) = 1996").select("station_id")))
q("u05_difference", "SELECT station_id, week_start FROM weekly EXCEPT SELECT station_id, week_start FROM weekly WHERE n_days >= 3", "weekly")(
    lambda v: v.weekly.select("station_id", "week_start").exceptAll(v.weekly.where("n_days >= 3").select("station_id", "week_start")).distinct())

# manifest
_JOB = "w.station_id, w.week_start, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg"
q("m01_plan_jobs", f"SELECT {_JOB} FROM weekly w JOIN stations s USING (station_id) WHERE station_id IN ({_SPREAD.format(n=7)}) AND week_start IN ({_SPREAD_W.format(n=10).replace('FROM weekly)', f'FROM weekly WHERE station_id IN ({_SPREAD.format(n=7)}))')})", "weekly", "stations")(
    lambda v: M.plan_jobs(v.weekly, v.stations, 7, 10))


def _week_manifest(v: Views) -> DataFrame:
    """The manifest merged from two parts, its rows under every labelled week of the same number."""
    merged = M.merge_manifest(v.manifest.where("ingest_seq % 2 = 0"), v.manifest.where("ingest_seq % 2 = 1")).withColumn("_n", F.weekofyear("week_start")).drop("week_start")
    return v.weekly.select("station_id", "week_start", F.weekofyear("week_start").alias("_n")).join(merged, ["station_id", "_n"])


q("m03_pending_jobs", """SELECT w.station_id, w.week_start FROM weekly w WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.station_id = w.station_id
 AND weekofyear(m.week_start) = weekofyear(w.week_start) AND product = 'l1c' AND mode = 'single' AND bands = 'rgb' AND status IN ('ok', 'too_cloudy', 'no_images'))
 AND NOT EXISTS (SELECT 1 FROM image_table e WHERE e.station_id = w.station_id AND e.week_start = w.week_start)""", "weekly", "merged", "image_table")(
    lambda v: M.pending_jobs(v.weekly.select("station_id", "week_start"), _week_manifest(v), v.embeddings, "l1c", "single").select("station_id", "week_start"))
q("m04_patch_status", """SELECT scene_id, CASE WHEN n = 0 THEN 'no_images' WHEN f < 0.5 THEN 'too_cloudy' ELSE 'ok' END AS status
 FROM (SELECT scene_id, max(cnt) AS n, avg(cnt) AS f FROM px GROUP BY scene_id)""", "px")(lambda v: M.patch_status(R.patch_stats(v.patches), 0.5).select("scene_id", "status"))
q("m05_status_counts", "SELECT status, count(*) AS n FROM manifest WHERE product = 'l1c' GROUP BY status", "manifest")(lambda v: M.status_counts(v.manifest, "l1c"))
q("m05_sample_errors", "SELECT station_id, ingest_seq FROM manifest WHERE status = 'error' ORDER BY ingest_seq LIMIT 3", "manifest")(lambda v: M.sample_errors(v.manifest).select("station_id", "ingest_seq"))
q("m06_purge_years", "SELECT station_id, week_start FROM weekly WHERE year(week_start) NOT IN (1995, 1996)", "weekly")(lambda v: M.purge_years(v.weekly, TRAIN_YEARS).select("station_id", "week_start"))
q("m07_pending_runs", "SELECT DISTINCT region, fold FROM predictions EXCEPT SELECT DISTINCT region, fold FROM predictions WHERE fold < 2", "predictions")(
    lambda v: M.pending_runs(v.predictions.select("region", "fold").distinct(), v.predictions.where("fold < 2").select("region", "fold")))
q("m08_with_patch", "SELECT station_id, week_start FROM weekly WHERE (station_id, week_start) IN (SELECT station_id, week_start FROM image_table)", "weekly", "image_table")(
    lambda v: M.with_patch(v.weekly, v.embeddings).select("station_id", "week_start"))
q("s06_load_manifest", "SELECT ingest_seq, mode, coalesce(bands, 'rgb') AS bands, scene_date FROM manifest", "manifest")(lambda v: M.with_defaults(v.manifest).select("ingest_seq", "mode", "bands", "scene_date"))


def _drifted(v: Views) -> DataFrame:
    """A manifest of an early version, as it is loaded from a file that lacks columns, and nothing from one that is not there."""
    path = shared_folder(v.spark, "manifest")
    v.manifest.drop("mode", "bands", "scene_date").write.parquet(path)
    return tables.load_manifest(v.spark, path).unionByName(tables.load_manifest(v.spark, path + "-absent").withColumn("week_start", F.col("week_start").cast("date")))


q("s06_drifted_manifest", "SELECT station_id, ingest_seq, status, 'median' AS mode, 'rgb' AS bands, '' AS scene_date, CAST(NULL AS INTEGER) AS n_images FROM manifest", "manifest")(
    lambda v: _drifted(v).select("station_id", "ingest_seq", "status", "mode", "bands", "scene_date", "n_images"))


def _recorded(v: Views) -> DataFrame:
    """The manifest after three jobs, the first of an early version, each with a version of its own."""
    table = tables.manifest_table(v.spark, shared_folder(v.spark, "manifest"))
    tables.record_jobs(table, v.manifest.where("ingest_seq % 3 = 0").drop("mode", "bands"))
    for k in (1, 2):
        tables.record_jobs(table, v.manifest.where(f"ingest_seq % 3 = {k}"))
    return table.read()


_EARLY = """, early AS (SELECT * REPLACE (CASE WHEN ingest_seq % 3 = 0 THEN 'median' ELSE mode END AS mode, CASE WHEN ingest_seq % 3 = 0 THEN 'rgb' ELSE coalesce(bands, 'rgb') END AS bands) FROM manifest)
 SELECT station_id, week_start, product, mode, bands, status, round(valid_fraction, 6) AS valid_fraction, scene_date, ingest_seq FROM (SELECT *,
 row_number() OVER (PARTITION BY station_id, week_start, product, mode, bands ORDER BY {}) AS rn FROM early) WHERE rn = 1"""
# A later job's row replaces an earlier one only with a later number, whatever the order of the jobs.
for _name in ("m02_versioned_manifest", "u02_missing_columns"):
    q(_name)(_recorded)
    ORACLE_SQL[_name] = sql("", "manifest") + _EARLY.format("ingest_seq DESC").strip()


def _rerun(v: Views) -> DataFrame:
    """Predictions of all folds, those of two folds then replaced by another model's, read back and scored with the results that were written last."""
    root, keys = shared_folder(v.spark, "run"), ["fold"]
    first = v.scored.select("station_id", "date", "y_true", "y_pred", "fold")
    tables.write_run(first, E.regression_metrics(first, keys), root, keys)
    again = v.predictions.where("fold >= 3").withColumn("y_pred", F.col("smoke")).select(*first.columns)
    tables.write_run(again, E.regression_metrics(again, keys), root, keys)
    predictions, last = tables.read_run(v.spark, root)
    return E.regression_metrics(predictions, keys).join(last.select("fold", F.col("mae").alias("last_mae")), "fold", "left")


_SCORES = """round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) AS r2, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae, count(*) AS n"""
q("s10_write_run", f"""SELECT fold, {_SCORES}, CASE WHEN fold >= 3 THEN round(avg(abs(y_true - y_pred)), 6) END AS last_mae
 FROM (SELECT fold, y_true, CASE WHEN fold >= 3 THEN smoke ELSE router END AS y_pred FROM predictions) GROUP BY fold""", "predictions")(_rerun)


def _resumed(v: Views) -> DataFrame:
    """Scores of every region and fold: two folds were finished before, the others are made now, from another model."""
    root, keys = shared_folder(v.spark, "runs"), ["region", "fold"]
    rows = v.scored.select("station_id", "date", "y_true", "y_pred", "region", "fold")
    tables.replace_partitions(rows.where("fold < 2"), root, keys)
    new = v.predictions.withColumn("y_pred", F.col("smoke")).select(*rows.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return N.resume_metrics(rows.select(*keys).distinct(), root, lambda todo: new.join(todo, keys, "left_semi").select(*rows.columns), schema)


q("m07_resume_metrics", f"""WITH p AS (SELECT region, fold, station_id, y_true, CASE WHEN fold < 2 THEN router ELSE smoke END AS y_pred FROM predictions),
 b AS (SELECT region, fold, CASE WHEN count(*) >= 3 THEN round(1 - sum((t - q) ** 2) / (var_pop(t) * count(*)), 6) END AS between_station_r2 FROM (
  SELECT region, fold, station_id, avg(y_true) AS t, avg(y_pred) AS q FROM p GROUP BY ALL) GROUP BY ALL),
 w AS (SELECT region, fold, round(1 - sum((t - q) ** 2) / sum(t ** 2), 6) AS within_station_r2 FROM (SELECT region, fold, y_true - avg(y_true) OVER g AS t, y_pred - avg(y_pred) OVER g AS q FROM p
  WINDOW g AS (PARTITION BY region, fold, station_id)) GROUP BY ALL)
 SELECT * FROM (SELECT region, fold, {_SCORES} FROM p GROUP BY ALL) JOIN b USING (region, fold) JOIN w USING (region, fold)""", "predictions")(_resumed)
ORACLE_SQL["m07_resume_metrics"] = ORACLE_SQL["m07_resume_metrics"].replace(" WITH p AS", ", p AS")

# pixels
_BAD = "scl IN (0, 1, 3, 8, 9, 10, 11)"
_LIST = "list(round({x}, 6) ORDER BY i) AS {b}"


def _lists(expr: str) -> str:
    return ", ".join(_LIST.format(x=expr.format(b=b), b=b) for b in ("b4", "b3", "b2"))


q("r01_mask_by_class", f"SELECT scene_id, {', '.join(f'list(CASE WHEN {_BAD} THEN NULL ELSE {b} END ORDER BY i) AS {b}' for b in ('b4', 'b3', 'b2'))} FROM px GROUP BY scene_id", "px")(
    lambda v: R.mask_by_class(v.patches).select("scene_id", *R.RGB))
q("r02_mask_by_score", f"SELECT scene_id, {', '.join(f'list(CASE WHEN scl / 12.0 >= 0.6 THEN {b} END ORDER BY i) AS {b}' for b in ('b4', 'b3', 'b2'))} FROM px GROUP BY scene_id", "px")(
    lambda v: R.mask_by_score(v.patches.withColumn("score", F.transform("scl", lambda s: s / 12.0))).select("scene_id", *R.RGB))
_MED = "CAST(coalesce(floor(median({b}) FILTER (NOT {bad})), 0) AS INTEGER) AS {b}"
_COMPOSITE = f"""SELECT station_id, list(b4 ORDER BY i) AS b4, list(b3 ORDER BY i) AS b3, list(b2 ORDER BY i) AS b2, list(cnt ORDER BY i) AS cnt FROM (
 SELECT station_id, i, {', '.join(_MED.format(b=b, bad=_BAD) for b in ('b4', 'b3', 'b2'))}, CAST(count(*) FILTER (NOT {_BAD}) AS INTEGER) AS cnt FROM px GROUP BY station_id, i) GROUP BY station_id"""
q("r03_median_composite", _COMPOSITE, "px")(lambda v: R.median_composite(R.mask_by_class(v.patches), ["station_id"]))
q("r03_median_composite_arrays", _COMPOSITE, "px")(lambda v: R.median_composite(R.mask_by_class(v.patches), ["station_id"], tile=5))
q("r04_scene_patch", f"""SELECT b.station_id, b.scene_id, b.b4, [CAST(NOT list_contains([0, 1, 3, 8, 9, 10, 11], s) AS INTEGER) for s in b.scl] AS cnt,
 CAST(b.scene_date - DATE '1970-01-01' AS INTEGER) AS day FROM best b""", "best")(lambda v: R.scene_patch(v.patches, ["station_id"]).select("station_id", "scene_id", "b4", "cnt", "day"))
q("r05_patch_stats", "SELECT scene_id, round(avg(cnt), 6) AS valid_fraction, max(cnt) AS n_images FROM px GROUP BY scene_id", "px")(lambda v: R.patch_stats(v.patches).select("scene_id", "valid_fraction", "n_images"))
q("r05_scene_stats", "SELECT station_id, strftime(scene_date, '%Y-%m-%d') AS scene_date, 1 AS n_images FROM best", "best")(
    lambda v: R.patch_stats(R.scene_patch(v.patches, ["station_id"]), "scene").select("station_id", "scene_date", "n_images"))
q("r06_zero_fraction", "SELECT scene_id, round(avg(CAST(b4 = 0 AND b3 = 0 AND b2 = 0 AS INTEGER)), 6) AS zero_frac FROM px GROUP BY scene_id", "px")(lambda v: R.zero_fraction(v.patches).select("scene_id", "zero_frac"))
_LIT = "CAST(b4 > 0 OR b3 > 0 OR b2 > 0 AS INTEGER)"
_FILL = ", ".join(f"CASE WHEN {_LIT} = 1 OR sum({_LIT}) OVER w = 0 THEN {b} ELSE sum({b}) OVER w / sum({_LIT}) OVER w END AS {b}" for b in ("b4", "b3", "b2"))
_FILLED = f"(SELECT scene_id, i, {_FILL} FROM px WINDOW w AS (PARTITION BY scene_id))"
q("r07_fill_invalid", f"SELECT scene_id, {_lists('{b}')} FROM {_FILLED} GROUP BY scene_id", "px")(lambda v: R.fill_invalid(v.patches).select("scene_id", *R.RGB))
_SHOW = "least(1.0, greatest(0.0, {b} / 10000.0 * 3.0))"
q("r08_to_display", f"SELECT scene_id, {_lists(_SHOW)} FROM px GROUP BY scene_id", "px")(lambda v: R.to_display(v.patches).select("scene_id", *R.RGB))


def _normal(source: str) -> str:
    parts = [f"list(round(({_SHOW.format(b=b)} - {m}) / {s}, 6) + 0.0 ORDER BY i)" for b, m, s in zip(("b4", "b3", "b2"), R.MEAN, R.STD, strict=True)]
    return f"SELECT scene_id, list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]}) AS x FROM {source} GROUP BY scene_id"


q("r09_normalize", _normal("px"), "px")(lambda v: _positive_zeros(R.normalize(R.to_display(v.patches)).select("scene_id", "x"), "x"))
q("r10_preprocess", _normal(_FILLED), "px")(lambda v: _positive_zeros(R.preprocess(v.patches).select("scene_id", "x"), "x"))
_PICK = "(SELECT scene_id FROM patches ORDER BY md5(CAST(scene_id AS VARCHAR) || '|0') LIMIT 300)"
_STATS = ", ".join(f"avg({b}) AS {b}_mean, stddev_pop({b}) + 1e-6 AS {b}_std" for b in ("b4", "b3", "b2"))
q("r11_band_stats", "SELECT " + ", ".join(f"round(avg({b}), 6) AS {b}_mean, round(stddev_pop({b}) + 1e-6, 6) AS {b}_std" for b in ("b4", "b3", "b2")) + f" FROM px WHERE scene_id IN {_PICK}", "px")(
    lambda v: R.band_stats(v.patches, ["scene_id"]))
q("r12_standardize", "SELECT scene_id, " + ", ".join(f"list(round(({b} - {b}_mean) / {b}_std, 6) ORDER BY i) AS {b}" for b in ("b4", "b3", "b2")) + f" FROM px, (SELECT {_STATS} FROM px WHERE scene_id IN {_PICK}) GROUP BY scene_id", "px")(
    lambda v: R.standardize(v.patches, R.band_stats(v.patches, ["scene_id"])).select("scene_id", *R.RGB))
q("r13_augment", """SELECT scene_id, turn, list(b4_src ORDER BY i) AS b4 FROM (
 SELECT a.scene_id, a.turn, a.i, p.b4 AS b4_src FROM (
  SELECT scene_id, i, turn, CASE WHEN turn % 2 = 1 THEN 3 - (i - 1) % 4 ELSE (i - 1) % 4 END AS x, CASE WHEN turn // 2 % 2 = 1 THEN 3 - (i - 1) // 4 ELSE (i - 1) // 4 END AS y
  FROM (SELECT scene_id, i, CAST(CAST('0x' || md5(CAST(scene_id AS VARCHAR) || '|0')[1] AS INTEGER) % 8 AS INTEGER) AS turn FROM px)) a
 JOIN px p ON p.scene_id = a.scene_id AND p.i = 1 + CASE WHEN a.turn >= 4 THEN a.x * 4 + a.y ELSE a.y * 4 + a.x END) GROUP BY scene_id, turn""", "px")(
    lambda v: R.augment(v.patches, ["scene_id"], 4).select("scene_id", "turn", "b4"))
q("r14_brightness", "SELECT scene_id, round((sum(b4) + sum(b3) + sum(b2)) / 48.0, 6) AS brightness FROM px GROUP BY scene_id", "px")(lambda v: R.brightness(v.patches).select("scene_id", "brightness"))
q("r14_brightness_probe", """SELECT count(*) AS n, round(corr(brightness, anomaly), 6) AS r FROM (SELECT scene_id, (sum(b4) + sum(b3) + sum(b2)) / 48.0 AS brightness FROM px GROUP BY scene_id)
 JOIN (SELECT scene_id, cloudy_pct - avg(cloudy_pct) OVER (PARTITION BY station_id) AS anomaly FROM patches) USING (scene_id)""", "px")(
    lambda v: R.brightness_probe(v.patches, v.patches.select("scene_id", "station_id", F.col("cloudy_pct").alias("pm25")), ["scene_id"]))
q("r15_select_bands", "SELECT scene_id, b4, b2 FROM patches", "patches")(lambda v: R.select_bands(v.patches, ["scene_id"], ["b4", "b2"]))

_CAPPED = "(SELECT scene_id, i, least(b4, 65535) AS b4, least(b3, 65535) AS b3, least(b2, 65535) AS b2 FROM px)"
q("s04_patches_of_thirteen_bands", _normal(_FILLED.replace("FROM px", f"FROM {_CAPPED}")), "px")(
    lambda v: _positive_zeros(R.preprocess(patches.scan_patches(v.spark, _patch_files(v), R.RGB)).select(F.substring_index("key", "_", -1).cast("long").alias("scene_id"), "x"), "x"))
q("s04_patch_shapes", """SELECT station_id, strftime(scene_date, '%Y-%m-%d') || '_' || CAST(scene_id AS VARCHAR) AS key, 4 AS height, 4 AS width, 13 AS channels FROM patches""", "patches")(
    lambda v: patches.scan_patches(v.spark, _patch_files(v)))

# places
q("g01_utm_epsg", "SELECT station_id, CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM stations", "stations")(lambda v: v.stations.select("station_id", X.utm_epsg("lon").alias("epsg")))
_UTM = """, z AS (SELECT station_id, lat, lon, floor((lon + 180) / 6) + 1 AS zone, 0.0033528106647474805 / (2 - 0.0033528106647474805) AS n FROM stations),
k AS (SELECT *, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a, 2 * sqrt(n) / (1 + n) AS c, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2,
 61 * n ** 3 / 240 AS a3, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam FROM z),
t AS (SELECT *, sinh(atanh(sin(phi)) - c * atanh(c * sin(phi))) AS t FROM k), x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
utm AS (SELECT station_id, CAST(32600 + zone AS INTEGER) AS epsg, 500000 + 0.9996 * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS east,
 0.9996 * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS north FROM x) """


def _utm(v: Views) -> DataFrame:
    east, north = X.to_utm("lat", "lon", "epsg")
    return v.stations.withColumn("epsg", X.utm_epsg("lon")).select("station_id", "epsg", _round(east, 3).alias("east"), _round(north, 3).alias("north"))


q("g02_to_utm")(_utm)
ORACLE_SQL["g02_to_utm"] = sql("", "stations") + _UTM.strip() + " SELECT station_id, epsg, round(east, 3) AS east, round(north, 3) AS north FROM utm"
q("g03_patch_grid")(lambda v: R.patch_grid(v.stations).select("station_id", "epsg", "x0", "y0").withColumns({c: F.col(c).cast("double") for c in ("x0", "y0")}))
ORACLE_SQL["g03_patch_grid"] = sql("", "stations") + _UTM.strip() + " SELECT station_id, epsg, CAST(floor((east - 1120) / 10) * 10 AS DOUBLE) AS x0, CAST(ceil((north + 1120) / 10) * 10 AS DOUBLE) AS y0 FROM utm"
q("g04_patch_bbox", """SELECT station_id, round(lon - h, 6) AS west, round(lat - h, 6) AS south, round(lon + h, 6) AS east, round(lat + h, 6) AS north
 FROM stations, (SELECT CAST(1120.0 AS DOUBLE) / 111000 * 1.5 AS h)""", "stations")(lambda v: v.stations.select("station_id", *X.bbox("lat", "lon")))
q("g05_request_grid")(lambda v: R.patch_grid(v.stations).select("station_id", F.col("grid.width").alias("width"), F.col("grid.scale_y").alias("scale_y"), F.col("grid.crs").alias("crs")))
ORACLE_SQL["g05_request_grid"] = sql("SELECT station_id, 224 AS width, CAST(-10 AS DOUBLE) AS scale_y, 'EPSG:' || CAST(CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS VARCHAR) AS crs FROM stations", "stations")


# model tables, splits, weights
def _model(v: Views) -> DataFrame:
    return A.assemble(v.weekly, v.embeddings, v.stations)


_MT = "SELECT station_id, week_start, round(pm25, 6) AS pm25, round(lat, 6) AS lat, region, CAST(year AS INTEGER) AS year, CAST(week_of_year AS INTEGER) AS week_of_year FROM model_table"
for _name in ("a01_assemble", "j03_label_join", "j04_station_join"):
    q(_name, _MT, "model_table")(lambda v: _model(v).select("station_id", "week_start", "pm25", "lat", "region", "year", "week_of_year"))
q("j05_left_default", "SELECT h.station_id, h.scene_date, round(coalesce(f.v, 1.0), 6) AS valid_fraction FROM hour_labels h LEFT JOIN (SELECT station_id, CAST(scene_date AS DATE) AS d, min(valid_fraction) AS v FROM manifest WHERE mode = 'single' AND product = 'l1c' GROUP BY ALL) f ON h.station_id = f.station_id AND h.scene_date = f.d", "hour_labels", "manifest")(
    lambda v: _quality_input(v).select("station_id", "scene_date", F.coalesce("valid_fraction", F.lit(1.0)).alias("valid_fraction")))
q("a02_assembly_report", """SELECT (SELECT count(*) FROM weekly) AS n_labels, (SELECT count(*) FROM image_table) AS n_embeddings, count(*) AS n_joined,
 count(DISTINCT station_id) AS n_stations, (SELECT count(*) FROM weekly) - count(*) AS labels_without_patch FROM model_table""", "model_table")(lambda v: A.assembly_report(v.weekly, v.embeddings, _model(v)))
q("a03_features", "SELECT station_id, week_start, list_transform(list_concat(CAST(embedding AS DOUBLE[]), [lat, lon, CAST(week_of_year AS DOUBLE)]), lambda x: round(x, 6)) AS features FROM model_table", "model_table")(
    lambda v: A.features(_model(v), "fused").select("station_id", "week_start", "features"))
q("a04_labels_for", "SELECT station_id, week_start, round(pm25, 6) AS pm25, n_days FROM weekly", "weekly")(lambda v: A.labels_for("weekly", v.daily, min_days=2))
q("a04_overpass_labels", _OVER, "hour_days", "pass_times")(lambda v: A.labels_for("overpass", v.hour_days, _pass_dates(v)))
q("a04_scene_labels", ORACLE_SQL["l09_scene_labels"])(lambda v: A.labels_for("scene", v.hour_days, scenes=_scenes(v)))
q("a04_scenehour_labels", ORACLE_SQL["l10_scenehour_labels"])(lambda v: A.labels_for("scenehour", None, scenes=_scenes(v), hour_labels=v.hour_labels, keep=C.scene_keep(_quality_input(v))))
q("a05_duplicate_keys", "SELECT station_id, scene_date, count(*) AS n FROM manifest GROUP BY ALL HAVING count(*) > 1", "manifest")(lambda v: A.duplicate_keys(v.manifest, ["station_id", "scene_date"]))
q("p01_random_split", """SELECT station_id, date, 0 AS fold, CASE WHEN rn <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (SELECT station_id, date,
 row_number() OVER (ORDER BY md5(station_id || '|' || CAST(date AS VARCHAR) || '|0'), station_id, date) AS rn, count(*) OVER () AS n FROM daily)""", "daily")(
    lambda v: A.random_split(v.daily.select("station_id", "date"), ["station_id", "date"]))
_FOLDS = """(SELECT station_id, CAST(CASE WHEN rn % 10 < 5 THEN rn % 10 ELSE 9 - rn % 10 END AS INTEGER) AS fold FROM (
 SELECT station_id, row_number() OVER (ORDER BY count(*) DESC, station_id) - 1 AS rn FROM daily GROUP BY station_id))"""
q("p02_spatial_folds", f"SELECT d.station_id, d.date, f.fold FROM daily d JOIN {_FOLDS} f USING (station_id)", "daily")(lambda v: A.spatial_folds(v.daily.select("station_id", "date")))
q("p03_temporal_split", "SELECT station_id, week_start, CASE WHEN year(week_start) < 1996 THEN 'train' WHEN year(week_start) = 1996 THEN 'test' END AS split FROM weekly", "weekly")(
    lambda v: A.temporal_split(v.weekly, 1996).select("station_id", "week_start", "split"))
q("p04_region_split", "SELECT d.region, f.fold, CASE WHEN d.region = f.fold THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM daily d, (SELECT DISTINCT region AS fold FROM daily) f GROUP BY ALL", "daily")(
    lambda v: A.region_split(v.daily).groupBy("region", "fold", "split").agg(F.count(F.lit(1)).alias("n")))
_HOLD = """(SELECT station_id, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY md5(station_id || '|0')) <= greatest(1, floor(0.2 * count(*) OVER (PARTITION BY region))) THEN 'test' ELSE 'train' END AS split
 FROM (SELECT DISTINCT station_id, region FROM daily))"""
q("p05_station_holdout", f"SELECT d.station_id, d.date, s.split FROM daily d JOIN {_HOLD} s USING (station_id)", "daily")(lambda v: A.station_holdout(v.daily).select("station_id", "date", "split"))
q("p06_final_split", "SELECT station_id, week_start, 0 AS fold, 'train' AS split FROM weekly", "weekly")(lambda v: A.final_split(v.weekly).select("station_id", "week_start", "fold", "split"))
q("p07_val_carveout", f"""SELECT d.station_id, d.date, CASE WHEN c.station_id IS NOT NULL THEN 'val' ELSE s.split END AS split FROM daily d JOIN {_HOLD} s USING (station_id) LEFT JOIN (
 SELECT station_id FROM (SELECT station_id, row_number() OVER (ORDER BY md5(station_id || '|0')) AS rn, greatest(1, floor(0.1 * count(*) OVER ())) AS n FROM {_HOLD} WHERE split = 'train') WHERE rn <= n) c ON c.station_id = d.station_id""", "daily")(
    lambda v: A.val_carveout(A.station_holdout(v.daily)).select("station_id", "date", "split"))
q("p08_leakage_report", "SELECT 0 AS fold, count(*) AS units, 0 AS leaks FROM (SELECT DISTINCT station_id FROM daily)", "daily")(lambda v: A.leakage_report(A.station_holdout(v.daily)).withColumn("leaks", F.col("leaks").cast("int")))
q("p08_leaking_split", """SELECT 0 AS fold, count(*) AS units, CAST(count(*) FILTER (s > 1) AS INTEGER) AS leaks FROM (SELECT station_id, count(DISTINCT split) AS s FROM (
 SELECT station_id, CASE WHEN row_number() OVER (ORDER BY md5(station_id || '|' || CAST(date AS VARCHAR) || '|0'), station_id, date) <= floor(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split
 FROM daily) GROUP BY station_id)""", "daily")(
    lambda v: A.leakage_report(A.random_split(v.daily.select("station_id", "date"), ["station_id", "date"])).withColumn("leaks", F.col("leaks").cast("int")))
q("p09_split_composition", f"""SELECT 0 AS fold, region, count(DISTINCT station_id) FILTER (split = 'test') AS test_stations, count(DISTINCT station_id) AS stations,
 round(count(DISTINCT station_id) FILTER (split = 'test') / count(DISTINCT station_id), 6) AS test_share FROM daily JOIN {_HOLD} USING (station_id) GROUP BY region""", "daily")(lambda v: A.split_composition(A.station_holdout(v.daily)))
_D = "SELECT station_id, date, round({}, 6) AS weight FROM daily"
q("h01_weight_high", _D.format("CASE WHEN pm25 > 35 THEN 5.0 WHEN pm25 > 20 THEN 2.5 ELSE 1.0 END"), "daily")(lambda v: A.weight_high(v.daily, 5.0).select("station_id", "date", "weight"))
_BK = "CASE WHEN pm25 <= 6 THEN {} WHEN pm25 <= 12 THEN {} WHEN pm25 <= 35 THEN {} WHEN pm25 <= 55 THEN {} WHEN pm25 > 55 THEN {} ELSE {} END"
q("h02_weight_buckets", _D.format(_BK.format(1.0, 1.5, 2.0, 4.0, 8.0, 1.0)), "daily")(lambda v: A.weight_buckets(v.daily, [1, 1.5, 2, 4, 8]).select("station_id", "date", "weight"))
_BN = _BK.format(0, 1, 2, 3, 4, "NULL")
_BAL = f"SELECT d.station_id, d.date, round({{}}, 6) AS weight FROM (SELECT *, {_BN} AS b FROM daily) d LEFT JOIN (SELECT b, max(count(*)) OVER () / count(*) AS w FROM (SELECT {_BN} AS b FROM daily) WHERE b IS NOT NULL GROUP BY b) c ON d.b = c.b"
q("h03_weight_balanced", _BAL.format("coalesce(w, 1)"), "daily")(lambda v: A.weight_balanced(v.daily).select("station_id", "date", "weight"))
q("h03_weight_damped", _BAL.format("sqrt(coalesce(w, 1))"), "daily")(lambda v: A.weight_balanced(v.daily, True).select("station_id", "date", "weight"))
_POINTS = f"floor(CAST({{}} AS DOUBLE) * (CAST(n AS DOUBLE) / CAST(total AS DOUBLE)) - {A.resample_offset(0)!r}::DOUBLE)"
q("h04_weighted_resample", f"""SELECT station_id, date, copies FROM (SELECT station_id, date, CAST({_POINTS.format("upto")} - {_POINTS.format("upto - u")} AS BIGINT) AS copies FROM (
 SELECT station_id, date, u, count(*) OVER () AS n, sum(u) OVER () AS total, sum(u) OVER (ORDER BY md5(station_id || '|' || CAST(date AS VARCHAR) || '|0'), station_id, date) AS upto FROM (
 SELECT station_id, date, CAST(floor(w / max(w) OVER () * 1099511627776) AS HUGEINT) AS u FROM (
 SELECT *, CASE WHEN pm25 > 35 THEN 5.0::DOUBLE WHEN pm25 > 20 THEN 2.5 ELSE 1.0 END AS w FROM daily)))) WHERE copies > 0""", "daily")(
    lambda v: A.weighted_resample(A.weight_high(v.daily, 5.0), ["station_id", "date"]).groupBy("station_id", "date").agg(F.count(F.lit(1)).alias("copies")))
q("h05_pos_weight", "SELECT count(*) FILTER (pm25 > 20) AS pos, count(*) FILTER (pm25 <= 20) AS neg, round(count(*) FILTER (pm25 <= 20) / greatest(count(*) FILTER (pm25 > 20), 1), 6) AS pos_weight FROM daily", "daily")(
    lambda v: A.pos_weight(v.daily, 20))

# evaluation
_SCORE = "round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) AS r2, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae, count(*) AS n"
q("e01_regression_metrics", f"SELECT fold, {_SCORE} FROM scored GROUP BY fold", "scored")(lambda v: E.regression_metrics(v.scored, ["fold"]))
q("e02_between_r2", """SELECT fold, CASE WHEN count(*) >= 3 THEN round(1 - sum((t - p) ** 2) / (var_pop(t) * count(*)), 6) END AS between_station_r2, count(*) AS stations
 FROM (SELECT fold, station_id, avg(y_true) AS t, avg(y_pred) AS p FROM scored GROUP BY ALL) GROUP BY fold""", "scored")(lambda v: E.between_r2(v.scored, ["fold"]))
q("e03_within_r2", """SELECT fold, round(1 - sum((t - p) ** 2) / sum(t ** 2), 6) AS within_station_r2 FROM (SELECT fold, y_true - avg(y_true) OVER w AS t, y_pred - avg(y_pred) OVER w AS p FROM scored
 WINDOW w AS (PARTITION BY fold, station_id)) GROUP BY fold""", "scored")(lambda v: E.within_r2(v.scored, ["fold"]))
_CLASS = """SELECT {by}, round(avg(CAST(y_true > 35 AS INTEGER)), 6) AS prevalence, round(avg(CAST((y_true > 35) = (y_pred > 35) AS INTEGER)), 6) AS accuracy,
 round(CASE WHEN sum(CAST(y_true > 35 AS INTEGER) + CAST(y_pred > 35 AS INTEGER)) > 0 THEN 2.0 * count(*) FILTER (y_true > 35 AND y_pred > 35) / sum(CAST(y_true > 35 AS INTEGER) + CAST(y_pred > 35 AS INTEGER)) ELSE 0 END, 6) AS f1,
 round((sum(rk) FILTER (y_true > 35) - count(*) FILTER (y_true > 35) * (count(*) FILTER (y_true > 35) + 1) / 2) / nullif(count(*) FILTER (y_true > 35) * count(*) FILTER (y_true <= 35), 0), 6) AS auc
 FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y_pred) + (count(*) OVER (PARTITION BY {by}, y_pred) - 1) / 2 AS rk FROM scored) GROUP BY {by}"""
q("e04_classification_metrics", _CLASS.format(by="fold"), "scored")(lambda v: E.classification_metrics(v.scored, by=["fold"]))
_FM = f"(SELECT region, fold, {_SCORE.replace('round(', '(').replace(', 6)', ')')} FROM scored GROUP BY ALL)"
q("e05_summarize_folds", f"SELECT region, count(*) AS n_folds, round(avg(r2), 6) AS r2, round(avg(mae), 6) AS mae FROM {_FM} GROUP BY region", "scored")(
    lambda v: E.summarize_folds(E.regression_metrics(v.scored, ["region", "fold"]), ["region"], ["r2", "mae"]))
q("e05_fold_spread", f"SELECT region, round(median(mae), 6) AS median, round(min(mae), 6) AS min, round(max(mae), 6) AS max FROM {_FM} GROUP BY region", "scored")(
    lambda v: E.fold_spread(E.regression_metrics(v.scored, ["region", "fold"]), ["region"], "mae"))
q("e05_summarize_seeds", f"SELECT region, round(avg(mae), 3) AS mae FROM {_FM} GROUP BY region", "scored")(
    lambda v: E.summarize_seeds(E.regression_metrics(v.scored, ["region", "fold"]), ["region"], ["mae"]))
q("e06_common_exam", """SELECT model, count(*) AS n, round(avg(y_pred), 6) AS mean_pred FROM long_predictions WHERE y_true >= 5 AND station_id NOT IN (
 SELECT station_id FROM stations WHERE n_days > 1200) AND (station_id, date) IN (SELECT (station_id, date) FROM long_predictions WHERE y_true >= 5 GROUP BY station_id, date HAVING count(DISTINCT model) = 3) GROUP BY model""", "long_predictions", "stations")(
    lambda v: E.common_exam(v.long_predictions, v.stations.where("n_days > 1200").withColumn("model", F.lit("clean")), ["station_id", "date"], 5.0).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred")))
q("e07_bucket_errors", """SELECT bucket, count(*) AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(avg(y_pred - y_true), 6) AS bias, round(avg(y_true), 6) AS mean_true, round(avg(y_pred), 6) AS mean_pred
 FROM bucketed GROUP BY bucket""", "bucketed")(lambda v: E.bucket_errors(v.scored))
q("e08_region_metrics", f"SELECT region, {_SCORE}, count(DISTINCT station_id) AS stations FROM scored GROUP BY region", "scored")(
    lambda v: E.regression_metrics(v.scored, ["region"]).join(E.between_r2(v.scored, ["region"]).select("region", "stations"), "region"))
q("e09_hit_rates", """SELECT fold, round(median(abs(y_pred - y_true)), 6) AS median_abs_error, round(avg(CAST(abs(y_pred - y_true) <= 3 AS INTEGER)), 6) AS within_3,
 round(avg(CAST(abs(y_pred - y_true) <= 5 AS INTEGER)), 6) AS within_5, round(avg(y_pred - y_true), 6) AS bias FROM scored GROUP BY fold""", "scored")(lambda v: E.hit_rates(v.scored, ["fold"]))
q("e10_calibration", "SELECT station_id, count(*) AS n, round(avg(y_true), 6) AS mean_true, round(avg(y_pred), 6) AS mean_pred FROM scored GROUP BY station_id", "scored")(lambda v: E.calibration(v.scored, ["station_id"]))
q("e11_consolidate", f"SELECT CAST(fold AS VARCHAR) AS grp, {_SCORE} FROM scored GROUP BY fold UNION ALL SELECT region, {_SCORE} FROM scored GROUP BY region", "scored")(
    lambda v: E.consolidate([E.regression_metrics(v.scored, ["fold"]).withColumn("grp", F.col("fold").cast("string")).drop("fold"), E.regression_metrics(v.scored, ["region"]).withColumnRenamed("region", "grp")]))
_ARM = "(SELECT model, avg(abs(y_true - y_pred)) AS mae, count(*) + avg(y_pred) AS level FROM long_predictions GROUP BY model)"
q("e12_column_winners", f"SELECT 'mae' AS metric, arg_min(model, mae) AS model, round(min(mae), 6) AS value FROM {_ARM} UNION ALL SELECT 'level', arg_max(model, level), round(max(level), 6) FROM {_ARM}", "long_predictions")(
    lambda v: E.column_winners(v.long_predictions.groupBy("model").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"), (F.count(F.lit(1)) + F.avg("y_pred")).alias("level")), "model", {"mae": "min", "level": "max"}))
q("x01_route_hard", "SELECT station_id, date, round(CASE WHEN router >= 20 THEN smoke ELSE clean END, 6) AS y_pred FROM predictions", "predictions")(lambda v: E.route_hard(v.predictions).select("station_id", "date", "y_pred"))
_SWEEP = """, swept AS (SELECT threshold, y_true, CAST(router >= threshold AS INTEGER) AS routed, CASE WHEN router >= threshold THEN smoke ELSE clean END AS y_pred FROM predictions, (SELECT unnest([10.0::DOUBLE, 15.0, 20.0, 25.0]) AS threshold))
 SELECT c.*, s.r2, s.rmse, s.mae, s.n, s.routed_share FROM (""" + _CLASS.format(by="threshold").replace("FROM scored", "FROM swept") + f") c JOIN (SELECT threshold, {_SCORE}, round(avg(routed), 6) AS routed_share FROM swept GROUP BY threshold) s USING (threshold)"
q("x02_route_sweep")(lambda v: E.route_sweep(v.predictions))
ORACLE_SQL["x02_route_sweep"] = sql("", "predictions") + _SWEEP.strip()
q("x03_blend_soft", "SELECT station_id, date, round((1 - p) * clean + p * smoke, 6) AS y_pred FROM (SELECT *, 1 / (1 + exp(-(router - 20) / 3)) AS p FROM predictions)", "predictions")(lambda v: E.blend_soft(v.predictions).select("station_id", "date", "y_pred"))
q("x04_ensemble_mean", "SELECT station_id, date, round((router + clean + smoke) / 3, 6) AS y_pred, 3 AS n_models FROM predictions", "predictions")(lambda v: E.ensemble_mean(v.long_predictions, ["station_id", "date"]))
q("x05_align_models", "SELECT station_id, date, round(router, 6) AS router, round(clean, 6) AS clean, round(smoke, 6) AS smoke FROM predictions", "predictions")(
    lambda v: E.align_models(v.long_predictions, ["station_id", "date"], ["router", "clean", "smoke"]))

# models (checked by tests, not by SQL)
q("n01_embed")(lambda v: N.embed(R.preprocess(v.patches), 48).select("scene_id", "embedding"))


def _staged_model(v: Views) -> DataFrame:
    """The model table from days that are written once, as both weeks and stations are made of them."""
    v.daily = staged(v.daily, shared_folder(v.spark, "daily"))
    return _model(v)


def _split_table(v: Views, kind: str) -> DataFrame:
    return A.features(A.station_holdout(_staged_model(v)), kind)


# The sizes of the surveyed work: 2,000 rounds at most, 300 trees, three seeds.
q("n02_gbt")(lambda v: N.fit_predict(_split_table(v, "spacetime"), "gbt", 2000))
q("n03_forest")(lambda v: N.fit_predict(_split_table(v, "spacetime"), "rf", 300))
q("n04_fit_predict")(lambda v: N.fit_predict(_split_table(v, "fused"), "rf", 300))
q("n05_run_grid")(lambda v: N.run_grid(_staged_model(v), ["station_id", "week_start"], ["image", "spacetime", "fused"], {"rf": 300, "gbt": 2000}, ["random", "spatial", "temporal"], [0, 1, 2], year=1996))
q("n06_classifier")(lambda v: N.fit_classifier(_split_table(v, "spacetime")))
q("n07_log_target")(lambda v: N.fit_log_target(_split_table(v, "spacetime"), 300))
