"""Logical tables as views over the driver's tables, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.functions import scalars as X
from airlake.operators import clean, labels


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def regions(self) -> DataFrame:
        return self.table("region").select(F.col("r_name").alias("region"), F.col("r_regionkey").cast("string").alias("state_code"))

    @cached_property
    def readings_raw(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
        )
        sites = (
            self.table("supplier").join(self.table("nation"), F.expr("s_nationkey = n_nationkey"))
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey")).select("s_suppkey", "s_name", "n_nationkey", "n_regionkey", "r_name")
        )
        return lines.join(sites, F.expr("l_suppkey = s_suppkey")).select(
            F.col("n_regionkey").cast("string").alias("state_code"), F.col("n_nationkey").cast("string").alias("county_code"), F.lit("1").alias("site_num"),
            F.col("r_name").alias("region"), F.col("l_suppkey").alias("poc"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"),
            F.to_date("l_shipdate").alias("date_local"),
            F.expr("CASE WHEN l_orderkey % 97 <> 0 THEN (l_quantity - 2) * IF(l_discount > 0.095, 8, 1) END").alias("arithmetic_mean"),
            F.expr("100 - 4 * round(100 * l_tax)").alias("obs_percent"),
            F.expr("CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Excluded' WHEN l_returnflag = 'A' THEN 'Included' END").alias("event_type"),
            F.expr("CASE WHEN l_linenumber = 1 THEN '1 HOUR' WHEN l_linenumber <= 3 THEN '24 HOUR' WHEN l_linenumber <= 6 THEN '24-HR BLK AVG' END").alias("sample_duration"),
            F.expr("25 + 0.9D * n_nationkey + 0.01D * (l_suppkey % 7)").alias("lat"), F.expr("-124 + 2.1D * n_nationkey").alias("lon"),
            F.expr("IF(l_suppkey % 2 = 0, NULL, s_name)").alias("site_name"), F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        return clean.clean_daily(self.readings_raw, self.regions)

    @cached_property
    def weekly(self) -> DataFrame:
        return labels.aggregate_weekly(self.daily, min_days=2)

    @cached_property
    def stations(self) -> DataFrame:
        return labels.build_stations(self.daily)

    @cached_property
    def hourly_raw(self) -> DataFrame:
        return self.table("events").where("event_type <> 'view'").select(
            F.expr("cast(user_id % 25 % 5 as string)").alias("state_code"), F.expr("cast(user_id % 25 as string)").alias("county_code"), F.lit("1").alias("site_num"),
            F.expr("user_id div 25").alias("poc"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("date_gmt"),
            F.date_format("ts", "HH:00").alias("time_gmt"), F.expr("IF(event_id % 11 = 0, NULL, value - 5)").alias("sample_measurement"),
        )

    @cached_property
    def hourly(self) -> DataFrame:
        return clean.clean_hourly(self.hourly_raw, self.regions)

    def _event_station(self):
        return X.station_id(F.expr("cast(user_id % 25 % 5 as string)"), F.expr("cast(user_id % 25 as string)"), F.lit("1"))

    @cached_property
    def pass_times(self) -> DataFrame:
        return self.table("events").where("event_type = 'view'").select(self._event_station().alias("station_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))

    @cached_property
    def hour_days(self) -> DataFrame:
        return self.hourly.groupBy("station_id", F.to_date("ts").alias("date")).agg(F.avg("pm25").alias("pm25"))

    @cached_property
    def hour_labels(self) -> DataFrame:
        return labels.overpass_hour_labels(self.hourly, self.pass_times)

    @cached_property
    def manifest(self) -> DataFrame:
        mode = F.expr("CASE WHEN event_type IN ('view', 'click') THEN 'single' WHEN event_type = 'purchase' THEN 'scene' ELSE 'median' END")
        events = self.table("events").withColumn("mode", mode).withColumn("day", F.to_date("ts"))
        return events.select(
            self._event_station().alias("station_id"), F.when(F.col("mode") == "scene", F.col("day")).otherwise(X.week_start("day")).alias("week_start"),
            F.expr("IF(event_id % 3 = 0, 'l2a', 'l1c')").alias("product"), "mode",
            F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'all' ELSE 'rgb' END").alias("bands"),
            F.expr("CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 13 = 0 THEN 'no_images' WHEN value < 30 THEN 'too_cloudy' ELSE 'ok' END").alias("status"),
            F.expr("least(1D, value / 100)").alias("valid_fraction"),
            F.when(F.col("mode") == "median", "").otherwise(F.date_format("day", "yyyy-MM-dd")).alias("scene_date"), F.col("event_id").alias("ingest_seq"),
        )

    @cached_property
    def patches(self) -> DataFrame:
        pixel = lambda lo: F.transform(F.slice("embedding", lo, 16), lambda v: F.greatest(F.lit(0), F.floor(10000 * v.cast("double"))).cast("int"))
        tail = F.slice("embedding", 49, 16)
        return self.table("embeddings").select(
            F.col("vec_id").alias("scene_id"), F.format_string("%02d", F.expr("cast(vec_id % 25 as int)")).alias("station_id"),
            F.expr("date_add(DATE'2024-01-01', cast(vec_id % 30 as int))").alias("scene_date"), F.expr("cast(vec_id % 100 as int)").alias("cloudy_pct"),
            pixel(1).alias("b4"), pixel(17).alias("b3"), pixel(33).alias("b2"), F.transform(tail, lambda v: (v > 0).cast("int")).alias("cnt"),
            F.transform(tail, lambda v: (F.floor(1000 * F.abs(v.cast("double"))) % 12).cast("int")).alias("scl"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        place = F.expr("vec_id % 25")
        return self.table("embeddings").select(
            F.col("vec_id").alias("scene_id"), F.expr("date_add(DATE'1995-01-02', cast(vec_id % 300 as int))").alias("scene_date"),
            (-124.05 + 2.1 * place).alias("west"), (24.95 + 0.9 * place).alias("south"), (-123.95 + 2.1 * place).alias("east"), (25.05 + 0.9 * place).alias("north"),
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", X.station_id(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.lit("1")).alias("station_id"))
        return self.table("embeddings").join(nations, F.expr("vec_id % 25 = n_nationkey")).select(
            "station_id", F.expr("date_add(DATE'1995-01-02', cast(7 * (vec_id div 25) as int))").alias("week_start"), "embedding"
        )

    @cached_property
    def predictions(self) -> DataFrame:
        kept = clean.with_station(clean.drop_excluded(clean.filter_duration(clean.filter_states(self.readings_raw, self.regions)))).withColumn("date", F.col("date_local"))
        rows = clean.dedupe_lowest_poc(kept).withColumn("pm25", X.clip_lower("arithmetic_mean")).where("pm25 IS NOT NULL")
        digit = F.substring(F.md5(F.concat_ws("|", "station_id", F.date_format("date", "yyyy-MM-dd"))), 1, 1)
        return rows.select(
            "station_id", "date", "region", F.col("pm25").alias("y_true"), (0.5 * F.col("pm25") + F.col("price") / 5000).alias("router"),
            (0.3 * F.col("pm25") + 6).alias("clean"), (0.9 * F.col("pm25") + 10).alias("smoke"), (F.ascii(digit) % 5).alias("fold"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.predictions.withColumn("y_pred", F.col("router"))

    @cached_property
    def long_predictions(self) -> DataFrame:
        return self.predictions.unpivot(["station_id", "date", "region", "fold", "y_true"], ["router", "clean", "smoke"], "model", "y_pred")


STATION = "lpad({0}, 2, '0') || '-' || lpad({1}, 3, '0') || '-' || lpad({2}, 4, '0')"
_EVENT_STATION = STATION.format("CAST(user_id % 25 % 5 AS VARCHAR)", "CAST(user_id % 25 AS VARCHAR)", "'1'")

#: name -> (names it needs, query)
CTES: dict[str, tuple[list[str], str]] = {
    "regions": ([], "SELECT r_name AS region, CAST(r_regionkey AS VARCHAR) AS state_code FROM region"),
    "readings_raw": ([], """SELECT CAST(n_regionkey AS VARCHAR) AS state_code, CAST(n_nationkey AS VARCHAR) AS county_code, '1' AS site_num, r_name AS region,
 l_suppkey AS poc, l_orderkey AS seq, l_linenumber AS line, CAST(l_shipdate AS DATE) AS date_local,
 CASE WHEN l_orderkey % 97 <> 0 THEN (l_quantity - 2) * CASE WHEN l_discount > 0.095 THEN 8 ELSE 1 END END AS arithmetic_mean,
 100 - 4 * round(100 * l_tax) AS obs_percent,
 CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Excluded' WHEN l_returnflag = 'A' THEN 'Included' END AS event_type,
 CASE WHEN l_linenumber = 1 THEN '1 HOUR' WHEN l_linenumber <= 3 THEN '24 HOUR' WHEN l_linenumber <= 6 THEN '24-HR BLK AVG' END AS sample_duration,
 25 + CAST(0.9 AS DOUBLE) * n_nationkey + CAST(0.01 AS DOUBLE) * (l_suppkey % 7) AS lat, -124 + CAST(2.1 AS DOUBLE) * n_nationkey AS lon,
 CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE s_name END AS site_name, l_extendedprice
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "ranked": (["readings_raw"], f"""SELECT *, {STATION.format('state_code', 'county_code', 'site_num')} AS station_id, date_local AS date,
 CASE WHEN arithmetic_mean < 0 THEN 0 ELSE arithmetic_mean END AS pm25,
 row_number() OVER (PARTITION BY state_code, county_code, date_local ORDER BY poc NULLS LAST, seq, line) AS rn
 FROM readings_raw WHERE contains(sample_duration, '24') AND event_type IS DISTINCT FROM 'Excluded'"""),
    "daily": (["ranked"], "SELECT station_id, date, pm25, obs_percent, lat, lon, site_name, region FROM ranked WHERE rn = 1"),
    "weekly": (["daily"], """SELECT station_id, CAST(date_trunc('week', date) AS DATE) AS week_start, avg(pm25) AS pm25, count(*) AS n_days
 FROM daily WHERE obs_percent >= 75 GROUP BY ALL HAVING count(*) >= 2"""),
    "stations": (["daily"], """SELECT station_id, median(lat) AS lat, median(lon) AS lon, arg_min(site_name, date) FILTER (site_name IS NOT NULL) AS site_name,
 count(*) AS n_days, arg_min(region, date) FILTER (region IS NOT NULL) AS region FROM daily GROUP BY station_id"""),
    "hourly_all": ([], f"""SELECT {_EVENT_STATION} AS station_id, date_trunc('hour', ts) AS ts, user_id // 25 AS poc, event_id AS seq,
 CASE WHEN event_id % 11 = 0 THEN NULL WHEN value - 5 < 0 THEN 0 ELSE value - 5 END AS pm25 FROM events WHERE event_type <> 'view'"""),
    "hourly_first": (["hourly_all"], "SELECT *, row_number() OVER (PARTITION BY station_id, ts ORDER BY poc NULLS LAST, seq) AS rn FROM hourly_all"),
    "hourly": (["hourly_first"], "SELECT station_id, ts, pm25 FROM hourly_first WHERE rn = 1 AND pm25 IS NOT NULL"),
    "pass_times": ([], f"SELECT {_EVENT_STATION} AS station_id, ts FROM events WHERE event_type = 'view'"),
    "first_pass": (["pass_times"], "SELECT station_id, CAST(ts AS DATE) AS scene_date, min(ts) AS ts FROM pass_times GROUP BY ALL"),
    "hour_days": (["hourly"], "SELECT station_id, CAST(ts AS DATE) AS date, avg(pm25) AS pm25 FROM hourly GROUP BY ALL"),
    "hour_labels": (["hourly", "first_pass"], """SELECT h.station_id, f.scene_date, avg(h.pm25) AS pm25, count(DISTINCT hour(h.ts)) AS n_hours,
 CAST(date_trunc('week', f.scene_date) AS DATE) AS week_start
 FROM hourly h JOIN first_pass f ON h.station_id = f.station_id AND CAST(h.ts AS DATE) = f.scene_date AND hour(h.ts) BETWEEN hour(f.ts) - 1 AND hour(f.ts) + 1
 GROUP BY h.station_id, f.scene_date"""),
    "manifest": ([], f"""SELECT {_EVENT_STATION} AS station_id,
 CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) ELSE CAST(date_trunc('week', ts) AS DATE) END AS week_start,
 CASE WHEN event_id % 3 = 0 THEN 'l2a' ELSE 'l1c' END AS product,
 CASE WHEN event_type IN ('view', 'click') THEN 'single' WHEN event_type = 'purchase' THEN 'scene' ELSE 'median' END AS mode,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'all' ELSE 'rgb' END AS bands,
 CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 13 = 0 THEN 'no_images' WHEN value < 30 THEN 'too_cloudy' ELSE 'ok' END AS status,
 least(1.0, value / 100) AS valid_fraction,
 CASE WHEN event_type IN ('view', 'click', 'purchase') THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS scene_date, event_id AS ingest_seq FROM events"""),
    "merged": (["manifest"], """SELECT * FROM (SELECT * REPLACE (coalesce(bands, 'rgb') AS bands),
 row_number() OVER (PARTITION BY station_id, week_start, product, mode, coalesce(bands, 'rgb') ORDER BY ingest_seq DESC) AS rn FROM manifest) WHERE rn = 1"""),
    "scenes": (["manifest"], """SELECT DISTINCT station_id, CAST(scene_date AS DATE) AS scene_date FROM manifest
 WHERE product = 'l1c' AND mode = 'single' AND coalesce(bands, 'rgb') = 'rgb' AND status = 'ok' AND scene_date <> ''"""),
    "vectors": ([], "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"),
    "patches": (["vectors"], """SELECT vec_id AS scene_id, lpad(CAST(vec_id % 25 AS VARCHAR), 2, '0') AS station_id,
 DATE '2024-01-01' + CAST(vec_id % 30 AS INTEGER) AS scene_date, CAST(vec_id % 100 AS INTEGER) AS cloudy_pct,
 [CAST(greatest(0, floor(10000 * v)) AS INTEGER) for v in e[1:16]] AS b4, [CAST(greatest(0, floor(10000 * v)) AS INTEGER) for v in e[17:32]] AS b3,
 [CAST(greatest(0, floor(10000 * v)) AS INTEGER) for v in e[33:48]] AS b2, [CAST(v > 0 AS INTEGER) for v in e[49:64]] AS cnt,
 [CAST(floor(1000 * abs(v)) % 12 AS INTEGER) for v in e[49:64]] AS scl FROM vectors"""),
    "px": (["patches"], """SELECT scene_id, station_id, scene_date, cloudy_pct, i, b4[i] AS b4, b3[i] AS b3, b2[i] AS b2, cnt[i] AS cnt, scl[i] AS scl
 FROM patches, (SELECT unnest(range(1, 17)) AS i)"""),
    "best": (["patches"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY cloudy_pct, scene_date, scene_id) AS rn FROM patches) WHERE rn = 1"),
    "image_table": ([], f"""SELECT {STATION.format('CAST(n_regionkey AS VARCHAR)', 'CAST(n_nationkey AS VARCHAR)', "'1'")} AS station_id,
 DATE '1995-01-02' + CAST(7 * (vec_id // 25) AS INTEGER) AS week_start, embedding FROM embeddings JOIN nation ON vec_id % 25 = n_nationkey"""),
    "model_table": (["weekly", "image_table", "stations"], """SELECT w.station_id, w.week_start, w.pm25, w.n_days, e.embedding, s.lat, s.lon, s.region,
 year(w.week_start) AS year, weekofyear(w.week_start) AS week_of_year
 FROM weekly w JOIN image_table e USING (station_id, week_start) LEFT JOIN stations s ON w.station_id = s.station_id"""),
    "predictions": (["ranked"], """SELECT station_id, date, region, pm25 AS y_true, 0.5 * pm25 + l_extendedprice / 5000 AS router, 0.3 * pm25 + 6 AS clean,
 0.9 * pm25 + 10 AS smoke, ascii(md5(station_id || '|' || strftime(date, '%Y-%m-%d'))[1]) % 5 AS fold FROM ranked WHERE rn = 1 AND pm25 IS NOT NULL"""),
    "scored": (["predictions"], "SELECT *, router AS y_pred FROM predictions"),
    "long_predictions": (["predictions"], """SELECT station_id, date, region, fold, y_true, model, y_pred FROM predictions
 UNPIVOT (y_pred FOR model IN (router, clean, smoke))"""),
    "bucketed": (["scored"], """SELECT *, CASE WHEN y_true <= -1 OR y_true > 1e9 THEN NULL WHEN y_true <= 6 THEN 0 WHEN y_true <= 12 THEN 1 WHEN y_true <= 35 THEN 2
 WHEN y_true <= 55 THEN 3 ELSE 4 END AS bucket FROM scored"""),
    "catalog": ([], """SELECT vec_id AS scene_id, DATE '1995-01-02' + CAST(vec_id % 300 AS INTEGER) AS scene_date,
 CAST(-124.05 AS DOUBLE) + CAST(2.1 AS DOUBLE) * (vec_id % 25) AS west, CAST(24.95 AS DOUBLE) + CAST(0.9 AS DOUBLE) * (vec_id % 25) AS south,
 CAST(-123.95 AS DOUBLE) + CAST(2.1 AS DOUBLE) * (vec_id % 25) AS east, CAST(25.05 AS DOUBLE) + CAST(0.9 AS DOUBLE) * (vec_id % 25) AS north FROM embeddings"""),
}


def sql(body: str, *needs: str) -> str:
    """``body`` after the expressions that it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                add(other)
            order.append(name)

    for name in needs:
        add(name)
    heads = ", ".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH {heads}{" " if body else ""}{body}" if heads else body
