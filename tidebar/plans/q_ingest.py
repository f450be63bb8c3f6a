"""Queries for sources, ingest validation and the session model."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import features as feats
from tidebar.operators import ingest
from tidebar.plans import views
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.registry import register
from tidebar.sources import readers, sinks
from tidebar.sources.scratch import scratch_path

K = ["symbol", "session"]
H, M = "hourly", "monthly"
OHLCV = "symbol session slot:i open:d high:d low:d close:d volume:d"


def raw_bars(spark, sf):
    """Hourly bars with an epoch ``time`` column, the raw file form."""
    b = views.bars(spark, sf, H)
    return b.withColumn("time", F.unix_timestamp(F.col("session").cast("timestamp")) + F.col("slot") * 3600)


RAW = "SELECT *, epoch(CAST(session AS TIMESTAMP)) + slot * 3600 AS time FROM bars"
RAWS = "symbol session time:i open:d high:d low:d close:d volume:d"


# ---- sources and sinks ---------------------------------------------------------

@register("source_bar_files", with_ctes(H, f"""{pick("time:i pos:i open:d high:d low:d close:d volume:d",
 "(SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY time) - 1 AS pos FROM raw)")}""", {"raw": RAW}))
def source_bar_files(spark, sf):
    path = scratch_path(spark, "bars-json")
    sinks.write_bar_files(raw_bars(spark, sf), path)
    return readers.read_bar_files(spark, path).drop("file")


@register("source_bars_csv", with_ctes(H, pick("symbol time:i open:d high:d low:d close:d volume:d", "raw"), {"raw": RAW}))
def source_bars_csv(spark, sf):
    path = scratch_path(spark, "bars-csv")
    cols = ["symbol", "time", "open", "high", "low", "close", "volume"]
    sinks.write_results(raw_bars(spark, sf).select(*cols), path)
    return readers.read_bars_csv(spark, path)


@register("source_series_csv", """SELECT CAST(o_orderdate AS DATE) AS obs_date, round(avg(o_totalprice) + 3e-10, 6) + 0.0 AS value
 FROM orders WHERE day(o_orderdate) % 7 <> 0 GROUP BY 1""")
def source_series_csv(spark, sf):
    path = scratch_path(spark, "series")
    d = views.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("DATE")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("v"))
    hole = F.dayofmonth("DATE") % 7 == 0
    sinks.write_results(d.select("DATE", F.when(hole, ".").otherwise(F.col("v").cast("string")).alias("VALUE")), path)
    return readers.read_series_csv(spark, path, ["observation_date", "DATE"], ["CLOSE", "VALUE"])


@register("source_bars_table", with_ctes(H, pick(OHLCV, "bars WHERE symbol = 'view' AND session >= DATE '2024-01-10'")))
def source_bars_table(spark, sf):
    path = scratch_path(spark, "bars-table")
    sinks.write_bars_table(views.bars(spark, sf, H), path)
    return readers.read_bars_table(spark, path).filter(
        "symbol = 'view' AND session >= DATE '2024-01-10'").select(*K, "slot", "open", "high", "low", "close", "volume")


@register("source_grid_file", with_ctes(H, """SELECT symbol, CAST(w.n AS BIGINT) AS lookback, round(q.x + 3e-10, 6) + 0.0 AS multiple,
 CAST(count(*) AS BIGINT) AS bars FROM bars, (VALUES (3), (5), (8)) w(n), (VALUES (0.5), (1.5)) q(x) GROUP BY 1, 2, 3"""))
def source_grid_file(spark, sf):
    path = scratch_path(spark, "grid")
    b = views.bars(spark, sf, H)
    per = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    per.withColumns({"lookback": F.array(*[F.lit(x) for x in (3, 5, 8)]),
                     "multiple": F.array(F.lit(0.5), F.lit(1.5))}).write.json(path)
    raw = spark.read.schema("symbol string, bars long, lookback array<long>, multiple array<double>").json(path)
    return raw.withColumn("lookback", F.explode("lookback")).withColumn("multiple", F.explode("multiple"))


@register("source_parts", with_ctes("monthly", """SELECT symbol, year(session) AS year, CAST(count(*) AS BIGINT) AS n,
 round(sum(volume) + 3e-10, 6) + 0.0 AS volume FROM bars GROUP BY 1, 2"""))
def source_parts(spark, sf):
    path = scratch_path(spark, "parts")
    r = views.bars(spark, sf, "monthly").groupBy("symbol", F.year("session").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    r.withColumn("shard", F.pmod(F.hash("symbol"), F.lit(3))).write.partitionBy("shard").json(path)
    return readers.read_parts(spark, path, "symbol string, year int, n long, volume double")


@register("source_manifest_changes", with_ctes(H, "SELECT 'symbol=' || min(symbol) AS file, 'altered' AS problem FROM bars UNION ALL SELECT 'symbol=' || max(symbol), 'absent' FROM bars UNION ALL SELECT 'symbol=extra', 'new'"))
def source_manifest_changes(spark, sf):
    """Parts written twice: the second time the first symbol has other volumes, the last symbol is gone and a new one is there."""
    b = views.bars(spark, sf, H)
    lo, hi = b.agg(F.min("symbol"), F.max("symbol")).first()
    paths = [scratch_path(spark, "parts") for _ in range(2)]
    later = b.filter(F.col("symbol") != hi).withColumn("volume", F.when(F.col("symbol") == lo, F.col("volume") + 1).otherwise(F.col("volume")))
    later = later.unionByName(b.filter(F.col("symbol") == lo).withColumn("symbol", F.lit("extra")))
    for path, df in zip(paths, (b, later)):
        df.repartition("symbol").sortWithinPartitions("symbol", "session", "slot").write.partitionBy("symbol").json(path)
    then, now = (readers.files_checksum(spark, path, -2) for path in paths)
    mpath = scratch_path(spark, "manifest")
    then.write.parquet(mpath)
    return readers.compare_manifest(now, spark.read.parquet(mpath))


@register("source_checksums")
def source_checksums(spark, sf):
    """Checksums of written parts against a manifest taken from the same folder: none may differ."""
    path = scratch_path(spark, "sums")
    views.bars(spark, sf, H).write.json(path)
    found = readers.files_checksum(spark, path)
    mpath = scratch_path(spark, "sums-manifest")
    found.write.parquet(mpath)
    bad = readers.changed_files(found, spark.read.parquet(mpath))
    return found.join(bad, "file", "left").groupBy("problem").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@register("sink_ledger", with_ctes(H, f"{pick('symbol session slot:i close:d atr:d vwap:d', 'feat WHERE atr > 0 AND close > or_high')}"))
def sink_ledger(spark, sf):
    path = scratch_path(spark, "ledger")
    t = views.feat(spark, sf, H).filter("atr > 0 AND close > or_high").select(*K, "slot", "close", "atr", "vwap")
    sinks.write_ledger(t, path, ["atr", "vwap"])
    s = "symbol string, session date, slot int, close double, context struct<atr: double, vwap: double>"
    return spark.read.schema(s).json(path).select(*K, "slot", "close", "context.atr", "context.vwap")


@register("sink_arrays", with_ctes("monthly", pick("symbol session day_ret:d day_volume:d", "daily")))
def sink_arrays(spark, sf):
    path = scratch_path(spark, "arrays")
    sinks.write_arrays(views.daily(spark, sf, "monthly").select(*K, "day_ret", "day_volume"), path, "symbol")
    return readers.read_bars_table(spark, path).select(*K, "day_ret", "day_volume")


@register("sink_manifest", with_ctes(H, """SELECT symbol, CAST(session AS VARCHAR) AS session_id,
 symbol || '-' || lpad(CAST(slot AS VARCHAR), 4, '0') AS config_id FROM bars"""))
def sink_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    b = views.bars(spark, sf, H)
    sinks.write_manifest(b.select("symbol", F.col("session").cast("string").alias("session_id"),
                                  F.format_string("%s-%04d", "symbol", "slot").alias("config_id")), path)
    return spark.read.schema("symbol string, session_id string, config_id string").json(path)


@register("sink_results_csv", with_ctes(H, pick("symbol session day_high:d day_low:d day_bars:i", "daily")))
def sink_results_csv(spark, sf):
    path = scratch_path(spark, "results")
    sinks.write_results(views.daily(spark, sf, H).select(*K, "day_high", "day_low", "day_bars"), path)
    return spark.read.csv(path, header=True, schema="symbol string, session date, day_high double, day_low double, day_bars long")


@register("source_cube_rows", with_ctes(H, f"""{pick(OHLCV, '(SELECT *, count(open) OVER (PARTITION BY symbol, session) AS n FROM g) WHERE n = close_slot')}"""))
def source_cube_rows(spark, sf):
    return ingest.complete_sessions(views.grid(spark, sf, H)).select(*K, "slot", "open", "high", "low", "close", "volume")


# ---- validation ----------------------------------------------------------------

def doubled(spark, sf):
    """Raw bars with copies and conflicts added by rule, to have something to find."""
    r = raw_bars(spark, sf)
    again = r.filter(F.col("slot") % 3 == 0)
    clash = r.filter(F.col("slot") % 7 == 0).withColumn("close", F.col("close") + 1)
    return r.unionByName(again).unionByName(clash)


DOUBLED = """SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE slot % 3 = 0
 UNION ALL SELECT * REPLACE (close + 1 AS close) FROM raw WHERE slot % 7 = 0"""
XT = {"raw": RAW, "dbl": DOUBLED}


@register("ingest_dedupe_exact", with_ctes(H, pick(RAWS, "(SELECT DISTINCT * FROM dbl)"), XT))
def ingest_dedupe_exact(spark, sf):
    return ingest.dedupe_exact(doubled(spark, sf)).drop("slot")


@register("ingest_conflicting_keys", with_ctes(H, """SELECT symbol, CAST(time AS BIGINT) AS time, CAST(count(*) AS BIGINT) AS versions
 FROM (SELECT DISTINCT * FROM dbl) GROUP BY 1, 2 HAVING count(*) > 1""", XT))
def ingest_conflicting_keys(spark, sf):
    return ingest.conflicting_keys(doubled(spark, sf), ["symbol", "time"])


@register("ingest_dedupe_first", with_ctes(H, pick("symbol time:i close:d volume:d", """(SELECT *,
 row_number() OVER (PARTITION BY symbol, time ORDER BY close) AS rn FROM dbl) WHERE rn = 1"""), XT))
def ingest_dedupe_first(spark, sf):
    return ingest.dedupe_first(doubled(spark, sf), ["symbol", "time"], ["close"]).select("symbol", "time", "close", "volume")


@register("ingest_quality_flags", """SELECT event_type AS symbol, CAST(count(*) AS BIGINT) AS row_count,
 CAST(count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS BIGINT) AS bad_value,
 CAST(count(*) FILTER (epoch(date_trunc('second', ts)) % 60 <> 0) AS BIGINT) AS misaligned,
 CAST(count(*) FILTER (value - 1 > value OR value < 0) AS BIGINT) AS bad_ohlc,
 CAST(count(*) FILTER (abs(value / 0.25 - round(value / 0.25)) > 1e-8 OR abs((value - 1) / 0.25 - round((value - 1) / 0.25)) > 1e-8) AS BIGINT) AS off_tick
 FROM events GROUP BY 1""")
def ingest_quality_flags(spark, sf):
    t = views.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"),
        F.col("value").alias("open"), F.col("value").alias("high"), (F.col("value") - 1).alias("low"),
        F.col("value").alias("close"), F.col("value").alias("volume"))
    q = ingest.quality_flags(t)
    return q.groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count"), *[
        F.count_if(c).alias(c) for c in ("bad_value", "misaligned", "bad_ohlc", "off_tick")])


@register("ingest_check_ohlc", with_ctes(H, """SELECT symbol, session, CAST(slot AS BIGINT) AS slot,
 high < greatest(open, low, close) OR low > least(open, high, close) OR volume < 0 AS bad_ohlc
 FROM (SELECT * REPLACE (CASE WHEN slot % 5 = 0 THEN low ELSE high END AS high) FROM bars)"""))
def ingest_check_ohlc(spark, sf):
    b = raw_bars(spark, sf).withColumn("high", F.when(F.col("slot") % 5 == 0, F.col("low")).otherwise(F.col("high")))
    return ingest.quality_flags(b).select(*K, "slot", "bad_ohlc")


@register("ingest_coerce_numeric", """SELECT CAST(event_id AS BIGINT) AS event_id, round(value + 3e-10, 6) + 0.0 AS px
 FROM events WHERE event_type <> 'error' OR event_id % 2 = 0""")
def ingest_coerce_numeric(spark, sf):
    bad = (F.col("event_type") == "error") & (F.col("event_id") % 2 != 0)
    t = views.table(spark, sf, "events").select(
        "event_id", F.when(bad, "n/a").otherwise(F.col("value").cast("string")).alias("px"))
    return ingest.coerce_numeric(t, ["px"], ["px"])


@register("ingest_normalize_stamp", """SELECT CAST(event_id AS BIGINT) AS event_id,
 CAST(epoch(date_trunc('minute', ts)) - 60 AS BIGINT) AS open_epoch, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS available_epoch
 FROM events""")
def ingest_normalize_stamp(spark, sf):
    t = views.table(spark, sf, "events").select(
        "event_id", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"))
    x = ingest.normalize_stamp(t, "close", 60)
    return x.select("event_id", F.unix_timestamp("bar_ts").alias("open_epoch"),
                    F.unix_timestamp("available_at").alias("available_epoch"))


@register("ingest_localize", """SELECT CAST(event_id AS BIGINT) AS event_id, CAST(t AS DATE) AS local_date,
 CAST(hour(t) * 60 + minute(t) AS BIGINT) AS local_minute, CAST(year(t) AS BIGINT) AS local_year
 FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS t FROM events)""")
def ingest_localize(spark, sf):
    """January in New York is UTC-5, so the twin may use a fixed shift; DST is in the tests."""
    t = views.table(spark, sf, "events").select("event_id", "ts")
    return ingest.localize(t, "America/New_York").drop("ts")


@register("ingest_session_calendar", with_ctes(H, pick("symbol session slot:i close_slot:i is_normal close:d",
          "bars JOIN cal USING (symbol, session) WHERE slot < close_slot")))
def ingest_session_calendar(spark, sf):
    b = views.bars(spark, sf, H)
    return ingest.session_calendar_join(b, views.calendar(b, H)).select(*K, "slot", "close_slot", "is_normal", "close")


@register("ingest_calendar_table", with_ctes(M, """SELECT e.symbol, t.session, CAST(t.close_slot AS BIGINT) AS close_slot, t.is_normal, CAST((SELECT count(*) FROM bars b WHERE b.symbol = e.symbol AND b.session = t.session) AS BIGINT) AS bars
 FROM (SELECT symbol, min(session) AS a, max(session) AS z FROM bars WHERE symbol <> '2-HIGH' OR session >= DATE '1997-05-01' GROUP BY 1) e JOIN (SELECT session, max(close_slot) AS close_slot, bool_and(is_normal) AS is_normal FROM cal WHERE month(session) <> 8 GROUP BY 1) t ON t.session BETWEEN e.a AND e.z"""))
def ingest_calendar_table(spark, sf):
    """A calendar as data: no sessions in August, one symbol listed in 1997. Each symbol is expected from its first bar on."""
    b = views.bars(spark, sf, M)
    table = views.calendar(b, M).filter(F.month("session") != 8).groupBy("session").agg(F.max("close_slot").alias("close_slot"), F.bool_and("is_normal").alias("is_normal"))
    listed = b.filter("symbol <> '2-HIGH' OR session >= DATE '1997-05-01'")
    n = listed.groupBy(*K).agg(F.count(F.lit(1)).alias("bars"))
    return ingest.listed_calendar(listed, table).join(n, K, "left").withColumn("bars", F.coalesce("bars", F.lit(0)))


@register("ingest_unlisted_sessions", with_ctes(M, "SELECT symbol, session, CAST(count(*) AS BIGINT) AS bars FROM bars WHERE month(session) = 8 GROUP BY 1, 2"))
def ingest_unlisted_sessions(spark, sf):
    """Bars on days that the calendar does not have."""
    b = views.bars(spark, sf, M)
    return ingest.unlisted_sessions(b, views.calendar(b, M).filter(F.month("session") != 8).select("session").distinct())


@register("ingest_complete_grid", with_ctes(H, pick(OHLCV + " close_slot:i", "g")))
def ingest_complete_grid(spark, sf):
    return views.grid(spark, sf, H).select(*K, "slot", "open", "high", "low", "close", "volume", "close_slot")


@register("ingest_missing_report", with_ctes(H, """SELECT symbol, session, CAST(count(*) AS BIGINT) AS missing,
 CAST(count(*) FILTER (slot < 8) AS BIGINT) AS missing_early, CAST(min(slot) AS BIGINT) AS first_missing
 FROM g WHERE open IS NULL GROUP BY 1, 2"""))
def ingest_missing_report(spark, sf):
    b = views.bars(spark, sf, H)
    return ingest.missing_report(b, views.calendar(b, H), 8)


@register("ingest_missing_sessions", with_ctes(M, """SELECT symbol, session, CAST(close_slot AS BIGINT) AS missing FROM cal
 WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = cal.symbol AND b.session = cal.session AND b.slot < close_slot)"""))
def ingest_missing_sessions(spark, sf):
    """Sessions of which every bar is missing."""
    b = views.bars(spark, sf, M)
    cal = views.calendar(b, M)
    gone = ingest.missing_report(b, cal, 8)
    return gone.join(cal.select(*K, "close_slot"), K).filter("missing = close_slot").select(*K, "missing")


ON = """SELECT symbol, CAST(CASE WHEN slot >= 18 THEN session + INTERVAL 1 DAY ELSE session END AS DATE) AS session,
 max(high) AS on_high, min(low) AS on_low, sum((high + low + close) / 3 * volume) / sum(volume) AS on_vwap
 FROM bars WHERE slot >= 18 GROUP BY 1, 2 HAVING count(open) = 6"""


@register("ingest_overnight", with_ctes(H, pick("symbol session on_high:d on_low:d on_vwap:d", "on_sum"), {"on_sum": ON}))
def ingest_overnight(spark, sf):
    return ingest.overnight_summary(views.bars(spark, sf, H), 18, 0, 24)


@register("ingest_stamp_sensitivity", with_ctes(H, """SELECT symbol, CAST(count(*) AS BIGINT) AS sessions,
 CAST(count(*) FILTER (a.n = close_slot) AS BIGINT) AS complete_if_open,
 CAST(count(*) FILTER (b.n = close_slot) AS BIGINT) AS complete_if_close,
 CAST(count(*) FILTER (a.k = 3 AND b.k = 3 AND (a.hi <> b.hi OR a.lo <> b.lo)) AS BIGINT) AS changed_opening
 FROM cal LEFT JOIN va a USING (symbol, session) LEFT JOIN vb b USING (symbol, session) GROUP BY 1""", {
    "va": """SELECT symbol, session, count(*) n, count(*) FILTER (slot < 3) k, max(high) FILTER (slot < 3) hi, min(low) FILTER (slot < 3) lo
 FROM bars JOIN cal USING (symbol, session) WHERE slot < close_slot GROUP BY 1, 2""",
    "vb": """SELECT symbol, session, count(*) n, count(*) FILTER (slot - 1 < 3) k, max(high) FILTER (slot - 1 < 3) hi, min(low) FILTER (slot - 1 < 3) lo
 FROM bars JOIN cal USING (symbol, session) WHERE slot >= 1 AND slot - 1 < close_slot GROUP BY 1, 2"""}))
def ingest_stamp_sensitivity(spark, sf):
    b = views.bars(spark, sf, H)
    return ingest.stamp_sensitivity(b, views.calendar(b, H), 3)


@register("ingest_bars_from_ticks", with_ctes(H, pick(OHLCV, "bars")))
def ingest_bars_from_ticks(spark, sf):
    return views.raw_bars(spark, sf, H)


@register("ingest_bars_monthly", with_ctes("monthly", pick(OHLCV, "bars")))
def ingest_bars_monthly(spark, sf):
    return views.raw_bars(spark, sf, "monthly")


# ---- simple projections and session aggregates ---------------------------------

@register("filter_session_hours", with_ctes(H, pick(OHLCV, "bars WHERE slot BETWEEN 9 AND 15")))
def filter_session_hours(spark, sf):
    return views.bars(spark, sf, H).filter(F.col("slot").between(9, 15))


@register("filter_date_range", with_ctes("monthly", pick(OHLCV, "bars WHERE session >= DATE '1996-01-01' AND session < DATE '1999-01-01'")))
def filter_date_range(spark, sf):
    """The raw date filter is stated on the source column so that it reaches the scan."""
    t = views.table(spark, sf, "orders").filter(
        (F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")))
        & (F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))))
    return ingest.bars_from_ticks(t, F.col("o_orderpriority"), F.trunc("o_orderdate", "month"),
                                  F.dayofmonth("o_orderdate") - 1, F.col("o_totalprice") / 1000,
                                  ingest.order_key(F.col("o_orderdate"), F.col("o_orderkey")))


@register("filter_eligible_sessions", with_ctes(H, pick("symbol session atr:d complete", """(SELECT d.symbol, d.session, d.atr,
 d.day_bars = c.close_slot AS complete FROM daily d JOIN cal c USING (symbol, session) WHERE d.atr > 0 AND c.is_normal)""")))
def filter_eligible_sessions(spark, sf):
    b = views.bars(spark, sf, H)
    cal = views.calendar(b, H)
    d = feats.daily_features(ingest.complete_grid(b, cal), 5, 3).join(cal, K)
    return feats.eligible(d).select(*K, "atr", (F.col("day_bars") == F.col("close_slot")).alias("complete"))


@register("agg_daily_bars", with_ctes(H, pick("symbol session day_open:d day_high:d day_low:d day_close:d day_volume:d day_bars:i", "daily")))
def agg_daily_bars(spark, sf):
    return feats.daily_bars(views.grid(spark, sf, H))


OR_SQL = """SELECT symbol, session, n AS length, max(high) AS or_high, min(low) AS or_low, arg_min(open, slot) AS or_open,
 arg_max(close, slot) AS or_close, sum(volume) AS or_volume, count(open) AS or_bars, max(high) - min(low) AS or_width,
 CASE WHEN arg_max(close, slot) > arg_min(open, slot) THEN 1 WHEN arg_max(close, slot) < arg_min(open, slot) THEN -1 ELSE 0 END AS or_dir
 FROM bars, (VALUES (2), (3), (4), (6)) v(n) WHERE slot < n GROUP BY 1, 2, 3
 HAVING count(open) >= greatest(1, n - 1) AND max(high) > min(low)"""
OR_COLS = "symbol session length:i or_high:d or_low:d or_open:d or_close:d or_volume:d or_bars:i or_width:d or_dir:i"


@register("agg_opening_range", with_ctes(H, pick(OR_COLS, "ors WHERE length = 3"), {"ors": OR_SQL}))
def agg_opening_range(spark, sf):
    return feats.opening_ranges(views.bars(spark, sf, H), [3])


@register("agg_opening_ranges", with_ctes(H, pick(OR_COLS, "ors"), {"ors": OR_SQL}))
def agg_opening_ranges(spark, sf):
    return feats.opening_ranges(views.bars(spark, sf, H), [2, 3, 4, 6])


@register("agg_opening_ranges_wide", with_ctes(H, "SELECT symbol, session, " + ", ".join(
    f"round(max(or_high) FILTER (length = {n}) + 3e-10, 6) + 0.0 AS \"{n}_hi\", round(max(or_low) FILTER (length = {n}) + 3e-10, 6) + 0.0 AS \"{n}_lo\", "
    f"round(max(or_volume) FILTER (length = {n}) + 3e-10, 6) + 0.0 AS \"{n}_vol\", CAST(max(or_dir) FILTER (length = {n}) AS BIGINT) AS \"{n}_dir\""
    for n in (2, 3, 4, 6)) + " FROM ors GROUP BY 1, 2", {"ors": OR_SQL}))
def agg_opening_ranges_wide(spark, sf):
    return feats.opening_ranges_wide(views.bars(spark, sf, H), [2, 3, 4, 6])


@register("agg_extremes_complete", with_ctes(H, """SELECT symbol, session,
 CASE WHEN count(open) = max(close_slot) THEN round(max(high) + 3e-10, 6) + 0.0 END AS full_high,
 CASE WHEN count(open) = max(close_slot) THEN round(min(low) + 3e-10, 6) + 0.0 END AS full_low,
 CASE WHEN count(open) = max(close_slot) THEN round(arg_max(close, slot) + 3e-10, 6) + 0.0 END AS full_close FROM g GROUP BY 1, 2"""))
def agg_extremes_complete(spark, sf):
    return feats.session_extremes_complete(views.grid(spark, sf, H))
