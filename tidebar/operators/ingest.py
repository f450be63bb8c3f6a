"""Bar ingest: validation, time normalisation and the session model (V operators)."""
from __future__ import annotations

import datetime

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidebar.functions.core import GUARD, KEYS, TICK

PRICES = ("open", "high", "low", "close")


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column."""
    return df.dropDuplicates()


def conflicting_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that still carry several different rows once exact copies are gone."""
    return (dedupe_exact(df).groupBy(*key).agg(F.count(F.lit(1)).alias("versions"))
            .filter("versions > 1"))


def dedupe_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """First row per key. min_by combines on the map side, so a key with many
    copies never gathers in one sort."""
    rest = [c for c in df.columns if c not in key]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(pick).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def quality_flags(df: DataFrame, time_col: str = "time", tick: float = TICK,
                  seconds: int = 60) -> DataFrame:
    """Row-level flags for non-finite values, stamp alignment, OHLC order and tick grid."""
    vals = [F.col(c) for c in (*PRICES, "volume")]
    bad = F.lit(False)
    for v in vals:
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    o, h, l, c = (F.col(x) for x in PRICES)
    order = (h < F.greatest(o, l, c)) | (l > F.least(o, h, c)) | (F.col("volume") < 0)
    off = F.lit(False)
    for p in PRICES:
        off = off | (F.abs(F.col(p) / tick - F.round(F.col(p) / tick)) > GUARD)
    return df.select(
        "*", bad.alias("bad_value"), (F.pmod(F.col(time_col), F.lit(seconds)) != 0).alias("misaligned"),
        order.alias("bad_ohlc"), off.alias("off_tick"))


def coerce_numeric(df: DataFrame, cols: list[str], required: list[str]) -> DataFrame:
    """Text to numbers; unreadable becomes missing; rows without the required values go."""
    cast = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols}
    return df.withColumns(cast).dropna(subset=required)


def normalize_stamp(df: DataFrame, convention: str, seconds: int, ts: str = "ts") -> DataFrame:
    """``bar_ts`` = bar open, ``available_at`` = bar close. The convention has no default."""
    if convention not in ("open", "close"):
        raise ValueError("convention must be 'open' or 'close'")
    step = F.make_dt_interval(secs=F.lit(float(seconds)))
    opened = F.col(ts) if convention == "open" else F.col(ts) - step
    return df.withColumn("bar_ts", opened).withColumn("available_at", opened + step)


def localize(df: DataFrame, tz: str, ts: str = "ts") -> DataFrame:
    """UTC wall time to local date, minute of day and year; DST from the zone table."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    return (df.withColumn("local_date", F.to_date(local))
            .withColumn("local_minute", (F.hour(local) * 60 + F.minute(local)).cast("int"))
            .withColumn("local_year", F.year(local)))


def order_key(ts: Column, tie: Column) -> Column:
    """Time and tie-break in one decimal: a fixed-width ordering keeps the bar aggregate a hash
    aggregate, where a struct would force a sort of the raw rows."""
    wide = F.lit(Decimal(10 ** 19)).cast("decimal(20,0)")
    return (F.unix_micros(ts.cast("timestamp")).cast("decimal(17,0)") * wide + tie.cast("decimal(19,0)")).cast("decimal(38,0)")


def bars_from_ticks(df: DataFrame, symbol: Column, session: Column, slot: Column,
                    value: Column, order: Column) -> DataFrame:
    """Tumbling OHLCV bars. One hash aggregate with map-side combine: a hot symbol
    shrinks to its bars before anything is shuffled."""
    return (df.select(symbol.alias("symbol"), session.alias("session"),
                      slot.cast("int").alias("slot"), value.alias("_v"), order.alias("_o"))
            .groupBy("symbol", "session", "slot")
            .agg(F.min_by("_v", "_o").alias("open"), F.max("_v").alias("high"),
                 F.min("_v").alias("low"), F.max_by("_v", "_o").alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume")))


def calendar_spine(symbols: DataFrame, first: datetime.date, last: datetime.date, step: str, close_slot: Column, is_normal: Column) -> DataFrame:
    """Every session from ``first`` to ``last`` for each symbol, one each ``step``, with close slot and normal flag
    by rule: a session without a single bar is expected all the same."""
    days = symbols.select("symbol", F.explode(F.sequence(F.lit(first), F.lit(last), F.expr(f"interval {step}"))).alias("session"))
    return days.withColumn("close_slot", close_slot.cast("int")).withColumn("is_normal", is_normal)


def listed_calendar(bars: DataFrame, table: DataFrame) -> DataFrame:
    """The sessions that a calendar table ``(session, close_slot, is_normal)`` expects of each symbol from its first bar on, up to its last.

    A symbol that is listed later has no missing sessions before, and a bar on a day that is no session of the table adds none. What goes to every
    symbol is the table itself, one row a session; a session that stands in it twice is refused."""
    rows = table.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.first("close_slot").alias("close_slot"), F.first("is_normal").alias("is_normal"))
    if rows.filter("n > 1").first() is not None:
        raise ValueError("a session stands in the calendar twice")
    days = rows.agg(F.array_sort(F.collect_list(F.struct("session", "close_slot", "is_normal"))).alias("d"))
    ends = bars.groupBy("symbol").agg(F.min("session").alias("_from"), F.max("session").alias("_to")).withColumn("_d", days.scalar())
    return ends.select("symbol", F.inline(F.filter("_d", lambda d: (d["session"] >= F.col("_from")) & (d["session"] <= F.col("_to")))))


def unlisted_sessions(bars: DataFrame, table: DataFrame) -> DataFrame:
    """``(symbol, session, bars)`` of bars on days that the calendar table does not have."""
    return bars.join(table.select("session"), "session", "left_anti").groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bars"))


def session_calendar_join(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach close slot and normal flag, dropping bars outside the session hours.

    No hint: the planner broadcasts the calendar only while its size allows it."""
    return bars.join(calendar, list(KEYS)).filter(F.col("slot") < F.col("close_slot"))


def complete_grid(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every expected (session, slot); a missing bar is a row of NULLs.

    Calendar rows and bars meet in one grouping by session, and the missing slots are appended in
    place: a single shuffle, the (symbol, session) one that all session windows need anyway, sized
    by the bars. A join on the slot would first shuffle the whole grid by three keys."""
    vals = (*PRICES, "volume")
    extra = [c for c in calendar.columns if c not in KEYS]
    u = calendar.unionByName(bars.select(*KEYS, "slot", *vals), allowMissingColumns=True)
    bar = F.when(F.col("slot").isNotNull(), F.struct("slot", *vals))
    x = u.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in extra], F.collect_list(bar).alias("_b")).filter("close_slot IS NOT NULL")
    gone = F.array_except(F.sequence(F.lit(0), F.col("close_slot") - 1), F.transform("_b", lambda b: b["slot"]))
    none = F.transform(gone, lambda i: F.struct(i.alias("slot"), *[F.lit(None).cast("double").alias(v) for v in vals]))
    rows = F.concat(F.filter("_b", lambda b: b["slot"] < F.col("close_slot")), none)
    return x.select(*KEYS, *extra, F.inline(rows))


def missing_report(bars: DataFrame, calendar: DataFrame, cut: int) -> DataFrame:
    """Missing slots per session, in all and before ``cut``."""
    want = calendar.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("close_slot") - 1)))
    gone = want.join(bars.select(*KEYS, "slot"), [*KEYS, "slot"], "left_anti")
    return gone.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("missing"), F.count_if(F.col("slot") < cut).alias("missing_early"),
        F.min("slot").alias("first_missing"))


def overnight_summary(bars: DataFrame, start: int, opening: int, slots: int) -> DataFrame:
    """High, low and VWAP of [previous day ``start``, ``opening``), only when complete.

    Each bar names the session it precedes, so the range join is a plain grouping."""
    late = F.col("slot") >= start
    owner = F.when(late, F.date_add("session", 1)).otherwise(F.col("session"))
    part = bars.filter(late | (F.col("slot") < opening)).withColumn("session", owner)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return (part.groupBy(*KEYS).agg(
        F.count("open").alias("n"), F.max("high").alias("on_high"), F.min("low").alias("on_low"),
        F.try_divide(F.sum(tp * F.col("volume")), F.sum("volume")).alias("on_vwap"))
        .filter(F.col("n") == slots - start + opening).drop("n"))


def stamp_sensitivity(bars: DataFrame, calendar: DataFrame, opening: int) -> DataFrame:
    """Completeness and opening extremes when stamps mean bar opens or bar closes."""
    shifted = bars.withColumn("slot", F.col("slot") - 1)

    def view(b, tag):
        x = session_calendar_join(b.filter("slot >= 0"), calendar)
        early = F.col("slot") < opening
        return x.groupBy(*KEYS).agg(
            F.count("open").alias(f"n_{tag}"), F.count_if(early).alias(f"k_{tag}"),
            F.max(F.when(early, F.col("high"))).alias(f"hi_{tag}"),
            F.min(F.when(early, F.col("low"))).alias(f"lo_{tag}"))

    j = (calendar.join(view(bars, "open"), list(KEYS), "left")
         .join(view(shifted, "close"), list(KEYS), "left"))
    both = (F.col("k_open") == opening) & (F.col("k_close") == opening)
    moved = (F.col("hi_open") != F.col("hi_close")) | (F.col("lo_open") != F.col("lo_close"))
    return j.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("n_open") == F.col("close_slot")).alias("complete_if_open"),
        F.count_if(F.col("n_close") == F.col("close_slot")).alias("complete_if_close"),
        F.count_if(both & moved).alias("changed_opening"))


def complete_sessions(grid: DataFrame) -> DataFrame:
    """Bars of the sessions in which no slot is missing."""
    n = F.count("open").over(W.partitionBy(*KEYS))
    return grid.withColumn("_n", n).filter(F.col("_n") == F.col("close_slot")).drop("_n")
