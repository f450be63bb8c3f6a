"""The two session models built on the supplied tables, and frames derived from them.

``hourly``: events by type, one session per day, slot = hour.
``monthly``: orders by priority, one session per month, slot = day of month - 1; its years
give the train / validate / test split.
``quarter``: as ``hourly`` with 15-minute slots, for larger grids.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import features as feats
from tidebar.operators import ingest
from tidebar.sources.scratch import exists, scratch_path


@dataclass(frozen=True)
class Model:
    """Lookbacks and session hours of one view."""
    length: int = 3      # opening range slots
    lookback: int = 5    # sessions in ATR and clock statistics
    minimum: int = 3
    flat: int = 23       # nothing is held into this slot's close
    cutoff: int = 21     # no signal from this slot on


MODELS = {"hourly": Model(), "monthly": Model(flat=27, cutoff=24), "quarter": Model(flat=95, cutoff=90)}
TRAIN, VALIDATE, TEST = (1995, 1996, 1997), (1998, 1999), (2000, 2001)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_bars(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Bars straight from the source table: one scan, one hash aggregate."""
    if kind == "monthly":
        t = table(spark, sf, "orders")
        return ingest.bars_from_ticks(
            t, F.col("o_orderpriority"), F.trunc("o_orderdate", "month"), F.dayofmonth("o_orderdate") - 1,
            F.col("o_totalprice") / 1000, ingest.order_key(F.col("o_orderdate"), F.col("o_orderkey")))
    t = table(spark, sf, "events")
    slot = F.hour("ts") if kind == "hourly" else (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int")
    return ingest.bars_from_ticks(t, F.col("event_type"), F.to_date("ts"), slot, F.col("value"),
                                  ingest.order_key(F.col("ts"), F.col("event_id")))


_PREPARED: dict[tuple, str] = {}
#: First and last session of a frame of bars, by the hash of its plan.
_ENDS: dict[int, tuple] = {}


def prepare(spark: SparkSession, sf: str, kind: str) -> str:
    """Write the bars of a view to the shared folder and return the path."""
    path = scratch_path(spark, f"bars-{kind}")
    raw_bars(spark, sf, kind).write.parquet(path)
    return path


def bars(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Prepared bars. Plans read them several times (calendar, session values, labels), so the raw
    table is aggregated once per application and the raw scan is not repeated inside a query."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _PREPARED or not exists(spark, _PREPARED[key] + "/_SUCCESS"):
        _PREPARED[key] = prepare(spark, sf, kind)
    return spark.read.parquet(_PREPARED[key])


def calendar(b: DataFrame, kind: str) -> DataFrame:
    """The sessions a view expects of every symbol: all between the first and the last of the table, those
    without a bar included."""
    ends = _ENDS.get(key := b.semanticHash())
    if ends is None:
        ends = _ENDS[key] = tuple(b.agg(F.min("session"), F.max("session")).first())
    spine = lambda *how: ingest.calendar_spine(b.select("symbol").distinct(), *ends, *how)
    if kind == "monthly":
        days = F.dayofmonth(F.last_day("session"))
        return spine("1 month", days, days >= 30)
    sunday = F.dayofweek("session") == 1
    full = 24 if kind == "hourly" else 96
    return spine("1 day", F.when(sunday, full // 2).otherwise(full), ~sunday)


def grid(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    b = bars(spark, sf, kind)
    return ingest.complete_grid(b, calendar(b, kind))


def daily(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    m = MODELS[kind]
    return feats.daily_features(grid(spark, sf, kind), m.lookback, m.minimum)


def base(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Grid bars with session values and intraday columns, before clock statistics."""
    m = MODELS[kind]
    g = grid(spark, sf, kind)
    d = feats.daily_features(g, m.lookback, m.minimum)
    df = g.join(d, ["symbol", "session"])
    return feats.opening_range_columns(feats.intraday(df), m.length)


def feat(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    m = MODELS[kind]
    return feats.clock_stats(base(spark, sf, kind), m.lookback, m.minimum)
