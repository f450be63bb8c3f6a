"""Window shapes, null-safe arithmetic and tick rounding shared by every operator.

Conventions: a bar is keyed by ``(symbol, session, slot)``; NULL means missing and
NaN never occurs; a value in row ``slot`` is known when that bar has closed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("symbol", "session")
TICK = 0.25
GUARD = 1e-8


def by_session():
    """Bars of one session in slot order. Bounded by the slots of a session."""
    return W.partitionBy(*KEYS).orderBy("slot")


def by_clock():
    """The same slot through the sessions of a symbol. Bounded by the calendar."""
    return W.partitionBy("symbol", "slot").orderBy("session")


def by_day():
    """Sessions of one symbol in date order. Bounded by the calendar."""
    return W.partitionBy("symbol").orderBy("session")


def whole_session():
    return W.partitionBy(*KEYS)


def upto(w):
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


def before(w):
    return w.rowsBetween(W.unboundedPreceding, -1)


def prior(w, n: int):
    return w.rowsBetween(-n, -1)


def trailing(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def ahead(w, n: int):
    return w.rowsBetween(1, n)


def at_least(agg: Column, x: Column, frame, m: int) -> Column:
    """``agg`` over ``frame`` only when at least ``m`` values of ``x`` are present."""
    return F.when(F.count(x).over(frame) >= m, agg.over(frame))


def ratio(a, b) -> Column:
    return F.try_divide(F.lit(a) if not isinstance(a, Column) else a, b)


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def sgn(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)


def quantile(x: Column, q: float) -> Column:
    """Exact interpolated quantile; usable in an ordered frame (median is not)."""
    return F.percentile(x, F.lit(q))


def floor_tick(px: Column) -> Column:
    return F.floor(px / TICK + GUARD) * TICK


def ceil_tick(px: Column) -> Column:
    return F.ceil(px / TICK - GUARD) * TICK


def away_tick(px: Column, side: Column) -> Column:
    """Protective stops move away from the market: down for longs, up for shorts."""
    return F.when(side > 0, floor_tick(px)).otherwise(ceil_tick(px))


def toward_tick(px: Column, side: Column) -> Column:
    """Targets move toward the entry, so a fill never promises extra reward."""
    return F.when(side > 0, floor_tick(px)).otherwise(ceil_tick(px))


def signed(side: Column, up: Column, down: Column) -> Column:
    return F.when(side > 0, up).otherwise(down)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form: doubles rounded with -0.0 removed, integers widened to bigint.

    A nudge far below the rounding unit moves exact decimal ties off the half, so that the order
    of a distributed sum cannot show in the last digit; the SQL twins round the same way."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(3e-10), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def first_of(col: str) -> Column:
    """Value of the earliest bar that has one (aggregate or window function)."""
    return F.min_by(col, F.when(F.col(col).isNotNull(), F.col("slot")))


def last_of(col: str) -> Column:
    """Value of the latest bar that has one (aggregate or window function)."""
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col("slot")))


def total(array) -> Column:
    """Sum of a double array."""
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)
