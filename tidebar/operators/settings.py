"""Settings as a relation: one table for all families of a search, each row with the axes its family has.

A row is ``(setting_id, family, axes map<string, double>, stop_atr, target_r, hold)``. Families have axes of their own, and a family may have
several blocks of axes (an axis that only counts under some value of another has a block for each case).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.core import KEYS
from tidebar.operators import detect as det

#: Axes of the trigger families; numbers of bars among them are those of ``detect.WINDOWS``.
AXES = {
    "trend_pullback": ("fast", "slow", "slope_bars", "slope_atr", "vwap_filter"),
    "rolling_breakout": ("lookback", "buffer_atr", "vwap_filter", "volume_z"),
    "failed_breakout": ("lookback", "overshoot_atr", "reclaim_atr", "volume_z"),
    "vwap_stretch_reversal": ("stretch_atr", "max_slope_atr", "slope_bars"),
    "impulse_continuation": ("lookback", "impulse_atr", "volume_z"),
    "impulse_reversal": ("lookback", "impulse_atr", "volume_z"),
    "compression_breakout": ("lookback", "max_range_atr", "buffer_atr"),
    "vwap_trend_reclaim": ("streak", "tolerance_atr", "slope_atr", "slope_bars"),
}
EXECUTION = ("stop_atr", "target_r", "hold")
#: Signals that meet a bar in one row.
BLOCK = 4096


def settings_table(spark: SparkSession, blocks: list[tuple[str, dict[str, list]]]) -> DataFrame:
    """All combinations of each block ``(family, axes and execution)``, numbered on; the digits of a number pick the values, so nothing is joined."""
    made, first = [], 0
    for family, values in blocks:
        n = reduce(lambda a, v: a * len(v), values.values(), 1)
        df, stride, at = spark.range(n), 1, {}
        for name, vals in values.items():
            at[name] = F.get(F.array(*[F.lit(v).cast("double") for v in vals]), F.pmod(F.floor(F.col("id") / stride), F.lit(len(vals))).cast("int"))
            stride *= len(vals)
        axes = F.create_map(*[x for k in values if k not in EXECUTION for x in (F.lit(k), at[k])])
        made.append(df.select((F.col("id") + first).alias("setting_id"), F.lit(family).alias("family"), axes.alias("axes"), at["stop_atr"].alias("stop_atr"), at["target_r"].alias("target_r"), at["hold"].cast("int").alias("hold")))
        first += n
    return reduce(DataFrame.unionByName, made)


def checked(settings: DataFrame) -> dict[str, dict[str, list]]:
    """The families of a table with the values of their numbers of bars. An unknown family, an unknown axis, an absent one and a number of bars
    that is not whole and positive are refused. What comes back is bounded by families and numbers of bars."""
    kinds = settings.groupBy("family").agg(F.collect_set(F.concat_ws(",", F.array_sort(F.map_keys("axes")))).alias("k")).collect()
    found = {}
    for r in kinds:
        if r.family not in AXES:
            raise ValueError(f"no family is called {r.family!r}")
        for keys in r.k:
            if strange := set(keys.split(",")) ^ set(AXES[r.family]):
                raise ValueError(f"{r.family}: axes {sorted(strange)} are unknown or absent")
        bars = [a for a in AXES[r.family] if a in det.WINDOWS.get(r.family, {})]
        got = settings.filter(F.col("family") == r.family).select(*[F.collect_set(F.element_at("axes", F.lit(a))).alias(a) for a in bars]).first() if bars else {}
        found[r.family] = {a: sorted(int(v) if v == int(v) else v for v in got[a]) for a in bars}
        if bars and any(not found[r.family][a] for a in bars):
            raise ValueError(f"{r.family}: a number of bars is missing")
    return found


def signal_key():
    """Signals are settings without their execution."""
    return F.sha2(F.concat_ws("|", "family", F.to_json(F.array_sort(F.map_entries("axes")))), 256)


def events_of(feat: DataFrame, settings: DataFrame, last: int) -> DataFrame:
    """``(symbol, session, slot, side, atr, signal)`` of every signal of the table, families united in one plan.

    A bar meets the signals of a family in blocks of ``BLOCK``, by an equi-join on the block's number; with one block the planner sees one small row."""
    families = checked(settings)
    made = []
    for family, bars in sorted(families.items()):
        own = settings.filter(F.col("family") == family).select(signal_key().alias("signal"), *[F.element_at("axes", F.lit(a)).alias(a) for a in AXES[family]]).distinct()
        n = own.count()
        blocks = -(-n // BLOCK)
        packed = own.groupBy(F.pmod(F.xxhash64("signal"), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(F.struct(*own.columns)).alias("_all"))
        x = det.with_windows(feat, family, bars).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        x = x.join(packed, "_block").withColumn("_p", F.explode("_all")).drop("_all", "_block")
        up, dn = det.RULES[family](det.Cols(), det.Cols("_p.", axes={**{a: [None] for a in AXES[family]}, **bars}))
        x = x.withColumn("side", det.one_side(up, dn)).filter(F.col("side").isNotNull() & (F.col("atr") > 0) & F.col("is_normal") & (F.col("slot") < last))
        made.append(x.select(*KEYS, "slot", "side", "atr", F.col("_p.signal").alias("signal")))
    return reduce(DataFrame.unionByName, made)


def dispatched(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Each distinct (event, stop, target, hold) once, with the ids of all settings that want it, so that it is labelled once."""
    s = settings.select(signal_key().alias("signal"), "setting_id", *EXECUTION)
    return events.join(s, "signal").groupBy(*KEYS, "slot", "side", *EXECUTION).agg(F.first("atr").alias("atr"), F.collect_set("setting_id").alias("setting_ids"))
