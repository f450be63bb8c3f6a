"""Joins between sessions, series, events, grids and results (J operators)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tidebar.functions.core import KEYS
from tidebar.sources.scratch import materialize


def asof_prev(left: DataFrame, left_date: str, series: DataFrame, obs_date: str, value: str, out: str,
              key: tuple = ()) -> DataFrame:
    """Strictly previous observation for every left row, optionally per key.

    Only the distinct (key, date) pairs meet the series; the rows themselves, however skewed, take the answer by an equi-join. Pairs and
    observations are dealt out in ranges of (key, date) and written with the number of their range. The last observation of
    each range is carried to the ranges behind it, one row a range and key, and a window inside each range does the rest, so
    neither a series without a key nor a key with most of the rows is one task."""
    d = left.select(*key, F.col(left_date).alias("_d")).distinct().select(
        *key, "_d", F.lit(0).alias("_o"), F.lit(None).cast("double").alias("_v"))
    obs = series.filter(F.col(value).isNotNull()).groupBy(*key, F.col(obs_date).alias("_d")).agg(
        F.max(F.col(value).cast("double")).alias("_v")).select(*key, "_d", F.lit(1).alias("_o"), "_v")
    laid = d.unionByName(obs).repartitionByRange(*key, "_d", "_o").withColumn("_p", F.spark_partition_id())
    laid = materialize(laid, "ranges")
    ends = laid.groupBy(*key, "_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_d", "_o"))).alias("_last"))
    behind = W.partitionBy(*key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*key, "_p", F.last("_last", ignorenulls=True).over(behind).alias("_carried"))
    w = W.partitionBy("_p", *key).orderBy("_d", "_o").rowsBetween(W.unboundedPreceding, -1)
    near = laid.withColumn("_near", F.last("_v", ignorenulls=True).over(w)).filter("_o = 0")
    same = reduce(lambda a, c: a & near[c].eqNullSafe(carried[c]), key, near["_p"] == carried["_p"])
    got = near.join(carried, same).select(*[near[c] for c in key], near["_d"], F.coalesce("_near", "_carried").alias(out))
    return left.join(got.select(*key, F.col("_d").alias(left_date), out), [*key, left_date], "left")


def with_daily(bars: DataFrame, daily: DataFrame, cols: list[str]) -> DataFrame:
    """Session values onto bars or events. No hint: the planner checks the size."""
    return bars.join(daily.select(*KEYS, *cols), list(KEYS))


def entry_to_deadline(events: DataFrame, bars: DataFrame, entry: Column, deadline: Column) -> DataFrame:
    """Each event with the bars from entry to deadline: equi-join on the session, slot filtered.

    The result keeps the (symbol, session) partitioning, so grouping by event needs no shuffle."""
    b = bars.select(*KEYS, F.col("slot").alias("k"), F.col("open").alias("bo"), F.col("high").alias("bh"),
                    F.col("low").alias("bl"), F.col("close").alias("bc"))
    e = events.withColumns({"_from": entry, "_to": deadline})
    return e.join(b, list(KEYS)).filter(F.col("k").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def grid_table(spark: SparkSession, axes: dict[str, list], id_prefix: str) -> DataFrame:
    """Every combination of the axes as a table: a range of ids whose mixed-radix digits pick
    the values, so the product is generated in parallel and never joined."""
    n = reduce(lambda a, v: a * len(v), axes.values(), 1)
    df, stride = spark.range(n), 1
    for name, vals in axes.items():
        digit = F.pmod(F.floor(F.col("id") / stride), F.lit(len(vals))).cast("int")
        df = df.withColumn(name, F.get(F.array(*[F.lit(v) for v in vals]), digit))
        stride *= len(vals)
    return df.withColumn("config_id", F.format_string(f"{id_prefix}-%07d", "id")).drop("id")


def explode_axes(df: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Repeat each row for every combination of the axes, in place and without a join."""
    for name, vals in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return df


def coverage_audit(manifest: DataFrame, results: DataFrame, key: str = "config_id") -> DataFrame:
    """Ids without a result and results without an id."""
    a = manifest.select(key).distinct()
    b = results.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("problem", F.lit("missing"))
            .unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("foreign"))))


def conflict_audit(results: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Ids that occur with different payloads."""
    h = F.sha2(F.to_json(F.struct(*payload)), 256)
    return results.select(key, h.alias("_h")).groupBy(key).agg(
        F.count_distinct("_h").alias("versions")).filter("versions > 1")


def payload_mismatch(manifest: DataFrame, results: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Results whose stored setting differs from the manifest's."""
    m = manifest.select(key, F.struct(*payload).alias("_m"))
    r = results.select(key, F.struct(*payload).alias("_r"))
    return m.join(r, key).filter(~F.col("_m").eqNullSafe(F.col("_r"))).select(key)


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame but not the other, with the side they are on."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("right")))


def union_latest(parts: list[DataFrame], key: str, version: str) -> DataFrame:
    """Union of result parts keeping the latest row per id, by a combinable max_by."""
    u = reduce(lambda x, y: x.unionByName(y), parts)
    rest = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(key, "_r.*")
