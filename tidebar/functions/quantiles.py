"""Exact grouped quantiles without gathering a group in one task."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidebar.sources.scratch import drop, materialize

#: Values that one task may put in order, and ranges that one round cuts a range into.
TASK, PARTS = 1 << 20, 1024


def _bucket(k: int) -> Column:
    """Twice the number of cuts ``_e`` below ``_v``, and one more where it is a cut; found by a coarse and a fine scan.
    A value that is a cut has a bucket of its own, so that one value held by many rows cannot keep a range large."""
    step = math.isqrt(k - 1) + 1
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(step), F.lit(k - 1), F.lit(step)), lambda i: F.element_at("_e", i)), lambda e: F.col("_v") > e)) if step < k else F.lit(0)
    below = coarse * step + F.size(F.filter(F.slice("_e", coarse * step + 1, step), lambda e: F.col("_v") > e))
    return 2 * below + F.coalesce((F.get("_e", below) == F.col("_v")).cast("int"), F.lit(0))


def exact_quantiles(df: DataFrame, group: list[str], value: str, qs: list[float], task: int = TASK) -> DataFrame:
    """Interpolated quantiles, columns ``q`` and ``threshold`` per group; null values are left out.

    Selection in rounds. A range that holds a wanted rank and more than ``task`` rows is cut by a sketch into as many ranges as its count asks for; exact
    counts tell which of these hold the rank, and only their rows go on. The sketch decides the work split, never the
    answer. What is left in the end is ordered, at most ``task`` values or one repeated value a range. The input is written
    once; later rounds read what is left of it."""
    by = [*group, "_id"]
    x = df.filter(F.col(value).isNotNull()).select(*group, F.lit(0).cast("decimal(38,0)").alias("_id"), F.col(value).cast("double").alias("_v"))
    work = materialize(x, "values")
    ends = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    sizes = work.groupBy(*by).agg(*ends)
    wanted = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_pos", (F.col("_n") - 1) * F.col("q"))
    wanted = wanted.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos"))))).withColumn("_r", F.col("_k"))
    wanted = materialize(wanted.select(*by, "q", "_pos", "_k", "_r", "_n", "_lo", "_hi"), "wanted")
    while (most := wanted.filter((F.col("_n") > task) & (F.col("_lo") < F.col("_hi"))).agg(F.max("_n")).first()[0]) is not None:
        k = max(2, min(PARTS, -(-2 * most // task)))
        large = wanted.filter((F.col("_n") > task) & (F.col("_lo") < F.col("_hi"))).select(*by).distinct()
        cut = work.join(large, by, "left_semi").groupBy(*by).agg(F.percentile_approx("_v", [i / k for i in range(1, k)], k * 20).alias("_e"))
        rows = work.join(cut, by, "left").withColumn("_b", F.when(F.col("_e").isNull(), 0).otherwise(_bucket(k)))
        rows = rows.select(*by, "_v", (F.col("_id") * (2 * k) + F.col("_b")).cast("decimal(38,0)").alias("_to"))
        counts = rows.groupBy(*by, "_to").agg(*ends)
        order = W.partitionBy(*by).orderBy("_to").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        found = wanted.drop("_n", "_lo", "_hi").join(counts, by).filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_n")))
        new = materialize(found.select(*group, F.col("_to").alias("_id"), "q", "_pos", "_k", (F.col("_r") - F.col("_before")).alias("_r"), "_n", "_lo", "_hi"), "wanted")
        left = materialize(rows.select(*group, F.col("_to").alias("_id"), "_v").join(new.select(*by).distinct(), by, "left_semi"), "values")
        drop(work, wanted)
        work, wanted = left, new
    vals = work.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_m"))
    vals = vals.withColumn("_upto", F.sum("_m").over(W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    hit = wanted.join(vals, by).filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_m")))
    lo, hi = F.min_by("_v", "_k"), F.max_by("_v", "_k")
    frac = F.first("_pos") - F.floor(F.first("_pos"))
    return hit.groupBy(*group, "q").agg((lo + (hi - lo) * frac).alias("threshold"))
