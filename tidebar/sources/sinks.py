"""Writers for grids, results, ledgers, daily matrices and prepared bars (S operators)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bar_files(bars: DataFrame, path: str) -> None:
    """One JSON array-of-arrays file per (symbol, session), the layout ``read_bar_files`` takes.

    A session is bounded, so its rows fit one string."""
    row = F.array(*[F.col(c).cast("double") for c in ("time", "open", "high", "low", "close", "volume")])
    packed = bars.groupBy("symbol", "session").agg(
        F.sort_array(F.collect_list(F.struct("time", row.alias("r")))).alias("x"))
    (packed.select("symbol", "session", F.to_json(F.transform("x", lambda s: s["r"])).alias("value"))
     .write.partitionBy("symbol", "session").text(path))


def write_manifest(grid: DataFrame, path: str) -> None:
    grid.write.json(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_ledger(trades: DataFrame, path: str, context: list[str]) -> None:
    """Trade rows with their context nested, as compressed JSON lines."""
    plain = [c for c in trades.columns if c not in context]
    (trades.select(*plain, F.struct(*context).alias("context"))
     .write.option("compression", "gzip").json(path))


def write_arrays(df: DataFrame, path: str, *partition_by: str) -> None:
    """Daily or minute paths in long form; clustered first so each directory gets few files."""
    (df.repartition(*partition_by).write.partitionBy(*partition_by).parquet(path))


def write_bars_table(bars: DataFrame, path: str) -> None:
    """Prepared bars by symbol and month. Clustering on both spreads a hot symbol over months."""
    x = bars.withColumn("month", F.date_format("session", "yyyy-MM"))
    x.repartition("symbol", "month").sortWithinPartitions("session", "slot").write.partitionBy(
        "symbol", "month").parquet(path)
