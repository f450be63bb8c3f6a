"""Readers for bar files, external series, prepared tables, grids and result parts (S operators)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("time", "open", "high", "low", "close", "volume")
CSV_SCHEMA = ("symbol string, time long, open double, high double, low double, close double, volume double")


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """Files holding a JSON array of ``[time, open, high, low, close, volume]`` arrays."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_name").alias("file"), "value")
    rows = raw.select("file", F.posexplode(F.from_json("value", "array<array<double>>")).alias("pos", "r"))
    cols = [F.get("r", F.lit(i)).alias(c) for i, c in enumerate(BAR_COLUMNS)]
    return rows.select("file", "pos", *cols).withColumn("time", F.col("time").cast("long"))


def read_bars_csv(spark: SparkSession, path: str, schema: str = CSV_SCHEMA) -> DataFrame:
    """Vendor CSV with a header and a declared schema; nothing is inferred."""
    return spark.read.csv(path, schema=schema, header=True)


def read_series_csv(spark: SparkSession, path: str, date_names: list[str], value_names: list[str],
                    null: str = ".") -> DataFrame:
    """Daily series whose header differs by vendor; the null marker and bad numbers are missing."""
    raw = spark.read.csv(path, header=True, nullValue=null)
    have = {c: c for c in raw.columns}

    def first_of(names):
        cols = [F.col(f"`{have[n]}`") for n in names if n in have]
        if not cols:
            raise ValueError(f"none of {names} in header")
        return F.coalesce(*cols)

    out = raw.select(first_of(date_names).cast("date").alias("obs_date"),
                     first_of(value_names).alias("_v"))
    return out.withColumn("value", F.expr("try_cast(_v AS DOUBLE)")).drop("_v").dropna()


def read_bars_table(spark: SparkSession, path: str) -> DataFrame:
    """Prepared bars, partitioned by symbol and session month so filters prune directories."""
    return spark.read.parquet(path)


def read_grid(spark: SparkSession, path: str, axes: list[str]) -> DataFrame:
    """JSON parameter registry: one object with an array per axis, expanded to settings."""
    raw = spark.read.json(path, multiLine=True)
    return reduce(lambda d, a: d.withColumn(a, F.explode(a)), axes, raw.select(*axes))


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every result part below ``path``, however deep, with one declared schema."""
    return spark.read.json(path, schema=schema, recursiveFileLookup=True)


def files_checksum(spark: SparkSession, path: str, name: int = -1) -> DataFrame:
    """SHA-256 of every input file. Input files are split small, one file is one row, named by part ``name`` of its path."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select(F.element_at(F.split("path", "/"), name).alias("file"),
                    F.sha2("content", 256).alias("sha256"), "length"))


def changed_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose checksum is not the one in the manifest, and manifest files not found."""
    k = ["file", "sha256"]
    return (found.join(manifest, k, "left_anti").select(*k).withColumn("problem", F.lit("unlisted"))
            .unionByName(manifest.join(found, k, "left_anti").select(*k)
                         .withColumn("problem", F.lit("absent"))))


def compare_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(file, problem)``: files that are ``altered`` since the manifest, ``new`` to it, or ``absent`` now."""
    both = found.select("file", F.col("sha256").alias("now")).join(manifest.select("file", F.col("sha256").alias("then")), "file", "full")
    problem = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "absent").when(F.col("now") != F.col("then"), "altered")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("file", "problem")
