"""Files in and out: Parquet and CSV by path, on any store Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.stats import sample_rows


def extension(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its suffix, CSV with a header and inferred types otherwise."""
    if extension(path) in ("parquet", "pq"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_path(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet by its suffix, CSV with a header otherwise; a folder of part files."""
    if extension(path) in ("parquet", "pq"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).csv(path)
    return path


def default_output(path: str) -> str:
    """``<stem>_cleaned<suffix>`` beside the input; the scheme of a URI stays as it is."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    return f"{folder}{slash}{stem}_cleaned.{suffix}" if dot and stem else f"{folder}{slash}{name}_cleaned"


def read_schema(spark: SparkSession, path: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in read_path(spark, path).schema}


def row_count(spark: SparkSession, path: str) -> int:
    return read_path(spark, path).count()


def sample_path(spark: SparkSession, path: str, k: int = 10_000, seed: int = 42) -> DataFrame:
    return sample_rows(read_path(spark, path), k, seed)
