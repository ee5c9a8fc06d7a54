"""Shared pieces: scratch tables, ASCII case folding, table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch, materialize, scratch_dir

__all__ = ["Scratch", "ascii_lower", "materialize", "read", "scratch_dir", "text_or_empty", "words"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: space and \x09-\x0D.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of an input folder, whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Array of the maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    return F.array_remove(F.split(c, SPACE_CLASS + "+"), "")
