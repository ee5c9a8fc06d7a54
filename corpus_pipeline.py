"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; ``n_chars`` follows the text. A stage deletes
the scratch tables of the stage before it on the same input, which its caller has
written by then, and nobody else's.

Defined results, for every stage: null texts count as empty; null doc_ids and repeated
rows are rows of their own (the near-duplicate stage keeps one of rows with near texts,
whatever their ids); an empty table gives an empty result; other columns than those of
``documents`` do not pass through, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.scratch import heap_watched, trim
from loamwork.llm import line_dedup as lines
from loamwork.llm import mixing, near_text, packing, quality_rules
from loamwork.llm.common import Scratch, materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share this part of their five-word shingles.
SHINGLE = 5
SIMILARITY = 0.8

_owned: dict[tuple[str, str], Scratch] = {}


def _stage(function: Callable) -> Callable:
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key in _owned:
            _owned.pop(key).delete()
        trim(spark)
        with Scratch(spark) as own, heap_watched(spark):
            out = function(spark, docs.select(*COLUMNS), sf_dir)
        _owned[key] = own
        return out

    return run


@_stage
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; texts without words go."""
    return quality_rules.quality_rules(docs).filter("kept").select(*COLUMNS)


@_stage
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later occurrences of repeated three-line windows; rows equal in doc_id and text share their fate."""
    return lines.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near texts: that with the least doc_id, nulls last; texts without words are one component."""
    return near_text.keep_one(docs, SHINGLE, SIMILARITY)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says; rates of clean prose are one or a little more."""
    mixed = mixing.mix(docs, read(spark, sf_dir, "labels"), carry=COLUMNS).filter("copies > 0")
    return mixed.select("carried.*", F.explode(F.sequence(F.lit(1), "copies")).alias("__copy")).select(*COLUMNS)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a text without tokens is one document of the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("simhash", near_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Expectation-maximisation, fingerprints, the classifier and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = read(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        staged = stage(spark, docs, sf_dir)
        with Scratch(spark) as own:
            docs = materialize(staged, f"stage-{name}")
        before.delete()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
