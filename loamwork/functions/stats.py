"""Column statistics: every function makes its aggregates in one pass over the table, percentiles in one over its distinct values besides."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import is_countable, is_numeric
from .scratch import materialize

CATEGORY_CAP = 100


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in float and double columns, so that both count as missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.nanvl(col(n), F.lit(None).cast(df.schema[n].dataType)) for n in floats}) if floats else df


def distinct_count(c: Column, count_nulls: bool = True) -> Column:
    """Distinct values; a null is a value of its own unless told otherwise."""
    n = F.count_distinct(c)
    return n + F.max(F.when(c.isNull(), 1).otherwise(0)) if count_nulls else n


def null_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return {"__rows": row[0]} | {c: row[f"n{i}"] for i, c in enumerate(df.columns)}


def profile(df: DataFrame, category_cap: int | None = CATEGORY_CAP, exact: bool = True) -> dict[str, dict[str, Any]]:
    """By column: null_ratio; mean and std_dev of numbers; unique_count and categories of the rest.

    Categories are listed in order, and only where there are at most
    ``category_cap`` (``categories_capped`` tells), so that what comes to the
    driver is bounded. ``exact=False`` counts distinct values approximately, which
    spares wide tables a row expansion for each counted column. An empty table has
    an empty profile.
    """
    df = clean_nan(df)
    kinds = {f.name: f.dataType for f in df.schema}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, kind) in enumerate(kinds.items()):
        c = col(name)
        aggs.append(F.avg(F.when(c.isNull(), 1.0).otherwise(0.0)).alias(f"null{i}"))
        if is_numeric(kind):
            aggs += [F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}")]
        elif is_countable(kind):
            n = distinct_count(c) if exact else F.approx_count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))
            aggs.append(n.alias(f"unique{i}"))
    row = df.agg(*aggs).first()
    if not row["rows"]:
        return {}
    number = lambda x: 0.0 if x is None or math.isnan(x) else float(x)
    out: dict[str, dict[str, Any]] = {}
    few = []
    for i, (name, kind) in enumerate(kinds.items()):
        stats: dict[str, Any] = {"null_ratio": number(row[f"null{i}"])}
        if is_numeric(kind):
            stats |= {"mean": number(row[f"mean{i}"]), "std_dev": number(row[f"std{i}"])}
        elif is_countable(kind):
            stats["unique_count"] = int(row[f"unique{i}"])
            if isinstance(kind, (T.StringType, T.BooleanType)):
                stats["categories_capped"] = category_cap is not None and stats["unique_count"] > category_cap + 1
                if not stats["categories_capped"]:
                    few.append(name)
        out[name] = stats
    if few:
        sets = df.agg(*[F.sort_array(F.collect_set(col(c).cast("string"))).alias(f"s{i}") for i, c in enumerate(few)]).first()
        for i, c in enumerate(few):
            out[c]["categories"] = list(sets[f"s{i}"])
    return out


#: Buckets of values in the search for a percentile: so many to a factor e of 1 + |value|.
BUCKETS = 1024


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v, n): how often each value, as a double, is in the i-th column; nulls are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("e")
    return df.select(each).select("e.i", "e.v").filter("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))


def percentiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(i, k, value): the linearly interpolated k-th share of each column of ``value_counts``, as ``percentile`` has it.

    The ranks are looked for in buckets of values and then among the values of the
    buckets met, so that no task holds the values of a column.
    """
    # Java's log1p never falls while its argument rises; NaN comes last.
    cells = counts.withColumn("b", F.signum("v") * F.floor(F.log1p(F.abs("v")) * BUCKETS))
    run = Window.partitionBy("i").orderBy("b")
    sizes = cells.groupBy("i", "b").agg(F.sum("n").alias("m"))
    sizes = sizes.withColumn("until", F.sum("m").over(run)).withColumn("rows", F.sum("m").over(Window.partitionBy("i")))
    sizes = sizes.select("i", "b", "until", (F.col("until") - F.col("m")).alias("before"), "rows", F.posexplode(F.array(*map(F.lit, shares))).alias("k", "share"))
    sizes = sizes.withColumn("at", (F.col("rows") - 1) * F.col("share"))
    sizes = sizes.withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    within = lambda r: (F.col(r) >= F.col("before")) & (F.col(r) < F.col("until"))
    met = sizes.filter(within("low") | within("high")).select("i", "b", "k", "at", "low", "high", "before")
    leaf = cells.join(F.broadcast(met), ["i", "b"])  # at most two rows a share
    leaf = leaf.withColumn("until", F.col("before") + F.sum("n").over(Window.partitionBy("i", "k", "b").orderBy("v")))
    leaf = leaf.withColumn("before", F.col("until") - F.col("n")).filter(within("low") | within("high"))
    ends = leaf.groupBy("i", "k").agg(F.first("at").alias("at"), F.first("low").alias("low"), F.first("high").alias("high"), F.max(F.when(within("low"), F.col("v"))).alias("a"), F.max(F.when(within("high"), F.col("v"))).alias("z"))
    between = (F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("z")
    return ends.select("i", "k", F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(between).alias("value"))


def quartiles(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, tuple[float, float] | None]:
    """Linearly interpolated first and third quartile by column; None where all is null."""
    if not columns:
        return {}
    if exact:
        found = {(r["i"], r["k"]): r["value"] for r in percentiles(materialize(value_counts(df, columns), "values"), [0.25, 0.75]).collect()}
        return {c: (found[i, 0], found[i, 1]) if (i, 0) in found else None for i, c in enumerate(columns)}
    row = df.agg(*[F.percentile_approx(col(c), [0.25, 0.75], 100_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: (float(row[f"q{i}"][0]), float(row[f"q{i}"][1])) if row[f"q{i}"] else None for i, c in enumerate(columns)}


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, m0, m1, ...: the median of each column, null where all is null."""
    found = percentiles(value_counts(df, columns), [0.5])
    return found.agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"m{i}") for i in range(len(columns))])


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null where one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def sample_rows(df: DataFrame, k: int = 10_000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Exactly k rows (all where there are fewer), the same for the same seed: the least hashes of the key columns."""
    keys = [col(c) for c in key or df.columns if is_countable(df.schema[c].dataType)]
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(k)
