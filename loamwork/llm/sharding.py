"""Sharding: proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; row r of n gets
the fractional rank (r + u) / n, with u in [0, 1) from the hash of the source, so that
sources of one row or few lie evenly, too. Sorted by fractional rank every stretch
holds the sources in their proportions, so cutting the order into equal stretches
gives shards that all match the mixture, with row counts at most one apart.

Ranks are made without a task that sees a whole source: rows fall into buckets of
the sort key, bucket counts are summed to offsets in two levels (buckets within
stretches of ``STRETCH`` buckets, then the stretches), and rows are numbered only
within a bucket. Bucket numbers follow the row count, so a bucket holds about
``ROWS_PER_BUCKET`` rows whatever the size of the hottest source. The text is
read once and only its size and checksum go on.

Defined results: a null text has size 1 and checksum 0; null sources form one
source; ties in the hash order by doc_id, checksum and size; rows with a null doc_id
are shuffled by their place in the input; fully repeated rows with a doc_id
take neighbouring places in any order; an empty table gives no rows. Fewer rows
than shards leave the last places empty. Other columns do not pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, text_or_empty

ROWS_PER_BUCKET = 2_000
STRETCH = 1_000
HASH_BITS = 60


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with 0-based column ``name``, the rank by (bucket, order) within group, and the group's row count ``of``."""
    df = df.withColumn("__bucket", bucket)
    # One row a bucket: far fewer than rows, and a count each.
    counts = df.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__stretch", F.expr(f"__bucket div {STRETCH}"))
    counts = materialize(counts, f"{name}-buckets")
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__stretch")
    stretches = counts.groupBy(*group, "__stretch").agg(F.sum("__n").alias("__n")).select(
        *[F.col(g).alias(f"__s{i}") for i, g in enumerate(group)],
        F.col("__stretch").alias("__s"),
        (F.sum("__n").over(w) - F.col("__n")).alias("__earlier"),
        F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"),
    )
    on = F.col("__stretch") == F.col("__s")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__s{i}"))
    within = Window.partitionBy(*group, "__stretch").orderBy("__bucket")
    summed = counts.withColumn("__before", F.sum("__n").over(within) - F.col("__n")).join(stretches, on)
    offsets = summed.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__bucket").alias("__b"), (F.col("__before") + F.col("__earlier")).alias("__before"), "of",
    )
    inner = Window.partitionBy(*group, "__bucket").orderBy(*order)
    numbered = df.withColumn("__in", F.row_number().over(inner) - 1)
    on = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = numbered.join(offsets, on).withColumn(name, F.col("__before") + F.col("__in"))
    return joined.select(*[c for c in df.columns if c != "__bucket"], name, "of")


def interleaved_shards(
    df: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of ``df``."""
    text = text_or_empty(F.col(text_col))
    digest = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), named, F.col("text_crc32").cast("string")).cast("binary"))
    digest = materialize(
        digest.withColumn("key", F.conv(F.substring(shuffled, 1, HASH_BITS // 4), 16, 10).cast("long")), "shard-digest"
    )
    total = digest.count()
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    ties = ["doc_id", "text_crc32", "size"]
    width = -(-(1 << HASH_BITS) // buckets)
    ranked = _ranked(digest, ["source"], F.expr(f"key div {width}"), ["key", *ties], "rank")
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / (1 << 30)
    fractional = materialize(
        ranked.withColumn("fraction", (F.col("rank") + offset) / F.col("of")).drop("rank", "of"), "shard-fraction"
    )
    placed = _ranked(
        fractional, [], F.floor(F.col("fraction") * buckets).cast("long"), ["fraction", "source", "key", *ties], "place"
    )
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") - first)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
