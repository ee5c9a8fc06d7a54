"""Exact dedup: two-pass Bloom filtering, so that only possibly repeated rows shuffle.

Digests are made once and written to the shared scratch folder. The Bloom table has
``BITS_PER_ROW`` bits a row, however many rows, in blocks of ``BLOCK_BITS``; a digest's
three bits are in one block. Pass one: every task turns the distinct digests of its rows
into places in their blocks and sends those (six bytes each, packed). One merge a block
keeps two bit tables, *once* and *twice*: a digest whose bits another emission has set,
or that its own task met again, sets its bits in *twice*. Pass two tests each row
against the *twice* table: a row with a clear bit has no equal and passes straight
through. The others, true repeats and a few false positives, shuffle by digest and are
grouped exactly.

What is broadcast at a time is a slice of the table of at most ``SLICE_BITS`` (128 MiB),
and of it only blocks with a bit in *twice*. A larger table is tested slice by slice, each
over the digests that fall into it, so the method holds for any number of rows.

Defined results: a null text counts as empty. A null doc_id loses to any other;
a group with null ids only has keep_id null and keeps its rows' ids null. Rows
equal in text and in the largest doc_id are all marked kept by ``annotate``;
``exact_dedup`` returns one of them. An empty table gives an empty result. Other
columns pass through; names of this operator's own columns must not clash with
them in ``annotate`` (they are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, read, text_or_empty

BITS_PER_ROW = 16
BLOCK_BITS = 1 << 16
SLICE_BITS = 1 << 30
HASHES = 3
#: Digests that a task of pass one holds at a time.
HELD = 1_000_000


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z folded, in UTF-8."""
    return F.sha2(ascii_lower(text_or_empty(text)).cast("binary"), 256)


def table_blocks(rows: int) -> int:
    """Blocks of the table for so many rows."""
    return max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))


def places(prefix: np.ndarray) -> np.ndarray:
    """(rows, HASHES) places within their block from 60-bit digest prefixes."""
    mixed = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return np.stack([mixed >> np.uint64(16 * k) for k in range(HASHES)], axis=1).astype(np.uint16)


def _pass_one(blocks: int):
    def emission(prefixes: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(prefixes), return_counts=True)
        again, block = counts > 1, values % blocks
        order = np.lexsort((again, block))
        values, again, block = values[order], again[order], block[order]
        cuts = np.flatnonzero(np.diff(block * 2 + again, prepend=-1))
        packed = places(values)
        ends = np.append(cuts[1:], len(values))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[cuts]), pa.array(again[cuts]), pa.array([packed[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())],
            names=["block", "again", "packed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size >= HELD:
                yield emission(held)
                held, size = [], 0
        if size:
            yield emission(held)

    return run


def _merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for again, packed in zip(pdf["again"], pdf["packed"], strict=True):
        at = np.frombuffer(packed, dtype=np.uint16).reshape(-1, HASHES)
        twice[at if again else at[once[at].all(axis=1)]] = True
        once[at] = True
    bits = np.packbits(twice, bitorder="little").tobytes() if twice.any() else b""
    return pd.DataFrame({"block": [int(key[0])], "bits": [bits]})


def maybe_repeated(digests: DataFrame, rows: int, slice_bits: int = SLICE_BITS) -> DataFrame:
    """``digests`` (with column __prefix) with __maybe: whether a row may have an equal."""
    spark, blocks, width = digests.sparkSession, table_blocks(rows), slice_bits // BLOCK_BITS
    merged = digests.select("__prefix").mapInArrow(_pass_one(blocks), "block long, again boolean, packed binary")
    merged = materialize(merged.groupBy("block").applyInPandas(_merge, "block long, bits binary").filter(F.length("bits") > 0), "bloom")

    def tested(first: int, part: DataFrame) -> DataFrame:
        # At most ``slice_bits`` bits come to the driver and are broadcast.
        found = merged.filter((F.col("block") >= first) & (F.col("block") < first + width)).toArrow()
        numbers = found.column("block").to_numpy()
        table = np.frombuffer(b"".join(found.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, BLOCK_BITS // 8)
        order = np.argsort(numbers)
        shared = spark.sparkContext.broadcast((numbers[order], table[order]))

        @F.pandas_udf("boolean")
        def maybe(prefix: pd.Series) -> pd.Series:
            blocks_with, bits = shared.value
            values = prefix.to_numpy()
            if not len(blocks_with):
                return pd.Series(np.zeros(len(values), bool))
            at = np.minimum(np.searchsorted(blocks_with, values % blocks), len(blocks_with) - 1)
            spots = places(values)
            hit = (bits[at[:, None], spots >> 3] >> (spots & 7).astype(np.uint8)) & 1
            return pd.Series((blocks_with[at] == values % blocks) & hit.astype(bool).all(axis=1))

        return part.withColumn("__maybe", maybe("__prefix"))

    if blocks <= width:
        return tested(0, digests)
    slice_of = F.expr(f"(__prefix % {blocks}) div {width}")
    parts = [tested(k * width, digests.filter(slice_of == k)) for k in range(-(-blocks // width))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """``df`` with keep_id, group_size, kept and text_sha256 for every row; ``carry_text=False`` leaves the text out."""
    own = ["keep_id", "group_size", "kept", "text_sha256", "__prefix", "__maybe"]
    columns = [c for c in df.columns if c not in own and (carry_text or c != text_col)]
    hashed = df.select(*columns, digest(F.col(text_col)).alias("text_sha256"))
    hashed = materialize(hashed.withColumn("__prefix", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long")), "digests")
    flagged = maybe_repeated(hashed, hashed.count())
    out = [*columns, "keep_id", "group_size", "kept", "text_sha256"]

    alone = flagged.filter(~F.col("__maybe")).select(
        *columns,
        F.col(id_col).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    repeats = flagged.filter("__maybe")
    groups = materialize(
        repeats.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "exact-groups",
    )
    # Both sides are plain exchanges, so that a hot group is split among tasks.
    grouped = repeats.join(groups, "text_sha256").withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return alone.select(*out).unionByName(grouped.select(*out))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``df``."""
    kept = annotate(df, id_col, text_col).filter("kept")
    single = kept.filter("group_size = 1")
    several = kept.filter("group_size > 1").dropDuplicates(["text_sha256"])
    return single.unionByName(several).select(*df.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, carry_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
