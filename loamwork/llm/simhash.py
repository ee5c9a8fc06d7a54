"""SimHash near-dedup by deletion-variant signatures.

A document's fingerprint has bit j set where over half the XXH64 hashes of its
word shingles have it set. Fingerprints link at ``max_bits`` differing bits or
fewer. To find all links without comparing all pairs, the fingerprint is cut into
``max_bits // 2 + 1`` segments: with at most ``max_bits`` differing bits one
segment differs by at most one bit. Each segment is indexed once as it is and once
for each of its bits with that bit as a wildcard; fingerprints whose segments
differ by at most one bit meet under a variant, and an equality join with a check
of the whole distance yields the links.

Only distinct fingerprints are indexed, so copies add nothing. The result is the
component of each document, so links inside what is known to be one component
need not be made: first each variant's least and largest fingerprints are compared
with the variant's members (a star, not all pairs), components of these links are
made, and only members of *different* components that meet under a variant are
compared with each other, exactly. No link between components is lost. The joins
have plain exchanges on both sides; a hot variant is split among tasks.

The number of comparisons grows with the square of the distinct fingerprints over
2^20 (the segment's values): cheap to about 10^8 fingerprints, beyond which a
smaller ``max_bits`` (more bits in a key for each link) should be taken.

Defined results: a null, empty or blank text has fingerprint zero and links like
any other; fewer words than a shingle give one shingle of all of them; component_id
is the least non-null doc_id reachable, null where there is none; repeated rows
keep their rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from ..functions.components import connected_components

BITS = 64
MAX_BITS = 4
SHINGLE = 4
SEED = 42
CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the A-Z-folded text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            marks = np.array([fingerprint(shingle_hashes(t, size)) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks)], names=[*batch.schema.names[:-1], "mark"])

    return run


def fingerprints(df: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark): the fingerprint as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprints(size), f"doc_id {kind}, mark long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: so many that one differs by at most one bit."""
    n = max_bits // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variant_keys(mark: Column, max_bits: int) -> Column:
    """Array of the keys under which a fingerprint is indexed: segment, wildcard and the other bits."""
    keys, number = [], 0
    for first, width in segments(max_bits):
        value = F.shiftrightunsigned(mark, first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in [None, *range(width)]:
            kept = value if bit is None else value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(kept.bitwiseOR(F.lit(number << 48)))
            number += 1
    return F.array(*keys)


def _near(a: str, b: str, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def linked_components(marks: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(vertex, root) of all distinct ``marks`` (column mark) that have a link."""
    index = materialize(marks.select("mark", F.explode(variant_keys(F.col("mark"), max_bits)).alias("key")), "variants")
    buckets = index.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count(F.lit(1)).alias("n"))
    hubs = materialize(buckets.filter("low < high"), "hubs")
    # Most shared variants are chance meetings of two, whose one comparison needs no join.
    twos = hubs.filter((F.col("n") == 2) & _near("low", "high", max_bits)).select(F.col("low").alias("a"), F.col("high").alias("b"))
    # The members of variants that more than two fingerprints have.
    met = materialize(index.join(hubs.filter("n > 2"), "key"), "met")
    star = met.filter(_near("mark", "low", max_bits)).select(F.col("mark").alias("a"), F.col("low").alias("b"))
    star = star.unionByName(met.filter(_near("mark", "high", max_bits)).select(F.col("mark").alias("a"), F.col("high").alias("b")))
    star = star.unionByName(twos)
    found = materialize(connected_components(star), "star-components")

    labelled = materialize(
        met.select("key", "mark").join(found, F.col("mark") == F.col("vertex"), "left").select("key", "mark", F.coalesce("root", "mark").alias("root")),
        "labelled",
    )
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key")
    rest = materialize(labelled.join(open_keys, "key", "left_semi"), "open")
    a = rest.select("key", F.col("mark").alias("a"), F.col("root").alias("ra"))
    b = rest.select("key", F.col("mark").alias("b"), F.col("root").alias("rb"))
    across = a.join(b, (a["key"] == b["key"]) & (F.col("ra") < F.col("rb")) & _near("a", "b", max_bits))
    more = connected_components(across.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    # Roots linked across: a root that the star left alone stands for itself.
    joined = found.join(more.select(F.col("vertex").alias("__v"), F.col("root").alias("__r")), F.col("root") == F.col("__v"), "left")
    first = joined.select("vertex", F.coalesce("__r", "root").alias("root"))
    alone = more.join(found.select("vertex"), "vertex", "left_anti")
    return first.unionByName(alone)


def near_duplicates(
    df: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    docs = materialize(fingerprints(df, size, id_col, text_col), "fingerprints")
    marks = materialize(docs.groupBy("mark").agg(F.min("doc_id").alias("least")), "marks")
    parts = linked_components(marks, max_bits)
    rooted = materialize(
        marks.join(parts, F.col("mark") == F.col("vertex"), "left").select("mark", "least", F.coalesce("root", "mark").alias("root")),
        "rooted",
    )
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialize(rooted.join(least, "root").select("mark", "component_id"), "named")
    return docs.join(named, "mark").select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
