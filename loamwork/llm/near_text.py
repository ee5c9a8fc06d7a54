"""Near duplicates by exact Jaccard similarity of word shingles, on top of the SimHash operator.

SimHash finds the nearest copies: distinct texts of one component of ``simhash`` (4 of
64 bits, by deletion variants) are candidates. At similarity 0.8 two fingerprints
differ by about 10 bits, which no index of deletion variants finds at a bearable number
of keys, so the other candidates come from ``BANDS`` MinHash keys of ``ROWS`` minima of
the same shingle hashes: a pair at similarity s shares no key with probability
(1 - s^ROWS)^BANDS, 3 in a million at 0.8 and less above. Every link is checked by the
exact similarity of the two shingle sets, so none is made below the threshold.

Links inside one component need not be made. The members of a key are first compared
with one of them (a star). Texts under keys whose members are still in different
components go through an exact set-similarity join: their shingles are ordered from
rare to frequent, two sets can only reach the threshold if they share a shingle among
their first n - ceil(t n) + 1, and the places of the first shared one bound the overlap.
Those that share one are compared with the text least edited (a second star), then all
of different components with each other. So a group of texts that are alike but below
the threshold is not compared pair by pair, and no link between components is lost.

Defined results: null, empty and blank texts have no shingles and are alike; fewer
words than a shingle give one shingle of all of them; rows with equal text are one;
null doc_ids come last; an empty table gives no rows; other columns do not pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import connected_components
from .common import materialize
from .simhash import MAX_BITS, fingerprint, linked_components, shingle_hashes

THRESHOLD = 0.8
BANDS = 32
ROWS = 5
CHUNK = 4096


def _family(seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return tuple(draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(odd) for odd in (1, 0))


def band_keys(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``BANDS`` keys of a set of shingle hashes."""
    times, plus = family
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at : at + CHUNK, None] * times + plus
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family()
        for batch in batches:
            hashes = [shingle_hashes(t, size) for t in batch.column(2).to_pylist()]
            marks = np.array([fingerprint(h) for h in hashes], dtype=np.uint64).view(np.int64)
            keys = [band_keys(np.unique(h), family) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks), _lists(keys)], names=["doc_id", "mark", "bits", "keys"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["mark", "grams"])

    return run


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (id, ...) with ``root``, the component of ``links`` (itself where it has none)."""
    found = connected_components(links)
    joined = members.join(found.hint("merge"), F.col("id") == F.col("vertex"), "left")
    return materialize(joined.select(*members.columns, F.coalesce("root", "id").alias("root")), "rooted")


def _open(members: DataFrame, key: str, hub: Column) -> DataFrame:
    """Members (with root) of keys that have several components, with the key's ``hub``."""
    hubs = members.groupBy(key).agg(hub.alias("hub"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select(key, "hub")
    return materialize(members.join(hubs.hint("merge"), key), "open")


def _may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether two sets whose first shared gram has these places can reach the threshold; struct or table names a, b with n and at."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    overlap = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    return overlap * (1 + threshold) >= threshold * (na + nb) - 1e-6


def near_components(df: DataFrame, size: int, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text) and component_id, the least non-null doc_id reachable by links of at least ``threshold``, of every row."""
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = materialize(docs.mapInArrow(_sketches(size), f"doc_id {kind}, mark long, bits long, keys array<long>"), "sketches")
    marks = sketches.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    marks = materialize(marks, "marks")

    near = linked_components(marks.select(F.col("bits").alias("mark")).distinct(), MAX_BITS)
    copies = marks.join(near.hint("merge"), F.col("bits") == F.col("vertex"), "left").select("mark", F.coalesce("root", "bits").alias("root"))
    copies = materialize(copies, "simhash-groups")
    groups = copies.groupBy("root").agg(F.min("mark").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "hub")
    nearest = materialize(copies.join(groups.hint("merge"), "root").filter("mark <> hub").select(F.col("hub").alias("a"), F.col("mark").alias("b")), "nearest")

    index = marks.select(F.explode("keys").alias("key"), F.col("mark").alias("id"))
    repeated = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    shared = materialize(index.join(repeated.hint("merge"), "key", "left_semi"), "shared")
    wanted = shared.select("id").union(nearest.select("a")).union(nearest.select("b")).distinct()
    texts = docs.select("mark", "text").join(materialize(wanted, "wanted").hint("merge"), F.col("mark") == F.col("id"), "left_semi")
    sets = materialize(texts.groupBy("mark").agg(F.first("text").alias("text")).mapInArrow(_sets(size), "mark long, grams array<long>"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold."""
        one, two = (sets.select(F.col("mark").alias(s), F.col("grams").alias(f"grams_{s}")) for s in "ab")
        both = materialize(pairs.distinct(), "candidates").join(two.hint("merge"), "b").join(one.hint("merge"), "a")
        return materialize(both.filter(similarity(F.col("grams_a"), F.col("grams_b")) >= threshold).select("a", "b"), "verified")

    def star(met: DataFrame, may: Column | bool = True) -> DataFrame:
        far = met.filter("root <> hub.root").filter(may) if may is not True else met.filter("root <> hub.root")
        return verified(far.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")))

    links = verified(nearest)
    met = _open(_rooted(shared, links), "key", F.min_by(F.struct("id", "root"), F.xxhash64("id")))
    links = links.unionByName(star(met))

    rooted = _rooted(met.select("key", "id"), links)
    unsettled = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key")
    rest = materialize(rooted.join(unsettled.hint("merge"), "key", "left_semi").select("id").distinct(), "rest")
    grams = sets.join(rest.hint("merge"), F.col("mark") == F.col("id")).select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    placed = grams.join(often.hint("merge"), "gram").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("often", "gram")) - 1)
    prefix = materialize(placed.filter((F.col("often") > 1) & (F.col("at") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-6))), "prefix")
    prefix = prefix.select("gram", "id", "n", "at")
    met = _open(_rooted(prefix, links), "gram", F.min_by(F.struct("id", "root", "n", "at"), F.struct("at", "id")))
    met = met.withColumn("own", F.struct("n", "at"))
    links = links.unionByName(star(met, _may_reach("own", "hub", threshold)))

    last = _open(_rooted(met.select("gram", "id", "n", "at"), links), "gram", F.first("id")).drop("hub")
    x, y = last.alias("x"), last.alias("y")
    across = x.join(y.hint("merge"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.root") < F.col("y.root")) & _may_reach("x", "y", threshold))
    links = links.unionByName(verified(across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))))

    whole = _rooted(marks.select(F.col("mark").alias("id"), "least"), links)
    least = materialize(whole.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialize(whole.join(least.hint("merge"), "root").select(F.col("id").alias("__mark"), "component_id", "root"), "named")
    return sketches.select("doc_id", "mark").join(named.hint("merge"), F.col("mark") == F.col("__mark")).select("doc_id", "mark", "component_id", "root")


def keep_one(df: DataFrame, size: int, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each component: that with the least doc_id (nulls last), of several such the least hash of the text, of equal rows any."""
    found = near_components(df, size, threshold, id_col, text_col)
    rows = found.groupBy("doc_id", "mark", "root").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    keepers = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "mark", "n"), rank).alias("k"))
    keepers = materialize(keepers.select(F.col("k.doc_id").alias("__id"), F.col("k.mark").alias("__mark"), F.col("k.n").alias("__n")), "keepers")
    marked = df.withColumn("__own", F.xxhash64(F.col(text_col).cast("string")))
    joined = marked.join(keepers.hint("merge"), (F.col("__own") == F.col("__mark")) & F.col(id_col).eqNullSafe(F.col("__id")))
    # Repeated rows of one keeper are few as a rule, and are pre-aggregated before they shuffle.
    once, several = joined.filter("__n = 1"), joined.filter("__n > 1").dropDuplicates(["__id", "__mark"])
    return once.unionByName(several).select(*df.columns)
