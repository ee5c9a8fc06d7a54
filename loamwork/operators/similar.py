"""Rules on similar text: unified category spellings and near-duplicate rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.components import bucket_links, connected_components
from ..functions.scratch import materialize
from ..functions.stats import clean_nan, col
from ..model import Decision, is_string
from .base import BaseRule

MATCHES = 5
MAX_VALUES = 5_000
BUCKET_PAIRS = 500


class FuzzyUnifier(BaseRule):
    """Maps similar spellings of a category to the one met first (by ``order_by``, else the least).

    Groups are made greedily over the distinct values, from the least on; each
    takes its best ``MATCHES`` matches. Beyond ``max_values`` distinct values the matches
    are found by a distributed join and only values that have any come to the driver;
    the groups are the same.
    """

    def __init__(self, threshold: float = 80.0, exclude_cols: list[str] | None = None, pre_lowercase: bool = False, order_by: str | None = None, max_values: int = MAX_VALUES):
        super().__init__()
        self.threshold, self.exclude, self.fold, self.order_by, self.max_values = threshold, set(exclude_cols or ()), pre_lowercase, order_by, max_values

    def groups(self, values: list[str]) -> dict[str, str]:
        """Value to canonical value; ``values`` in the order they were met."""
        place = {v: i for i, v in enumerate(values)}
        forms: dict[str, list[str]] = {}
        for v in values:
            forms.setdefault(v.lower() if self.fold else v, []).append(v)
        left, mapping = set(forms), {}
        while left:
            target = min(left)
            scored = sorted(((-X.token_sort(target, v), v) for v in left))
            taken = {v for s, v in scored[:MATCHES] if -s >= self.threshold} | {target}
            left -= taken
            members = [m for t in taken for m in forms[t]]
            if len(members) > 1:
                canonical = min(members, key=place.__getitem__)
                mapping |= {m: canonical for m in members if m != canonical}
        return mapping

    def joined_groups(self, values: DataFrame) -> dict[str, str]:
        """As ``groups``, of a table (v, at); two forms at the threshold share a pair of letters or are both very short."""
        forms = values.groupBy((F.lower("v") if self.fold else F.col("v")).alias("form")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("members"))
        forms = materialize(forms.withColumn("s", X.words_sorted("form")).withColumn("n", F.length("s")), "forms")
        share = self.threshold / 100
        # Matched letters at threshold t of summed length S have at least S (1.5 t - 1) - 1 neighbours in common.
        short = 1 / (1.5 * share - 1) if share > 2 / 3 else None
        at = F.sequence(F.lit(1), F.col("n") - 1)
        pairs = F.when(F.col("n") > 1, F.array_distinct(F.transform(at, lambda i: F.substring("s", i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
        blocks = F.array(F.lit("")) if short is None else F.when(F.col("n") <= short, F.concat(pairs, F.array(F.lit("")))).otherwise(pairs)
        index = materialize(forms.select("form", "s", "n", F.explode(blocks).alias("block")), "blocks")
        a, b = (index.select("block", F.col("form").alias(f"f{k}"), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
        met = a.join(b, "block").filter("fa < fb").filter(2 * F.least("na", "nb") >= (share - 1e-9) * (F.col("na") + F.col("nb")))
        met = met.select("fa", "fb").distinct().withColumn("score", X.token_sort_ratio("fa", "fb")).filter(F.col("score") >= self.threshold)
        near: dict[str, dict[str, float]] = {}
        met = materialize(met, "matches")
        for r in met.toLocalIterator():
            near.setdefault(r["fa"], {})[r["fb"]] = near.setdefault(r["fb"], {})[r["fa"]] = r["score"]
        wanted = met.select(F.col("fa").alias("form")).unionByName(met.select(F.col("fb").alias("form"))).distinct()
        kept = forms.join(wanted, "form", "left_semi").unionByName(forms.join(wanted, "form", "left_anti").filter(F.size("members") > 1))
        members = {r["form"]: [(m["at"], m["v"]) for m in r["members"]] for r in kept.select("form", "members").toLocalIterator()}
        left, mapping = set(members), {}
        for target in sorted(members):
            if target not in left:
                continue
            scored = sorted([(-100.0, target), *((-s, v) for v, s in near.get(target, {}).items() if v in left)])
            taken = {v for _, v in scored[:MATCHES]} | {target}
            left -= taken
            group = [m for t in taken for m in members[t]]
            canonical = min(group, key=lambda m: (m[0] is not None, m[0], m[1]) if m[0] is not None else (False, m[1]))[1]
            mapping |= {m: canonical for _, m in group if m != canonical}
        return mapping

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        found = []
        for f in df.schema:
            if not is_string(f.dataType) or f.name in self.exclude:
                continue
            c = col(f.name)
            first = F.min(col(self.order_by)) if self.order_by else F.min(c)
            values = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(first.alias("at"))
            rows = values.orderBy("at", "v").limit(self.max_values + 1).collect()
            if len(rows) < 2:
                continue
            mapping = self.groups([r["v"] for r in rows]) if len(rows) <= self.max_values else self.joined_groups(values)
            if mapping:
                found.append(self.decide(f.name, "replace_values", f"{len(mapping)} spellings of others", mapping=mapping, threshold=self.threshold))
        return found

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        for d in decisions:
            if d.column in df.columns:
                df = df.replace(d.parameters["mapping"], subset=[d.column])
        return df


def near_duplicate_links(docs: DataFrame, threshold: float, permutations: int) -> DataFrame:
    """(a, b) of the verified pairs of docs (id long, doc string), by MinHash bands.

    Rows with equal text are one; their links follow from the first of them.
    Buckets of up to ``BUCKET_PAIRS`` texts are compared pairwise. Of larger ones only
    members of different components are, so that their links give the same clusters
    without emitting all pairs.
    """
    bands, rows = X.band_shape(permutations, threshold)
    texts = materialize(docs.groupBy("doc").agg(F.min("id").alias("id")), "texts")
    grams = texts.select("id", "doc", X.shingles(F.col("doc")).alias("grams"))
    signed = grams.select("id", X.minhash(F.transform("grams", X.token_hash), permutations).alias("sig"))
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    index = materialize(signed.select("id", F.explode(keys).alias("key")), "bands")
    sizes = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    met = index.join(sizes, "key")
    small = met.filter(F.col("n") <= BUCKET_PAIRS)
    pairs = small.select("key", F.col("id").alias("a")).join(small.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b")
    pairs = materialize(pairs.distinct(), "candidates")
    left, right = (grams.select(F.col("id").alias(s), F.col("doc").alias(f"doc_{s}"), F.col("grams").alias(f"grams_{s}")) for s in "ab")

    def verify(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(left, "a").join(right, "b").withColumn("j", X.jaccard(F.col("grams_a"), F.col("grams_b")))
        sure = joined.filter(F.col("j") >= threshold).select("a", "b")
        # The slower ratio is only computed where the sets don't decide.
        other = joined.filter(F.col("j") < threshold).filter(X.token_sort_ratio("doc_a", "doc_b") / 100 >= threshold).select("a", "b")
        return sure.unionByName(other)

    found = materialize(verify(pairs), "small")
    large = materialize(met.filter(F.col("n") > BUCKET_PAIRS).select("key", "id"), "large")
    if not large.isEmpty():
        found = bucket_links(large, verify, known=found)
    equal = docs.join(texts.select("doc", F.col("id").alias("first")), "doc").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    # Texts too short for a shingle are all alike.
    return materialize(found.unionByName(equal), "pairs")


class NearDuplicateDetector(BaseRule):
    """Flags clusters of near-duplicate rows; the transform changes nothing.

    ``key`` names a unique long column; without one rows are numbered in file order.
    """

    def __init__(self, num_perm: int = 32, threshold: float = 0.85, key: str | None = None):
        super().__init__()
        self.num_perm, self.threshold, self.key = num_perm, threshold, key

    def clusters(self, df: DataFrame, threshold: float | None = None, num_perm: int | None = None) -> DataFrame:
        """(id, cluster): the rows that have a near duplicate, with the least id of their cluster."""
        columns = [col(c) for c in df.columns if c != self.key]
        document = X.row_document(columns)
        if self.key:
            docs = df.select(col(self.key).cast("long").alias("id"), document.alias("doc"))
        else:
            docs = materialize(df.select(document.alias("doc")), "rows").select(F.monotonically_increasing_id().alias("id"), "doc")
            docs = materialize(docs, "numbered")
        links = near_duplicate_links(docs, threshold or self.threshold, num_perm or self.num_perm)
        return connected_components(links).select(F.col("vertex").alias("id"), F.col("root").alias("cluster"))

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        p = params or {}
        threshold, n = p.get("threshold", self.threshold), p.get("num_perm", self.num_perm)
        df = clean_nan(df)
        rows = df.count()
        if rows <= 1:
            return []
        found = self.clusters(df, threshold, n).groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("cluster").collect()
        if not found:
            return []
        clusters = [r["ids"] for r in found]
        dups = sum(map(len, clusters))
        return [
            self.decide("all", "flag_duplicates", f"{dups} rows in {len(clusters)} clusters", dups / rows, clusters=clusters, num_duplicates=dups, threshold=threshold, num_perm=n)
        ]

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        return df
