"""Connected components of a link table by repeated contraction.

Every round each vertex is mapped to the least vertex of its neighbourhood,
chains of that mapping are shortened, links are rewritten to the mapped ends and
made distinct; rounds go on until no link is left. Each round at least halves
the vertices that still have links. All tables stay distributed; each round is
written to the shared scratch folder, so lineage stays short and the joins have
plain exchanges on both sides, which Spark splits where a vertex is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``links`` (a, b): root is the least vertex reachable.

    Vertices are longs. Self links and nulls are dropped; an empty table gives none.
    """
    edges = materialize(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    total: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "parents")
        step = _shorten(step)
        total = step if total is None else _follow(total, step)
        left = edges.join(step.withColumnRenamed("v", "a"), "a").select(F.col("p").alias("a"), "b")
        moved = materialize(left, "moved").join(step.withColumnRenamed("v", "b"), "b").select("a", F.col("p").alias("b"))
        moved = moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(moved.distinct(), "links")
    if total is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return total.select(F.col("v").alias("vertex"), F.col("p").alias("root"))


def _follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """The mapping ``first`` followed by ``then``, which leaves what it doesn't hold."""
    on = then.select(F.col("v").alias("__v"), F.col("p").alias("__p"))
    joined = first.join(on, F.col("p") == F.col("__v"), "left")
    return materialize(joined.select("v", F.coalesce("__p", "p").alias("p")), "mapping")


def _shorten(step: DataFrame) -> DataFrame:
    """Two doublings: chains of up to four steps become one."""
    for _ in range(2):
        step = _follow(step, step)
    return step


STARS = 3
SALTS = 8


def bucket_links(index: DataFrame, verify: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, stars: int = STARS) -> DataFrame:
    """Verified links (a, b) whose components are those of all pairs that share a bucket of ``index`` (key, id) and pass ``verify``.

    ``verify`` takes distinct pairs (a, b) and keeps the right ones. First each bucket
    is compared with one member of it, a few times with another one; links inside one
    component need not be made, so then only members of different components are
    compared, all of them, a hot bucket in ``SALTS`` blocks. ``known`` are links made before.
    """
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    left = materialize(index.join(sizes.hint("merge"), "key", "left_semi"), "shared")
    links = known
    for star in range(stars + 1):
        if links is None:
            rooted = left.withColumn("root", F.col("id"))
        else:
            found = connected_components(links)
            rooted = left.join(found.hint("merge"), F.col("id") == F.col("vertex"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
            rooted = materialize(rooted, "rooted")
        hub = F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(star))).alias("hub")
        hubs = rooted.groupBy("key").agg(hub, F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key", "hub")
        met = materialize(rooted.join(hubs.hint("merge"), "key"), "met")
        if star < stars:
            pairs = met.filter("root <> hub.root").select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
        else:
            one = met.select("key", F.col("id").alias("i"), F.col("root").alias("ri"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
            two = met.select("key", F.col("id").alias("j"), F.col("root").alias("rj"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
            both = one.join(two.hint("merge"), ["key", "salt"]).filter("ri < rj")
            pairs = both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        more = materialize(verify(materialize(pairs.distinct(), "candidates")).select("a", "b"), "verified")
        links = more if links is None else links.unionByName(more)
        left = met.select("key", "id")
    return links
