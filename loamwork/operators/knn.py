"""Nearest-neighbour imputation.

Distances are Euclidean over the numeric columns without nulls. The rows that
have the value are laid out by place and cut into chunks with bounding boxes. A
row that lacks it is compared with its nearest chunk first, then with those
whose box is no farther than the k-th neighbour found there, so that the result
is that of all pairs. Both sides are spread over tasks; a task holds one chunk
and at most about ``block`` rows that lack the value.
"""

from __future__ import annotations

import warnings
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from ..functions.stats import clean_nan, col, medians, null_counts
from ..model import Decision, is_integral, is_numeric
from .base import BaseRule

NEIGHBOURS = 5
MAX_ROWS = 10_000
MAX_MISSING = 10_000
#: A chunk has so many rows, or up to twice as many; a range of the layout so many.
CHUNK = 4_096
RANGE = 100_000
#: Bits of a place in the layout, and cells of a matrix of distances.
PLACE_BITS = 52
CELLS = 2_000_000


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), dtype=float).reshape(-1, width)


def _gaps(xs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, never above those to the points inside, which are summed in the same order."""
    out = np.zeros((len(xs), len(low)))
    with np.errstate(invalid="ignore"):
        for j in range(xs.shape[1]):
            x = xs[:, j, None]
            out += np.nan_to_num(np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0.0), posinf=np.inf) ** 2
    return out


def _nearest(xs: np.ndarray, have: np.ndarray, order: np.ndarray, k: int):
    """(row of xs, row of have, squared distance) of the k nearest, ties by ``order``."""
    out = []
    step = max(1, CELLS // len(have))
    for lo in range(0, len(xs), step):
        d = np.zeros((len(xs[lo : lo + step]), len(have)))
        with np.errstate(invalid="ignore"):
            for j in range(xs.shape[1]):
                d += (xs[lo : lo + step, j, None] - have[None, :, j]) ** 2
        d[np.isnan(d)] = np.inf
        i, w = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None]) if k < len(have) else np.indices(d.shape).reshape(2, -1)
        by = np.lexsort((order[w], d[i, w], i))
        i, w = i[by], w[by]
        first = np.concatenate([[True], i[1:] != i[:-1]])
        kept = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) < k
        out.append((i[kept] + lo, w[kept], d[i[kept], w[kept]]))
    return [np.concatenate(v) for v in zip(*out, strict=True)]


def _chunked(known: DataFrame, low: list[float], high: list[float], kind: str) -> DataFrame:
    """``known`` with its chunk: rows along a Z curve of cells that are as wide in every feature, so that near rows share one."""
    width = len(low)
    spread = np.nan_to_num(np.array(high) - np.array(low))
    main = np.argsort(-spread, kind="stable")[:6]
    bits = PLACE_BITS // len(main)
    scale = spread.max() or 1.0

    def placed(batches):
        for b in batches:
            xs = _matrix(b.column("x"), width)
            z = np.zeros(len(xs), dtype=np.int64)
            with np.errstate(invalid="ignore"):
                cells = np.clip(np.nan_to_num((xs[:, main] - np.array(low)[main]) / scale), 0.0, 1.0) * (2**bits - 1)
            for i, cell in enumerate(cells.astype(np.int64).T):
                for j in range(bits):
                    z |= (cell >> j & 1) << (j * len(main) + i)
            yield pa.RecordBatch.from_arrays([pa.array(z), *b.columns], names=["z", *b.schema.names])

    def cut(batches):
        at, seq, waiting = TaskContext.get().partitionId(), 0, None
        for b in batches:
            waiting = pa.Table.from_batches([b]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([b])])
            while len(waiting) >= 2 * CHUNK:
                yield from numbered(waiting[:CHUNK], at << 32 | seq)
                waiting, seq = waiting[CHUNK:], seq + 1
        if waiting is not None and len(waiting):
            yield from numbered(waiting, at << 32 | seq)

    def numbered(rows, chunk):
        return rows.append_column("chunk", pa.array(np.full(len(rows), chunk))).combine_chunks().to_batches()

    schema = f"z long, o {kind}, y double, x array<double>"
    at = materialize(known.select("o", "y", "x").mapInArrow(placed, schema), "places")
    by = ["z", "x", "o"]
    laid = at.repartitionByRange(at.count() // RANGE + 1, *by).sortWithinPartitions(*by)
    return materialize(laid.mapInArrow(cut, schema + ", chunk long").drop("z"), "chunks")


def nearest_means(df: DataFrame, target: str, features: list[str], key: str, k: int = NEIGHBOURS, block: int = MAX_MISSING) -> DataFrame:
    """(key, value): the mean of the target over the k nearest rows, for each row without it; ties by key."""
    width, kind = len(features), "long" if is_integral(df.schema[key].dataType) else "double"
    points = df.select(
        F.monotonically_increasing_id().alias("id"), col(key).alias("key"), col(key).cast(kind).alias("o"),
        col(target).cast("double").alias("y"), F.array(*[col(c).cast("double") for c in features]).alias("x"),
    )
    points = materialize(points, "points")
    missing, known = points.filter("y is null").select("id", "x"), points.filter("y is not null")
    bounds = known.agg(*[f(F.col("x")[j]) for f in (F.min, F.max) for j in range(width)]).first()
    if bounds[0] is None or missing.isEmpty():
        return points.limit(0).select("key", F.col("y").alias("value"))
    chunks = _chunked(known, list(bounds[:width]), list(bounds[width:]), kind)
    edges = [f(F.col("x")[j]).alias(f"{n}{j}") for n, f in (("l", F.min), ("h", F.max)) for j in range(width)]
    boxes = sorted(tuple(r) for r in chunks.groupBy("chunk").agg(*edges).collect())  # one row a chunk
    shared = df.sparkSession.sparkContext.broadcast((np.array([r[0] for r in boxes]), np.array([r[1:] for r in boxes], dtype=float)))

    def visits(batches):
        """The chunks a row is to be compared with: its nearest, or with a radius all others that reach into it."""
        ids, edges = shared.value
        for b in batches:
            xs, rows = _matrix(b.column("x"), width), np.asarray(b.column("id"))
            step = max(1, CELLS // len(ids))
            for lo in range(0, len(xs), step):
                gaps = _gaps(xs[lo : lo + step], edges[:, :width], edges[:, width:])
                if "radius" in b.schema.names:
                    near = gaps <= np.asarray(b.column("radius"))[lo : lo + step, None]
                    near &= ids[None, :] != np.asarray(b.column("home"))[lo : lo + step, None]
                    i, w = np.nonzero(near)
                else:
                    i, w = np.arange(len(gaps)), gaps.argmin(axis=1)
                for at in range(0, len(i), 100_000):
                    j = i[at : at + 100_000] + lo
                    yield pa.RecordBatch.from_arrays([pa.array(rows[j]), b.column("x").take(pa.array(j)), pa.array(ids[w[at : at + 100_000]])], names=["id", "x", "chunk"])

    def compared(left, right):
        if not len(left) or not len(right):
            return found_schema.empty_table()
        order, y = np.asarray(right["o"]), np.asarray(right["y"])
        i, w, d = _nearest(_matrix(left["x"], width), _matrix(right["x"], width), order, min(k, len(right)))
        return pa.table([np.asarray(left["id"])[i], np.asarray(left["chunk"])[i], d, order[w], y[w]], schema=found_schema)

    found_schema = pa.schema([("id", pa.int64()), ("home", pa.int64()), ("d", pa.float64()), ("o", pa.int64() if kind == "long" else pa.float64()), ("y", pa.float64())])

    def compare(rows: DataFrame, name: str) -> DataFrame:
        asked = materialize(rows.mapInArrow(visits, "id long, x array<double>, chunk long"), f"{name}_visits")
        # A chunk that many rows visit serves them in several groups.
        sizes = asked.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
        left = asked.join(F.broadcast(sizes), "chunk").select("id", "x", "chunk", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("salt"))
        right = chunks.join(F.broadcast(sizes), "chunk").select("o", "y", "x", "chunk", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
        met = left.groupBy("chunk", "salt").cogroup(right.groupBy("chunk", "salt")).applyInArrow(compared, f"id long, home long, d double, o {kind}, y double")
        return materialize(met, name)

    first = compare(missing, "nearest")
    reach = first.groupBy("id").agg(F.first("home").alias("home"), F.when(F.count(F.lit(1)) < k, float("inf")).otherwise(F.max("d")).alias("radius"))
    found = first.unionByName(compare(missing.join(reach, "id"), "others"))
    top = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "o", "y"))), 1, k).alias("t"))
    mean = F.aggregate("t", F.lit(0.0), lambda s, e: s + e["y"], lambda s: s / F.size("t"))
    return points.select("id", "key").join(top, "id").select("key", mean.alias("value"))


class KnnImputer(BaseRule):
    """Imputes numeric columns by nearest neighbours; by the median beyond ``max_rows`` rows or without complete columns.

    ``key`` names a unique numeric column that tells rows apart; without one the
    first identifier-like complete numeric column serves, else the median does.
    """

    def __init__(self, k: int = NEIGHBOURS, max_rows: int = MAX_ROWS, key: str | None = None):
        super().__init__()
        self.k, self.max_rows, self.key = k, max_rows, key

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        p = params or {}
        k, limit, key = p.get("k", self.k), p.get("max_rows", self.max_rows), p.get("key", self.key)
        df = clean_nan(df)
        counts = null_counts(df)
        rows = counts.pop("__rows")
        numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
        gaps, features = [c for c in numeric if counts[c]], [c for c in numeric if not counts[c]]
        if not gaps:
            return []
        if rows > limit:
            warnings.warn(f"{rows} rows are more than max_rows={limit}; filling by the median", RuntimeWarning, stacklevel=2)
        if key is None and features:
            unique = df.agg(*[F.count_distinct(col(c)).alias(f"u{i}") for i, c in enumerate(features)]).first()
            key = next((c for i, c in enumerate(features) if unique[f"u{i}"] == rows), None)
        middle = medians(df, gaps).first()
        found = []
        for i, c in enumerate(gaps):
            ratio = counts[c] / rows
            if rows > limit or not features or key is None or counts[c] == rows:
                value = 0.0 if middle[f"m{i}"] is None else float(middle[f"m{i}"])
                found.append(self.decide(c, "median_fallback", f"{counts[c]} nulls", ratio, strategy="median_fallback", median_value=value))
                continue
            values = {str(r["key"]): r["value"] for r in nearest_means(df, c, features, key, k).collect()}  # at most max_rows
            found.append(self.decide(c, "knn_impute", f"{counts[c]} nulls", ratio, strategy="knn", k=min(k, rows - counts[c]), key=key, imputed_values=values))
        return found

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        df = clean_nan(df)
        spark = df.sparkSession
        for d in decisions:
            if d.column not in df.columns:
                continue
            if d.action == "median_fallback":
                df = df.withColumn(d.column, F.coalesce(col(d.column), F.lit(d.parameters["median_value"])))
                continue
            kind, key = df.schema[d.column].dataType, d.parameters["key"]
            values = spark.createDataFrame(list(d.parameters["imputed_values"].items()), "__k string, __v double")
            new = F.bround("__v").cast(kind) if is_integral(kind) else F.col("__v").cast(kind)
            joined = df.join(F.broadcast(values), col(key).cast("string") == F.col("__k"), "left")  # at most max_rows
            df = joined.select(*[F.coalesce(col(c), new).alias(c) if c == d.column else col(c) for c in df.columns])
        return df
