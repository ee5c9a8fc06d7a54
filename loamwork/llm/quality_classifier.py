"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels table: 2 for good and clean, 1 for one fault (low
quality or toxic), 0 for both. One weight vector over hashed text features is
shared by all grades, with ordered thresholds t1 < t2:
P(grade >= k) = sigmoid(w.x - t_k). It gives every document its expected grade and
the tail probabilities, and selection keeps those whose P(grade >= 2) reaches
``select_at``.

Features are the presence of each distinct word (A-Z folded, punctuation at the
ends taken off), of the word beginnings of ``STEMS`` bytes, of each run of
punctuation within a word, and of a few binned shape counts, hashed to 2^18
weights; whole texts are read. The model is fitted by Adam with a sparsity penalty
in numpy on the driver, on at most ``sample`` labelled documents taken in
hash order (a documented bound; all labelled rows where there are fewer). Scoring
is one pass without a shuffle.

Defined results: null, empty and blank texts have only shape features; label rows
with nulls are left out, and of a document's several label rows each counts;
without labels the expected grade is the prior's, 1.0, and nothing is selected;
repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

WIDTH = 1 << 18
SAMPLE = 20_000
SELECT_AT = 0.5
MIN_DOCS = 10
STRIP = b".,;:!?()[]{}\"'|*#$%&<>-_=+/\\"
CACHE = 300_000
#: Lengths in bytes of the word beginnings that are features too, for words that come with many endings.
STEMS = (5, 6)


class Features:
    """Sorted distinct feature numbers of a text; hashes of words are cached up to ``CACHE``."""

    def __init__(self) -> None:
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def word(self, word: bytes) -> tuple[int, ...]:
        core = word.strip(STRIP)
        out = [crc32(core) % WIDTH] if core else []
        out += [crc32(b"\x02" + core[:n]) % WIDTH for n in STEMS if len(core) > n]
        rest = word.replace(core, b" ", 1) if core else word
        out += [crc32(b"\x00" + run) % WIDTH for run in rest.split() if run not in (b".", b",")]
        return tuple(out)

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        words = raw.lower().split()
        if len(self.cache) > CACHE:
            self.cache.clear()
        found: set[int] = set()
        for w in set(words):
            f = self.cache.get(w)
            if f is None:
                f = self.word(w)
                if len(w) < 64:
                    self.cache[w] = f
            found.update(f)
        n = max(1, len(words))
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = len(raw) - len(raw.translate(None, b"#*$%&|<>!"))
        lines = raw.split(b"\n")
        shape = {
            "words": len(words).bit_length(),
            "distinct": 10 * len(set(words)) // n,
            "upper": min(9, 10 * upper // max(1, len(raw))),
            "marks": min(9, 4 * marks // n),
            "lines": 5 * len(set(lines)) // len(lines),
        }
        found.update(crc32(f"\x01{k}={v}".encode()) % WIDTH for k, v in shape.items())
        return np.fromiter(sorted(found), dtype=np.int32, count=len(found))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(features: list[np.ndarray], grades: np.ndarray, steps: int = 150, rate: float = 0.05, sparsity: float = 2e-4):
    """(weights, t1, t2) of the cumulative-link model with grades 0, 1, 2."""
    w, t, gap = np.zeros(WIDTH), -1.0, 0.0
    if not len(features):
        return w, 0.0, 0.0
    # Features of very few documents are what a document is alone in; they teach nothing about others.
    common = np.bincount(np.concatenate(features), minlength=WIDTH) >= min(MIN_DOCS, len(features))
    features = [f[common[f]] for f in features]
    lengths = np.array([len(f) for f in features])
    flat, row = np.concatenate(features), np.repeat(np.arange(len(features)), lengths)
    n, m1, m2 = len(features), np.zeros(WIDTH + 2), np.zeros(WIDTH + 2)
    y0, y2 = grades == 0, grades == 2
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=w[flat], minlength=n)
        p1, p2 = _sigmoid(score - t), _sigmoid(score - t - np.exp(gap))
        # d(log likelihood)/d(score) is p-free in the tails and shared in the middle.
        middle = np.maximum(p1 - p2, 1e-12)
        d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
        g1 = np.where(y0, -d1 / np.maximum(1 - p1, 1e-12), np.where(y2, 0.0, d1 / middle))
        g2 = np.where(y2, d2 / np.maximum(p2, 1e-12), np.where(y0, 0.0, -d2 / middle))
        grad = np.empty(WIDTH + 2)
        grad[:WIDTH] = -np.bincount(flat, weights=(g1 + g2)[row], minlength=WIDTH) / n
        grad[WIDTH] = (g1 + g2).sum() / n
        grad[WIDTH + 1] = g2.sum() * np.exp(gap) / n
        m1 += 0.1 * (grad - m1)
        m2 += 0.001 * (grad * grad - m2)
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w -= move[:WIDTH]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity / (np.sqrt(m2[:WIDTH] / (1 - 0.999**step)) + 1e-8), 0)
        t -= move[WIDTH]
        gap -= move[WIDTH + 1]
    return w, t, t + np.exp(gap)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Features()
    for b in batches:
        feats = [make.of(t).tolist() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(feats, pa.list_(pa.int32()))], names=["grade", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """The model fitted on a bounded sample of labelled rows, in hash order."""
    graded = labels.filter("doc_id is not null and quality is not null and toxic is not null").select(
        F.col("doc_id").alias("__label_id"),
        (F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("grade"),
    )
    picked = graded.orderBy(F.xxhash64("__label_id"), "__label_id", "grade").limit(sample)
    # At most ``sample`` rows of two numbers are broadcast, so that texts don't shuffle.
    rows = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .join(F.broadcast(picked), F.col("__id") == F.col("__label_id"))
        .select("grade", "__text")
        .mapInArrow(_featurize, "grade int, features array<int>")
        .toArrow()
    )
    features = [np.asarray(f.values) for f in rows.column("features").combine_chunks()] if rows.num_rows else []
    return fit(features, rows.column("grade").to_numpy().astype(int) if rows.num_rows else np.zeros(0, int))


def classify(docs: DataFrame, model, select_at: float = SELECT_AT, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, p_ge_1, p_ge_2 and selected (clashing names are replaced)."""
    own = ["expected_grade", "p_ge_1", "p_ge_2", "selected"]
    w, t1, t2 = model
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), t1, t2))
    columns = [c for c in docs.columns if c not in own]
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, (weights, a, b) = Features(), shared.value
        for batch in batches:
            score = np.array([weights[make.of(t)].sum(dtype=np.float64) for t in batch.column(at).to_pylist()])
            p1, p2 = _sigmoid(score - a), _sigmoid(score - b)
            more = [pa.array(p1 + p2), pa.array(p1), pa.array(p2), pa.array((p2 >= select_at) & bool(b > a))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *own])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns).mapInArrow(run, f"{schema}, expected_grade double, p_ge_1 double, p_ge_2 double, selected boolean")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return classify(docs, model).drop("text").withColumnRenamed("selected", "kept")
