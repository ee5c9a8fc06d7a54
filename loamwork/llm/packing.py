"""Best-fit packing of token sequences into training sequences of fixed capacity.

Bulk-synchronous best-fit. Pieces are range-sorted by length and gaps (the free
ends of open sequences) by size. A sweep goes through the lengths from the
longest down; each takes its successor, the smallest gap that holds it, for as
many pieces as there are such gaps, then the next, and opens new sequences for
the rest; gaps are updated before the next sweep. Pieces of one length and gaps
of one size are interchangeable, so the sweeps run on the exact histograms of
lengths and gaps, at most ``capacity`` classes each, whatever the number of rows:
a sweep step stands for all pieces of a class. Which piece of a class goes to
which gap is then resolved by rank: pieces are numbered within their length by a
distributed rank (per task counts and prefix sums, no task sees a whole class)
and each looks up the step that its rank falls in.

Pieces of the full capacity fill a sequence each and are not ranked.

Defined results: a null or empty text is one document of id 0 only; null or
repeated doc_ids are packed as rows of their own; an empty table gives no rows;
texts of any length are cut only where longer than the capacity. Other columns
do not pass through.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS, CACHE_PARTS = 400_000, 1_000_000
#: Printable ASCII without the apostrophe.
PLAIN = re.compile(rb"[!-&(-~]+").fullmatch
PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+").findall


class PartEncoder(dict):
    """Token ids of parts of words, by a cache of at most ``CACHE_PARTS``.

    A part is one piece of the tokenizer's own cut and of printable ASCII signs, which
    its byte alphabet leaves as they are, so only the merges are left to do.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.holds_added = re.compile(b"|".join(map(re.escape, added)) or b"(?!)").search

    def whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: bytes) -> bytes:
        ids = array("I", [t.id for t in self.merge(part.decode())]).tobytes()
        if len(part) < 64:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = ids
        return ids


class WordEncoder(dict):
    """Token ids of a text, by a cache of encoded words.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its words in turn. It folds case and cuts ASCII words without an
    apostrophe into runs of letters, single digits and runs of other signs, so those
    are encoded part by part: the same parts make up many words that occur once.
    Words that hold an added token, or other characters, are encoded whole. At most ``CACHE_WORDS`` words are kept, but for those of one text.
    """

    def __init__(self, path: str):
        super().__init__()
        self.parts = PartEncoder(path)

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower()
        if PLAIN(low) and not self.parts.holds_added(low):
            ids = b"".join(map(self.parts.__getitem__, PARTS(low)))
        else:
            ids = self.parts.whole(word)
        if len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.encode().split())), dtype="<u4")  # words by ASCII white space


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, whose tasks share its cache."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "task", "rank_in_task"))]
)


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ranks, task = encoder(path).ids, Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[list] = [[] for _ in PIECES]
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for to, x in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), task, ranks[len(part)]), strict=True):
                        to.append(x)
                    ranks[len(part)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, PIECES, strict=True)], schema=PIECES)

    return run


def sweep(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, first rank, end rank, first sequence, offset) and the number of sequences.

    ``histogram`` counts the pieces by length, all shorter than the capacity. A
    gap class holds its sequences as runs of consecutive numbers.
    """
    runs: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []
    steps, opened = [], 0

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                runs[gap] = deque()
                insort(sizes, gap)
            runs[gap].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                # No gap holds it: open sequences for all that are left, as many
                # pieces to a sequence as fit, in layers over the same run.
                fit = capacity // length
                new = last = -(-left // fit)
                for layer in range(fit):
                    count = min(new, left)
                    free(capacity - layer * length, opened + count, last - count)
                    if count:
                        steps.append((length, rank, rank + count, opened, layer * length))
                    rank, left, last = rank + count, left - count, count
                free(capacity - fit * length, opened, last)
                opened += new
            else:
                gap = sizes[at]
                first, count = runs[gap].popleft()
                taken = min(count, left)
                if taken < count:
                    runs[gap].appendleft((first + taken, count - taken))
                elif not runs[gap]:
                    del runs[gap], sizes[at]
                steps.append((length, rank, rank + taken, first, capacity - gap))
                free(gap - length, first, taken)
                rank, left = rank + taken, left - taken
    return steps, opened


def pack(
    df: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Where each piece of each document goes: one row a piece."""
    path = tokenizer or default_tokenizer()
    pieces = materialize(
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _cut(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank_in_task long"
        ),
        "pieces",
    )
    full, rest = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    per_task = rest.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, opened = sweep(histogram, capacity)
    spark = df.sparkSession

    before = per_task.select(
        F.col("length").alias("__l"), F.col("task").alias("__t"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"),
    )
    ranked = rest.join(before, (F.col("length") == F.col("__l")) & (F.col("task") == F.col("__t"))).withColumn(
        "rank", F.col("before") + F.col("rank_in_task")
    )
    # The steps by length, to be searched by rank; their number follows the capacity, not the rows.
    order = np.array(sorted(steps), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(order)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        span = int(t[:, 2].max()) + 1 if len(t) else 1
        key = length.to_numpy() * span + rank.to_numpy()
        at = np.searchsorted(t[:, 0] * span + t[:, 1], key, side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 3] + rank.to_numpy() - t[at, 1], "offset": t[at, 4]})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.withColumn("place", place("length", "rank")).select(*columns, "place.sequence_id", "place.offset")
    alone = full.select(*columns, (F.lit(opened) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
