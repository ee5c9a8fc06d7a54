"""Text similarity: character shingles, MinHash bands and the token-sort ratio."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the signature scheme: modulus and seed of the hash family.
PRIME = 4294967311
SEED = 42
SHINGLE = 3


def row_document(columns: list[Column]) -> Column:
    """A row as text: its values joined by spaces, nulls left out."""
    return F.concat_ws(" ", *[c.cast("string") for c in columns])


def shingles(document: Column, size: int = SHINGLE) -> Column:
    """Set of lower-cased character shingles; empty for shorter texts."""
    low = F.lower(document)
    at = F.sequence(F.lit(1), F.length(low) - (size - 1))
    return F.when(F.length(low) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>")
    )


def token_hash(token: Column) -> Column:
    """The first 32 bits of the token's MD5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")


def coefficients(n: int, seed: int = SEED) -> list[tuple[int, int]]:
    """The n hash functions (a, b): all a are drawn first."""
    draw = random.Random(seed)
    a = [draw.randint(1, PRIME - 1) for _ in range(n)]
    return list(zip(a, [draw.randint(0, PRIME - 1) for _ in range(n)], strict=True))


def minhash(hashes: Column, n: int) -> Column:
    """Array of n minima of (a h + b) mod P over the token hashes; P each for an empty set.

    The product is made from two 16-bit halves of h, so that it fits 64 bits.
    """

    def one(a: int, b: int) -> Column:
        part = lambda h: ((F.lit(a) * F.shiftright(h, 16)) % PRIME * 65536 + F.lit(a) * h.bitwiseAND(F.lit(65535)) + b) % PRIME
        return F.coalesce(F.array_min(F.transform(hashes, part)), F.lit(PRIME))

    return F.array(*[one(a, b) for a, b in coefficients(n)])


def band_shape(n: int, threshold: float) -> tuple[int, int]:
    """(bands, rows a band): of all rows r with n // r bands, the one whose turning point comes closest below the threshold."""
    fits = [((n // r), r) for r in range(1, n + 1) if (1 / (n // r)) ** (1 / r) <= threshold]
    return max(fits, key=lambda x: (1 / x[0]) ** (1 / x[1])) if fits else (1, n)


def indel_ratio(a: str, b: str) -> float:
    """200 LCS / (len a + len b), by bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    """Indel similarity of the texts with their words sorted, 0 to 100."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@F.pandas_udf(T.StringType())
def words_sorted(a: pd.Series) -> pd.Series:
    return a.map(lambda x: " ".join(sorted(x.split())))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))
