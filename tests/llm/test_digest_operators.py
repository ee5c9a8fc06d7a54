"""Exact dedup, sharding, packing and SimHash against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loamwork.llm import exact_dedup, packing, sharding, simhash
from loamwork.functions.components import connected_components

SF = "/root/testdata/sf0.001"


def fold(text):
    return (text or "").encode().lower().decode()


def rows_of(spark, path):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


@pytest.mark.parametrize("where", ["saved", "sf"])
def test_exact_dedup(spark, where, request):
    path = SF if where == "sf" else request.getfixturevalue("saved")
    groups = defaultdict(list)
    for doc_id, text, _ in rows_of(spark, path):
        groups[hashlib.sha256(fold(text).encode()).hexdigest()].append(doc_id)
    expected = Counter()
    for sha, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[(i, keep, len(ids), i == keep, sha)] += 1
    got = Counter(tuple(r) for r in exact_dedup.op4_exact_dedup(spark, path).collect())
    assert got == expected


def test_exact_dedup_keeps_one_row_of_each_text(spark, docs):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(fold(r["text"]) for r in kept.collect()) == sorted({fold(r["text"]) for r in docs.collect()})


def test_bloom_table_by_slices(spark):
    """Several slices of the table flag every repeat and few other rows, as one slice does."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 60, 20_000)
    values[15_000:] = values[:5_000]
    df = spark.createDataFrame([(int(v),) for v in values], "__prefix long")
    for bits in (exact_dedup.SLICE_BITS, 2 * exact_dedup.BLOCK_BITS):
        flagged = exact_dedup.maybe_repeated(df, len(values), bits).collect()
        assert len(flagged) == len(values)
        repeated = set(values[:5_000].tolist())
        assert all(r["__maybe"] for r in flagged if r["__prefix"] in repeated)
        assert sum(r["__maybe"] for r in flagged if r["__prefix"] not in repeated) < 300
    assert exact_dedup.table_blocks(10**12) * exact_dedup.BLOCK_BITS >= 16 * 10**12


@pytest.mark.parametrize("where", ["saved", "sf"])
def test_sharding(spark, where, request):
    path = SF if where == "sf" else request.getfixturevalue("saved")
    source = rows_of(spark, path)
    got = sharding.op8_sharding(spark, path).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in source
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    mixed = sharding.interleaved_shards(spark.read.parquet(f"{path}/documents.parquet")).groupBy("source", "shard").count().collect()
    share = Counter(s if s is not None else "\x00" for _, _, s in source)
    for r in mixed:
        assert abs(r["count"] - share[r["source"]] / 8) <= 2


def test_sharding_of_many_small_sources(spark):
    """A source of 4,000 rows, 4,000 of one row, and null ids: every shard matches the mixture."""
    rows = [(i, "t", "big") for i in range(4000)] + [(4000 + i, "t", f"s{i}") for i in range(4000)] + [(None, "t", "nameless")] * 2000
    got = sharding.interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    counts = Counter((r["shard"], "s" if r["source"].startswith("s") else r["source"]) for r in got)
    for shard in range(8):
        assert abs(counts[shard, "big"] - 500) <= 25 and abs(counts[shard, "nameless"] - 250) <= 25 and abs(counts[shard, "s"] - 500) <= 50


def test_sharding_is_the_same_for_any_layout(spark, docs):
    a = sharding.interleaved_shards(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    b = sharding.interleaved_shards(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3))
    pick = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert pick(a) == pick(b)


@pytest.mark.parametrize("where", ["saved", "sf"])
def test_packing(spark, where, request):
    from tokenizers import Tokenizer

    path = SF if where == "sf" else request.getfixturevalue("saved")
    tok = Tokenizer.from_file(packing.default_tokenizer())
    expected = Counter()
    for doc_id, text, _ in rows_of(spark, path):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            expected[(doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.op5_best_fit_packing(spark, path).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= best_fit_decreasing([r["length"] for r in got])


def best_fit_decreasing(lengths, capacity=2048):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_matches_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 63) for _ in range(rng.randint(1, 300))]
        steps, opened = packing.sweep(dict(Counter(lengths)), 64)
        assert opened <= best_fit_decreasing(lengths, 64)
        used = defaultdict(set)
        for length, r0, r1, first, offset in steps:
            for i in range(r1 - r0):
                cells = set(range(offset, offset + length))
                assert not cells & used[first + i] and max(cells) < 64
                used[first + i] |= cells
        assert sum(map(len, used.values())) == sum(lengths)


def brute_marks(source):
    out = []
    for doc_id, text, _ in source:
        words = fold(text).encode().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        out.append((doc_id, sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))))
    return out


@pytest.mark.parametrize("where", ["saved", "sf"])
def test_simhash(spark, where, request):
    path = SF if where == "sf" else request.getfixturevalue("saved")
    marks = brute_marks(rows_of(spark, path))
    distinct = sorted({m for _, m in marks})
    root = {m: m for m in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for doc_id, m in marks:
        if doc_id is not None:
            least[find(m)] = min(doc_id, least.get(find(m), doc_id))
    expected = Counter((i, f"{m:016x}", least.get(find(m))) for i, m in marks)
    assert Counter(tuple(r) for r in simhash.op6_simhash(spark, path).collect()) == expected


def test_simhash_finds_all_links_of_dense_groups(spark):
    rng = random.Random(9)
    marks = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            m = centre
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                m ^= 1 << bit
            marks.add(m)
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    root = {m: m for m in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(m,) for m in signed], "mark long")
    got = {r["vertex"]: r["root"] for r in simhash.linked_components(df).collect()}
    assert all((got.get(m, m) == got.get(n, n)) == (find(m) == find(n)) for m in signed for n in signed[::7])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 700)], "a long, b long")
    got = {r["vertex"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 700, 700: 700}


def test_empty_tables(spark, nothing):
    for query in (exact_dedup.op4_exact_dedup, sharding.op8_sharding, packing.op5_best_fit_packing, simhash.op6_simhash):
        assert query(spark, nothing).count() == 0
