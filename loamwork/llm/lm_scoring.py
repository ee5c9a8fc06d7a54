"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

Tokens are the A-Z-folded words of a text, then one end. A word's subwords are the
ids of a public byte-level BPE (with a leading space, so that a subword tells
whether it starts a word). The model:

* Counts over the whole training corpus: every word and, from them, every subword.
  Subwords are dealt to 16 groups of 16 classes of about equal mass, word starts and
  continuations apart; the end is a group of its own.
* One causal self-attention layer predicts the next subword's group and, given it, its
  class (a two-level softmax over 257 classes); within its class a subword has its
  corpus share. All weights are trained by Adam, first in one task on about
  ``WARM_DOCS`` documents taken by hash, to have one starting point, then by every task
  on all windows of its own training documents, end to end, so that each token is
  learned once; the tasks' weights are averaged by their token counts. Texts never
  come to the driver.
* A word's probability is that of its subwords and of the word ending there, given
  what precedes: P(subwords) x P(start after) / P(start before). Words counted at
  most ``RARE`` times, and only they, are backed off to their corpus share: with L
  the share of such words in the training tokens, a word has (1 - L) P, and a rare
  one c / N besides, which sums to one.

Texts are scored in overlapping windows of ``WINDOW`` positions that advance by
``STRIDE``: the first scores all its positions, later ones the last STRIDE, so that
each token is scored once, in masked attention over batches of windows.

What is broadcast is bounded: the weights, the subword shares and the counts of the
at most ``HOT_WORDS`` most frequent words. Other words leave the scoring pass as
rows and meet their counts in a join, so any vocabulary is counted in full and very
frequent words never shuffle one by one.

Defined results: null, empty and blank texts are one end token; a null doc_id counts
as an empty string in the held-out rule; repeated rows are scored alike and each
counts in training; an empty table gives no rows; other columns do not pass through.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

VOCABULARY = "byte_bpe_50k.tiktoken"
GROUPS = 16
MEMBERS = 16
#: The first groups are of word starts, the others of continuations; the end's group and class follow them.
START_GROUPS = 10
END_CLASS = GROUPS * MEMBERS
WIDTH = 16
BUCKETS = 1024
WINDOW = 24
STRIDE = 18
BATCH = 512
TRAIN_BATCH, WARM_BATCH = 256, 64
WARM_DOCS = 400
RATE = 0.01
HOT_WORDS = 200_000
RARE = 5
#: Subwords of the documents that are scored or trained on at a time.
AT_A_TIME = 200_000
#: Octets of the texts whose words are encoded, or counted, together, and words in one call of the encoder.
ENCODED, COUNTED, TOGETHER = 1 << 24, 1 << 26, 50_000
UNICODE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def words_of_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of() of many texts, end to end, and the number of each text's."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    texts = pc.if_else(pc.equal(texts, ""), None, texts)
    words = pc.ascii_split_whitespace(texts)
    return words.flatten(), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(texts: pa.Array, octets: int) -> Iterator[pa.Array]:
    """Texts of about so many octets at a time, so that memory is bounded."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, octets + (sizes[start - 1] if start else 0), side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def portions(per_text: np.ndarray) -> Iterator[slice]:
    """Texts of about a third of AT_A_TIME words and ends at a time; the last may have fewer."""
    start = size = 0
    for i, n in enumerate(per_text.tolist()):
        size += n + 1
        if size >= AT_A_TIME // 3:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(per_text):
        yield slice(start, len(per_text))


class Subwords:
    """Ids of a word, cached; ``end`` is the id after the last of the vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.end = len(ranks)
        self.starts = np.array([t.startswith(b" ") for t, _ in sorted(ranks.items(), key=lambda x: x[1])] + [True])
        self._encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def of(self, word: bytes) -> list[int]:
        return self._encode(" " + word.decode())

    def of_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end and the number of each word's, many words in a call."""
        parts = [self._of_some(words.slice(i, TOGETHER)) for i in range(0, len(words), TOGETHER)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _of_some(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        if text.isascii() or not UNICODE_SPACE.search(text):
            # Only the space before a word can start an id with a space, and it always does.
            ids = np.array(self._encode(text), dtype=np.int32)
            heads = np.flatnonzero(self.starts[ids])
            if len(heads) == len(words):
                return ids, np.diff(heads, append=len(ids))
        each = [self._encode(" " + w) for w in words.to_pylist()]
        return np.array([i for ids in each for i in ids], dtype=np.int32), np.fromiter(map(len, each), dtype=np.int64, count=len(each))


@functools.cache
def subwords(path: str) -> Subwords:
    """One for each Python worker."""
    return Subwords(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# --- the attention model -------------------------------------------------------


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"ec": (END_CLASS + 1, WIDTH), "eb": (BUCKETS, WIDTH), "ep": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH),
              "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "group": (WIDTH, GROUPS + 1), "member": (GROUPS, WIDTH, MEMBERS)}
    weights = {n: (rng.standard_normal(s) * 0.3).astype(np.float32) for n, s in shapes.items()}
    return weights | {"group_bias": np.zeros(GROUPS + 1, np.float32), "member_bias": np.zeros((GROUPS, MEMBERS), np.float32)}


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept; as a product, which is faster than a reduction of so few."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], dtype=x.dtype)).reshape(*x.shape[:-1], 1)


_SEEN = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))


def _rows(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _attending(w: dict) -> np.ndarray:
    """Side by side: the product of the weights of queries, scaled, and of keys, so that states themselves are the keys; that of the weights
    of values and of the way out; a last column, which becomes the ones that sum the attention."""
    return np.concatenate([w["q"] @ w["k"].T * WIDTH**-0.5, w["v"] @ w["o"], np.zeros_like(w["v"][:, :1])], axis=1, dtype=w["v"].dtype)


def with_table(w: dict, classes: np.ndarray) -> dict:
    """The weights with all that hidden() makes of an id alone, and of a place alone, for passes that don't change the weights."""
    ids = w["ec"].take(classes, axis=0)
    ids += w["eb"].take(np.arange(len(classes)) % BUCKETS, axis=0)
    made = [np.concatenate([x, x @ _attending(w)], axis=1) for x in (ids, w["ep"])]
    made[0][:, -1] = 1
    return w | {"by_id": made[0], "by_place": made[1]}


def hidden(w: dict, ids: np.ndarray, classes: np.ndarray, skip: int = 0):
    """Hidden states (windows, positions, WIDTH) after masked attention, without those of the first ``skip`` positions, and what backward() needs."""
    n = len(ids)
    if "by_id" in w:
        c = b = None
        made = w["by_id"].take(ids, axis=0)
        made += w["by_place"]
        x, made = made[..., :WIDTH], made[..., WIDTH:]
    else:
        c, b = classes.take(ids), ids % BUCKETS
        x = w["ec"].take(c, axis=0)
        x += w["eb"].take(b, axis=0)
        x += w["ep"]
        made = (_rows(x) @ _attending(w)).reshape(n, WINDOW, -1)
        made[..., -1] = 1
    q, v = made[:, skip:, :WIDTH], made[..., WIDTH:]
    s = q @ x.transpose(0, 2, 1)
    np.clip(s, -60, 60, out=s)
    np.exp(s, out=s)
    s *= _SEEN[skip:]
    mixed = s @ v  # the last column is the sum of a row of s
    total = 1 / mixed[..., WIDTH:]
    mixed = mixed[..., :WIDTH] * total
    return mixed + x[:, skip:], (c, b, x, q, v, s, mixed, total)


def _softmax(z: np.ndarray) -> np.ndarray:
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    z /= _sums(z)
    return z


def by_group(classes: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Rows in order of their groups, those of the end, which has no members, last; where each group's stand."""
    group = (classes // MEMBERS).astype(np.int8)
    order = np.argsort(group, kind="stable")
    cuts = np.cumsum(np.bincount(group, minlength=GROUPS + 1)).tolist()
    return order, [slice(*x) for x in zip([0, *cuts[:-1]], cuts, strict=True)]


def softmaxes(w: dict, h: np.ndarray, target: np.ndarray, at: np.ndarray | None = None):
    """For the rows ``at`` of ``h`` (all) and their target classes: by_group() and, in that order, states, classes, probabilities of groups and of members."""
    # Rows stand together by group, so that all but the products runs over all of them at once.
    order, cuts = by_group(target)
    own, target = h.take(order if at is None else at.take(order), axis=0), target.take(order)
    # Column by column in memory: what is done to all rows then runs over long columns, not over rows of 17 or 16.
    groups = (w["group"].T @ own.T).T
    groups += w["group_bias"]
    members = np.empty((MEMBERS, cuts[-1].start), groups.dtype).T
    for g, cut in enumerate(cuts[:-1]):
        np.matmul(w["member"][g].T, own[cut].T, out=members[cut].T)
        members[cut] += w["member_bias"][g]
    return order, cuts, own, target, _softmax(groups), _softmax(members)


def outputs(w: dict, h: np.ndarray, target: np.ndarray, at: np.ndarray | None = None):
    """For hidden states (rows, WIDTH), or their rows ``at``: log probability of the target class and of any word start or end, and what backward() needs."""
    out = order, cuts, _, by, groups, members = softmaxes(w, h, target, at)
    p, rows = np.empty(len(by), groups.dtype), np.arange(len(members))
    for g, cut in enumerate(cuts):
        p[cut] = groups[cut, g]
    p[: len(rows)] *= members.T.ravel().take(by[: len(rows)] % MEMBERS * len(rows) + rows)
    starts = np.zeros((GROUPS + 1, 1), groups.dtype)
    starts[:START_GROUPS] = starts[GROUPS] = 1
    log, begin = np.empty_like(p), np.empty_like(p)
    log[order], begin[order] = np.log(p), np.log(groups @ starts)[:, 0]
    return log, begin, out


def backward(w: dict, kept, h: np.ndarray, target: np.ndarray, valid: np.ndarray, out) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log likelihood; ``h`` and ``target`` are those of the valid positions."""
    c, b, x, q, v, e, mixed, total = kept
    order, cuts, own, by, groups, members = out
    ones = np.ones(max(x.shape[0], len(own)), x.dtype)
    many, rows, at = len(members), np.arange(len(members)), np.flatnonzero(valid)
    for i, cut in enumerate(cuts):
        groups[cut, i] -= 1
    members.T.ravel()[by[:many] % MEMBERS * many + rows] -= 1  # a view: see softmaxes()
    g = {"group": own.T @ groups, "group_bias": ones[: len(own)] @ groups, "member": np.zeros_like(w["member"]), "member_bias": np.zeros_like(w["member_bias"])}
    part = np.empty((len(own) + 1, WIDTH), x.dtype)  # a row more, for positions that are not valid
    np.matmul(groups, w["group"].T, out=part[:-1])
    part[-1] = 0
    for i, cut in enumerate(cuts[:-1]):
        g["member"][i], g["member_bias"][i] = own[cut].T @ members[cut], ones[: cut.stop - cut.start] @ members[cut]
        part[cut] += members[cut] @ w["member"][i].T
    place = np.full(x.shape[0] * x.shape[1], len(own), np.intp)
    place[at.take(order)] = np.arange(len(own))
    dx = part.take(place, axis=0).reshape(x.shape)
    # The attention is e * total: with the gradient of mixed and, for its sum, their product beside it, one product gives that of e.
    dm = np.empty(v.shape, x.dtype)
    np.multiply(dx, total, out=dm[..., :WIDTH])
    np.multiply(_sums(dx * mixed), -total, out=dm[..., WIDTH:])
    de = dm @ v.transpose(0, 2, 1)
    de *= e
    made = np.empty((*x.shape[:2], 2 * WIDTH), x.dtype)
    np.matmul(de, x, out=made[..., :WIDTH])
    np.matmul(e.transpose(0, 2, 1), dm[..., :WIDTH], out=made[..., WIDTH:])
    reach, way = np.split((_rows(made).T @ _rows(x)).T, 2, axis=1)
    g["q"], g["k"] = reach @ w["k"] * WIDTH**-0.5, reach.T @ w["q"] * WIDTH**-0.5
    g["v"], g["o"] = way @ w["o"].T, w["v"].T @ way
    dx += de.transpose(0, 2, 1) @ q
    dx += (_rows(made) @ _attending(w)[:, :-1].T).reshape(x.shape)
    g["ep"] = (ones[: len(dx)] @ dx.reshape(len(dx), -1)).reshape(dx.shape[1:])
    columns = _rows(dx).T.astype(np.float64, order="C")
    for n, at, size in (("ec", c, END_CLASS + 1), ("eb", b, BUCKETS)):
        cells = at.ravel().astype(np.intp)
        g[n] = np.array([np.bincount(cells, weights=column, minlength=size) for column in columns]).T.astype(w[n].dtype)
    return {n: d * (1 / max(1, len(own))) for n, d in g.items()}


class Adam:
    def __init__(self, w: dict):
        self.flat, self.t = _pack(w), 0
        self.m, self.s, self.made = (np.zeros_like(self.flat) for _ in range(3))
        self.w = _unpack(self.flat)

    def step(self, ids, target, valid, classes) -> None:
        h, kept = hidden(self.w, ids, classes)
        at = np.flatnonzero(valid)
        target = classes.take(target.take(at))
        g = _pack(backward(self.w, kept, h, target, valid, softmaxes(self.w, _rows(h), target, at)))
        self.t += 1
        made = self.made
        np.subtract(g, self.m, out=made)
        made *= 0.1
        self.m += made
        g *= g
        g -= self.s
        g *= 0.01
        self.s += g
        np.multiply(self.s, 1 / (1 - 0.99**self.t), out=g)
        np.sqrt(g, out=g)
        g += 1e-6
        np.divide(self.m, g, out=made)
        made *= RATE / (1 - 0.9**self.t)
        self.flat -= made


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places and validity (windows, positions) of the windows of texts of these lengths that stand end to end; each place is valid once."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    many = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    text = np.repeat(np.arange(len(lengths)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = ((ends - lengths)[text] + number * stride)[:, None] + np.arange(WINDOW)
    valid = at < ends[text][:, None]
    valid[number > 0, : WINDOW - stride] = False
    return np.minimum(at, max(0, int(lengths.sum()) - 1)), valid


# --- the corpus ----------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in pieces(batch.column(0), COUNTED):
            counts = words_of_all(texts)[0].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], names=["word", "n"])


def _count_subwords(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path)
        total = np.zeros(sub.end + 1, dtype=np.int64)
        for batch in batches:
            ids, sizes = sub.of_all(batch.column(0))
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), sizes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def subword_classes(totals: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id and the natural log of its share within the class."""
    weight = totals + 0.1
    classes = np.zeros(len(totals), dtype=np.int32)
    classes[-1] = END_CLASS
    body = np.arange(len(totals)) < len(totals) - 1
    many = START_GROUPS * MEMBERS
    for group, first, n in ((starts & body, 0, many), (~starts & body, many, END_CLASS - many)):
        ids = np.flatnonzero(group)
        ids = ids[np.argsort(-weight[ids], kind="stable")]
        before = np.cumsum(weight[ids]) - weight[ids]
        classes[ids] = first + np.minimum(n - 1, (before / weight[ids].sum() * n).astype(np.int32))
    mass = np.bincount(classes, weights=weight, minlength=END_CLASS + 1)
    return classes, np.log(weight / mass[classes]).astype(np.float32)


class WordIds:
    """Subword ids of texts, and the counts of their words (-1 where a word is not among ``counts``); each different word is encoded once."""

    def __init__(self, path: str, counts: dict[bytes, int]):
        self.sub, self.end = subwords(path), subwords(path).end
        self.counted = pa.array(list(counts), pa.binary()).cast(pa.string())
        self.counts = np.append(np.fromiter(counts.values(), np.float64, len(counts)), -1.0)

    def meet(self, words: pa.Array, per_text: np.ndarray) -> None:
        """Takes the words of texts, end to end, and the number of each text's; portion() tells of them."""
        met = words.dictionary_encode()
        self.different, self.numbers, self.per_text = met.dictionary, met.indices.to_numpy(), per_text
        self.flat, self.sizes = self.sub.of_all(self.different)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.known = self.counts.take(pc.index_in(self.different, value_set=self.counted).fill_null(-1).to_numpy())
        self.until = np.concatenate([[0], np.cumsum(per_text)])

    def portion(self, cut: slice):
        """For some texts: ids of all, each with its end; texts' lengths; words' counts; words' first places; words' texts; words' numbers among the different."""
        numbers, per_text = self.numbers[self.until[cut.start] : self.until[cut.stop]], self.per_text[cut]
        sizes, n = self.sizes.take(numbers), len(per_text)
        text_of = np.repeat(np.arange(n), per_text)
        before = np.cumsum(sizes) - sizes
        lengths = np.bincount(text_of, weights=sizes, minlength=n).astype(np.int64) + 1
        ids = np.full(int(lengths.sum()), self.end, dtype=np.int32)
        inside = np.ones(len(ids), dtype=bool)
        inside[np.cumsum(lengths) - 1] = False
        at = np.repeat(self.first.take(numbers) - before, sizes)
        at += np.arange(len(at))
        ids[inside] = self.flat.take(at)
        return ids, lengths, self.known.take(numbers), before + text_of, text_of, numbers

    def texts(self, texts: list[list[bytes]]):
        """portion() of these texts, without the words' numbers."""
        self.meet(pa.array(list(itertools.chain.from_iterable(texts)), pa.binary()).cast(pa.string()), np.fromiter(map(len, texts), np.int64, len(texts)))
        return self.portion(slice(0, len(texts)))[:5]


def train_local(weights: dict, texts: Iterator[str | None], path: str, classes: np.ndarray, size_of_batch: int = TRAIN_BATCH) -> tuple[dict, int]:
    """Weights after Adam over all windows of the texts, end to end, and the positions seen."""
    words, model, seen, held, size = WordIds(path, {}), Adam(weights), 0, [], 0

    def learn(last: bool) -> list:
        """Learns the texts held, but for a last portion to which more may come; returns that."""
        nonlocal seen
        words.meet(*words_of_all(pa.array(held, pa.string())))
        for cut in portions(words.per_text):
            if not last and cut.stop == len(held) and int((words.per_text[cut] + 1).sum()) < AT_A_TIME // 3:
                return held[cut]
            ids, lengths, *_ = words.portion(cut)
            at, valid = windows(lengths, WINDOW)
            stream = np.concatenate([[words.end], ids]).astype(np.int32)
            for i in range(0, len(at), size_of_batch):
                some = slice(i, i + size_of_batch)
                model.step(stream[at[some]], stream[at[some] + 1], valid[some], classes)
            seen += len(ids)
        return []

    for text in texts:
        held.append(text)
        size += len(text or "") + 1
        if size >= ENCODED:
            held, size = learn(False), 0
    if held:
        learn(True)
    return model.w, seen


def _pack(w: dict) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)])


def _unpack(flat: np.ndarray) -> dict:
    """The weights as parts of ``flat``."""
    out, at, like = {}, 0, initial()
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    flats = [np.frombuffer(b, dtype=np.float32).astype(np.float64) * n for b, n in zip(pdf["weights"], pdf["seen"], strict=True)]
    seen = int(pdf["seen"].sum())
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "weights": [(sum(flats) / max(1, seen)).astype(np.float32).tobytes()], "seen": [seen]})


def fit(docs: DataFrame, vocabulary: str | None = None) -> dict:
    """The model: counts of words (a table) and all that the scoring pass needs, from docs (doc_id, text, held_out)."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    learned = docs.filter("not held_out")
    counts = materialize(
        learned.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "words"
    )
    tests = [F.count_if(F.col("c") >= (1 << j)).alias(f"j{j}") for j in range(44)]
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("c") <= RARE, F.col("c"))).alias("rare"), *tests).first()
    ends = learned.count()
    hot_from = next(1 << j for j in range(44) if sums[f"j{j}"] <= HOT_WORDS)
    hot = counts.filter((F.col("c") >= hot_from) & (F.octet_length("word") <= 64)).toArrow()
    sub = Subwords(path)
    totals = np.zeros(sub.end + 1, dtype=np.int64)
    ids = counts.mapInArrow(_count_subwords(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    totals[ids.column("id").to_numpy()] = ids.column("n").to_numpy()
    totals[sub.end] = ends
    classes, shares = subword_classes(totals, sub.starts)

    flat = _pack(initial())

    def warmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, _ = train_local(_unpack(flat), (t for b in batches for t in b.column(0).to_pylist()), path, classes, WARM_BATCH)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(w).tobytes()])], names=["weights"])

    # About WARM_DOCS documents by hash, to one task.
    whole = 1 << 40
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(whole))
    few = learned.select("text", mark.alias("h")).filter(F.col("h") < F.lit(min(whole, whole * WARM_DOCS // max(1, ends))))
    warm = few.repartition(1).sortWithinPartitions("h").select("text").mapInArrow(warmed, "weights binary").first()
    weights = _unpack(np.frombuffer(warm["weights"], np.float32)) if warm else initial()
    start = spark.sparkContext.broadcast((weights, classes))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cls = start.value
        trained, seen = train_local(w, (t for b in batches for t in b.column(0).to_pylist()), path, cls)
        row = [pa.array([TaskContext.get().partitionId() % 64]), pa.array([_pack(trained).tobytes()]), pa.array([seen])]
        yield pa.RecordBatch.from_arrays(row, names=["part", "weights", "seen"])

    parts = learned.select("text").mapInArrow(local, "part long, weights binary, seen long")
    parts = parts.groupBy("part").applyInPandas(_average, "part long, weights binary, seen long").toPandas()  # at most 64 rows
    if parts["seen"].sum():
        parts["part"] = 0
        weights = _unpack(np.frombuffer(_average(parts)["weights"][0], dtype=np.float32))
    return {
        "path": path, "weights": weights, "classes": classes, "shares": shares, "counts": counts,
        "hot": dict(zip(hot.column("word").cast(pa.binary()).to_pylist(), hot.column("c").to_pylist(), strict=True)),
        "n": int(sums["n"] or 0) + ends, "v": int(sums["v"]) + (ends > 0), "ends": ends,
        "rare": int(sums["rare"] or 0) + (ends if ends <= RARE else 0),
    }


def subword_scores(model: dict, ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For the ids of texts end to end: natural log probability, and that of a word start standing there."""
    at, valid = windows(lengths)
    stream = np.concatenate([[end], ids]).astype(np.int32)
    logs, begins = (np.empty(len(ids), dtype=np.float32) for _ in range(2))
    # A text's first window scores all its positions; of later ones only the last STRIDE need a state.
    first, weights = valid[:, 0], model["weights"] if "by_id" in model["weights"] else with_table(model["weights"], model["classes"])
    for chosen, skip in ((np.flatnonzero(first), 0), (np.flatnonzero(~first), WINDOW - STRIDE)):
        for i in range(0, len(chosen), BATCH):
            cut = chosen[i : i + BATCH]
            places, scored = at[cut], np.flatnonzero(valid[cut, skip:])
            h, _ = hidden(weights, stream.take(places), model["classes"], skip)
            places = places[:, skip:].take(scored)
            target = stream.take(places + 1)
            log, begin, _ = outputs(weights, _rows(h), model["classes"].take(target), scored)
            logs[places], begins[places] = log + model["shares"][target], begin
    return logs.astype(np.float64), begins.astype(np.float64)


def mixed_log10(model: dict, c: np.ndarray, log_sub: np.ndarray) -> np.ndarray:
    n = max(1, model["n"])
    backed = np.where(c <= RARE, c, 0.0) / n
    return np.log10(np.maximum(backed + (1 - model["rare"] / n) * np.exp(log_sub), 1e-300))


SCORED = (
    "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, "
    "words array<string>, logs array<double>"
)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = dict(shared.value)
        number = TaskContext.get().partitionId() << 33
        model["weights"] = with_table(model["weights"], model["classes"])
        words, unseen = WordIds(model["path"], model["hot"]), np.log10(model["n"] + 0.5 * (model["v"] + 1))

        def scored(doc_ids: pa.Array, held: pa.Array, cut: slice) -> pa.RecordBatch:
            nonlocal number
            ids, lengths, counts, first, text_of, numbers = words.portion(cut)
            logs, begins = subword_scores(model, ids, lengths, words.end)
            run_up = np.concatenate([[0.0], np.cumsum(logs)])
            ends = np.cumsum(lengths) - 1
            after = np.append(first[1:], 0)
            if len(first):
                last = np.append(text_of[1:] != text_of[:-1], True)
                after[last] = ends[text_of[last]]
            word_log = run_up[after] - run_up[first] + begins[after] - begins[first] if len(first) else np.zeros(0)
            seen, n = counts >= 0, len(lengths)
            by_text = lambda x: np.bincount(text_of[seen], weights=x, minlength=n)
            end_c = np.full(n, float(model["ends"]))
            known = by_text(counts[seen] > 0).astype(np.int64) + (model["ends"] > 0)
            base = by_text(np.log10(counts[seen] + 0.5) - unseen) + np.log10(end_c + 0.5) - unseen
            score = by_text(mixed_log10(model, counts[seen], word_log[seen])) + mixed_log10(model, end_c, logs[ends] - begins[ends])
            cold = np.flatnonzero(~seen)
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text_of[cold], minlength=n))]).astype(np.int32))
            colds = words.different.take(pa.array(numbers[cold])).cast(pa.string())
            columns = [
                doc_ids.cast(pa.int64()), held, pa.array(np.arange(number, number + n)), pa.array(words.per_text[cut] + 1), pa.array(known),
                pa.array(base), pa.array(score), pa.ListArray.from_arrays(cuts, colds),
                pa.ListArray.from_arrays(cuts, pa.array(word_log[cold])),
            ]
            number += n
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "words", "logs"])

        for batch in batches:
            doc_ids, texts, held = batch.columns
            start = 0
            for piece in pieces(texts, ENCODED):
                words.meet(*words_of_all(piece))
                for cut in portions(words.per_text):
                    own = start + cut.start, cut.stop - cut.start
                    yield scored(doc_ids.slice(*own), held.slice(*own), cut)
                start += len(piece)

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row a document of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    counts = model["counts"]
    shared = spark.sparkContext.broadcast({k: v for k, v in model.items() if k != "counts"})
    passed = materialize(docs.select("doc_id", "text", "held_out").mapInArrow(_score(shared), SCORED), "scored")
    n, v = model["n"], model["v"]
    cold = passed.select("row", F.explode(F.arrays_zip("words", "logs")).alias("w")).select("row", "w.words", "w.logs")
    c = F.coalesce("c", F.lit(0))
    share = F.when(c <= RARE, c).otherwise(0) / max(1, n) + (1 - model["rare"] / max(1, n)) * F.exp("logs")
    tail = (
        cold.join(counts, F.col("words") == F.col("word"), "left")
        .groupBy(F.col("row").alias("__row"))
        .agg(
            F.count_if(c > 0).alias("more_known"),
            F.sum(F.log10(c + 0.5) - F.log10(F.lit(n + 0.5 * (v + 1)))).alias("more_base"),
            F.sum(F.log10(F.greatest(share, F.lit(1e-300)))).alias("more_score"),
        )
    )
    joined = passed.drop("words", "logs").join(tail, F.col("row") == F.col("__row"), "left")
    plus = lambda a, b, zero: (F.col(a) + F.coalesce(b, F.lit(zero)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known", 0).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "more_base", 0.0).alias("base_score"), plus("score", "more_score", 0.0).alias("score"),
    )


def with_held_out(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    mark = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (mark % 5 == 1).alias("held_out"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_held_out(read(spark, sf_dir, "documents"))
    return score(docs, fit(docs))
