"""The two-level softmax of the scoring model over rows put together by group."""

import numpy as np
import pyarrow as pa

from loamwork.llm import lm_scoring as lm


def test_outputs_take_all_members_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    w = lm.initial()
    w["member_bias"] = rng.standard_normal(w["member_bias"].shape).astype(np.float32)
    # Groups without rows, and the end, which has no members.
    target = np.array([0, 255, lm.END_CLASS, 17, 16, 255, lm.END_CLASS, 40, 3], dtype=np.int32)
    h = rng.standard_normal((len(target), lm.WIDTH)).astype(np.float32)
    calls, softmax = [], lm._softmax
    monkeypatch.setattr(lm, "_softmax", lambda z: calls.append(len(z)) or softmax(z))
    log, _, _ = lm.outputs(w, h, target)
    assert calls == [9, 7]
    for row, t, got in zip(h, target.tolist(), log, strict=True):
        z = row @ w["group"] + w["group_bias"]
        want = z[t // lm.MEMBERS] - np.log(np.exp(z).sum())
        if t != lm.END_CLASS:
            z = row @ w["member"][t // lm.MEMBERS] + w["member_bias"][t // lm.MEMBERS]
            want += z[t % lm.MEMBERS] - np.log(np.exp(z).sum())
        assert abs(got - want) < 1e-5
    only_ends = np.full(3, lm.END_CLASS, dtype=np.int32)
    assert np.isfinite(lm.outputs(w, h[:3], only_ends)[0]).all()


def test_later_windows_make_only_the_states_they_score(monkeypatch):
    """Of a window after a text's first the last STRIDE positions are made, and they equal those of the whole window."""
    rng = np.random.default_rng(5)
    ids, classes = rng.integers(0, 300, (4, lm.WINDOW)), rng.integers(0, lm.END_CLASS + 1, 301).astype(np.int32)
    skip = lm.WINDOW - lm.STRIDE
    whole, part = lm.hidden(lm.initial(), ids, classes)[0], lm.hidden(lm.initial(), ids, classes, skip)[0]
    assert np.allclose(whole[:, skip:], part, atol=1e-5)
    made, hidden = [], lm.hidden
    monkeypatch.setattr(lm, "hidden", lambda *a: made.append(hidden(*a)) or made[-1])
    model = {"weights": lm.initial(), "classes": classes, "shares": np.zeros(301, dtype=np.float32)}
    lengths = np.array([lm.WINDOW + 3 * lm.STRIDE, 1, lm.WINDOW + 1])
    logs, begins = lm.subword_scores(model, rng.integers(0, 300, lengths.sum()).astype(np.int32), lengths, 300)
    assert len(logs) == len(begins) == lengths.sum()
    assert sum(h.shape[0] * h.shape[1] for h, _ in made) == 3 * lm.WINDOW + 4 * lm.STRIDE


def test_different_words_are_encoded_together_and_once(monkeypatch):
    path = lm.default_vocabulary()
    sub, calls = lm.subwords(path), []
    encode = sub._encode
    monkeypatch.setattr(sub, "_encode", lambda text: calls.append(text) or encode(text))
    texts = [[b"together17", b"it's", b"\xc3\xa9t\xc3\xa9", b"(once)"] * 50, [], [b"together17", b"17,5"]]
    ids, lengths, counts, first, text_of = lm.WordIds(path, {b"it's": 3}).texts(texts)
    assert len(calls) == 1
    expected = [[*(i for w in words for i in sub.of(w)), sub.end] for words in texts]
    assert ids.tolist() == [i for x in expected for i in x] and lengths.tolist() == list(map(len, expected))
    assert counts.tolist() == [3.0 if w == b"it's" else -1.0 for words in texts for w in words]
    words = [w for words in texts for w in words]
    assert [ids[at : at + len(sub.of(w))].tolist() for at, w in zip(first, words, strict=True)] == [sub.of(w) for w in words]
    assert text_of.tolist() == [0] * 200 + [2, 2]


def test_words_with_white_space_of_unicode_are_whole(monkeypatch):
    """White space of Unicode divides no word, and words beside such a one keep their ids; pieces and portions leave no text out."""
    texts = [None, "", " \t\n", "A b   \x1c", "\x85", "É café X\x0by", "plain words"]
    words, per_text = lm.words_of_all(pa.array(texts))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in lm.words_of(t)]
    assert per_text.tolist() == [len(lm.words_of(t)) for t in texts]
    sub = lm.Subwords(lm.default_vocabulary())
    ids, sizes = sub.of_all(words)
    each = [sub.of(w.encode()) for w in words.to_pylist()]
    assert ids.tolist() == [i for x in each for i in x] and sizes.tolist() == list(map(len, each))
    for octets in (1, 7, 1000):
        assert [t for x in lm.pieces(pa.array(texts), octets) for t in x.to_pylist()] == texts
    monkeypatch.setattr(lm, "AT_A_TIME", 9)
    assert [i for cut in lm.portions(per_text) for i in range(cut.start, cut.stop)] == list(range(len(texts)))


def test_learning_does_not_depend_on_pieces(monkeypatch):
    """Texts whose portion is not full at the end of a piece wait for the next, so that each batch is what it was without pieces."""
    path, rng = lm.default_vocabulary(), np.random.default_rng(6)
    texts = [None if i == 3 else " ".join(f"w{n}" for n in rng.integers(0, 50, rng.integers(0, 60))) for i in range(40)]
    classes = rng.integers(0, lm.END_CLASS, lm.subwords(path).end + 1).astype(np.int32)
    monkeypatch.setattr(lm, "AT_A_TIME", 600)
    whole, seen = lm.train_local(lm.initial(), iter(texts), path, classes, 4)
    monkeypatch.setattr(lm, "ENCODED", 500)
    small, again = lm.train_local(lm.initial(), iter(texts), path, classes, 4)
    assert seen == again and all(np.array_equal(whole[n], small[n]) for n in whole)


def test_states_from_the_table_by_id():
    rng = np.random.default_rng(7)
    ids, classes = rng.integers(0, 300, (5, lm.WINDOW)), rng.integers(0, lm.END_CLASS + 1, 301).astype(np.int32)
    w = lm.initial()
    for skip in (0, lm.WINDOW - lm.STRIDE):
        assert np.allclose(lm.hidden(w, ids, classes, skip)[0], lm.hidden(lm.with_table(w, classes), ids, classes, skip)[0], atol=1e-5)
