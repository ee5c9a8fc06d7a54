"""Line dedup, quality rules, extraction, LM scoring, classifier and mixing."""

import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm import html_text, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules
from loamwork.llm.queries import SQL

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"


def duck(path, sql):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return Counter(c.sql(sql).fetchall())


# --- line dedup


def brute_lines(rows):
    """rows: (doc_id, text) in order of doc_id."""
    seen, out = set(), []
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        norm = [lines[i].strip(" \t\r\f\v") for i in solid]
        gone = set()
        for i in range(len(norm) - 2):
            w = tuple(norm[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        keep, at = [], -1
        for i, x in enumerate(lines):
            at += i in solid
            if at not in gone:
                keep.append(x)
        out.append((doc_id, len(solid), len(gone), "\n".join(keep)))
    return Counter(out)


def test_line_dedup_small(spark):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\n a \nb\t\n\nc\ny"), (3, "a\na\na\na\na"), (4, None), (5, ""), (6, "a\nb"), (7, "\n\n a\nb\nc\n"),
        (8, "b\nc\nd\ne\nf"), (9, "q\n\n\nr\n  \ns\nt\nb\nc\nd"), (10, "\n".join(f"l{i % 50}" for i in range(400))),
    ]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text")
    assert Counter(tuple(r) for r in got.collect()) == brute_lines(rows)


def test_line_dedup_query(spark):
    got = Counter(tuple(r) for r in line_dedup.op1_line_dedup(spark, SF).collect())
    assert got == duck(SF, SQL["op1_line_dedup"])


def test_line_dedup_edges(spark, docs, nothing):
    out = line_dedup.line_dedup(docs)
    assert out.count() == docs.count() and {"n_lines", "n_removed"} <= set(out.columns)
    assert line_dedup.op1_line_dedup(spark, nothing).count() == 0


# --- quality rules


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("where", ["saved", "sf"])
def test_quality_counts(spark, where, request):
    path = SF if where == "sf" else request.getfixturevalue("saved")
    source = [(r["doc_id"], brute_counts(r["text"])) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = quality_rules.op7_quality_rules(spark, path).collect()
    assert Counter((r["doc_id"], tuple(r)[1:6]) for r in got) == Counter(source)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_keep_good_and_reject_junk(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = [(r["quality"], r["kept"]) for r in quality_rules.op7_quality_rules(spark, path).drop("quality").join(labels, "doc_id").collect()]
    good, bad = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.05


def test_quality_rules_match_their_sql(spark):
    for path in (SF, "/root/testdata/sf0.01"):
        got = quality_rules.op7_quality_rules(spark, path)
        names = sorted(got.columns)
        expected = duck(path, f"SELECT {', '.join(names)} FROM ({SQL['op7_quality_rules']})")
        assert Counter(tuple(r) for r in got.select(*names).collect()) == expected


def decided(patterns):
    odds, adds = quality_rules.fit(patterns)
    return {p: odds + sum(a[v] for a, v in zip(adds, p, strict=True)) > 0 for p in patterns}, adds


def test_em_outvotes_a_noisy_rule():
    """Three rules see the same bad documents; a fourth casts bad votes at random on three in ten."""
    patterns = Counter()
    for seen, n in (((1, 1, 0), 9000), ((0, 1, 0), 300), ((-1, -1, 0), 300), ((-1, -1, -1), 400), ((0, -1, -1), 200)):
        patterns[(*seen, 0)] += int(0.7 * n)
        patterns[(*seen, -1)] += int(0.3 * n)
    kept, adds = decided(patterns)
    assert kept == {p: p[:3] in ((1, 1, 0), (0, 1, 0)) for p in patterns}
    assert abs(adds[3][-1]) < 0.2 < 3 < -adds[0][-1]


def test_one_bad_vote_may_be_outvoted(spark):
    """On a real table some documents with a bad vote are kept, and none that fails the base rule."""
    counted = quality_rules.counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    any_bad = F.least(*quality_rules.votes().values()) < 0
    flagged = {r["doc_id"] for r in counted.filter(any_bad).select("doc_id").collect()}
    got = quality_rules.op7_quality_rules(spark, "/root/testdata/sf0.1").filter("kept").collect()
    assert flagged & {r["doc_id"] for r in got} and not any(r["base_failed"] for r in got)
    assert quality_rules.fit({})[1] == []


# --- html


@pytest.fixture(scope="module")
def labeller():
    return html_text.train()


def test_labeller_on_unseen_layouts(labeller):
    rng, right, total = random.Random(4242), 0, 0
    for _ in range(150):
        page, marks = html_text.make_page(rng)
        found = html_text.blocks(page)
        if len(found) == len(marks) and found:
            p = html_text.label(labeller, [found])[0]
            right, total = right + int(((p >= 0.5) == np.array(marks)).sum()), total + len(marks)
    assert total > 1000 and right / total > 0.97


def test_extraction_of_the_pages_table(spark, labeller):
    path = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{path}/pages.parquet")
    exact = 0
    rows = html_text.extract_text(pages, labeller).collect()
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", sources[r["page_id"]], re.S)[1]
        import html

        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        exact += r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])
    assert len(rows) == len(sources) and exact / len(rows) > 0.97


def test_blocks_of_odd_markup():
    b = html_text.blocks("x<p>a &amp; b<b> c</b>  d<p>e<script>var t='</p>';</script>f<!-- no --><br>g<div hidden>h</div><ul><li>i<li>j</ul></p></i>")
    assert [k.text for k in b] == ["x", "a & b c d", "e", "f g", "i", "j"]
    assert "var" not in " ".join(k.text for k in b) and "h" not in [k.text for k in b]
    assert html_text.blocks(None) == [] and html_text.blocks("") == []
    assert [k.text for k in html_text.blocks("<p>a<p>b")] == ["a", "b"]
    assert html_text.blocks("<" * 5000)


#: What a tag, comment or declaration is, as one pattern; tried at every "<", which takes quadratic time on broken pages.
A_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ODD = ["<", "</", "p", "<p>", "</p>", "<b>", ">", '"', "'", " x ", " class='a b'", ' id="c<d>"', "<!--", "-->", "<br>", "<div ", "&amp;", "=", "/"]
ODD += ["<![CDATA[", "]]>", "<a href=x>", "</a>", "<!", "<?", " title='hidden x'"]


def test_scanner_finds_what_the_pattern_finds():
    rng = random.Random(3)
    for _ in range(4000):
        page = "".join(rng.choice(ODD) for _ in range(rng.randint(1, 16)))
        scanned, tags = [], html_text.Scanner(page).tags()
        tag = next(tags, None)
        while tag:
            scanned.append(tag)
            try:
                tag = tags.send(tag[1])
            except StopIteration:
                break
        assert scanned == [(m.start(), m.end(), m[1], m[2] or "", m[3] or "") for m in A_TAG.finditer(page)], page


BROKEN = {
    "open quotes": lambda k: "<p '" * k,
    "mixed quotes": lambda k: "<p \"<p '" * k + ">",
    "open elements": lambda k: "<div>x" * k,
    "open inline elements": lambda k: "<b>" * k + "<li>x" * k,
    "names": lambda k: "<a" * k + ' ">',
    "open data": lambda k: "<![CDATA[>" * k,
    "declarations": lambda k: ">" + "<!x" * k,
    "raw ends": lambda k: "<p></title " * k,
    "attributes": lambda k: "<p " + "class " * k + ">x",
    "references": lambda k: "&#" + "1" * k + ";&#" + "0" * k + "65;",
}


@pytest.mark.parametrize("kind", BROKEN)
def test_long_broken_pages_take_linear_time(kind):
    began = time.process_time()
    html_text.blocks(BROKEN[kind](100_000))
    assert time.process_time() - began < 20  # the square of 100,000 steps takes hours


def test_extraction_reads_long_words_digits_and_formulas(spark, labeller):
    assert html_text.blocks("<p>&#" + "0" * 6000 + "65;b&#" + "9" * 6000 + ";")[0].text == "Ab\ufffd"
    assert [k.text for k in html_text.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds<p title='a hidden gem' data-hidden=no>y")] == ["so x=1 holds", "y"]
    short, long = html_text.blocks("<p>" + "a" * 39 + " 12</p><p>" + "b" * 500 + " 12")
    x = html_text.features([short, long])
    assert (np.abs(x[:, html_text.PATH_WIDTH : -html_text.COUNTS]).sum(1) > 0).all() and (x[:, -4] > 0).all()


def test_extraction_of_repeated_and_long_pages(spark, labeller):
    page = "<nav><a href=/>Home</a></nav><article>" + "<p>Some long text. It goes on here, and on.</p>" * 3 + "</article>"
    long = "<nav><a href=/>Home</a></nav><article>" + "<p>Some long text. It goes on here, and on.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, page, "x", 0), (1, page, "x", 0), (2, long, "y", 0)], "page_id long, html string, text string, n_chars int")
    rows = html_text.extract_text(df, labeller).collect()
    assert [r["page_id"] for r in rows] == [1, 1, 2] and rows[0] == rows[1] and rows[0]["text"].count("\n") == 2
    assert rows[2]["text"].count("\n") == 19_999


def test_extraction_edges(spark, labeller):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "u"), (None, "<article><p>Some long text. It goes on here, and on.</p></article>", None)], "page_id long, html string, text string")
    rows = {r["page_id"]: r for r in html_text.extract_text(df, labeller).collect()}
    assert rows[1]["text"] == rows[2]["text"] == "" and rows[1]["n_chars"] == 0
    assert html_text.extract_text(df.limit(0), labeller).count() == 0


# --- LM scoring


def test_attention_gradient():
    rng = np.random.default_rng(0)
    w = {n: x.astype(np.float64) for n, x in lm_scoring.initial().items()}
    ids, target = rng.integers(0, 300, (3, lm_scoring.WINDOW)), rng.integers(0, 300, (3, lm_scoring.WINDOW))
    valid = rng.random((3, lm_scoring.WINDOW)) < 0.7
    classes = rng.integers(0, lm_scoring.END_CLASS + 1, 300)

    def loss():
        h, kept = lm_scoring.hidden(w, ids, classes)
        log, _, out = lm_scoring.outputs(w, h[valid], classes[target[valid]])
        return -log.mean(), kept, h[valid], out

    _, kept, h, out = loss()
    g = lm_scoring.backward(w, kept, h, classes[target[valid]], valid, out)
    for n in w:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w[n].shape)
            at = (int(ids[0, 0]) % lm_scoring.BUCKETS, 1) if n == "eb" else (int(classes[ids[0, 0]]), 1) if n == "ec" else at
            old, e = w[n][at], 1e-4
            w[n][at] = old + e
            up = loss()[0]
            w[n][at] = old - e
            down = loss()[0]
            w[n][at] = old
            assert abs((up - down) / (2 * e) - g[n][at]) < 1e-4


def brute_logs(w, ids, classes, stride, start, end_class):
    """Log probabilities of a text's classes, token by token, from plain loops over its windows."""
    size, out = lm_scoring.WINDOW, []
    for t in range(len(ids)):
        k = 0 if t < size else -(-(t - size + 1) // stride)  # the first window that reaches the place
        stream = [end_class, *ids]
        inside = stream[k * stride : t + 1]
        x = np.array([w["ec"][classes[i]] + w["eb"][i % lm_scoring.BUCKETS] + w["ep"][p] for p, i in enumerate(inside)], dtype=np.float64)
        score = x @ w["k"] @ (x[-1] @ w["q"]) / lm_scoring.WIDTH**0.5
        a = np.exp(score) / np.exp(score).sum()
        h = x[-1] + a @ (x @ w["v"]) @ w["o"]
        z = np.exp(h @ w["group"] + w["group_bias"])
        c = classes[ids[t]]
        p = z[c // lm_scoring.MEMBERS] / z.sum()
        if c < lm_scoring.END_CLASS:
            m = np.exp(h @ w["member"][c // lm_scoring.MEMBERS] + w["member_bias"][c // lm_scoring.MEMBERS])
            p *= m[c % lm_scoring.MEMBERS] / m.sum()
        out.append((np.log(p), np.log((z[:start].sum() + z[-1]) / z.sum())))
    return np.array(out)


def test_scores_match_a_token_by_token_model():
    rng, end = np.random.default_rng(2), 299
    classes = np.append(rng.integers(0, lm_scoring.END_CLASS, end), lm_scoring.END_CLASS)
    model = {"weights": lm_scoring.initial(5), "classes": classes, "shares": np.zeros(end + 1, dtype=np.float32)}
    texts = [np.append(rng.integers(0, end, n), end) for n in (0, 3, 23, 24, 41, 90)]
    logs, begins = lm_scoring.subword_scores(model, np.concatenate(texts).astype(np.int32), np.array(list(map(len, texts))), end)
    expected = np.concatenate([brute_logs(model["weights"], t, classes, lm_scoring.STRIDE, lm_scoring.START_GROUPS, end) for t in texts])
    assert np.abs(logs - expected[:, 0]).max() < 1e-3 and np.abs(begins - expected[:, 1]).max() < 1e-3


def test_windows_score_each_token_once():
    lengths = np.array([1, 5, 24, 25, 40, 42, 43, 100])
    for stride in (lm_scoring.STRIDE, lm_scoring.WINDOW):
        at, valid = lm_scoring.windows(lengths, stride)
        assert at[valid].tolist() == list(range(lengths.sum()))


@pytest.mark.parametrize("where", ["saved", "sf"])
def test_lm_scoring(spark, where, request):
    path = SF if where == "sf" else request.getfixturevalue("saved")
    source = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in source if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in source:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        expected[(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 4))] += 1
    got = lm_scoring.op3_lm_scoring(spark, path).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == expected
    assert all(-1e7 < r["score"] < 0 for r in got)


def test_lm_words_sum_to_at_most_one(spark):
    """The mixture's first-word probabilities over many words stay below one."""
    docs = lm_scoring.with_held_out(spark.read.parquet(f"{SF}/documents.parquet"))
    model = lm_scoring.fit(docs)
    counts = {r["word"]: r["c"] for r in model["counts"].collect()}
    sub = lm_scoring.Subwords(model["path"])
    words = [w.encode() for w in counts]
    ids, lengths, c, *_ = lm_scoring.WordIds(model["path"], {w.encode(): n for w, n in counts.items()}).texts([[w] for w in words])
    assert c.tolist() == list(counts.values())
    logs, begins = lm_scoring.subword_scores(model, ids, lengths, sub.end)
    ends = np.cumsum(lengths) - 1
    sums = np.add.reduceat(logs, ends - lengths + 1) - logs[ends] + begins[ends] - begins[ends - lengths + 1]
    total = (10 ** lm_scoring.mixed_log10(model, c, sums)).sum()
    assert 0.5 < total < 1.0001


def test_lm_training_reaches_every_position():
    sub = lm_scoring.Subwords(lm_scoring.default_vocabulary())
    texts = ["a short text", "another one", None, " ".join(f"word{i}" for i in range(300))]
    positions = sum(sum(len(sub.of(w)) for w in lm_scoring.words_of(t)) + 1 for t in texts)
    classes = np.zeros(sub.end + 1, dtype=np.int32)
    seen = lm_scoring.train_local(lm_scoring.initial(), iter(texts), lm_scoring.default_vocabulary(), classes)[1]
    assert seen == positions


def test_lm_score_follows_attention():
    """Without probability from attention a frequent word has none; only a rare one keeps its back-off."""
    model = {"n": 1000, "v": 50, "rare": 100}
    frequent, rare = (lm_scoring.mixed_log10(model, np.array([c]), np.array([-1.0, -20.0])) for c in (200.0, 2.0))
    assert frequent[0] - frequent[1] > 8
    assert rare[0] - rare[1] < 4


# --- classifier and mixing


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    feats = [np.unique(np.concatenate([[5], [10 + g], rng.integers(100, 400, 6)])).astype(np.int32) for g in grades]
    w, t1, t2 = quality_classifier.fit(feats, grades)
    assert t1 < t2 and w[10] < w[11] < w[12]


def test_classifier_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = quality_classifier.train(docs, labels.filter("doc_id % 4 <> 0"))
    test = labels.filter("doc_id % 4 = 0").join(quality_classifier.classify(docs, model), "doc_id").collect()
    clean = [r["selected"] for r in test if r["quality"] == 1 and r["toxic"] == 0]
    rest = [r["selected"] for r in test if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(clean) / len(clean) > 0.95 and sum(rest) / len(rest) < 0.15


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (10, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.classify(docs, model)
    assert out.count() == docs.count()
    assert all(0 <= r["p_ge_2"] <= r["p_ge_1"] <= 1 for r in out.collect())
    none = quality_classifier.classify(docs, quality_classifier.train(docs, labels.limit(0)))
    assert {r["expected_grade"] for r in none.collect()} == {1.0}


def test_mixing_meets_its_targets(spark):
    rows = mixing.op10_mixing(spark, "/root/testdata/sf0.01").collect()
    totals = [sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
    for d, t in zip(mixing.DOMAINS, totals, strict=True):
        assert abs(t / sum(totals) - mixing.TARGETS[d]) < 0.005
    assert min(r["rate"] for r in rows) >= 0
    expected, real = sum(r["rate"] * r["n_tokens"] for r in rows), sum(r["copies"] * r["n_tokens"] for r in rows)
    assert abs(real / expected - 1) < 0.03


def test_mixing_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (10, 0, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels).count() == docs.count()
    assert mixing.mix(docs, labels.limit(0)).count() == docs.count()
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_mixing_classifier_shares_symbol_runs(spark):
    """Junk words that were never seen are known by the symbols on them."""
    rows = [(i, f"plain{i} words{i} here{i}", 1) for i in range(40)] + [(100 + i, f"rare{i}### odd{i}### text{i}", 0) for i in range(40)]
    unseen = [(500, "new### other### thing", None), (501, "newer another thing", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + unseen], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["posterior"] for r in mixing.posteriors(docs, labels).filter("doc_id >= 500").collect()}
    assert got[500][1] > 0.9 and got[501][1] < 0.6


def test_mixing_fills_scarce_domains(spark, caplog):
    rows = [(i, i, 100, p0, p1, p2) for i, (p0, p1, p2) in enumerate([(0.98, 0.01, 0.01)] * 900 + [(0.1, 0.9, 0.0)] * 6 + [(0.2, 0.0, 0.8)] * 240)]
    table = spark.createDataFrame(rows, "doc_id long, mark long, n_tokens long, p0 double, p1 double, p2 double")
    for targets in (mixing.TARGETS, {"clean": 0.5, "low": 0.25, "toxic": 0.25}):
        steps, shares = mixing.fit_rates(table, targets)
        got = mixing.rated(table, steps).collect()
        totals = [sum(r["rate"] * r["n_tokens"] * r[f"p{d}"] for r in got) for d in range(3)]
        for d, name in enumerate(mixing.DOMAINS):
            assert abs(totals[d] / sum(totals) - targets[name]) < 0.005 and abs(shares[name] - totals[d] / sum(totals)) < 1e-6
        assert min(r["rate"] for r in got) >= 0
    assert not caplog.records
    none = table.withColumns({"p0": F.col("p0") + F.col("p1"), "p1": F.lit(0.0)})
    assert mixing.fit_rates(none, mixing.TARGETS)[1]["low"] == 0 and "low" in caplog.text
