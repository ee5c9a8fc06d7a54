"""The pipeline's stages against their operators' plain meaning."""

import random
from collections import defaultdict

import corpus_pipeline as pipeline
from loamwork.llm import near_text, packing

PATH = "/root/testdata/sf0.01"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], PATH).write.parquet(f"{tmp_path}/{k}-{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}-{name}"))
        if k < 4:
            assert seen[-1].columns == pipeline.COLUMNS
    ids = [[r["doc_id"] for r in df.select("doc_id").collect()] for df in seen]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    clean = {i for i, x in labels.items() if x == (1, 0)}
    assert len(clean & set(ids[1])) > 0.97 * len(clean & set(ids[0]))
    assert len({i for i, x in labels.items() if x[0] == 0} & set(ids[1])) < 0.05 * sum(x[0] == 0 for x in labels.values())
    assert sorted(ids[2]) == sorted(ids[1])
    assert len(ids[3]) == len(set(ids[3])) < len(ids[2])
    texts = defaultdict(list)
    for r in seen[2].collect():
        texts[(r["text"] or "").encode().lower()].append(r["doc_id"])
    for group in texts.values():
        assert len(set(group) & set(ids[3])) <= 1
    assert len(clean & set(ids[4])) > 0.98 * len(clean & set(ids[3]))
    toxic = {i for i, x in labels.items() if x[1] == 1}
    assert len(toxic & set(ids[4])) < 0.4 * len(toxic & set(ids[3]))
    pieces = seen[5].collect()
    encoder = packing.WordEncoder(packing.default_tokenizer())
    tokens = sum(len(encoder.ids(r["text"] or "")) + 1 for r in seen[4].collect())
    assert sum(r["length"] for r in pieces) == tokens


def test_pipeline_edges(spark, saved):
    labels = spark.createDataFrame([(1, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{saved}/labels.parquet", mode="overwrite")
    assert pipeline.run(spark, saved).count() >= 1


def test_near_stage_goes_by_exact_similarity(spark):
    """Pairs on both sides of five-word Jaccard 0.8, a chain, and the pairs of sf0.01 against brute force."""
    words = [f"w{i}" for i in range(230)]

    def edited(*places):
        return " ".join("edit%d" % i if i in places else w for i, w in enumerate(words))

    rows = [
        (1, edited()), (2, edited(*range(10, 210, 40))),  # 5 edits: 201 of 251 shared, 0.80
        (3, " ".join(f"v{i}" for i in range(230))), (4, " ".join("x" if i in (20, 60, 100, 140, 180, 220) else f"v{i}" for i in range(230))),  # 6: 0.77
        (5, "one two"), (6, "ONE  two"), (7, None), (8, " "), (None, edited()), (9, "one two three"),
    ]
    got = near_text.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
    assert len(got) == len(rows)


def test_near_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").filter("doc_id is not null")
    grams = {}
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        grams[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in grams}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(grams)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = grams[i], grams[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(a & b)
                if not a and not b or both >= 0.8 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_components(docs, 5).collect()}
    assert got == {i: find(i) for i in ids}
    kept = {r["doc_id"] for r in pipeline.near_stage(spark, docs, PATH).collect()}
    assert kept == {i for i in ids if find(i) == i}


def test_near_stage_keeps_one_of_repeated_rows_and_null_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (5, text), (5, other), (7, other), (7, other), (None, text), (None, "alone"), (None, "alone"), (9, None), (8, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_stage(spark, docs, "somewhere").collect()), key=str)
    assert got == sorted([(1, text), (5, other), (None, "alone"), (8, " ")], key=str)
    assert pipeline.near_stage(spark, docs.limit(0), "somewhere").count() == 0


def test_stages_leave_other_results_alone(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    found = near_text.near_components(docs, 5)
    for _ in range(2):
        pipeline.rules_stage(spark, docs, "elsewhere").count()
    assert found.count() == 2


def test_dense_group_below_the_threshold_keeps_all_links(spark):
    """Variants of one text by 0 to 8 edits: components equal those of all pairs."""
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(160):
        edited = list(words)
        for at in rng.sample(range(150), rng.randint(0, 8)):
            edited[at] = f"e{rng.randint(0, 30)}"
        rows.append((i, " ".join(edited)))
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    root = list(range(160))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(160):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = near_text.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(160)}


def test_pipeline_of_an_empty_table(spark, nothing):
    spark.createDataFrame([(1, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{nothing}/labels.parquet")
    assert pipeline.run(spark, nothing).count() == 0
