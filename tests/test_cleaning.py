"""Rules, plans and the cleaner on small tables."""

import json
import logging
import math
import random

import pytest
from pyspark.sql import functions as F

from loamwork import CleaningPlan, DataCleaner, Decision, install_accessor
from loamwork.functions import stats, text
from loamwork.model import semantic_type, target_type
from loamwork.operators import (
    BaseRule,
    CardinalityChecker,
    Constraint,
    CrossColumnRule,
    DuplicateHandler,
    FuzzyUnifier,
    KnnImputer,
    NearDuplicateDetector,
    NullHandler,
    OutlierHandler,
    SchemaCaster,
)
from loamwork.operators import knn, similar
from loamwork.plans.checks import detect_drift, leakage_warnings
from loamwork.plans.registry import discover_rules
from loamwork.sources import default_output, read_schema, row_count
from loamwork.streaming import apply_to_stream
from loamwork.telemetry import JsonLinesSink, LoggingSink


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def run(rule, df, params=None):
    found = rule.detect(df, params)
    return found, rule.transform(df, found)


def test_nulls_and_outliers(spark):
    df = frame(spark, "age double, city string", (25.0, "a"), (30.0, "a"), (None, "b"), (28.0, None), (31.0, "a"), (27.0, "b"), (400.0, "a"))
    found, out = run(NullHandler(), df)
    assert {(d.column, d.action) for d in found} == {("age", "median"), ("city", "mode")}
    assert out.filter("age is null or city is null").count() == 0
    assert out.filter("city = 'a'").count() == 5
    found, out = run(OutlierHandler(), df)
    bound = found[0].parameters["upper_bound"]
    assert out.agg(F.max("age")).first()[0] == bound and out.filter("age is null").count() == 1


def test_percentiles_without_all_values_in_one_task(spark, monkeypatch):
    """As Spark's own percentile, without its aggregate, which gathers every distinct value of a column in one task."""
    draw = random.Random(3)
    rows = [(draw.choice([-1.0, 1.0]) * 10 ** draw.uniform(-9, 12), draw.randint(-3, 3), None, draw.choice([None, 2.5])) for _ in range(501)]
    rows += [(math.inf, 2**40, None, None), (-math.inf, None, None, None), (0.0, 1, None, None), (-0.0, 1, None, None)]
    df = frame(spark, "a double, b long, c double, d double", *rows)
    expected = df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in "abcd"]).first()

    def refuse(*_):
        raise AssertionError("one task for all values")

    for name in ("percentile", "median", "mode"):
        monkeypatch.setattr(F, name, refuse)
    got = stats.quartiles(df, list("abcd"))
    assert {c: q and list(q) for c, q in got.items()} == {c: expected[c] and [expected[c][0], expected[c][2]] for c in "abcd"}
    assert list(stats.medians(df, list("abcd")).first()) == [expected[c] and expected[c][1] for c in "abcd"]
    filled = NullHandler().transform(df, [Decision("NullHandler", c, "median", {"strategy": "median"}) for c in "bd"])
    assert filled.filter("b is null or d is null").count() == 0 and filled.filter("d = 2.5").count() == len(rows)
    tied = frame(spark, "s string", ("b",), ("a",), ("b",), ("a",), ("c",), (None,))
    assert NullHandler().transform(tied, [Decision("NullHandler", "s", "mode", {"strategy": "mode"})]).filter("s = 'a'").count() == 3


def test_nan_counts_as_missing(spark):
    df = frame(spark, "x double", (1.0,), (math.nan,), (3.0,))
    assert stats.null_counts(stats.clean_nan(df))["x"] == 1
    assert [r[0] for r in run(NullHandler("mean"), df)[1].collect()] == [1.0, 2.0, 3.0]


def test_identifiers_are_not_clipped(spark):
    df = frame(spark, "user_id long, age double", (1, 20.0), (2, 22.0), (3, 21.0), (99999, 500.0), (4, 20.0), (5, 21.0))
    assert [d.column for d in OutlierHandler().detect(df)] == ["age"]


def test_semantic_names():
    assert [semantic_type(n) for n in ("Email_x", "price_id", "id", "user_id", "update_count", "o_key")] == ["email", "currency", "identifier", "identifier", None, None]
    assert [semantic_type(n) for n in ("o_orderdate", "signupDate", "created_at", "salePrice", "paid", "candidate", "format")] == ["datetime_hint"] * 3 + ["currency", None, None, None]
    assert target_type("UInt8").simpleString() == "smallint" and target_type("INTERVAL") is None and target_type("Datetime").simpleString() == "timestamp_ntz"


def test_casts(spark):
    df = frame(spark, "created_at string, name string, age double", ("2024-01-02", "x", 2.7), ("junk", "y", 3.0))
    found, out = run(SchemaCaster({"age": "Int64", "name": "Nonsense"}), df)
    assert {d.column for d in found} == {"created_at", "age"}
    assert dict(out.dtypes) == {"created_at": "timestamp_ntz", "name": "string", "age": "bigint"}
    assert [(r["age"], r["created_at"] is None) for r in out.collect()] == [(2, False), (3, True)]


@pytest.mark.parametrize("keep,expected", [("first", [1, 3]), ("last", [2, 3]), ("none", [3])])
def test_duplicates(spark, keep, expected):
    df = frame(spark, "k string, v long", ("a", 1), ("a", 2), ("b", 3))
    found, out = run(DuplicateHandler(["k"], keep, ["v"]), df)
    assert sorted(r["v"] for r in out.collect()) == expected and found[0].signal_strength == 0.8
    assert DuplicateHandler().detect(df) == []


def test_cardinality(spark):
    df = frame(spark, "constant long, unique_id string, normal string", *[(1, f"u{i}", "ab"[i % 2]) for i in range(5)])
    found, out = run(CardinalityChecker(), df)
    assert {(d.column, d.action) for d in found} == {("constant", "drop_column"), ("unique_id", "flag_id")}
    assert out.columns == ["unique_id", "normal"]


def test_constraints(spark):
    df = frame(spark, "age long, ok boolean", (25, True), (15, True), (30, False), (None, True), (12, True))
    found, out = run(CrossColumnRule([Constraint("minor", "age < 18 and ok", "too young", "drop")]), df)
    assert found[0].parameters["violation_count"] == 2 and out.count() == 3
    found, out = run(CrossColumnRule([Constraint("minor", F.col("age") < 18)]), df)
    assert found[0].action == "flag_violation" and out.count() == 5


def test_knn(spark):
    df = frame(spark, "x double, y double, z double", (1.0, 2.0, 3.0), (1.1, None, 3.1), (10.0, 20.0, 30.0))
    found, out = run(KnnImputer(k=1), df)
    assert sorted(r["y"] for r in out.collect()) == [2.0, 2.0, 20.0]
    with pytest.warns(RuntimeWarning):
        found = KnnImputer(max_rows=2).detect(df)
    assert found[0].action == "median_fallback" and found[0].parameters["median_value"] == 11.0
    gaps = frame(spark, "x double, y double", (None, 3.0), (2.0, None), (2.0, 3.0))
    assert {d.column: d.parameters["median_value"] for d in KnnImputer().detect(gaps)} == {"x": 2.0, "y": 3.0}
    whole = frame(spark, "key long, n long", (1, 1), (2, 4), (3, None), (4, None))
    assert {r["key"]: r["n"] for r in run(KnnImputer(k=2), whole)[1].collect()} == {1: 1, 2: 4, 3: 2, 4: 2}


def _by_all_pairs(known, asked, k):
    """Mean of the k nearest by plain loops; ties by key."""
    out = {}
    for key, *x in asked:
        best = sorted((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), o, y) for o, y, *p in known)[:k]
        out[key] = sum(y for _, _, y in best) / len(best)
    return out


@pytest.mark.parametrize("chunk, block", [(4, 2), (16, 10_000), (100_000, 3)])
def test_nearest_in_chunks_as_all_pairs(spark, monkeypatch, chunk, block):
    """Ties at the k-th place, one place held by many rows, rows without the value far from all others, keys beyond 2^53."""
    monkeypatch.setattr(knn, "CHUNK", chunk)
    monkeypatch.setattr(knn, "RANGE", 40)
    draw = random.Random(5)
    places = [(draw.randint(0, 9), draw.randint(-300, 300) / 4) for _ in range(120)] + [(3, 1.0)] * 30
    known = [(2**60 + i, float(i % 17), *p) for i, p in enumerate(places)]
    asked = [(2**60 + 1000 + i, draw.randint(0, 9), draw.randint(-300, 300) / 4) for i in range(40)] + [(2**60 + 2000 + i, 3, 1.0) for i in range(5)] + [(2**60 + 3000, 900, -1e6)]
    rows = [(o, y, a, b) for o, y, a, b in known] + [(o, None, a, b) for o, a, b in asked]
    draw.shuffle(rows)
    got = knn.nearest_means(frame(spark, "key long, y double, a int, b double", *[(o, y, int(a), float(b)) for o, y, a, b in rows]), "y", ["a", "b"], "key", 5, block)
    assert {r["key"]: pytest.approx(r["value"]) for r in got.collect()} == _by_all_pairs(known, asked, 5)
    assert got.schema["key"].dataType.simpleString() == "bigint"


def test_nearest_compares_few_pairs(spark, monkeypatch):
    """On a line a row meets its chunk and the next ones, not all chunks."""
    monkeypatch.setattr(knn, "CHUNK", 50)
    met = spark.sparkContext.accumulator(0)
    plain = knn._nearest

    def counted(xs, have, order, k):
        met.add(len(xs) * len(have))
        return plain(xs, have, order, k)

    monkeypatch.setattr(knn, "_nearest", counted)
    df = spark.range(4_000).selectExpr("id as key", "case when id % 10 <> 0 then id * 1.0D end as y", "id as x")
    got = knn.nearest_means(df, "y", ["x"], "key", 2)
    assert all(r["value"] == r["key"] + (0.0 if r["key"] else 1.5) for r in got.collect())
    assert met.value < 400 * 3_600 / 20


def test_fuzzy(spark):
    df = frame(spark, "i long, city string", (1, "New York"), (2, "New Yorkk"), (3, "Paris"), (4, "Paris "), (5, None), (6, "Rome"))
    found, out = run(FuzzyUnifier(order_by="i"), df)
    assert found[0].parameters["mapping"] == {"New Yorkk": "New York", "Paris ": "Paris"}
    assert out.filter("city is not null").select("city").distinct().count() == 3
    assert FuzzyUnifier(exclude_cols=["city"]).detect(df) == []
    roles = frame(spark, "i long, role string", (1, "Manager"), (2, "manager"), (3, "MANAGER"), (4, "clerk"))
    assert FuzzyUnifier(pre_lowercase=True, order_by="i").detect(roles)[0].parameters["mapping"] == {"manager": "Manager", "MANAGER": "Manager"}


def test_fuzzy_beyond_the_cap(spark):
    names = ["New York", "New Yorkk", "York New", "Paris", "Paris ", "Rome", "rome", "Roma", "", " ", "ab", "abc", "b", "Lisbon", "Lisbonn", "Lisbom", "Lisbo", "Lizbon", "Lisboon"]
    df = frame(spark, "i long, city string", *[(100 - i, n) for i, n in enumerate(names)])
    for options in ({"order_by": "i"}, {}, {"pre_lowercase": True, "order_by": "i"}, {"threshold": 60.0}):
        whole = FuzzyUnifier(**options).detect(df)[0].parameters["mapping"]
        assert FuzzyUnifier(**options, max_values=3).detect(df)[0].parameters["mapping"] == whole


def test_ratio_against_dynamic_programming():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in [("kitten", "sitting"), ("", ""), ("abc", ""), ("Manager", "manager"), ("b a c", "c b a"), ("äöü xyz", "xyz äou")]:
        s, t = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert text.token_sort(a, b) == (200 * lcs(s, t) / (len(s) + len(t)) if s or t else 100.0)


def test_band_shapes():
    assert [text.band_shape(32, t) for t in (0.5, 0.7, 0.8, 0.85, 0.9, 0.95)] == [(10, 3), (6, 5), (5, 6), (4, 8), (3, 10), (2, 13)]


def test_near_duplicates(spark):
    df = frame(spark, "id long, name string, city string, age long", (0, "Jonathan Smithson", "San Francisco", 33), (1, "Jonathan Smithsen", "San Francisco", 33),
               (2, "Margaret Thatcherson", "Los Angeles", 45), (3, "Margaret Thatchersen", "Los Angeles", 45), (4, "Bob", "Rome", 9))
    found, out = run(NearDuplicateDetector(threshold=0.8, key="id"), df)
    assert found[0].parameters["clusters"] == [[0, 1], [2, 3]] and out is df
    assert NearDuplicateDetector(key="id").detect(df.filter("id in (0, 2, 4)")) == []
    same = spark.range(700).select("id", F.lit("the very same row in each").alias("t"))
    assert NearDuplicateDetector(key="id").detect(same)[0].parameters["num_duplicates"] == 700


def test_near_duplicates_of_large_buckets(spark, monkeypatch):
    """Pairs alike with each other but not with the least text of the bucket that they share."""
    monkeypatch.setattr(similar, "BUCKET_PAIRS", 3)
    head = "boilerplate that every row of this table shares with all the other rows of it, and which is longer than the rest of them"
    tails = ["quick brown foxes jumped over lazy dogs", "seven wizards mixed a potion of herbs", "xylophone kumquat zephyr", "pale moonlit harbours", "urgent invoices unpaid"]
    rows = [(2 * i + k, f"{head} {t} {'ab'[k]}") for i, t in enumerate(tails) for k in (0, 1)]
    df = frame(spark, "id long, t string", *rows)
    rule = NearDuplicateDetector(threshold=0.92, key="id", num_perm=1)
    small = rule.detect(df)[0].parameters["clusters"]
    monkeypatch.setattr(similar, "BUCKET_PAIRS", 500)
    assert small == rule.detect(df)[0].parameters["clusters"]
    assert any(0 not in c for c in small)


def test_profile_and_drift(spark):
    df = frame(spark, "num double, cat string", (1.0, "a"), (2.0, "b"), (4.0, "a"), (5.0, None), (None, "a"))
    p = stats.profile(df)
    assert p["num"]["null_ratio"] == 0.2 and p["num"]["mean"] == 3.0 and p["cat"]["unique_count"] == 3
    assert stats.profile(df.limit(0)) == {}
    kinds = {(a["column"], a["kind"]) for a in detect_drift(p, frame(spark, "num double", (4.0,), (3.0,)))}
    assert kinds == {("num", "null_ratio"), ("num", "mean"), ("cat", "missing_column")}
    assert detect_drift({}, df) == [] and detect_drift(p, df) == []


def test_drift_of_many_categories(spark, caplog):
    few = spark.range(50).select(F.concat(F.lit("c"), F.col("id") % 5).alias("cat"))
    many = spark.range(300).select(F.concat(F.lit("c"), F.col("id")).alias("cat"))
    more = spark.range(320).select(F.concat(F.lit("c"), F.col("id")).alias("cat"))
    alerts = detect_drift(stats.profile(few), many)
    assert [(a["kind"], a["count"], len(a["categories"])) for a in alerts] == [("new_categories", 295, 100)]
    assert [a["count"] for a in detect_drift(stats.profile(many, None), more)] == [20]
    assert [a["count"] for a in detect_drift(stats.profile(many), more, reference=many)] == [20]
    assert detect_drift(stats.profile(many), many, reference=many) == [] and not caplog.records
    assert detect_drift(stats.profile(many), more) == [] and "cat" in caplog.text
    assert [a["count"] for a in detect_drift(DataCleaner().fit(many).baseline_stats, more)] == [20]


def test_leakage(spark):
    df = frame(spark, "fraud double, fraud_date string, high double, low double, same double", *[(float(i % 2), "x", i % 2 + 0.01 * i, float(i * 7 % 5), 1.0) for i in range(6)])
    assert {(w["column"], w["kind"]) for w in leakage_warnings(df, "fraud")} == {("fraud_date", "semantic"), ("high", "correlation")}
    with pytest.raises(AssertionError):
        leakage_warnings(df, "absent")


def test_sampling(spark):
    df = spark.range(15000)
    a, b = (sorted(r[0] for r in stats.sample_rows(df, 100).collect()) for _ in range(2))
    assert a == b and len(a) == 100 and stats.sample_rows(df.limit(50)).count() == 50


def test_cleaner_end_to_end(spark, tmp_path, caplog):
    rows = [(float(i % 9), 1, "x" if i % 3 else None, i) for i in range(30)] + [(900.0, 1, "y", 77)]
    df = frame(spark, "spread double, constant long, cat string, order_id long", *rows, rows[0])
    sink = JsonLinesSink(tmp_path / "log" / "events.jsonl")
    cleaner = DataCleaner(sinks=[sink, LoggingSink()], plugins=False)
    with caplog.at_level(logging.INFO, logger="loamwork"):
        out, report = cleaner.fit_transform(df)
    assert out.columns == ["spread", "cat", "order_id"] and out.count() == 31
    assert out.filter("cat is null").count() == 0 and out.agg(F.max("spread")).first()[0] < 100
    assert report.initial_shape == (32, 4) and report.final_shape == (31, 3) and "OutlierHandler" in report.display()
    events = [json.loads(x) for x in (tmp_path / "log" / "events.jsonl").read_text().splitlines()]
    assert {e["event_type"] for e in events} == {"rule_mutation"} and len({e["run_id"] for e in events}) == 1


def test_plan_round_trip_and_rejection(spark, tmp_path):
    df = frame(spark, "a double, b string", (1.0, "x"), (None, "y"), (3.0, None))
    cleaner = DataCleaner(plugins=False)
    plan = cleaner.fit(df)
    assert plan.reject("NullHandler", "b") == 1
    plan.save(tmp_path / "plan.json")
    loaded = CleaningPlan.load(tmp_path / "plan.json")
    assert loaded.decisions == plan.decisions and loaded.baseline_stats == plan.baseline_stats
    out = cleaner.apply(df, loaded)
    assert out.filter("a is null").count() == 0 and out.filter("b is null").count() == 1
    assert loaded.to_frame(spark).count() == len(plan.decisions) and "1 of" not in loaded.approve_all().summary()[:4]


def test_path_mode(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text("id,created_at,age,salary\n1,2024-01-01,30,100\n2,2024-01-02,,110\n2,2024-01-02,,110\n3,2024-01-03,40,90\n")
    cleaner = DataCleaner([DuplicateHandler(), NullHandler(fill_from="input")], spark=spark)
    result, report = cleaner.fit_transform(path)
    assert result == default_output(path) == str(tmp_path / "in_cleaned.csv")
    assert row_count(spark, result) == 3 and report.final_shape[0] == 3
    assert read_schema(spark, path)["age"] in ("int", "double")
    assert default_output("s3://bucket/a/b.parquet") == "s3://bucket/a/b_cleaned.parquet"


class Shout(BaseRule):
    def detect(self, df, params=None):
        return [self.decide("name", "shout", "upper case")]

    def transform(self, df, decisions):
        return df.withColumn("name", F.upper("name"))


def test_plugins_config_and_knn_strategy(spark, tmp_path):
    cleaner = DataCleaner([])
    cleaner.register_rule(Shout())
    out, report = cleaner.fit_transform(frame(spark, "name string", ("a",)))
    assert out.first()[0] == "A" and "upper case" in report.display()
    with pytest.raises(TypeError):
        cleaner.register_rule(object())
    assert discover_rules("no.such.group") == []
    (tmp_path / "c.toml").write_text('[cleaner]\nimpute_strategy = "knn"\n[rules.KnnImputer]\nk = 3\nmax_rows = 15000\n[rules.NullHandler]\nnumeric_strategy = "mean"\n[rules.SchemaCaster.schema]\na = "Int64"\n')
    configured = DataCleaner.from_config(tmp_path / "c.toml", plugins=False)
    knn = next(r for r in configured.rules if isinstance(r, KnnImputer))
    assert (knn.k, knn.max_rows) == (3, 15000)
    names = [r.name for r in configured.rules]
    assert names.index("KnnImputer") < names.index("NullHandler")
    plan = configured.fit(frame(spark, "a double, b double", (1.0, 1.0), (2.0, None), (3.0, 5.0)))
    assert {d.action for d in plan.decisions if d.column == "b"} == {"knn_impute"}


def test_accessor(spark):
    install_accessor()
    df = frame(spark, "x double, c long", (1.0, 1), (None, 1), (3.0, 1))
    cleaned = df.loam.clean()
    assert cleaned.columns == ["x"] and cleaned.loam.report.final_shape == (3, 1)
    assert any(d.rule_name == "NullHandler" for d in df.loam.audit().decisions)


def test_empty_table(spark):
    df = frame(spark, "x double, s string, d date")
    out, report = DataCleaner(plugins=False).fit_transform(df)
    assert out.count() == 0 and report.mutations == []


def test_stream(spark, tmp_path):
    frame(spark, "x double, s string", (1.0, "a"), (500.0, "b"), (None, "b")).write.parquet(str(tmp_path / "in"))
    plan = CleaningPlan([Decision("OutlierHandler", "x", "clip", {"lower_bound": 0.0, "upper_bound": 9.0}), Decision("FuzzyUnifier", "s", "replace_values", {"mapping": {"b": "a"}})])
    stream = spark.readStream.schema("x double, s string").parquet(str(tmp_path / "in"))
    query = apply_to_stream(stream, plan, [OutlierHandler(), FuzzyUnifier()], {"x": 2.0}).writeStream.format("memory").queryName("cleaned_stream").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("cleaned_stream").collect()) == [(1.0, "a"), (2.0, "a"), (9.0, "a")]
