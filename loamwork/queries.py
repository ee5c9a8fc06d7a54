"""One query an operator, on the shared test tables with defects injected by key, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats, text
from .operators import (
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
from .operators.knn import nearest_means
from .plans.checks import detect_drift, leakage_warnings
from .plans.cleaner import DataCleaner
from .sources import read_path, read_schema

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Views with injected defects: the same text for Spark and DuckDB.
LI_NULL = "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN (l_orderkey*7+l_linenumber)%11=0 THEN NULL ELSE l_quantity END AS qty FROM lineitem"
ORD_DUP = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey%20=0"
CUST_OUT = "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey%97=0 THEN c_acctbal*100 ELSE c_acctbal END AS bal FROM customer"
SEG_NULL = "SELECT c_custkey, CASE WHEN c_custkey%9=0 THEN NULL ELSE c_mktsegment END AS seg FROM customer"
SEG_TYPO = (
    "SELECT c_custkey, CASE WHEN c_custkey%13=0 THEN lower(c_mktsegment) WHEN c_custkey%17=0 THEN c_mktsegment||'S' ELSE c_mktsegment END AS seg FROM customer"
)
SUPP_NULL = "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey%10=0 THEN NULL ELSE s_acctbal END AS bal FROM supplier"
HALF = (
    "SELECT o_orderkey, CASE WHEN {h}=1 AND o_orderkey%5=1 THEN NULL ELSE o_totalprice*(1+{h}*0.3) END AS price, "
    "CASE WHEN {h}=1 AND o_orderkey%7=1 THEN 'new' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey%2={h}"
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """SQL over the tables it names, without leaving views behind for other queries to meet."""
    names = [t for t in ("lineitem", "orders", "customer", "supplier", "events", "part") if f"FROM {t}" in sql]
    return spark.sql(_braced(sql, names), **{t: table(spark, d, t) for t in names})


def _braced(sql: str, names: list[str]) -> str:
    for t in names:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return sql


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' AND l_quantity > 45")
def scan_parquet(spark, d):
    df = read_path(spark, f"{d}/lineitem.parquet")
    return df.filter("l_shipdate < timestamp_ntz '1999-01-01' and l_quantity > 45").select("l_orderkey", "l_quantity")


@query("SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) AS t(name, type)")
def schema_of_file(spark, d):
    return spark.createDataFrame(list(read_schema(spark, f"{d}/region.parquet").items()), "name string, type string")


@query(f"""WITH v AS ({LI_NULL})
SELECT 'qty' AS col, 'null_ratio' AS metric, round(avg(CASE WHEN qty IS NULL THEN 1.0 ELSE 0.0 END), 6) AS val FROM v
UNION ALL SELECT 'qty', 'mean', round(avg(qty), 6) FROM v UNION ALL SELECT 'qty', 'std_dev', round(stddev_samp(qty), 6) FROM v""")
def profile_numeric(spark, d):
    p = stats.profile(view(spark, d, LI_NULL).select("qty"))["qty"]
    return spark.createDataFrame([("qty", m, float(p[m])) for m in ("null_ratio", "mean", "std_dev")], "col string, metric string, val double").withColumn("val", F.round("val", 6))


@query(f"""WITH v AS ({SEG_NULL})
SELECT count(DISTINCT seg) + max(CASE WHEN seg IS NULL THEN 1 ELSE 0 END) AS unique_count, round(avg(CASE WHEN seg IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ratio,
       (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT seg AS s FROM v WHERE seg IS NOT NULL)) AS categories FROM v""")
def profile_categorical(spark, d):
    p = stats.profile(view(spark, d, SEG_NULL).select("seg"))["seg"]
    return spark.createDataFrame([(p["unique_count"], round(p["null_ratio"], 6), ",".join(p["categories"]))], "unique_count long, null_ratio double, categories string")


@query(f"WITH v AS ({LI_NULL}) SELECT 'qty' AS col, count(*) FILTER (qty IS NULL) AS n FROM v UNION ALL SELECT 'l_partkey', count(*) FILTER (l_partkey IS NULL) FROM v")
def null_counts(spark, d):
    n = stats.null_counts(view(spark, d, LI_NULL).select("qty", "l_partkey"))
    return spark.createDataFrame([(c, n[c]) for c in ("qty", "l_partkey")], "col string, n long")


def _filled(value: str, source: str = LI_NULL, column: str = "qty", key: str = "l_orderkey, l_linenumber") -> str:
    return f"WITH v AS ({source}) SELECT {key}, coalesce({column}, ({value})) AS {column} FROM v"


def _fill(df: DataFrame, rule: NullHandler) -> DataFrame:
    return rule.transform(df, rule.detect(df))


@query(_filled("SELECT quantile_cont(qty, 0.5) FROM v"))
def null_median(spark, d):
    return _fill(view(spark, d, LI_NULL), NullHandler()).select("l_orderkey", "l_linenumber", "qty")


@query(f"WITH v AS ({LI_NULL}) SELECT l_orderkey, l_linenumber, round(coalesce(qty, (SELECT avg(qty) FROM v)), 6) AS qty FROM v")
def null_mean(spark, d):
    out = _fill(view(spark, d, LI_NULL), NullHandler("mean"))
    return out.select("l_orderkey", "l_linenumber", F.round("qty", 6).alias("qty"))


@query(_filled("SELECT seg FROM v WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1", SEG_NULL, "seg", "c_custkey"))
def null_mode(spark, d):
    return _fill(view(spark, d, SEG_NULL), NullHandler())


DUP_NULL = f"SELECT o_orderkey, CASE WHEN o_orderkey%6=0 THEN NULL ELSE o_totalprice END AS price FROM ({ORD_DUP}) AS u"


@query(f"WITH v AS ({DUP_NULL}) SELECT DISTINCT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM v)) AS price FROM v")
def null_median_input(spark, d):
    df = view(spark, d, DUP_NULL)
    cleaner = DataCleaner([DuplicateHandler(), NullHandler(fill_from="input")])
    return cleaner.apply(df, cleaner.fit(df))


BOUNDS = f"WITH v AS ({CUST_OUT}), q AS (SELECT quantile_cont(bal, 0.25) AS q1, quantile_cont(bal, 0.75) AS q3 FROM v)"


@query(f"{BOUNDS} SELECT round(q1-1.5*(q3-q1), 6) AS lo, round(q3+1.5*(q3-q1), 6) AS hi, (SELECT count(*) FROM v, q WHERE bal < q1-1.5*(q3-q1) OR bal > q3+1.5*(q3-q1)) AS outliers FROM q")
def outlier_bounds(spark, d):
    df = view(spark, d, CUST_OUT).select("bal")
    found = OutlierHandler().detect(df)[0]
    n = round(found.signal_strength * df.count())
    return spark.createDataFrame([(round(found.parameters["lower_bound"], 6), round(found.parameters["upper_bound"], 6), n)], "lo double, hi double, outliers long")


@query(f"{BOUNDS} SELECT c_custkey, round(CASE WHEN bal < q1-1.5*(q3-q1) THEN q1-1.5*(q3-q1) WHEN bal > q3+1.5*(q3-q1) THEN q3+1.5*(q3-q1) ELSE bal END, 4) AS bal FROM v, q")
def outlier_clip(spark, d):
    df, rule = view(spark, d, CUST_OUT).select("c_custkey", "bal"), OutlierHandler()
    found = [x for x in rule.detect(df) if x.column == "bal"]
    return rule.transform(df, found).select("c_custkey", F.round("bal", 4).alias("bal"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT 'value' AS col FROM q WHERE EXISTS (SELECT 1 FROM events, q WHERE value < a-1.5*(b-a) OR value > b+1.5*(b-a))""")
def outlier_skips_identifiers(spark, d):
    found = OutlierHandler().detect(table(spark, d, "events"))
    return spark.createDataFrame([(x.column,) for x in found], "col string")


@query(f"SELECT DISTINCT * FROM ({ORD_DUP}) AS u")
def dedup_full(spark, d):
    df, rule = view(spark, d, ORD_DUP), DuplicateHandler()
    return rule.transform(df, rule.detect(df))


@query(f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({ORD_DUP}) AS a) AS b) AS duplicates FROM ({ORD_DUP}) AS u")
def dedup_count(spark, d):
    n = DuplicateHandler().detect(view(spark, d, ORD_DUP))[0].parameters["num_duplicates"]
    return spark.createDataFrame([(n,)], "duplicates long")


def _dedup(keep: str):
    def run(spark, d):
        df, rule = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), DuplicateHandler(["o_custkey"], keep, ["o_orderkey"])
        return rule.transform(df, rule.detect(df))

    return run


for _keep, _order in (("first", "o_orderkey"), ("last", "o_orderkey DESC")):
    QUERIES[f"dedup_subset_{_keep}"] = _dedup(_keep)
    SQL[f"dedup_subset_{_keep}"] = f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_order}) AS r FROM orders) WHERE r = 1"
QUERIES["dedup_subset_none"] = _dedup("none")
SQL["dedup_subset_none"] = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 1"


@query("SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def schema_cast(spark, d):
    df, rule = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), SchemaCaster({"c_acctbal": "Int64", "c_nationkey": "String"})
    return rule.transform(df, rule.detect(df))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS order_date FROM orders")
def datetime_cast(spark, d):
    df, rule = view(spark, d, "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_date FROM orders"), SchemaCaster()
    return rule.transform(df, rule.detect(df))


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def drop_constant(spark, d):
    df, rule = view(spark, d, "SELECT s_suppkey, s_nationkey, 1 AS constant FROM supplier"), CardinalityChecker()
    return rule.transform(df, rule.detect(df))


@query("SELECT 'c_name' AS col, round(count(DISTINCT c_name)/count(*), 6) AS ratio FROM customer HAVING count(DISTINCT c_name)/count(*) > 0.99")
def flag_id(spark, d):
    found = [x for x in CardinalityChecker().detect(table(spark, d, "customer")) if x.action == "flag_id"]
    return spark.createDataFrame([(x.column, round(x.parameters["unique_ratio"], 6)) for x in found], "col string, ratio double")


RULES = [Constraint("steep", "l_discount > 0.05 AND l_tax < 0.02", "discount without tax", "drop"), Constraint("big", "l_quantity > 49", "large order")]


@query("""SELECT 'steep' AS name, count(*) FILTER (l_discount > 0.05 AND l_tax < 0.02) AS violations FROM lineitem
UNION ALL SELECT 'big', count(*) FILTER (l_quantity > 49) FROM lineitem""")
def cross_warn(spark, d):
    found = CrossColumnRule(RULES).detect(table(spark, d, "lineitem"))
    return spark.createDataFrame([(x.column, x.parameters["violation_count"]) for x in found], "name string, violations long")


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE NOT coalesce(l_discount > 0.05 AND l_tax < 0.02, false)")
def cross_drop(spark, d):
    df, rule = table(spark, d, "lineitem"), CrossColumnRule(RULES)
    return rule.transform(df, rule.detect(df)).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def map_values(spark, d):
    from .model import Decision

    df = view(spark, d, "SELECT o_orderkey, o_orderstatus AS status FROM orders")
    return FuzzyUnifier().transform(df, [Decision("FuzzyUnifier", "status", "replace_values", {"mapping": {"F": "filled", "O": "open"}})])


@query(f"""WITH a AS ({HALF.format(h=0)}), b AS ({HALF.format(h=1)}),
s AS (SELECT (SELECT avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) FROM a) AS na, (SELECT avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) FROM b) AS nb,
             (SELECT avg(price) FROM a) AS ma, (SELECT avg(price) FROM b) AS mb)
SELECT 'price' AS col, 'null_ratio' AS kind, round(abs(nb-na), 4) AS shift, '' AS detail FROM s WHERE abs(nb-na) > 0.1
UNION ALL SELECT 'price', 'mean', round(abs(mb-ma)/abs(ma), 4), '' FROM s WHERE abs(mb-ma)/abs(ma) > 0.15
UNION ALL SELECT 'priority', 'new_categories', 0.0, string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT priority AS p FROM b WHERE priority NOT IN (SELECT priority FROM a)) HAVING count(*) > 0
UNION ALL SELECT 'o_orderkey', 'missing_column', 0.0, ''""")
def drift(spark, d):
    base = stats.profile(view(spark, d, HALF.format(h=0)))
    alerts = detect_drift(base, view(spark, d, HALF.format(h=1)).drop("o_orderkey"))
    rows = [(a["column"], a["kind"], round(float(a.get("shift", 0.0)), 4), ",".join(a.get("categories", []))) for a in alerts]
    return spark.createDataFrame(rows, "col string, kind string, shift double, detail string")


LEAK = "SELECT o_totalprice AS price, o_totalprice*1.01+1 AS copy, o_custkey AS other, 1 AS fixed, o_totalprice*0 AS price_flag FROM orders"


@query(f"""WITH v AS ({LEAK}) SELECT 'copy' AS col, 'correlation' AS kind, round(corr(copy, price), 4) AS r FROM v HAVING abs(corr(copy, price)) > 0.85
UNION ALL SELECT 'price_flag', 'semantic', 0.0""")
def leakage(spark, d):
    found = leakage_warnings(view(spark, d, LEAK), "price")
    return spark.createDataFrame([(w["column"], w["kind"], round(w.get("correlation", 0.0), 4)) for w in found], "col string, kind string, r double")


@query(f"""WITH v AS ({SUPP_NULL}), n AS (
SELECT m.s_suppkey, k.bal, row_number() OVER (PARTITION BY m.s_suppkey ORDER BY (m.s_suppkey-k.s_suppkey)*(m.s_suppkey-k.s_suppkey)+(m.s_nationkey-k.s_nationkey)*(m.s_nationkey-k.s_nationkey), k.s_suppkey) AS r
FROM v m, v k WHERE m.bal IS NULL AND k.bal IS NOT NULL)
SELECT s_suppkey, round(coalesce(bal, (SELECT avg(bal) FROM n WHERE n.s_suppkey = v.s_suppkey AND r <= 5)), 4) AS bal FROM v""")
def knn_impute(spark, d):
    df = view(spark, d, SUPP_NULL)
    near = nearest_means(df, "bal", ["s_suppkey", "s_nationkey"], "s_suppkey").withColumnRenamed("key", "s_suppkey")
    return df.join(near, "s_suppkey", "left").select("s_suppkey", F.round(F.coalesce("bal", "value"), 4).alias("bal"))


@query("SELECT p_partkey, CASE WHEN length(p_name) < 3 THEN 0 ELSE len(list_distinct([lower(p_name)[i:i+2] for i in range(1, length(p_name)-1)])) END AS n FROM part")
def shingle_counts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(text.shingles(F.col("p_name"))).alias("n"))


def _signature_sql() -> str:
    mins = ", ".join(f"coalesce(min(({a}::HUGEINT*h+{b})%{text.PRIME}), {text.PRIME})::BIGINT AS m{i}" for i, (a, b) in enumerate(text.coefficients(4)))
    return f"""WITH g AS (SELECT p_partkey, unnest(list_distinct([lower(p_name)[i:i+2] for i in range(1, length(p_name)-1)])) AS t FROM part),
h AS (SELECT p_partkey, CAST('0x'||substr(md5(t), 1, 8) AS BIGINT) AS h FROM g)
SELECT p.p_partkey, {mins} FROM part p LEFT JOIN h ON p.p_partkey = h.p_partkey GROUP BY p.p_partkey"""


@query(_signature_sql())
def minhash_signature(spark, d):
    sig = text.minhash(F.transform(text.shingles(F.col("p_name")), text.token_hash), 4)
    return table(spark, d, "part").select("p_partkey", sig.alias("s")).select("p_partkey", *[F.col("s")[i].alias(f"m{i}") for i in range(4)])


@query("""SELECT s_suppkey AS id, s_suppkey AS cluster FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey + 1000000, s_suppkey FROM supplier WHERE s_suppkey % 5 = 0""")
def near_dup_clusters(spark, d):
    """Suppliers of which a fifth come twice, under another key."""
    df = table(spark, d, "supplier")
    copies = df.filter("s_suppkey % 5 = 0").withColumn("s_suppkey", F.expr("s_suppkey + 1000000"))
    return NearDuplicateDetector(threshold=0.85, key="s_suppkey").clusters(df.unionByName(copies))


@query(f"""WITH v AS ({SEG_TYPO}), f AS (SELECT seg, min(c_custkey) AS met FROM v GROUP BY seg),
g AS (SELECT upper(CASE WHEN right(seg, 1) = 'S' AND seg IN (SELECT c_mktsegment||'S' FROM customer) THEN left(seg, length(seg)-1) ELSE seg END) AS stem, seg, met FROM f WHERE seg = upper(seg)),
c AS (SELECT seg, first_value(seg) OVER (PARTITION BY stem ORDER BY met) AS canonical FROM g)
SELECT v.c_custkey, coalesce(c.canonical, v.seg) AS seg FROM v LEFT JOIN c ON v.seg = c.seg""")
def fuzzy_unify(spark, d):
    df, rule = view(spark, d, SEG_TYPO), FuzzyUnifier(threshold=90, order_by="c_custkey")
    return rule.transform(df, rule.detect(df))


@query("SELECT least(count(*), 10000) AS n FROM lineitem")
def reservoir_sample(spark, d):
    return stats.sample_rows(table(spark, d, "lineitem"), 10_000).agg(F.count(F.lit(1)).alias("n"))


@query()
def plan_decisions(spark, d):
    return DataCleaner(plugins=False).fit(table(spark, d, "events")).to_frame(spark)


@query()
def knn_rule(spark, d):
    df, rule = view(spark, d, SUPP_NULL), KnnImputer()
    return rule.transform(df, rule.detect(df))


FLAG = f"SELECT o_orderkey, CASE WHEN o_orderkey%6=0 THEN NULL WHEN o_orderkey%101=0 THEN o_totalprice*50 ELSE o_totalprice END AS total, o_orderpriority, 'x' AS constant FROM ({ORD_DUP}) AS u"


@query(f"""WITH v AS ({FLAG}), u AS (SELECT DISTINCT * FROM v), q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM v),
f AS (SELECT o_orderkey, coalesce(total, (SELECT quantile_cont(total, 0.5) FROM u)) AS total, o_orderpriority FROM u)
SELECT o_orderkey, round(CASE WHEN total < a-1.5*(b-a) THEN a-1.5*(b-a) WHEN total > b+1.5*(b-a) THEN b+1.5*(b-a) ELSE total END, 4) AS total, o_orderpriority FROM f, q""")
def clean_pipeline(spark, d):
    """Flagship: deduplicate, fill, clip and drop a constant column by one fitted plan."""
    df = view(spark, d, FLAG)
    cleaner = DataCleaner(plugins=False)
    out = cleaner.apply(df, cleaner.fit(df))
    return out.select("o_orderkey", F.round("total", 4).alias("total"), "o_orderpriority")
