"""Mixing sources to target weights with soft domain membership, native throughout.

A classifier fitted on the labels table (hashed words, and multinomial logistic
regression of Spark's own ML library, all in the JVM) predicts for every document the
probability of each domain: clean prose, low quality, toxic. Then a nonnegative rate
is fitted for every document so that the expected domain token totals, the sum of
rate x tokens x posterior, meet the targets: least squares with a pull of every rate
to 1, by projected gradient. A step is one aggregate of three numbers over a narrow
table of posteriors and tokens. A document's rate depends on its posterior and the
three errors of each step only, so it is a fold over those errors, a column
expression beside the document: no join brings rates and texts together. Rates are
realised as whole copies, floor(rate + u) with u uniform from the document's hash,
whose expectation is the rate.

The targets are weights of the three domains; the scale is set so that clean prose
keeps its tokens (its rates come to about 1) and the others are brought to their
weights: down where they have more, and up, by rates above 1, where they have less.
Achieved shares are compared with the wanted ones, and a miss (a domain without any
tokens cannot be filled) is logged as a warning. The classifier is fitted on at most
``sample`` labelled documents in hash order (a documented bound), with the features
that ``MIN_SHARE`` of them have; a feature goes by its 64-bit name, so that other words
that share its place have no weight. Tokens are the runs of characters other than white
space and ``.,;:?!``; the classifier also splits runs of symbols off its words, and
runs of symbols and punctuation are features of their own.

Defined results: null and empty texts have no tokens and get the fitted rate all
the same; null doc_ids hash by their text; without labelled rows posteriors are
uniform, with labels of one domain or without any word they are the domains' shares of the labels; labels with
nulls are left out; of documents with one doc_id and several labels or texts each label
counts once, with the least text; repeated rows get equal rates; an empty table gives
no rows; clashing names are replaced, and carried columns are a struct of their own.
"""

from __future__ import annotations

import logging

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import heap_watched
from .common import materialize, read, text_or_empty

DOMAINS = ["clean", "low", "toxic"]
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
SAMPLE = 20_000
WIDTH = 1 << 17
#: Features of fewer of the labelled documents than this share are left out.
MIN_SHARE = 0.003
STEM = 5
#: White space is listed sign by sign: a class without ranges is one table look-up in the regular expression engine.
SEPARATORS = r"[\x20\t\n\x0B\f\r.,;:?!]+"
WORDS_AND_RUNS = r"[^\x20\t\n\x0B\f\r.,;:?!#*$%&|<>]+|[#*$%&|<>.,;:?!]+"
STEPS = 32
STEPS_A_TABLE = 8
PULL = 0.001
#: A warning is given where a domain's achieved share is this far from the wanted one.
MISS = 0.005

log = logging.getLogger(__name__)


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, 2).when(quality > 0, 0).otherwise(1).cast("double")


def n_tokens(text: Column) -> Column:
    """The number of runs of characters other than white space and sentence punctuation."""
    parts = F.split(text_or_empty(text), SEPARATORS)
    empty_ends = [(F.element_at(parts, end) == "").cast("int") for end in (1, -1)]
    return F.greatest(F.lit(0), F.size(parts) - empty_ends[0] - empty_ends[1]).cast("long")


def features(text: Column) -> Column:
    """Distinct folded words, cut at runs of symbols too, and the distinct runs of symbols and punctuation of the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(WORDS_AND_RUNS), F.lit(0)))


def names_of(distinct: Column) -> Column:
    """Distinct 64-bit names of distinct words and of their beginnings."""
    stems = F.transform(distinct, lambda w: F.xxhash64(F.substring(w, 1, STEM), F.lit(STEM)))
    return F.array_distinct(F.concat(F.transform(distinct, lambda w: F.xxhash64(w)), stems))


def place(name: Column) -> Column:
    """Where a feature's name and weights stand, if it has any: the name's last bits, as ``WIDTH`` is a power of two."""
    return name.bitwiseAND(F.lit(WIDTH - 1)).cast("int")


def _softmax(names: Column, model: dict, counted: DataFrame) -> DataFrame:
    """``counted`` with array ``posterior``; a domain's score against the first domain is the sum of the weights of the features that have any.

    The arrays of names and weights have ``WIDTH`` elements whatever the input; they are the row of a table and reach tasks as scalar subqueries.
    Each is used in one place, so that the optimizer puts the subquery there and no row carries a copy of the arrays.
    """
    others = sorted(model["scores"])
    columns = [model["names"], *(model["scores"][k][1] for k in others)]
    fields = ["names", *(f"w{k}" for k in others)]
    schema = "names array<long>, " + ", ".join(f"{f} array<double>" for f in fields[1:])
    table = materialize(counted.sparkSession.createDataFrame([tuple(columns)], schema), "weights")
    known = counted.withColumns({f"__at_{f}": table.select(f).scalar() for f in fields})
    hits = F.transform(F.filter(names, lambda x: F.get(F.col("__at_names"), place(x)) == x), place)
    starts = F.struct(*[F.lit(model["scores"][k][0]).alias(f"s{k}") for k in others])
    sums = F.aggregate(hits, starts, lambda acc, i: F.struct(*[(acc[f"s{k}"] + F.get(F.col(f"__at_w{k}"), i)).alias(f"s{k}") for k in others]))
    known = known.select(*counted.columns, sums.alias("__sums"))
    exps = {model["first"]: F.lit(1.0)}
    for k in others:
        exps[k] = F.exp(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), F.col(f"__sums.s{k}"))))
    known = known.select(*counted.columns, *[v.alias(f"__e{k}") for k, v in exps.items()])
    whole = sum((F.col(f"__e{k}") for k in others), F.col(f"__e{model['first']}"))
    posterior = F.array(*[F.col(f"__e{d}") / whole if d in exps else F.lit(0.0) for d in range(len(DOMAINS))])
    return known.withColumn("posterior", posterior).drop(*[f"__e{k}" for k in exps])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> dict:
    """The classifier: shares of the domains among the labelled documents; names of its features by place; intercept and weights of each domain but the first."""
    good = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    picked = good.select(F.col("doc_id").alias("__label_id"), domain(F.col("quality"), F.col("toxic")).alias("label")).distinct()
    picked = picked.orderBy(F.xxhash64("__label_id"), "__label_id", "label").limit(sample)
    # At most ``sample`` rows of two numbers are broadcast, so that texts don't shuffle.
    labelled = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .join(F.broadcast(picked), F.col("__id") == F.col("__label_id"))
        .groupBy("__id", "label")
        .agg(F.min("__text").alias("__text"))
    )
    table = labelled.withColumn("__words", features(F.col("__text"))).select("label", names_of(F.col("__words")).alias("__names"))
    table = materialize(table, "labelled")
    counts = {int(r["label"]): r["n"] for r in table.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most three rows
    n, present = sum(counts.values()), sorted(counts)
    model = {"shares": [counts.get(d, 0) / n if n else 1 / len(DOMAINS) for d in range(len(DOMAINS))], "first": None, "scores": {}}
    often = table.select(F.explode("__names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SHARE * n)
    # A place has one feature, the most frequent of those that fall there: at most ``WIDTH`` rows.
    kept = often.groupBy(place(F.col("name")).alias("place")).agg(F.max(F.struct("n", "name")).alias("top")).select("place", "top.name")
    vocabulary = [(r["place"], r["name"]) for r in kept.orderBy("place").collect()]
    if len(present) < 2 or not vocabulary:
        return model
    counter = CountVectorizerModel.from_vocabulary([str(x) for _, x in vocabulary], inputCol="__names", outputCol="__features").setBinary(True)
    strings = table.withColumn("__names", F.transform("__names", lambda x: x.cast("string")))
    # At most ``sample`` rows: read as one partition, an evaluation is one task, not three stages that shuffle gradients and fill the driver's heap.
    vectors = materialize(counter.transform(strings).select("label", "__features"), "vectors").coalesce(1)
    with heap_watched(docs.sparkSession):  # an iteration is a job or more, and none writes a table
        fitted = LogisticRegression(
            featuresCol="__features", labelCol="label", family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=80,
        ).fit(vectors)
    matrix, intercepts, first = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), present[0]
    model |= {"first": first, "names": [0] * WIDTH}
    for k in present[1:]:
        weights = [0.0] * WIDTH
        for (at, _), weight in zip(vocabulary, (matrix[k] - matrix[first]).tolist(), strict=True):
            weights[at] = weight
        model["scores"][k] = (float(intercepts[k] - intercepts[first]), weights)
    for at, name in vocabulary:
        # A feature without weight, as most are in a sparse regression, adds nothing and need not be found.
        if any(weights[at] for _, weights in model["scores"].values()):
            model["names"][at] = name
    return model


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the text, with array ``posterior`` by domain and ``n_tokens`` (words)."""
    model = train(docs, labels, sample, text_col, id_col)
    counted = docs.withColumns({"n_tokens": n_tokens(F.col(text_col)), "__words": features(F.col(text_col))}).drop(text_col)
    if model["first"] is None:
        return counted.drop("__words").withColumn("posterior", F.array(*map(F.lit, model["shares"])))
    counted = counted.withColumn("__names", names_of(F.col("__words"))).drop("__words")
    return _softmax(F.col("__names"), model, counted).drop("__names")


def stepped(rate: Column, errors: list[Column]) -> Column:
    """The rate after one projected gradient step."""
    slope = sum((e * F.col(f"p{d}") for d, e in enumerate(errors)), PULL * (rate - 1))
    return F.greatest(F.lit(0.0), rate - slope / (1 + PULL))


def rated(table: DataFrame, steps: list[list[float]]) -> DataFrame:
    """``table`` with column ``rate``: all steps, folded over the errors (p0, p1, p2) of each."""
    if not steps:
        return table.withColumn("rate", F.lit(1.0))
    errors = F.array(*[F.array(*map(F.lit, e)) for e in steps])
    rate = F.aggregate(errors, F.lit(1.0), lambda r, e: stepped(r, [e[d] for d in range(len(DOMAINS))]))
    return table.withColumn("rate", rate)


def fit_rates(table: DataFrame, targets: dict[str, float], steps: int = STEPS) -> tuple[list[list[float]], dict[str, float]]:
    """The errors of each step over ``table`` (n_tokens, p0..p2), for ``rated``; the achieved share of the tokens, by domain.

    Minimises sum_d ((sum_i r_i n_i p_id - T_d) / S)^2 / (2 q_d) + PULL / 2 * sum_i (n_i / S) (r_i - 1)^2
    over r >= 0, with S all tokens and q_d the share of the domain. The gradient is
    divided by n_i / S; by that and the q_d its Lipschitz constant is 1 + PULL, so
    that one step size fits all rows and small domains move as fast as large ones.
    """
    k = range(len(DOMAINS))
    sums = [F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p{d}")).alias(f"s{d}") for d in k]
    table = table.select("n_tokens", *[f"p{d}" for d in k]).withColumn("rate", F.lit(1.0))
    now = table.agg(*sums, F.sum("n_tokens").alias("all")).first()
    total, taken = float(now["all"] or 0), []
    if not total:
        return taken, dict.fromkeys(DOMAINS, 0.0)
    share = [max((now[f"s{d}"] or 0.0) / total, 1e-6) for d in k]
    # Without clean tokens, or a weight for them, all tokens are kept.
    scale = now["s0"] / targets[DOMAINS[0]] if now["s0"] and targets[DOMAINS[0]] else total / sum(targets.values())
    goal = [scale * targets[name] for name in DOMAINS]
    for step in range(steps):
        taken.append([(now[f"s{d}"] - goal[d]) / (total * share[d]) for d in k])
        table = table.withColumn("rate", stepped(F.col("rate"), [F.lit(e) for e in taken[-1]]))
        if step % STEPS_A_TABLE == STEPS_A_TABLE - 1:
            table = materialize(table, "rates")
        now = table.agg(*sums).first()
        if max(abs(now[f"s{d}"] - goal[d]) for d in k) <= 1e-9 * total:
            break
    kept, whole = sum(now[f"s{d}"] or 0.0 for d in k), sum(targets.values())
    shares = {name: (now[f"s{d}"] or 0.0) / kept if kept else 0.0 for d, name in enumerate(DOMAINS)}
    missed = {name: (round(shares[name], 4), targets[name] / whole) for name in DOMAINS if abs(shares[name] - targets[name] / whole) > MISS}
    if missed:
        log.warning("mixing misses its weights (achieved, wanted): %s", missed)
    return taken, shares


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", id_col: str = "doc_id",
    carry: list[str] | None = None,
) -> DataFrame:
    """doc_id, mark (a hash of the text), n_tokens, p0..p2, rate and copies of every row of ``docs``, and struct ``carried`` of the columns ``carry``."""
    more = [F.struct(*carry).alias("carried")] if carry else []
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"), *more)
    table = posteriors(picked, labels).select(
        "doc_id", "mark", "n_tokens",
        *[F.col("posterior")[d].alias(f"p{d}") for d in range(len(DOMAINS))], *["carried"] * bool(carry),
    )
    table = materialize(table, "posteriors")
    steps, _ = fit_rates(table, targets or TARGETS)
    uniform = F.pmod(F.xxhash64(F.coalesce("doc_id", "mark"), F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    return rated(table, steps).withColumn("copies", F.floor(F.col("rate") + uniform).cast("int"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")
