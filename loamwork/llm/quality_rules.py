"""Quality rules as weak supervision, in DataFrame functions only.

Each rule reads counts of a text and votes good (1) or bad (-1), or abstains (0).
Every kind of fault is seen by two rules or more. Documents are counted by vote
pattern, at most 3^6 * 2^5 rows whatever their number, and expectation-maximisation
over those counts estimates the share of good documents and, for each rule, how often
good and bad documents get each of its votes. A document's log odds of being good are
those of the share and, for every rule, the log ratio of the two; it is kept where
they reach the ``keep_at`` probability. No rule decides alone: a bad vote that the
other rules do not bear out is outvoted, and a rule whose votes are noise weighs
nothing.

Priors are a few counts (``PRIOR``), so that the documents decide. Without labels only
two things tell good from bad: good documents are the majority (a learned share of
less than a half counts as a half), and no vote may count against itself. EM starts
from the share's prior with every bad vote weighing its odds once, so that a document
with one bad vote starts undecided. The base rule (too short, or too much repeated)
rejects whatever the votes say.

All counts are made per row from the whole text, without a shuffle. Repeated
five-word windows are found by hash (64 bits) within the text: window hashes are
sorted with their places only where there is a repeat.

Defined results: null, empty and blank texts have no words and fail the base
rule; repeated rows count as often as they occur; an empty table gives no rows;
other columns pass through, those with this operator's names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, UPPER, materialize, read, text_or_empty, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KEEP_AT = 0.5
#: Prior counts of good and of bad documents, and of each vote (-1, 0, 1) among either.
SHARE_PRIOR = (9.0, 1.0)
PRIOR = {-1: (0.1, 1.0), 0: (1.0, 1.0), 1: (1.0, 0.5)}
ROUNDS = 40
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _removed(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur twice or more. ``w`` must be a stored column, for lambdas read it."""
    parts = [F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{i}") for i in range(WINDOW)]
    zipped = F.slice(F.arrays_zip(*parts), F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
    return F.transform(zipped, lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(WINDOW)]))


def _covered(h: Column) -> Column:
    """Words covered by the windows whose hash in array ``h`` occurs twice or more."""
    def hits(placed: Column) -> Column:
        # A sorted element repeats if a neighbour has its hash; neighbours come by zipping shifted arrays.
        none = F.array(F.lit(None).cast("struct<x:bigint,i:int>"))
        after = F.concat(F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))), none)
        zipped = F.slice(F.arrays_zip(F.concat(none, placed).alias("b"), placed.alias("p"), after.alias("a")), F.lit(1), F.size(placed))
        return F.filter(zipped, lambda z: z["p"]["x"].eqNullSafe(z["b"]["x"]) | z["p"]["x"].eqNullSafe(z["a"]["x"]))

    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    # The one-element array binds the sorted array, so that it is made once.
    hit = F.transform(F.array(placed), hits)[0]
    at = F.sort_array(F.transform(hit, lambda z: z["p"]["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(
        at, start, lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n"), i.alias("last"))
    )
    return total["n"]


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the five counts, base_failed and the helper counts the rules read (``__`` names)."""
    text = text_or_empty(F.col(text_col))
    has_word = lambda line: F.btrim(line, F.lit(SPACE)) != ""
    # Each step is one projection, and arrays that later steps read more than once are columns of it.
    out = df.withColumns({"__w": words(text), "__lines": F.filter(F.split(text, "\n"), has_word)})
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": _removed(text, SPACE).cast("long"),
            "n_symbols": (F.char_length(text) - _removed(text, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_lines": F.size("__lines"),
            "__upper": F.char_length(text) - _removed(text, UPPER),
            "__digits": F.char_length(text) - _removed(text, "0123456789"),
            "__stops": F.char_length(text) - _removed(text, ".!?"),
            "__marks": F.char_length(text) - _removed(text, PUNCTUATION),
            "__distinct": F.size(F.array_distinct("__w")),
            "__h": _repeat_words(F.col("__w")),
        }
    ).drop("__w", "__lines")
    out = out.withColumn("__repeats", F.size(F.array_distinct("__h")) < F.size("__h"))
    out = out.withColumn("n_repeat_words", F.when(F.col("__repeats"), _covered(F.col("__h"))).otherwise(0).cast("long")).drop("__h", "__repeats")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def votes() -> dict[str, Column]:
    """The rules: each a column of 1, 0 or -1 over the columns of ``counts``."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        says = F.when(bad, -1)
        return (says if good is None else says.when(good, 1)).otherwise(0)

    length, symbols, share = chars / n, F.col("n_symbols") / n, F.col("n_symbols") / chars
    repeated, dup = F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest("__n_lines", F.lit(1))
    upper, digits, stops = F.col("__upper") / chars, F.col("__digits") / chars, F.col("__stops") / n
    marks, variety = F.col("__marks") / chars, F.col("__distinct") / n
    return {
        "length": vote(n < 10, n >= 40),
        "word_length": vote((length < 2.5) | (length > 12), length.between(3, 9)),
        "symbols": vote(symbols > 0.15),
        "symbol_share": vote(share > 0.04),
        "marks": vote(marks > 0.1, marks.between(0.01, 0.06)),
        "lines": vote((dup > 0.4) & (F.col("__n_lines") >= 4)),
        "repeats": vote(repeated > 0.17, repeated < 0.02),
        "variety": vote(variety < 0.35, variety >= 0.55),
        "upper": vote(upper > 0.3),
        "digits": vote(digits > 0.15),
        "stops": vote((stops < 0.004) & (n >= 40) | (stops > 0.6), stops.between(0.02, 0.4)),
    }


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log odds of the learned share of good, and what each vote of each rule adds to them, by EM over pattern counts."""
    start = math.log(SHARE_PRIOR[0] / SHARE_PRIOR[1])
    if not patterns:
        return start, []
    rules = range(len(next(iter(patterns))))
    good = {p: 1 / (1 + math.exp(start * (p.count(-1) - 1))) for p in patterns}
    total = sum(patterns.values())
    odds, adds = start, [dict.fromkeys(PRIOR, 0.0) for _ in rules]
    for _ in range(rounds):
        all_good = sum(n * good[p] for p, n in patterns.items())
        share = max(0.5, (all_good + SHARE_PRIOR[0]) / (total + sum(SHARE_PRIOR)))
        odds = math.log(share / (1 - share))
        for r in rules:
            for vote, (prior_good, prior_bad) in PRIOR.items():
                cast = sum(n for p, n in patterns.items() if p[r] == vote)
                of_good = sum(n * good[p] for p, n in patterns.items() if p[r] == vote)
                rate_good = (of_good + prior_good) / (all_good + sum(a for a, _ in PRIOR.values()))
                rate_bad = (cast - of_good + prior_bad) / (total - all_good + sum(b for _, b in PRIOR.values()))
                ratio = math.log(rate_good / rate_bad)
                adds[r][vote] = vote * max(0.0, vote * ratio) if vote else ratio
        good = {p: 1 / (1 + math.exp(-odds - sum(adds[r][p[r]] for r in rules))) for p in patterns}
    return odds, adds


def quality_rules(df: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT, carry_text: bool = True) -> DataFrame:
    """``df`` with the counts, base_failed, quality (posterior probability) and kept.

    The counts are written once to the shared scratch folder, for the rules and the
    scores both read them; ``carry_text=False`` leaves the text out of that table and
    of the result.
    """
    own = {*COUNTS, "base_failed", "quality", "kept"}
    df = df.select(*[c for c in df.columns if c not in own and not c.startswith("__")])
    carried = [c for c in df.columns if carry_text or c != text_col]
    counted = counts(df, text_col)
    counted = materialize(counted.select(*carried, *[c for c in counted.columns if c not in df.columns]), "quality-counts")
    rules = votes()
    tally = counted.select(*[v.alias(k) for k, v in rules.items()]).groupBy(*rules).agg(F.count(F.lit(1)).alias("n"))
    patterns = {tuple(r[k] for k in rules): r["n"] for r in tally.collect()}  # at most 3^6 * 2^5 rows
    prior, adds = fit(patterns)
    odds = F.lit(prior)
    for vote, by in zip(rules.values(), adds, strict=False):
        odds = odds + F.when(vote < 0, by[-1]).when(vote > 0, by[1]).otherwise(by[0])
    scored = counted.withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 6))
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
    return scored.select(*carried, *COUNTS, "base_failed", "quality", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, carry_text=False).select("doc_id", *COUNTS, "base_failed", "kept", "quality")


_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_PUNCTUATION = PUNCTUATION.replace("'", "''")


def _less(chars: str) -> str:
    return f"length(translate(t, {chars}, ''))"


def _em_sql(names: list[str]) -> str:
    """One round of ``fit`` over the table em (round, votes, n, good)."""
    sums = ", ".join(f"sum(n * good) OVER (PARTITION BY {r}) AS g_{r}, sum(n) OVER (PARTITION BY {r}) AS n_{r}" for r in names)
    whole = [sum(p[k] for p in PRIOR.values()) for k in (0, 1)]

    def prior(r: str, k: int) -> str:
        return f"CASE {r} " + " ".join(f"WHEN {v} THEN {p[k]}" for v, p in PRIOR.items()) + " END"

    def added(r: str) -> str:
        ratio = f"ln((g_{r} + {prior(r, 0)}) / (g + {whole[0]}) / ((n_{r} - g_{r} + {prior(r, 1)}) / (total - g + {whole[1]})))"
        return f"CASE {r} WHEN 0 THEN {ratio} WHEN 1 THEN greatest(0, {ratio}) ELSE least(0, {ratio}) END"

    share = f"greatest(0.5, (g + {SHARE_PRIOR[0]}) / (total + {sum(SHARE_PRIOR)}))"
    odds = f"ln({share} / (1 - {share})) + " + " + ".join(map(added, names))
    return f"""
  SELECT round + 1, {", ".join(names)}, n, 1 / (1 + exp(-({odds})))
  FROM (SELECT *, sum(n * good) OVER () AS g, sum(n) OVER () AS total, {sums} FROM em WHERE round < {ROUNDS})"""


_RULES = [
    "length", "word_length", "symbols", "symbol_share", "marks", "lines", "repeats", "variety", "upper", "digits", "stops",
]
_BAD_VOTES = " + ".join(f"({r} < 0)::INT" for r in _RULES)

OP7_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS l FROM docs),
spans AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, h) AS times
  FROM (SELECT id, unnest(range(1, len(w) - 3)) AS i,
               unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS h FROM parts)),
covered AS (SELECT id, count(DISTINCT i + k) AS c FROM spans, (VALUES (0), (1), (2), (3), (4)) AS o(k) WHERE times > 1 GROUP BY id),
counted AS (
  SELECT p.id, doc_id, len(w)::BIGINT AS n_words, {_less(_BLANK)}::BIGINT AS word_chars,
         (length(t) - {_less(f"'{SYMBOLS}'")})::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c, 0)::BIGINT AS n_repeat_words, greatest(len(l), 1) AS lines_, length(t) - {_less(f"'{UPPER}'")} AS upper_,
         length(t) - {_less("'0123456789'")} AS digits_, length(t) - {_less("'.!?'")} AS stops_,
         length(t) - {_less(f"'{_SQL_PUNCTUATION}'")} AS marks_, len(list_distinct(w)) AS distinct_
  FROM parts p LEFT JOIN covered USING (id)),
rates AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS n_, greatest(word_chars, 1)::DOUBLE AS c_
  FROM counted),
voted AS (
  SELECT id, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CASE WHEN n_ < 10 THEN -1 WHEN n_ >= 40 THEN 1 ELSE 0 END AS length,
    CASE WHEN c_ / n_ < 2.5 OR c_ / n_ > 12 THEN -1 WHEN c_ / n_ BETWEEN 3 AND 9 THEN 1 ELSE 0 END AS word_length,
    CASE WHEN n_symbols / n_ > 0.15::DOUBLE THEN -1 ELSE 0 END AS symbols,
    CASE WHEN n_symbols / c_ > 0.04::DOUBLE THEN -1 ELSE 0 END AS symbol_share,
    CASE WHEN marks_ / c_ > 0.1::DOUBLE THEN -1 WHEN marks_ / c_ BETWEEN 0.01::DOUBLE AND 0.06::DOUBLE THEN 1 ELSE 0 END AS marks,
    CASE WHEN n_dup_lines / lines_::DOUBLE > 0.4::DOUBLE AND lines_ >= 4 THEN -1 ELSE 0 END AS lines,
    CASE WHEN n_repeat_words / n_ > 0.17::DOUBLE THEN -1 WHEN n_repeat_words / n_ < 0.02::DOUBLE THEN 1 ELSE 0 END AS repeats,
    CASE WHEN distinct_ / n_ < 0.35::DOUBLE THEN -1 WHEN distinct_ / n_ >= 0.55::DOUBLE THEN 1 ELSE 0 END AS variety,
    CASE WHEN upper_ / c_ > 0.3::DOUBLE THEN -1 ELSE 0 END AS upper,
    CASE WHEN digits_ / c_ > 0.15::DOUBLE THEN -1 ELSE 0 END AS digits,
    CASE WHEN stops_ / n_ < 0.004::DOUBLE AND n_ >= 40 OR stops_ / n_ > 0.6::DOUBLE THEN -1
         WHEN stops_ / n_ BETWEEN 0.02::DOUBLE AND 0.4::DOUBLE THEN 1 ELSE 0 END AS stops
  FROM rates),
em AS (
  SELECT 0 AS round, *, 1 / (1 + exp(ln({SHARE_PRIOR[0]} / {SHARE_PRIOR[1]}) * ({_BAD_VOTES} - 1))) AS good
  FROM (SELECT {", ".join(_RULES)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL)
  UNION ALL {_em_sql(_RULES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND round(good, 6) >= {KEEP_AT} AS kept, round(good, 6) AS quality
FROM voted JOIN em USING ({", ".join(_RULES)}) WHERE round = {ROUNDS}
"""
