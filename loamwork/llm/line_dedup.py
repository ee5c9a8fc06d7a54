"""Line dedup: overlapping three-line windows, in DataFrame functions only.

Lines that hold more than white space are numbered within their document (a
blank line belongs to the line before it) and trimmed. Each three consecutive
lines are a window. A window met more than once in all documents keeps its first
occurrence, by (doc_id, position), nulls first; the lines of later occurrences
are removed. The positions that overlapping windows cover are merged to ranges,
and the text is put together from the stretches between them. Of every line that
is removed an equal line stays at an earlier place.

Windows are compared by two 64-bit hashes (128 bits). Counts are pre-aggregated
before they shuffle; repeated windows, a small table, are written once and joined
with the windows on plain exchanges, so that Spark splits a very common window.
The text shuffles once, in the join by document; both are merge joins at every size.

Defined results: a null text stays null and an empty one empty; texts of fewer
than three such lines are never changed; a document without removed lines is
returned byte for byte; one that loses all its lines keeps its row with an empty
text. Rows equal in doc_id and text count as one document and share its fate. An
empty table gives no rows; other columns pass through unchanged, so that
``n_chars`` is set anew only where a caller does it. Columns of the caller that
are named like this operator's own (n_lines, n_removed) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

WINDOW = 3
BLANK = " \t\r\f\x0b"
#: A newline before a line with something in it; blank lines stay with the line before.
CUT = r"\n(?=[ \t\r\f\x0B]*[^ \t\r\n\f\x0B])"


def segments(text: Column) -> Column:
    """The text cut so that each element has one non-blank line, the blank ones after it included."""
    return F.split(text, CUT)


def _trimmed(segs: Column) -> Column:
    return F.transform(segs, lambda s: F.btrim(s, F.lit(BLANK + "\n")))


def _windows(docs: DataFrame) -> DataFrame:
    """(id, mark, at, w1, w2) of every window of the table (id, mark, segs)."""
    lines = docs.select("__id", "__mark", _trimmed(F.col("__segs")).alias("__l"))
    later = [F.slice("__l", i + 1, F.greatest(F.size("__l"), F.lit(1))).alias(f"l{i}") for i in range(1, WINDOW)]
    zipped = F.arrays_zip(F.col("__l").alias("l0"), *later)

    def hashed(z: Column) -> Column:
        parts = [z[f"l{i}"] for i in range(WINDOW)]
        whole = parts[-1].isNotNull() & (parts[0] != "")
        return F.when(whole, F.struct(F.xxhash64(*parts).alias("w1"), F.xxhash64(F.lit(7), *parts).alias("w2")))

    rows = lines.filter(F.size("__l") >= WINDOW).select("__id", "__mark", F.posexplode(F.transform(zipped, hashed)).alias("at", "w"))
    return rows.filter("w is not null").select("__id", "__mark", "at", "w.w1", "w.w2")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text deduplicated, and n_lines and n_removed."""
    df = df.select(*[c for c in df.columns if c not in ("n_lines", "n_removed", "__id", "__mark", "__segs")])
    keyed = df.withColumns({"__id": F.col(id_col), "__mark": F.xxhash64(text_col), "__segs": segments(F.col(text_col))})
    windows = _windows(keyed.select("__id", "__mark", "__segs"))
    repeats = materialize(
        windows.groupBy("w1", "w2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__id", "__mark", "at")).alias("first"))
        .filter("n > 1")
        .select("w1", "w2", "first"),
        "repeated-windows",
    )
    met = windows.join(repeats.hint("merge"), ["w1", "w2"]).filter(~F.struct("__id", "__mark", "at").eqNullSafe(F.col("first")))
    starts = met.groupBy(F.col("__id").alias("__i"), F.col("__mark").alias("__m")).agg(F.sort_array(F.collect_set("at")).alias("__s"))
    starts = materialize(starts, "covered")

    joined = keyed.drop(text_col).join(starts.hint("merge"), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__mark") == F.col("__m")), "left")
    s, segs = F.col("__s"), F.col("__segs")
    # Overlapping and touching windows merge: a range begins where no window covers the line before.
    begins = F.filter(s, lambda x, i: (i == 0) | (x > F.get(s, i - 1) + WINDOW))
    ends = F.transform(F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > x + WINDOW)), lambda x: x + WINDOW)
    between = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(begins, F.array(F.size(segs))).alias("b"))
    left = F.flatten(F.transform(between, lambda g: F.slice(segs, g["a"] + 1, g["b"] - g["a"])))
    blank_first = F.when(F.btrim(F.get(segs, F.lit(0)), F.lit(BLANK + "\n")) == "", 1).otherwise(0)
    joined = joined.withColumn("__left", F.when(s.isNull(), segs).otherwise(left))
    return joined.select(
        *[F.array_join("__left", "\n").alias(text_col) if c == text_col else F.col(c) for c in df.columns],
        F.when(segs.isNull(), 0).otherwise(F.size(segs) - blank_first).cast("long").alias("n_lines"),
        F.when(segs.isNull(), 0).otherwise(F.size(segs) - F.size("__left")).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


_ENDS = "chr(32) || chr(9) || chr(13) || chr(12) || chr(11)"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, trim(line, {_ENDS}) AS norm, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
placed AS (
  SELECT *, count(*) FILTER (norm <> '') OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM lines),
solid AS (
  SELECT doc_id, seg, norm AS l0, lead(norm) OVER w AS l1, lead(norm, 2) OVER w AS l2
  FROM placed WHERE norm <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY seg)),
later AS (
  SELECT doc_id, seg FROM (
    SELECT doc_id, seg, rank() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id NULLS FIRST, seg) AS r FROM solid WHERE l2 IS NOT NULL)
  WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, seg + k AS seg FROM later, (VALUES (0), (1), (2)) AS t(k)),
joined AS (
  SELECT p.*, c.seg IS NOT NULL AS gone FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.seg = c.seg),
texts AS (
  SELECT doc_id, count(*) FILTER (norm <> '') AS n_lines, count(*) FILTER (gone AND norm <> '') AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM joined GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""
