"""Cross-site boilerplate: lines that many sites carry, found by merged HyperLogLog sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.frame import c
from tabloom.llm.common import BLANK, read, stage

#: A line on so many sites is boilerplate; shorter lines (in words) are left alone.
MIN_SITES, MIN_WORDS = 5, 4
#: Sketch buckets (log2). Estimates off the threshold by more than MARGIN of it, five
#: standard errors of a merged sketch, are taken; nearer lines are counted exactly.
LOG_BUCKETS, MARGIN = 10, 0.17


def long_enough(line: Column, words: int) -> Column:
    return line.rlike(f"^[{BLANK}]*([^{BLANK}]+[{BLANK}]+){{{words - 1}}}[^{BLANK}]") if words > 1 else line.rlike(f"[^{BLANK}]")


def lines_of(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """doc, mark, at, high, low, site: the 128-bit hash of each line with enough words.

    ``mark`` tells rows with the same doc_id but other texts apart.
    """
    rows = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), F.col(site).cast("string").alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("at", "line"),
    ).filter(long_enough(F.col("line"), min_words))
    return rows.select("doc", "mark", "at", F.xxhash64("line").alias("high"), F.xxhash64(F.lit("low"), "line").alias("low"), "site")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """high, low, first (the smallest doc, at) of each line found on at least ``min_sites`` sites.

    One sketch per line hash, merged by the aggregation, so a line that holds a
    third of all rows is a few thousand bytes per map task. Lines whose estimate is
    near the threshold are counted exactly, from distinct (line, site) pairs.
    """
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "at", "mark")
    sketched = lines.groupBy("high", "low").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS))).alias("sites"), F.min(place).alias("first")
    )
    # the same rows serve both branches below
    sketched = stage(sketched.filter(F.col("sites") > min_sites * (1 - MARGIN) - 1))
    sure = F.col("sites") > min_sites * (1 + MARGIN) + 1
    near = sketched.filter(~sure).select("high", "low", "first")
    exact = lines.join(near.select("high", "low"), ["high", "low"], "left_semi").select("high", "low", "site").distinct()
    counted = exact.groupBy("high", "low").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return sketched.filter(sure).select("high", "low", "first").unionByName(near.join(counted.drop("sites"), ["high", "low"]))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines, n_removed (long).

    Lines are parts between line feeds, compared as they are; a line with
    ``min_words`` words on ``min_sites`` sites stays once, where doc_id and place
    are smallest. Null texts stay null with no line; a null site is no site; rows
    with equal doc_id and text are treated alike; a null doc_id comes last. Other
    columns are kept as they are, ``n_lines`` and ``n_removed`` are replaced.
    """
    lines = stage(lines_of(docs, site, min_words))
    common = boilerplate(lines, min_sites)
    found = lines.join(common, ["high", "low"])
    kept = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("at") == F.col("first.at")) & (F.col("mark") == F.col("first.mark"))
    gone = found.filter(~kept).groupBy("doc", "mark").agg(F.collect_set("at").alias("gone_at"))
    own = [n for n in docs.columns if n not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*map(c, own)).alias("own"), F.xxhash64("text").alias("text_mark"))
    joined = rows.join(gone, F.col("own.doc_id").eqNullSafe(F.col("doc")) & (F.col("text_mark") == F.col("mark")), "left")
    parts = joined.select("own", "gone_at", F.split("own.text", "\n", -1).alias("parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone_at")
    text = F.when(F.col("gone_at").isNull(), F.col("own.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.col("parts")[i]), "\n")
    )
    out = [text.alias(n) if n == "text" else F.col("own")[n].alias(n) for n in own]
    size = F.when(F.col("own.text").isNull(), 0).otherwise(F.size("parts")).cast("long")
    removed = F.when(F.col("gone_at").isNull(), 0).otherwise(F.size("gone_at"))
    return parts.select(*out, size.alias("n_lines"), removed.cast("long").alias("n_removed"))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after the removal of lines that at least five sources carry."""
    out = remove_boilerplate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


QUERIES = {"op5_line_spread": op5_line_spread}
ORACLES = {
    "op5_line_spread": rf"""
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut
), worded AS (
  SELECT *, regexp_matches(line, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{MIN_WORDS - 1}}}[^\x20\x09-\x0D]') AS counts
  FROM lines
), common AS (
  SELECT line FROM worded WHERE counts GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT w.doc_id, w.pos, w.line, c.line IS NOT NULL
         AND row_number() OVER (PARTITION BY w.line ORDER BY w.doc_id, w.pos) > 1 AS gone
  FROM worded w LEFT JOIN common c ON w.counts AND w.line = c.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       length(k.text) AS kept_chars, md5(k.text) AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
}
