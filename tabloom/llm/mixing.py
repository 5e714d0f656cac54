"""Mixing sources to target weights by Poisson replication, in Spark expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.frame import c
from tabloom.llm.common import join_small, partitions, read

SEED = 11
#: Without weights, sources are weighted by their documents to this power.
TEMPERATURE = 0.5


def unit(*parts: str | Column) -> Column:
    """A number in [0, 1) from the hash of the parts: 52 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_steps(rated: DataFrame) -> DataFrame:
    """``rated`` (keys and rate) with ``steps``: cumulative Poisson probabilities of 0, 1, 2, … copies.

    They go on until the rest is below double precision. Terms are added up in logarithms, so large
    rates do not underflow, and by windows, so the work grows with the rate and not with its square.
    """
    keys = rated.columns
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    terms = rated.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    order = Window.partitionBy(*map(c, keys)).orderBy("k")
    rate = F.greatest("rate", F.lit(1e-300))
    terms = terms.withColumn("log", F.sum(F.when(F.col("k") == 0, -rate).otherwise(F.log(rate / F.col("k")))).over(order))
    terms = terms.withColumn("sum", F.sum(F.exp("log")).over(order))
    listed = terms.groupBy(*map(c, keys)).agg(F.array_sort(F.collect_list(F.struct("k", "sum"))).alias("listed"))
    return listed.select(*map(c, keys), F.transform("listed", lambda x: x["sum"]).alias("steps"))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | Column | None, size: float, by: Sequence[str] = ("source",)) -> DataFrame:
    """of0, of1, …, rate, steps: mean copies of a document of each group, so that the groups get their weights.

    ``size`` is the expected number of documents that come out, as a multiple of those that go in.
    """
    counts = docs.groupBy(*[c(b) for b in by]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(TEMPERATURE))
    elif isinstance(weights, Column):
        weight = F.coalesce(weights.cast("double"), F.lit(0.0))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(F.try_element_at(given, c(by[0])), F.lit(0.0))
    weighted = counts.select(*[c(b).alias(f"of{i}") for i, b in enumerate(by)], "n", weight.alias("weight"))
    sums = weighted.agg(F.sum("weight").alias("all_weights"), F.sum("n").alias("all_n")).first()
    rate = F.col("weight") / F.lit(sums.all_weights) * F.lit(sums.all_n) * F.lit(float(size)) / F.col("n")
    rate = F.when(F.col("weight") > 0, rate).otherwise(0.0)
    return with_steps(weighted.select(*[f"of{i}" for i in range(len(by))], rate.alias("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | Column | None = None, size: float = 1.0, seed: int = SEED, by: Sequence[str] = ("source",)) -> DataFrame:
    """Documents repeated to target weights and shuffled globally, with copy, copies int and shuffle_key long.

    The number of copies is the inverse Poisson distribution at a number in [0, 1)
    hashed from seed and doc_id, so a document always gets the same number,
    wherever it is read. Keys hashed from seed, doc_id and copy order the result:
    partitions hold ranges of the key and are sorted. Groups are documents of one source, or of equal
    columns ``by``. ``weights`` maps sources to relative weights (missing: 0; null sources have none),
    or is an expression of the columns ``by`` and the group's documents ``n`` (null: 0); without it,
    a group weighs the square root of its documents. Rows with equal doc_id are drawn
    alike; rows without doc_id are drawn and ordered by their text, so only equal
    texts are alike there, and without text as the word ``null``. Columns
    named copy, copies or shuffle_key are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    rates = repetition_rates(docs, weights, size, by)
    own = [n for n in docs.columns if n not in ("copy", "copies", "shuffle_key")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5("text")), F.lit("null"))
    rows = docs.select(F.struct(*map(c, own)).alias("own"), name.alias("name_"))
    rows = rows.withColumn("draw", unit(F.lit(str(seed)), "name_"))
    same = reduce(and_, [F.col("own")[b].eqNullSafe(F.col(f"of{i}")) for i, b in enumerate(by)])
    rated = join_small(rows, rates, same, F.col("name_"))
    copies = F.when(F.col("rate") > 0, F.size(F.filter("steps", lambda p: p <= F.col("draw")))).otherwise(0)
    counted = rated.select("own", "name_", copies.alias("copies")).filter(F.col("copies") > 0)
    out = counted.select("own", "name_", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "copies")
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "name_", "copy")), 1, 15), 16, 10).cast("long")
    out = out.select(*[F.col("own")[n].alias(n) for n in own], "copy", "copies", key.alias("shuffle_key"))
    # keys are uniform, so the ranges are known without sampling the rows
    count = partitions(spark)
    place = F.floor(F.col("shuffle_key") / float(1 << 60) * count).cast("int")
    return out.repartitionById(count, place).sortWithinPartitions("shuffle_key", "doc_id", "copy")


#: Fixed values of the query's target weights: what a group counts for, by a hash of its source and language.
FACTORS = (0.0, 0.2, 1.0, 4.0)


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source and language to four kinds of target weights: none, a fifth, as they are, fourfold."""
    name = F.concat_ws(":", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    number = F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("int") % len(FACTORS)
    weights = F.col("n") * F.get(F.array(*[F.lit(f) for f in FACTORS]), number)
    out = mix(read(spark, sf_dir, "documents"), weights, by=("source", "lang"))
    return out.select("doc_id", "source", "lang", "copy", "copies", "shuffle_key", F.md5("text").alias("text_md5"))


def _poisson_sql() -> str:
    return f"""
WITH n AS (SELECT source, lang, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source, lang),
w AS (SELECT *, n * [{', '.join(f'{f}e0' for f in FACTORS)}][
        1 + CAST('0x' || substr(md5(coalesce(source, '') || ':' || coalesce(lang, '')), 1, 4) AS INTEGER) % {len(FACTORS)}] AS weight FROM n),
r AS (SELECT source, lang, weight / (SELECT sum(weight) FROM w) * (SELECT sum(n) FROM w) / n AS rate FROM w WHERE weight > 0),
terms AS (
  SELECT source, lang, rate, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END) OVER (PARTITION BY source, lang ORDER BY k) AS log
  FROM (SELECT *, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r)
), steps AS (SELECT source, lang, k, sum(exp(log)) OVER (PARTITION BY source, lang ORDER BY k) AS c FROM terms),
lists AS (SELECT source, lang, list(c ORDER BY k) AS steps FROM steps GROUP BY source, lang),
drawn AS (
  SELECT doc_id, d.source, d.lang, text, l.steps,
         CAST(CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}.0 AS u
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source AND d.lang IS NOT DISTINCT FROM l.lang
), counted AS (SELECT doc_id, source, lang, text, CAST(len(list_filter(steps, lambda c: c <= u)) AS INTEGER) AS copies FROM drawn),
copied AS (SELECT *, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM counted WHERE copies > 0)
SELECT doc_id, source, lang, copy, copies,
       CAST('0x' || substr(md5('order{SEED}:' || doc_id || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key, md5(text) AS text_md5
FROM copied
"""


QUERIES = {"op8_poisson_mixing": op8_poisson_mixing}
ORACLES = {"op8_poisson_mixing": _poisson_sql()}
