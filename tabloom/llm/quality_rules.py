"""Quality rules: base statistics of whole texts, and robust multivariate outliers, in Spark expressions only.

Statistic vectors get a minimum covariance determinant (MCD) estimate per language
and source: from medians and absolute deviations, concentration steps keep the h
nearest vectors of a group and take their mean and covariance until nothing
changes (Rousseeuw and Van Driessen 1999). A document is rejected by its
Mahalanobis distance. Vectors are integers of 1/UNIT and their sums are exact, so
results do not depend on partitions or the order of rows.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import BLANK, join_small, read, stage

MIN_GROUP = 100  # rows of a source in a language that get an own estimate; smaller ones share one
SHARE = 0.75  # of a group's rows in the subset
STEPS = 10  # concentration steps at most
SETTLED = 0.02  # change of the logarithm of the determinant that a last step may bring without a warning
UNIT = 1024
BINS_PER_UNIT, LAST_BIN = 100, 5000  # of the distance, to find the subset without a sort
#: Statistics and the standard deviation below which differences do not matter.
FLOORS = {"x1": 0.10, "x2": 0.045, "x3": 0.20, "x4": 0.17}
XS = list(FLOORS)
PAIRS = [(a, b) for i, a in enumerate(XS) for b in XS[: i + 1]]


def chi_square(x: float, even: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def chi_square_quantile(share: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if chi_square((low + high) / 2, even) > share else ((low + high) / 2, high)
    return low


#: Makes the covariance of the nearest SHARE of a normal sample that of all of it.
CONSISTENCY = SHARE / chi_square(chi_square_quantile(SHARE, len(XS)), len(XS) + 2)
CUTOFF = 30.0  # squared distance; chi-square with 4 degrees exceeds it once in 200,000 draws


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts.

    Windows of three words are compared by 64-bit hashes within a text: sorted with
    their places, equal neighbours are repeats, and what the windows at those
    places cover is added up from the sorted places. No step is quadratic in a text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    words = F.regexp_extract_all("text", F.lit(f"([^{BLANK}]+)"), F.lit(1))
    counted = rows.select(
        "doc_id", "lang", "source",
        F.length(F.translate("text", "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
    )
    h = F.col("hashes")
    windows = F.when(
        F.size(h) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - 3),
            lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<k:bigint,i:int>>"))
    sorted_ = counted.select(
        "doc_id", "lang", "source", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("windows"),
    )
    w = F.col("windows")
    same = F.filter(w, lambda x, j: (x["k"] == F.get(w, j - 1)["k"]) | (x["k"] == F.get(w, j + 1)["k"]))
    places = sorted_.select("*", F.sort_array(F.transform(same, lambda x: x["i"])).alias("places")).drop("windows")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    return places.select("*", covered.alias("n_repeat_words")).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Transformed statistics, for Spark and for the check in SQL: mean word length, and the
#: roots of the shares of symbols, repeated lines and repeated words.
VECTOR = {
    "x1": "ln(1.0e0 + CAST(word_chars AS DOUBLE) / n_words)",
    "x2": "sqrt(CAST(n_symbols AS DOUBLE) / word_chars)",
    "x3": "sqrt(CAST(n_dup_lines AS DOUBLE) / n_lines)",
    "x4": "sqrt(CAST(n_repeat_words AS DOUBLE) / n_words)",
}


def vector_sql(x: str) -> str:
    return f"CAST(floor({VECTOR[x]} * {UNIT}) AS BIGINT) AS {x}"


def scatter_sql() -> list[str]:
    """Location and scatter of the subset from its exact sums: mean of each statistic, entries s_ab."""
    entries = []
    for a, b in PAIRS:
        product = f"CAST(t_{a}{b} AS DOUBLE) / n - CAST(t_{a} AS DOUBLE) / n * (CAST(t_{b} AS DOUBLE) / n)"
        floor = f" + {float((FLOORS[a] * UNIT) ** 2)!r}e0" if a == b else ""
        entries.append(f"({product}) * {CONSISTENCY!r}e0{floor} AS s_{a}{b}")
    return [f"CAST(t_{a} AS DOUBLE) / n AS m_{a}" for a in XS] + entries


def factor_sql() -> list[list[str]]:
    """The Cholesky factor, in layers of columns l_ab that use earlier layers only."""
    layers: list[list[str]] = []
    for j, b in enumerate(XS):
        inner = "".join(f" - l_{b}{k} * l_{b}{k}" for k in XS[:j])
        layers.append([f"sqrt(s_{b}{b}{inner}) AS l_{b}{b}"])
        below = []
        for a in XS[j + 1 :]:
            inner = "".join(f" - l_{a}{k} * l_{b}{k}" for k in XS[:j])
            below.append(f"(s_{a}{b}{inner}) / l_{b}{b} AS l_{a}{b}")
        if below:
            layers.append(below)
    return layers


def distance_sql() -> list[str]:
    """Layers z_a of the forward substitution; their squares add up to the squared distance."""
    out = []
    for i, a in enumerate(XS):
        inner = "".join(f" - l_{a}{b} * z_{b}" for b in XS[:i])
        out.append(f"(CAST({a} AS DOUBLE) - m_{a}{inner}) / l_{a}{a} AS z_{a}")
    return out


DISTANCE = " + ".join(f"z_{a} * z_{a}" for a in XS)
FACTORS = [f"l_{a}{b}" for a, b in PAIRS]


def with_layers(df: DataFrame, layers: list[list[str]]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *layer)
    return df


def estimated(scatter: DataFrame) -> DataFrame:
    return with_layers(scatter, factor_sql()).select("g", *[f"m_{a}" for a in XS], *FACTORS)


def grouped(vectors: DataFrame) -> DataFrame:
    """``vectors`` with g: language and source, the language's small sources, or all small languages."""
    named = vectors.withColumns({"of_lang": F.coalesce("lang", F.lit("")), "of_source": F.coalesce("source", F.lit(""))})
    sizes = named.groupBy("of_lang", "of_source").agg(F.count(F.lit(1)).alias("size"))
    small = sizes.filter(F.col("size") < MIN_GROUP).groupBy("of_lang").agg(F.sum("size").alias("rest"))
    level = (
        F.when(F.col("size") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("2"), "of_lang", "of_source"))
        .when(F.col("rest") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("1"), "of_lang"))
        .otherwise(F.lit("0"))
    )
    names = sizes.join(small, "of_lang", "left").select(
        F.col("of_lang").alias("key_lang"), F.col("of_source").alias("key_source"), level.alias("g")
    )
    same = (F.col("of_lang") == F.col("key_lang")) & (F.col("of_source") == F.col("key_source"))
    return join_small(named, stage(names), same, F.col("doc_id")).drop("of_lang", "of_source", "key_lang", "key_source")


def first_estimate(rows: DataFrame) -> DataFrame:
    """Medians and absolute deviations; the statistics are small integers, so exact percentiles stay small."""
    medians = stage(rows.groupBy("g").agg(*[F.percentile(x, F.lit(0.5)).alias(f"m_{x}") for x in XS]))
    aside = join_small(rows, medians.withColumnRenamed("g", "of"), F.col("g") == F.col("of"), F.col("doc_id"))
    spread = aside.groupBy("g").agg(
        *[F.first(f"m_{x}").alias(f"m_{x}") for x in XS],
        *[F.percentile(F.abs(F.col(x) - F.col(f"m_{x}")), F.lit(0.5)).alias(f"d_{x}") for x in XS],
    )
    return estimated(spread.selectExpr("g", *[f"m_{x}" for x in XS], *start_sql()))


def start_sql() -> list[str]:
    return [
        f"(d_{a} * 1.4826e0) * (d_{a} * 1.4826e0) + {float((FLOORS[a] * UNIT) ** 2)!r}e0 AS s_{a}{b}" if a == b else f"0.0e0 AS s_{a}{b}"
        for a, b in PAIRS
    ]


def distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance in their group."""
    near = join_small(rows, estimate.withColumnRenamed("g", "of"), F.col("g") == F.col("of"), F.col("doc_id"))
    return with_layers(near, [[z] for z in distance_sql()]).selectExpr(*rows.columns, f"{DISTANCE} AS d2")


SUMS = [f"t_{a}" for a in XS] + [f"t_{a}{b}" for a, b in PAIRS]


def subset_sums(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """g, n and exact sums of the nearest SHARE of each group.

    Rows are added up per group and bin of the distance before the shuffle; the
    subset ends with the bin in which it is reached.
    """
    placed = distances(rows, estimate).selectExpr(*rows.columns, f"CAST(least({LAST_BIN}, floor(sqrt(d2) * {BINS_PER_UNIT})) AS INT) AS bin")
    sums = [F.sum(F.col(a).cast("decimal(20,0)")).alias(f"t_{a}") for a in XS]
    sums += [F.sum((F.col(a) * F.col(b)).cast("decimal(20,0)")).alias(f"t_{a}{b}") for a, b in PAIRS]
    binned = placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    ranked = binned.selectExpr(
        "*", "sum(n) OVER (PARTITION BY g ORDER BY bin) - n AS before", "sum(n) OVER (PARTITION BY g) AS size"
    ).filter(f"before < ceil({SHARE} * size)")
    return ranked.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in SUMS])


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """g, location and Cholesky factor of each group's subset, after steps that change no more."""
    estimate = stage(first_estimate(rows))
    sums = None
    for _ in range(steps):
        last, earlier, sums = sums, estimate, stage(subset_sums(rows, estimate))
        estimate = stage(estimated(sums.selectExpr("g", *scatter_sql())))
        if last is not None and not sums.exceptAll(last).take(1):
            return estimate
    before, after = (e.selectExpr("g", f"2 * ({' + '.join(f'ln(l_{a}{a})' for a in XS)}) AS det") for e in (earlier, estimate))
    change = before.join(after.withColumnRenamed("det", "new"), "g").agg(F.max(F.abs(F.col("new") - F.col("det"))).alias("c")).first().c
    if change is not None and change > SETTLED:
        warnings.warn(f"log determinants still changed by {change:.3g} after {steps} concentration steps", stacklevel=2)
    return estimate


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The base statistics of each document, base_failed, kept and d2.

    ``docs`` has doc_id, text, lang, source. Base rules fail texts of few or mostly
    repeated words; estimates are made from the others and reject those with
    squared distance over ``cutoff``. A null or empty text has no words and fails; null lang
    and source are the empty text; repeated rows each count; an empty table gives
    no rows; further columns are ignored.
    """
    table = stage(base_statistics(docs).withColumn("base_failed", base_failed()))
    vectors = table.filter(~F.col("base_failed")).selectExpr("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *map(vector_sql, XS))
    rows = stage(grouped(vectors))
    passed = distances(rows, robust_estimates(rows)) if rows.take(1) else rows.withColumn("d2", F.lit(None).cast("double"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = table.filter("base_failed").select(*names, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"))
    judged = passed.select(*names, F.lit(False).alias("base_failed"), (F.col("d2") <= cutoff).alias("kept"), "d2")
    return failed.unionByName(judged)


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict on every document."""
    return quality_rules(read(spark, sf_dir, "documents")).drop("d2")


def _sql() -> str:
    """The same estimates unrolled; steps after the last change repeat it."""
    x_list = ", ".join(XS)

    def chain(step: int, scatter: str) -> str:
        out, inner = f", sc_{step} AS MATERIALIZED ({scatter})", f"sc_{step}"
        for k, layer in enumerate(factor_sql()):
            out += f", f_{step}_{k} AS MATERIALIZED (SELECT *, {', '.join(layer)} FROM {inner})"
            inner = f"f_{step}_{k}"
        zs, z_inner = "", f"(SELECT v.*, e.* EXCLUDE (g) FROM v JOIN {inner} e USING (g))"
        for k, z in enumerate(distance_sql()):
            zs += f", z_{step}_{k} AS MATERIALIZED (SELECT *, {z} FROM {z_inner})"
            z_inner = f"z_{step}_{k}"
        return out + zs + f", d_{step} AS MATERIALIZED (SELECT doc_id, g, {x_list}, {DISTANCE} AS d2 FROM {z_inner})"

    med = ", ".join(f"quantile_cont({x}, 0.5) AS m_{x}" for x in XS)
    mad = ", ".join(f"any_value(m_{x}) AS m_{x}, quantile_cont(abs({x} - m_{x}), 0.5) AS d_{x}" for x in XS)
    start = f"SELECT g, {', '.join(f'm_{x}' for x in XS)}, {', '.join(start_sql())} FROM (SELECT g, {mad} FROM v JOIN (SELECT g, {med} FROM v GROUP BY g) USING (g) GROUP BY g)"
    body = chain(0, start)
    for step in range(1, STEPS + 1):
        sums = ", ".join([f"sum({a}) AS t_{a}" for a in XS] + [f"sum({a} * {b}) AS t_{a}{b}" for a, b in PAIRS])
        totals = ", ".join(["sum(n) AS n", *[f"sum({s}) AS {s}" for s in SUMS]])
        scatter = f"""SELECT g, {', '.join(scatter_sql())} FROM (
          SELECT g, {totals} FROM (
            SELECT *, sum(n) OVER (PARTITION BY g ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY g) AS size FROM (
              SELECT g, bin, count(*) AS n, {sums}
              FROM (SELECT *, CAST(least({LAST_BIN}, floor(sqrt(d2) * {BINS_PER_UNIT})) AS INTEGER) AS bin FROM d_{step - 1}) GROUP BY g, bin)
          ) WHERE before < ceil({SHARE} * size) GROUP BY g)"""
        body += chain(step, scatter)
    words = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{words}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{words}')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), cov AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, unnest(range(3)) AS o FROM win WHERE n > 1)) GROUP BY doc_id
), b AS MATERIALIZED (
  SELECT w.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), r AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
x AS MATERIALIZED (SELECT doc_id, lang, source, {', '.join(map(vector_sql, XS))} FROM r WHERE NOT base_failed),
sz AS (SELECT lang, source, count(*) AS size FROM x GROUP BY lang, source),
rest AS (SELECT lang, sum(size) AS rest FROM sz WHERE size < {MIN_GROUP} GROUP BY lang),
v AS MATERIALIZED (
  SELECT doc_id, {x_list}, CASE WHEN size >= {MIN_GROUP} THEN '2' || chr(31) || lang || chr(31) || source
    WHEN rest >= {MIN_GROUP} THEN '1' || chr(31) || lang ELSE '0' END AS g
  FROM x JOIN sz USING (lang, source) LEFT JOIN rest USING (lang)
){body}
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(d2 <= {CUTOFF}, false) AS kept
FROM r LEFT JOIN d_{STEPS} d USING (doc_id)
"""


QUERIES = {"op1_mcd_quality": op1_mcd_quality}
ORACLES = {"op1_mcd_quality": _sql()}
