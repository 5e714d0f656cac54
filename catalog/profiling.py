"""Meta-features and column statistics."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from catalog.registry import GAPS_SQL, LINE_NUMBERS, gappy_lines, lines, load, query, r6, rounded
from tabloom import Table
from tabloom.frame import CLASSIFICATION
from tabloom.plans.columnstats import (
    column_statistics,
    column_types,
    entropy,
    first_appearance_codes,
    missing_values,
    mutual_information,
    numeric_statistics,
    pearson,
    spearman,
    summarise,
)
from tabloom.plans.groups import grouped_profile
from tabloom.plans.profile import (
    class_occurrences,
    metafeature_profile,
    metafeature_values,
    num_symbols,
    prepared,
    shape_table,
)
from tabloom.sources.sinks import metafeature_rows

WITH_GAPS = f"WITH g AS ({GAPS_SQL.replace('SELECT l_orderkey', 'SELECT l_returnflag AS y, l_orderkey')})"


def profiled(spark, sf) -> Table:
    return gappy_lines(spark, sf, label="l_returnflag")


def values(spark, sf, names, t=None):
    found = metafeature_values(t or profiled(spark, sf), names)
    return rounded(spark.createDataFrame([(n, float(v)) for n, v in found.items()], "name string, value double"))


FACTS = f"""{WITH_GAPS}, n AS (SELECT count(*) AS n, 5 AS p, 4 AS num, 1 AS nom,
    count(*) FILTER (WHERE qty IS NULL) AS mq, count(*) FILTER (WHERE disc IS NULL) AS md, count(*) FILTER (WHERE tax IS NULL) AS mt,
    count(*) FILTER (WHERE qty IS NULL OR disc IS NULL OR tax IS NULL) AS bad FROM g),
cols AS (SELECT *, (mq > 0)::INT + (md > 0)::INT + (mt > 0)::INT AS bc, mq + md + mt AS cells FROM n)"""


def _named(pairs: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {r6(e)} AS value FROM {source}" for n, e in pairs.items())


COUNT_ROWS = {
    "metafeature_instances": {"NumberOfInstances": "n", "LogNumberOfInstances": "ln(n)"},
    "metafeature_features": {"NumberOfFeatures": "p", "LogNumberOfFeatures": "ln(p)"},
    "metafeature_missing_rows": {
        "NumberOfInstancesWithMissingValues": "bad",
        "PercentageOfInstancesWithMissingValues": "bad / n",
        "NumberOfFeaturesWithMissingValues": "bc",
        "PercentageOfFeaturesWithMissingValues": "bc / p",
    },
    "metafeature_missing_cells": {"NumberOfMissingValues": "cells", "PercentageOfMissingValues": "cells / (n * p)"},
    "metafeature_types": {"NumberOfNumericFeatures": "num", "NumberOfCategoricalFeatures": "nom"},
    "metafeature_type_ratios": {"RatioNumericalToNominal": "num / nom", "RatioNominalToNumerical": "nom / num"},
    "metafeature_dataset_ratios": {
        "DatasetRatio": "p / n",
        "LogDatasetRatio": "ln(p / n)",
        "InverseDatasetRatio": "n / (p + 1e-7)",
        "LogInverseDatasetRatio": "ln(n / (p + 1e-7))",
    },
}
for _name, _pairs in COUNT_ROWS.items():

    def _counts(spark, sf, names=tuple(_pairs)):
        return values(spark, sf, names)

    query(_name, f"{FACTS} {_named(_pairs, 'cols')}")(_counts)

SHARES = f"{WITH_GAPS}, s AS (SELECT y, count(*) / (SELECT count(*) FROM g)::DOUBLE AS p FROM g GROUP BY y)"


@query("metafeature_classes", f"{SHARES} SELECT 'NumberOfClasses' AS name, count(*)::DOUBLE AS value FROM s")
def q_classes(spark, sf):
    return values(spark, sf, ["NumberOfClasses"])


@query(
    "metafeature_class_probability",
    f"{SHARES}, a AS (SELECT min(p) AS lo, max(p) AS hi, avg(p) AS m, stddev_pop(p) AS sd FROM s) "
    + _named({"ClassProbabilityMin": "lo", "ClassProbabilityMax": "hi", "ClassProbabilityMean": "m", "ClassProbabilitySTD": "sd"}, "a"),
)
def q_class_probability(spark, sf):
    return values(spark, sf, [f"ClassProbability{a}" for a in ("Min", "Max", "Mean", "STD")])


@query("metafeature_class_occurrences", 'SELECT l_returnflag AS "class", count(*) AS n FROM lineitem GROUP BY 1')
def q_occurrences(spark, sf):
    return class_occurrences(profiled(spark, sf))


@query("metafeature_class_entropy", f"{SHARES} SELECT 'ClassEntropy' AS name, {r6('-sum(p * log2(p))', 'value')} FROM s")
def q_class_entropy(spark, sf):
    return values(spark, sf, ["ClassEntropy"])


PART_TEXTS = ["p_name", "p_brand", "p_type"]


def parts(spark, sf) -> Table:
    return Table.of(load(spark, sf, "part"), "p_partkey", "p_size", PART_TEXTS, CLASSIFICATION)


SYMBOLS = "WITH s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(DISTINCT {n}) AS symbols FROM part" for n in PART_TEXTS) + ")"


@query("metafeature_num_symbols", f"{SYMBOLS} SELECT * FROM s")
def q_num_symbols(spark, sf):
    return num_symbols(parts(spark, sf))


@query(
    "metafeature_symbols",
    f"{SYMBOLS}, a AS (SELECT min(symbols) AS lo, max(symbols) AS hi, avg(symbols) AS m, stddev_pop(symbols) AS sd, sum(symbols) AS s FROM s) "
    + _named({"SymbolsMin": "lo", "SymbolsMax": "hi", "SymbolsMean": "m", "SymbolsSTD": "sd", "SymbolsSum": "s"}, "a"),
)
def q_symbols(spark, sf):
    return values(spark, sf, [f"Symbols{a}" for a in ("Min", "Max", "Mean", "STD", "Sum")], parts(spark, sf))


CODED = f"""{WITH_GAPS}, mm AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt FROM g),
x AS (SELECT coalesce(qty, mq) AS qty, price, coalesce(disc, md) AS disc, coalesce(tax, mt) AS tax,
      CASE coalesce(status, 'NaN') WHEN 'F' THEN 0 WHEN 'NaN' THEN 1 ELSE 2 END::DOUBLE AS status FROM g, mm)"""
CODED_NAMES = {"qty": "qty_imp_mean", "price": "price", "disc": "disc_imp_mean", "tax": "tax_imp_mean", "status": "status_lbl_enc"}
SHAPE_ROWS = " UNION ALL ".join(
    f"""SELECT '{out}' AS feature, kurtosis_pop({n}) AS k,
    (SELECT avg(pow({n} - m, 3)) / pow(any_value(v), 1.5) FROM x, (SELECT avg({n}) AS m, var_pop({n}) AS v FROM x)) AS s FROM x"""
    for n, out in CODED_NAMES.items()
)


@query(
    "metafeature_shapes",
    f"{CODED}, sh AS ({SHAPE_ROWS}) SELECT feature, {r6('k', 'kurtosis')}, {r6('s', 'skewness')} FROM sh",
)
def q_shapes(spark, sf):
    return rounded(shape_table(prepared(profiled(spark, sf))))


for _kind, _col in (("Kurtosis", "k"), ("Skewness", "s")):
    _aggs = {f"{_kind}Min": f"min({_col})", f"{_kind}Max": f"max({_col})", f"{_kind}Mean": f"avg({_col})", f"{_kind}STD": f"stddev_pop({_col})"}

    def _shape(spark, sf, names=tuple(_aggs)):
        return values(spark, sf, names)

    query(f"metafeature_{_kind.lower()}", f"{CODED}, sh AS ({SHAPE_ROWS}) {_named(_aggs, 'sh')}")(_shape)


@query(
    "metafeature_correlation",
    f"""{WITH_GAPS}, x AS (SELECT CASE y WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, qty, price, disc, tax,
      CASE coalesce(status, 'NaN') WHEN 'F' THEN 0 WHEN 'NaN' THEN 1 ELSE 2 END AS status FROM g),
    r AS (SELECT unnest([corr(qty, y), corr(price, y), corr(disc, y), corr(tax, y), corr(status, y)]) AS r FROM x),
    a AS (SELECT avg(r) AS m, stddev_pop(r) AS sd FROM r) """
    + _named({"CorrelationMean": "m", "CorrelationSTD": "sd"}, "a"),
)
def q_correlation(spark, sf):
    return values(spark, sf, ["CorrelationMean", "CorrelationSTD"])


# Landmarks on the customers: two numeric features, five classes.
def customers(spark, sf) -> Table:
    return Table.of(load(spark, sf, "customer"), "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"], CLASSIFICATION)


SCALED = """
WITH r AS (SELECT c_custkey AS id, c_mktsegment AS y, ntile(2) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS fold,
     (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS a,
     (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS b FROM customer)
"""
ACCURACY = "acc AS (SELECT fold, avg((y = p)::INT) AS acc FROM o GROUP BY fold)"


@query(
    "landmark_naive_bayes",
    f"""{SCALED}, k AS (SELECT unnest([0, 1]) AS k),
    e AS (SELECT k, 1e-9 * greatest(var_pop(a), var_pop(b)) AS e FROM r, k WHERE fold <> k GROUP BY k),
    st AS (SELECT k.k, y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) + any_value(e) AS va, var_pop(b) + any_value(e) AS vb
           FROM r, k, e WHERE fold <> k.k AND e.k = k.k GROUP BY k.k, y),
    o AS (SELECT id, r.y, fold, arg_max(st.y, ln(n) - 0.5 * ln(va) - 0.5 * ln(vb) - pow(a - ma, 2) / (2 * va) - pow(b - mb, 2) / (2 * vb)) AS p
          FROM r JOIN st ON st.k = r.fold GROUP BY ALL), {ACCURACY}
    SELECT 'LandmarkNaiveBayes' AS name, {r6('avg(acc)', 'value')} FROM acc""",
)
def q_landmark_nb(spark, sf):
    return values(spark, sf, ["LandmarkNaiveBayes"], customers(spark, sf))


@query(
    "landmark_1nn",
    f"""{SCALED}, d AS (SELECT q.id, q.y, q.fold, arg_min(t.y, (pow(q.a - t.a, 2) + pow(q.b - t.b, 2), t.id)) AS p
    FROM r q JOIN r t ON q.fold <> t.fold GROUP BY q.id, q.y, q.fold), o AS (SELECT * FROM d), {ACCURACY}
    SELECT 'Landmark1NN' AS name, {r6('avg(acc)', 'value')} FROM acc""",
)
def q_landmark_1nn(spark, sf):
    return values(spark, sf, ["Landmark1NN"], customers(spark, sf))


@query(
    "landmark_lda",
    f"""{SCALED}, k AS (SELECT unnest([0, 1]) AS k),
    cl AS (SELECT k, y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb,
           covar_pop(a, b) * count(*) AS sab FROM r, k WHERE fold <> k GROUP BY k, y),
    tt AS (SELECT k, sum(saa) / sum(n) AS vaa, sum(sbb) / sum(n) AS vbb, sum(sab) / sum(n) AS vab FROM cl GROUP BY k),
    o AS (SELECT id, r.y, fold, arg_max(cl.y, ln(n) - 0.5 * (vbb * pow(a - ma, 2) - 2 * vab * (a - ma) * (b - mb) + vaa * pow(b - mb, 2))
          / (vaa * vbb - vab * vab)) AS p FROM r JOIN cl ON cl.k = r.fold JOIN tt ON tt.k = r.fold GROUP BY ALL), {ACCURACY}
    SELECT 'LandmarkLDA' AS name, {r6('avg(acc)', 'value')} FROM acc""",
)
def q_landmark_lda(spark, sf):
    return values(spark, sf, ["LandmarkLDA"], customers(spark, sf))


for _name, _mf in (
    ("landmark_decision_tree", "LandmarkDecisionTree"),
    ("landmark_decision_node", "LandmarkDecisionNodeLearner"),
    ("landmark_random_node", "LandmarkRandomNodeLearner"),
):

    def _landmark(spark, sf, mf=_mf):
        return values(spark, sf, [mf], customers(spark, sf))

    query(_name)(_landmark)


@query(
    "metafeature_pca_fraction",
    f"""{SCALED} SELECT 'PCAFractionOfComponentsFor95PercentVariance' AS name,
    CASE WHEN (1 + abs(corr(a, b))) / 2 >= 0.95 THEN 0.5e0 ELSE 1.0e0 END AS value FROM r""",
)
def q_pca_fraction(spark, sf):
    return values(spark, sf, ["PCAFractionOfComponentsFor95PercentVariance"], customers(spark, sf))


@query(
    "metafeature_pca_kurtosis",
    f"""{SCALED} SELECT 'PCAKurtosisFirstPC' AS name, {r6('kurtosis_pop(a + s * b)', 'value')}
    FROM r, (SELECT sign(corr(a, b)) AS s FROM r)""",
)
def q_pca_kurtosis(spark, sf):
    return values(spark, sf, ["PCAKurtosisFirstPC"], customers(spark, sf))


@query("metafeature_pca_skewness")
def q_pca_skewness(spark, sf):
    """The sign follows the axis, which two equal loadings leave open: rows only."""
    return values(spark, sf, ["PCASkewnessFirstPC"], customers(spark, sf))


@query("metafeature_profile")
def q_profile(spark, sf):
    """The default vector in one call."""
    return rounded(metafeature_profile(profiled(spark, sf), dont_calculate=("Landmark1NN", "LandmarkDecisionNodeLearner", "LandmarkLDA")))


@query(
    "metafeature_table_sink",
    f"""{FACTS}, v AS ({_named(COUNT_ROWS['metafeature_missing_rows'] | COUNT_ROWS['metafeature_types'], 'cols')})
    SELECT name, 'METAFEATURE' AS type, 0 AS fold, 0 AS repeat, value, NULL::DOUBLE AS time, '' AS comment FROM v""",
)
def q_sink(spark, sf):
    names = [*COUNT_ROWS["metafeature_missing_rows"], *COUNT_ROWS["metafeature_types"]]
    return metafeature_rows(values(spark, sf, names))


# Column statistics: (mf, a, b, value).
def _stats(df):
    return rounded(df.select("mf", "a", F.coalesce("b", F.lit("")).alias("b"), "value"))


def _skewness(n: str, source: str) -> str:
    return f"(SELECT avg(pow({n} - mean_, 3)) / pow(any_value(var_), 1.5) FROM {source}, (SELECT avg({n}) AS mean_, var_pop({n}) AS var_ FROM {source}))"


NUMERIC_SQL = " UNION ALL ".join(
    f"SELECT '{mf}' AS mf, '{n}' AS a, '' AS b, {r6(e)} AS value"
    for n in ("qty", "price", "disc", "tax")
    for mf, e in (
        ("mean", f"(SELECT avg({n}) FROM g)"),
        ("std", f"(SELECT stddev_pop({n}) FROM g)"),
        ("kurtosis", f"(SELECT kurtosis_pop({n}) FROM g)"),
        ("skew", _skewness(n, "g")),
    )
)
for _mf in ("mean", "std", "kurtosis", "skew"):

    def _numeric(spark, sf, mf=_mf):
        t = gappy_lines(spark, sf)
        return _stats(numeric_statistics(t, t.numeric).where(F.col("mf") == mf))

    query(f"mf_{_mf}", f"{WITH_GAPS} SELECT * FROM ({NUMERIC_SQL}) WHERE mf = '{_mf}'")(_numeric)


@query(
    "mf_missing_values",
    WITH_GAPS + " UNION ALL ".join(
        f" SELECT 'missing_values' AS mf, '{n}' AS a, '' AS b, count(*) FILTER (WHERE {n} IS NULL)::DOUBLE AS value FROM g"
        for n in ("qty", "price", "disc", "tax", "status")
    ),
)
def q_missing(spark, sf):
    t = gappy_lines(spark, sf)
    return _stats(missing_values(t, list(t.features)))


def _entropy_sql(n: str) -> str:
    return f"""SELECT 'entropy' AS mf, '{n}' AS a, '' AS b, {r6('-sum(p * log2(p))')} AS value
    FROM (SELECT count(*) / (SELECT count(*) FROM part)::DOUBLE AS p FROM part GROUP BY {n})"""


@query("mf_entropy", " UNION ALL ".join(_entropy_sql(n) for n in PART_TEXTS))
def q_entropy(spark, sf):
    return _stats(entropy(parts(spark, sf), PART_TEXTS))


def _nmi_sql(a: str, b: str) -> str:
    return f"""SELECT 'mutual_information' AS mf, '{a}' AS a, '{b}' AS b, {r6('(hx + hy - hxy) / sqrt(hx * hy)')} AS value FROM
    (SELECT -sum(p * ln(p)) AS hx FROM (SELECT count(*) / (SELECT count(*) FROM part)::DOUBLE AS p FROM part GROUP BY {a})),
    (SELECT -sum(p * ln(p)) AS hy FROM (SELECT count(*) / (SELECT count(*) FROM part)::DOUBLE AS p FROM part GROUP BY {b})),
    (SELECT -sum(p * ln(p)) AS hxy FROM (SELECT count(*) / (SELECT count(*) FROM part)::DOUBLE AS p FROM part GROUP BY {a}, {b}))"""


TEXT_PAIRS = list(itertools.combinations(PART_TEXTS, 2))


@query("mf_mutual_information", " UNION ALL ".join(_nmi_sql(a, b) for a, b in TEXT_PAIRS))
def q_mutual(spark, sf):
    return _stats(mutual_information(parts(spark, sf), TEXT_PAIRS))


NUMBER_PAIRS = list(itertools.combinations(LINE_NUMBERS, 2))


@query(
    "mf_pearson",
    " UNION ALL ".join(
        f"SELECT 'pearson' AS mf, '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS value FROM lineitem" for a, b in NUMBER_PAIRS
    ),
)
def q_pearson(spark, sf):
    return _stats(pearson(lines(spark, sf), NUMBER_PAIRS))


RANKS = "WITH k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0e0 AS {n}" for n in LINE_NUMBERS
) + " FROM lineitem) "


@query(
    "mf_spearman",
    RANKS + " UNION ALL ".join(
        f"SELECT 'spearman' AS mf, '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS value FROM k" for a, b in NUMBER_PAIRS
    ),
)
def q_spearman(spark, sf):
    return _stats(spearman(lines(spark, sf), NUMBER_PAIRS, rows_per_range=10000))


@query("column_statistics")
def q_column_statistics(spark, sf):
    """Every statistic at once on a table with gaps, text and a class label."""
    return rounded(column_statistics(profiled(spark, sf)))


MEANS = "v AS (SELECT unnest([avg(qty), avg(price) / 1000, avg(disc), avg(tax)]) AS v FROM g)"
SUMMARY_SQL = {
    "mean": "(SELECT avg(v) FROM v)",
    "std": "(SELECT stddev_pop(v) FROM v)",
    "kurtosis": "(SELECT kurtosis_pop(v) FROM v)",
    "skew": _skewness("v", "v"),
}


def _summaries(spark, sf):
    t = gappy_lines(spark, sf)
    scaled = t.derive({n: t.number(n) / (1000 if n == "price" else 1) for n in t.numeric})
    means = numeric_statistics(scaled, list(scaled.features)).where("mf = 'mean'")
    return rounded(summarise(means))


for _pp, _e in SUMMARY_SQL.items():

    def _summary(spark, sf, pp=_pp):
        return _summaries(spark, sf).where(F.col("name") == f"Features.mean.{pp}")

    query(f"pp_{_pp}", f"{WITH_GAPS}, {MEANS} SELECT 'Features.mean.{_pp}' AS name, {r6(_e, 'value')}")(_summary)


@query("pp_non_aggregated", f"SELECT 'Features.mean.non_aggregated' AS name, {r6('avg(l_quantity)', 'value')} FROM lineitem")
def q_non_aggregated(spark, sf):
    """A single value stays as it is."""
    return rounded(summarise(numeric_statistics(lines(spark, sf, ["l_quantity"]), ["l_quantity"]).where("mf = 'mean'")))


@query(
    "column_types",
    """WITH f AS (SELECT p_type AS level, min(p_partkey) AS k FROM part GROUP BY 1)
    SELECT 'p_type' AS name, 'categorical' AS type, 0 AS is_target, level, row_number() OVER (ORDER BY k) - 1 AS code FROM f
    UNION ALL SELECT 'p_retailprice', 'numerical', 0, '', -1 FROM (SELECT count(*) FROM part)
    UNION ALL SELECT 'p_brand', 'categorical', 1, '', -1 FROM (SELECT count(*) FROM part)""",
)
def q_column_types(spark, sf):
    """Types from the schema; levels numbered in order of first appearance."""
    t = Table.of(load(spark, sf, "part"), "p_partkey", "p_brand", ["p_type", "p_retailprice"], CLASSIFICATION)
    codes = first_appearance_codes(t, "p_type", "p_partkey", rows_per_range=4).withColumn("name", F.lit("p_type"))
    joined = column_types(t).join(codes, "name", "left")
    level, code = F.coalesce("level", F.lit("")), F.coalesce("code", F.lit(-1))
    return joined.select("name", "type", "is_target", level.alias("level"), code.cast("bigint").alias("code"))


BY = "PARTITION BY l_suppkey"
GROUPED = {
    "NumberOfInstances": "n",
    "NumberOfInstancesWithMissingValues": "bad",
    "NumberOfMissingValues": "cells",
    "PercentageOfMissingValues": "cells / (n * 5)",
    "LogDatasetRatio": "ln(5 / n)",
    "NumberOfClasses": "k",
    "ClassProbabilityMax": "hi",
    "ClassProbabilitySTD": "sd",
    "ClassEntropy": "h",
    "SymbolsSum": "s",
    "KurtosisMax": "list_max(ku)",
    "KurtosisMean": "list_avg(ku)",
    "CorrelationMean": "list_avg(r)",
    "CorrelationSTD": "list_stddev_pop(r)",
}
GROUPED_SQL = f"""{WITH_GAPS}, x AS (SELECT *, coalesce(qty, avg(qty) OVER ({BY})) AS fq, coalesce(disc, avg(disc) OVER ({BY})) AS fd,
    coalesce(tax, avg(tax) OVER ({BY})) AS ft, dense_rank() OVER ({BY} ORDER BY coalesce(status, 'NaN')) AS st,
    dense_rank() OVER ({BY} ORDER BY y) AS c FROM g),
a AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE qty IS NULL OR disc IS NULL OR tax IS NULL) AS bad,
    3 * count(*) - count(qty) - count(disc) - count(tax) AS cells, max(st) AS s,
    [kurtosis_pop(fq), kurtosis_pop(price), kurtosis_pop(fd), kurtosis_pop(ft), kurtosis_pop(st)] AS ku,
    [corr(qty, c), corr(price, c), corr(disc, c), corr(tax, c), corr(st, c)] AS r FROM x GROUP BY l_suppkey),
m AS (SELECT l_suppkey, y, count(*) AS o, sum(count(*)) OVER ({BY}) AS t FROM g GROUP BY l_suppkey, y),
cl AS (SELECT l_suppkey, count(*) AS k, max(o / t) AS hi, stddev_pop(o / t) AS sd, -sum(o / t * log2(o / t)) AS h FROM m GROUP BY l_suppkey),
w AS (SELECT * FROM a JOIN cl USING (l_suppkey)) """ + " UNION ALL ".join(
    f"SELECT l_suppkey::VARCHAR AS \"group\", '{n}' AS name, {r6(e, 'value')} FROM w" for n, e in GROUPED.items()
)


@query("metafeature_grouped", GROUPED_SQL)
def q_grouped(spark, sf):
    """Every supplier's lines as a dataset of its own, all in one set of jobs."""
    return rounded(grouped_profile(profiled(spark, sf), "l_suppkey", GROUPED))
