"""Scores, selections and correlations on columns that do not vary, tell the classes apart or follow the target."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import LINE_KEY, load, query, r6, rounded
from tabloom import Table, get_operator
from tabloom.frame import CLASSIFICATION, REGRESSION
from tabloom.operators.scores import SCORES
from tabloom.plans.columnstats import pearson, spearman
from tabloom.plans.profile import metafeature_values

FEATURES = {"flat": "3.5e0", "telling": "CAST(ascii(l_returnflag) AS DOUBLE)", "tax": "l_tax", "twice": "2.0e0 * l_extendedprice + 1.0e0"}
HARD_SQL = "WITH h AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in FEATURES.items()) + " FROM lineitem)"


def hard(spark, sf, names, label="l_returnflag", task=CLASSIFICATION) -> Table:
    df = load(spark, sf, "lineitem").selectExpr(*LINE_KEY, label, *[f"{FEATURES[n]} AS {n}" for n in names])
    return Table.of(df, LINE_KEY, label, names, task)


ANOVA = """
c AS (SELECT l_returnflag AS y, count(*) AS n, avg(tax) AS m, var_pop(tax) AS v FROM h GROUP BY 1),
a AS (SELECT sum(n * pow(m - (SELECT avg(tax) FROM h), 2)) / (count(*) - 1) AS between_ms,
             sum(n * v) / (sum(n) - count(*)) AS within_ms, sum(n) - count(*) AS d2 FROM c)
"""


@query(
    "score_f_classif_hard",
    f"""{HARD_SQL}, {ANOVA}
    SELECT 'flat' AS feature, NULL::DOUBLE AS score, NULL::DOUBLE AS p_value
    UNION ALL SELECT 'telling', 'Infinity'::DOUBLE, 0.0e0
    UNION ALL SELECT 'tax', {r6('between_ms / within_ms')}, {r6('pow(1 + 2 * between_ms / within_ms / d2, -d2 / 2.0e0)')} FROM a""",
)
def q_f_classif(spark, sf):
    return rounded(SCORES["f_classif"](hard(spark, sf, ["flat", "telling", "tax"])).select("feature", "score", "p_value"))


@query("select_f_classif_hard", f"{HARD_SQL} SELECT {r6('avg(telling)', 'telling')} FROM h")
def q_select_classif(spark, sf):
    kept = get_operator("select_f_classif_kbest", k=1).fit_transform(hard(spark, sf, ["flat", "telling", "tax"]))
    return rounded(kept.df.agg(*[F.avg(n).alias(n) for n in kept.features]))


@query(
    "score_f_regression_hard",
    f"""{HARD_SQL}
    SELECT 'flat' AS feature, NULL::DOUBLE AS score UNION ALL SELECT 'twice', 'Infinity'::DOUBLE
    UNION ALL SELECT 'tax', {r6('r * r / (1 - r * r) * (n - 2)')} FROM (SELECT corr(tax, l_extendedprice) AS r, count(*) AS n FROM h)""",
)
def q_f_regression(spark, sf):
    t = hard(spark, sf, ["flat", "twice", "tax"], "l_extendedprice", REGRESSION)
    return rounded(SCORES["f_regression"](t).select("feature", "score"))


@query("select_f_regression_hard", f"{HARD_SQL} SELECT {r6('avg(twice)', 'twice')} FROM h")
def q_select_regression(spark, sf):
    t = hard(spark, sf, ["flat", "twice", "tax"], "l_extendedprice", REGRESSION)
    kept = get_operator("select_f_regression_kbest", k=1).fit_transform(t)
    return rounded(kept.df.agg(*[F.avg(n).alias(n) for n in kept.features]))


PAIRS = [("flat", "tax"), ("flat", "flat"), ("twice", "twice"), ("tax", "twice")]


def _pairs_sql(kind: str, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS mf, '{a}' AS a, '{b}' AS b, "
        + ("NULL::DOUBLE AS value" if "flat" in (a, b) else r6("1.0e0", "value") if a == b else f"{r6(f'corr({a}, {b})', 'value')} FROM {table}")
        for a, b in PAIRS
    )


RANKED = "r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0e0 AS {n}" for n in ("tax", "twice")
) + " FROM h)"


@query("mf_pearson_hard", f"{HARD_SQL} {_pairs_sql('pearson', 'h')}")
def q_pearson(spark, sf):
    return rounded(pearson(hard(spark, sf, ["flat", "tax", "twice"], task=None), PAIRS).select("mf", "a", "b", "value"))


@query("mf_spearman_hard", f"{HARD_SQL}, {RANKED} {_pairs_sql('spearman', 'r')}")
def q_spearman(spark, sf):
    t = hard(spark, sf, ["flat", "tax", "twice"], task=None)
    return rounded(spearman(t, PAIRS, rows_per_range=10_000).select("mf", "a", "b", "value"))


@query(
    "metafeature_correlation_hard",
    f"""{HARD_SQL}, r AS (SELECT abs(corr(tax, l_extendedprice)) AS r, sign(corr(tax, l_extendedprice)) AS s FROM h)
    SELECT 'CorrelationMean' AS name, {r6('(0 + 1 + r * s) / 3', 'value')} FROM r
    UNION ALL SELECT 'CorrelationSTD', {r6('sqrt((0 + 1 + r * r) / 3 - pow((0 + 1 + r * s) / 3, 2))')} FROM r""",
)
def q_correlation(spark, sf):
    t = hard(spark, sf, ["flat", "twice", "tax"], "l_extendedprice", REGRESSION)
    found = metafeature_values(t, ["CorrelationMean", "CorrelationSTD"])
    return rounded(spark.createDataFrame([(n, float(v)) for n, v in found.items()], "name string, value double"))
