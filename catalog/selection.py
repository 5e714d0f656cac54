"""Univariate scores and the selectors built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import EMBEDDING_LONG_SQL, embedding_columns, lines, load, query, r6, rounded
from tabloom import Table, get_operator
from tabloom.frame import CLASSIFICATION, REGRESSION, c
from tabloom.functions.stats import unpivot
from tabloom.operators.scores import SCORES

# Three classes from ten labels; the first eight columns are moved by the class
# so that something is significant. Same expressions on both sides.
SHIFTED_SQL = f"""
WITH long AS ({EMBEDDING_LONG_SQL}),
f AS (SELECT vec_id, label % 3 AS y, feature, i,
             x + 1.0e0 + CASE WHEN i < 8 THEN (i + 1) * 0.05e0 * (label % 3) ELSE 0.0e0 END AS x FROM long)
"""


def shifted(spark, sf, task=CLASSIFICATION) -> Table:
    df = embedding_columns(load(spark, sf, "embeddings"))
    y = F.col("label") % 3
    cols = [
        (F.col(f"e{i:02d}") + 1.0 + (y * ((i + 1) * F.lit(0.05)) if i < 8 else F.lit(0.0))).alias(f"e{i:02d}")
        for i in range(64)
    ]
    return Table.of(df.select("vec_id", y.alias("y"), *cols), "vec_id", "y", task=task)


CHI2_SQL = """
cls AS (SELECT y, count(*) / 64.0e0 AS n FROM f GROUP BY y),
tot AS (SELECT feature, sum(x) AS s FROM f GROUP BY feature),
obs AS (SELECT feature, y, sum(x) AS s FROM f GROUP BY feature, y),
sc AS (SELECT feature, sum(pow(obs.s - n * tot.s / (SELECT sum(n) FROM cls), 2)
              / (n * tot.s / (SELECT sum(n) FROM cls))) AS score
       FROM obs JOIN cls USING (y) JOIN tot USING (feature) GROUP BY feature),
scored AS (SELECT feature, score, exp(-score / 2) AS p FROM sc)
"""
ANOVA_SQL = """
m AS (SELECT feature, avg(x) AS g, count(*) AS n FROM f GROUP BY feature),
mc AS (SELECT feature, y, avg(x) AS m, count(*) AS n FROM f GROUP BY feature, y),
b AS (SELECT feature, sum(mc.n * pow(mc.m - g, 2)) / 2 AS between_ms FROM mc JOIN m USING (feature) GROUP BY feature),
w AS (SELECT f.feature, sum(pow(x - mc.m, 2)) / (count(*) - 3) AS within_ms, count(*) - 3 AS d2
      FROM f JOIN mc ON f.feature = mc.feature AND f.y = mc.y GROUP BY f.feature),
scored AS (SELECT feature, between_ms / within_ms AS score,
                  pow(1 + 2 * between_ms / within_ms / d2, -d2 / 2.0e0) AS p FROM b JOIN w USING (feature))
"""
# Two-sided t tail with an even number of degrees of freedom as a finite series
# (Abramowitz & Stegun 26.7.4); the tables hold an even number of vectors.
REGRESSION_SQL = """
st AS (SELECT feature, corr(x, y) AS r, count(*) AS n FROM f GROUP BY feature),
fs AS (SELECT feature, r * r / (1 - r * r) * (n - 2) AS score, n - 2 AS nu FROM st),
coef AS (SELECT 0 AS k, 1.0e0 AS lc UNION ALL
         SELECT k, exp(sum(ln((2 * k - 1) / (2.0e0 * k))) OVER (ORDER BY k)) FROM range(1, (SELECT max(nu) // 2 FROM fs)) g(k)),
scored AS (SELECT feature, score,
       1 - sqrt(score / (score + nu)) * (SELECT sum(lc * pow(nu / (score + nu), k)) FROM coef WHERE k < nu // 2) AS p FROM fs)
"""


def _mi_sql(y: str, table: str) -> str:
    return f"""
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
      FROM {table} GROUP BY feature),
b AS (SELECT feature, {y} AS y, len(list_filter(e[2:len(e) - 1], lambda q: q <= x)) AS b FROM {table} JOIN e USING (feature)),
cc AS (SELECT feature, y, b, count(*) AS n FROM b GROUP BY ALL),
ww AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS rb,
              sum(n) OVER (PARTITION BY feature, y) AS ry FROM cc),
scored AS (SELECT feature, greatest(sum(n / t * ln(n * t / (rb * ry))), 0) AS score, NULL::DOUBLE AS p FROM ww GROUP BY feature)
"""


YBIN_SQL = """
ye AS (SELECT list_sort(list_distinct(quantile_cont(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS ye FROM f0),
f AS (SELECT feature, x, len(list_filter(ye[2:len(ye) - 1], lambda q: q <= y)) AS y FROM f0, ye)
"""
# Regression target: the last coordinate plus a share of the first ones.
TARGET_SQL = f"""
WITH long AS ({EMBEDDING_LONG_SQL}),
tgt AS (SELECT vec_id, sum(CASE WHEN i = 63 THEN x WHEN i < 4 THEN 0.5e0 * x ELSE 0 END) AS y FROM long GROUP BY vec_id),
"""


def targeted(spark, sf) -> Table:
    df = embedding_columns(load(spark, sf, "embeddings"))
    y = F.col("e63") + 0.5 * (F.col("e00") + F.col("e01") + F.col("e02") + F.col("e03"))
    names = [f"e{i:02d}" for i in range(63)]
    return Table.of(df.select("vec_id", y.alias("y"), *names), "vec_id", "y", names, REGRESSION)


SCORED_SQL = {
    "chi2": f"{SHIFTED_SQL}, {CHI2_SQL}",
    "f_classif": f"{SHIFTED_SQL}, {ANOVA_SQL}",
    "f_regression": f"{TARGET_SQL} f AS (SELECT feature, x, y FROM long JOIN tgt USING (vec_id) WHERE i < 63), {REGRESSION_SQL}",
    "mi_classif": f"{SHIFTED_SQL}, {_mi_sql('y', 'f')}",
    "mi_regression": f"{TARGET_SQL} f0 AS (SELECT feature, x, y FROM long JOIN tgt USING (vec_id) WHERE i < 63), {YBIN_SQL}, {_mi_sql('y', 'f')}",
}
LONG_NAMES = {"mi_classif": "mutual_info_classif", "mi_regression": "mutual_info_regression"}


def _table(spark, sf, score) -> Table:
    return targeted(spark, sf) if score.endswith("regression") else shifted(spark, sf)


for _score, _sql in SCORED_SQL.items():

    def _run_score(spark, sf, score=_score):
        scored = SCORES[score](_table(spark, sf, score))
        return rounded(scored.select("feature", "score", "p_value"))

    query(
        f"score_{LONG_NAMES.get(_score, _score)}",
        f"{_sql} SELECT feature, {r6('score', 'score')}, {r6('p', 'p_value')} FROM scored",
    )(_run_score)

# Neighbours by all pairs: r to the third neighbour of the class, m rows nearer than r; psi by its sum of inverses.
NEIGHBOUR_SQL = f"""{SHIFTED_SQL},
psi AS (SELECT CAST(k AS BIGINT) AS k, -0.57721566490153286e0 + coalesce(sum(CASE WHEN k > 1 THEN 1.0e0 / (k - 1) END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 0.0e0) AS p
        FROM (SELECT k FROM range(2, (SELECT count(*) + 2 FROM embeddings)) g(k) UNION ALL SELECT 1) ORDER BY k),
q AS (SELECT feature, vec_id, y, x, count(*) OVER (PARTITION BY feature, y) AS held, count(*) OVER (PARTITION BY feature) AS n FROM f),
pairs AS (SELECT a.feature, a.vec_id, a.x, a.held, a.n, abs(b.x - a.x) AS d, b.x AS bx, a.y = b.y AS same, a.vec_id = b.vec_id AS own
          FROM q a JOIN q b ON a.feature = b.feature WHERE a.held > 1 AND b.held > 1),
near AS (SELECT feature, vec_id, max(d) AS r FROM (
           SELECT *, row_number() OVER (PARTITION BY feature, vec_id ORDER BY d) AS place FROM pairs WHERE same AND NOT own) WHERE place <= 3 GROUP BY feature, vec_id),
m AS (SELECT feature, vec_id, any_value(held) AS held, any_value(n) AS n, any_value(r) AS r,
             count(*) FILTER (CASE WHEN r > 0 THEN bx > x - r AND bx < x + r ELSE bx = x END) AS m,
             count(*) FILTER (bx = x AND same) AS ties
      FROM pairs JOIN near USING (feature, vec_id) GROUP BY feature, vec_id),
terms AS (SELECT feature, any_value(pn.p) AS pn, avg(pk.p - ph.p - pm.p) AS t FROM m
          JOIN psi pn ON pn.k = m.n JOIN psi ph ON ph.k = held JOIN psi pm ON pm.k = m.m
          JOIN psi pk ON pk.k = CASE WHEN r > 0 THEN least(3, held - 1) ELSE ties END GROUP BY feature),
scored AS (SELECT feature, greatest(pn + t, 0) AS score, NULL::DOUBLE AS p FROM terms)
"""


@query(
    "score_mutual_info_neighbours",
    f"{NEIGHBOUR_SQL} SELECT feature, {r6('score', 'score')}, {r6('p', 'p_value')} FROM scored",
)
def q_neighbour_scores(spark, sf):
    scored = SCORES["mi_classif"](shifted(spark, sf), estimator="neighbours")
    return rounded(scored.select("feature", "score", "p_value"))


@query(
    "select_mi_neighbours_kbest",
    f"""{NEIGHBOUR_SQL}, kept AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS rk FROM scored) WHERE rk <= 10)
    SELECT feature, {r6('avg(x)', 'mean')} FROM kept JOIN f USING (feature) GROUP BY feature""",
)
def q_neighbour_select(spark, sf):
    return _means(get_operator("select_mi_classif_kbest", estimator="neighbours").fit_transform(shifted(spark, sf)))


KEEP_SQL = {
    "kbest": "row_number() OVER (ORDER BY score DESC, feature) <= 10",
    "percentile": "score > quantile_cont(score, 0.9) OVER ()",
    "fpr": "p < 0.05",
    "fwe": "p < 0.05 / count(*) OVER ()",
    "fdr": "p <= max(ok) OVER ()",
}


def _select_sql(score: str, rule: str) -> str:
    ranked = "SELECT *, row_number() OVER (ORDER BY p, feature) AS rk, count(*) OVER () AS m FROM scored"
    marked = f"SELECT *, CASE WHEN p <= 0.05 * rk / m THEN p END AS ok FROM ({ranked})"
    kept = f"SELECT feature, score, {KEEP_SQL[rule]} AS keep FROM ({marked})"
    return f"""{SCORED_SQL[score]}, kept AS ({kept}),
    means AS (SELECT feature, avg(x) AS mean FROM {'f0' if score == 'mi_regression' else 'f'} GROUP BY feature)
    SELECT feature, {r6('mean', 'mean')} FROM kept JOIN means USING (feature) WHERE keep"""


def _means(t: Table):
    row = t.df.agg(*[F.avg(c(n)).alias(n) for n in t.features])
    return rounded(unpivot(row, {n: c(n) for n in t.features}).withColumnRenamed("value", "mean"))


for _score in SCORED_SQL:
    for _rule in KEEP_SQL:
        if _score.startswith("mi_") and _rule not in ("kbest", "percentile"):
            continue

        def _run_select(spark, sf, score=_score, rule=_rule):
            fitted_on = _table(spark, sf, score)
            return _means(get_operator(f"select_{score}_{rule}").fit_transform(fitted_on))

        query(f"select_{_score}_{_rule}", _select_sql(_score, _rule))(_run_select)


# Not scored: constant columns go.
@query(
    "variance_threshold",
    f"""SELECT 'l_quantity' AS feature, {r6('avg(l_quantity)', 'mean')} FROM lineitem
    UNION ALL SELECT 'l_tax', {r6('avg(l_tax)')} FROM lineitem""",
)
def q_variance(spark, sf):
    t = lines(spark, sf, ["l_quantity", "l_tax"])
    wide = t.derive({"l_quantity": c("l_quantity"), "flat": F.lit(3.5), "l_tax": c("l_tax"), "zero": c("l_tax") * 0})
    return _means(get_operator("variance_threshold").fit_transform(wide))
