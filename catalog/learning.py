"""Learners with a closed form, checked row by row, and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    EMBEDDING_LONG_SQL,
    HASH_SQL,
    LINE_KEY,
    LINE_NUMBERS,
    embeddings,
    keys_sql,
    lines,
    load,
    query,
    r6,
    result,
    rounded,
)
from tabloom import Table, get_operator
from tabloom.frame import CLASSIFICATION
from tabloom.operators.ensemble import MajorityVote
from tabloom.operators.neighbors import nearest
from tabloom.plans.metrics import METRICS, cross_validate
from tabloom.sources.splits import train_test_split

K = keys_sql()
# Long form of the four numeric columns; rid numbers the rows of the scan.
LONG = " UNION ALL ".join(f"SELECT rid, l_returnflag AS y, {i} AS f, {n} AS x FROM r" for i, n in enumerate(LINE_NUMBERS))
BASE = f"r AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM lineitem), long AS MATERIALIZED ({LONG})"
PRIOR = "prior AS (SELECT l_returnflag AS y, count(*) AS n, ln(count(*) / (SELECT count(*)::DOUBLE FROM lineitem)) AS lp FROM lineitem GROUP BY 1)"


def _probabilities(logs: str, title: str) -> str:
    """From ``logs`` (rid, y, s): the class of largest score and all class shares."""
    cells = ", ".join(
        r6(f"sum(CASE WHEN y = '{v}' THEN e END) / sum(e)", f"{v}_{title}Pred") for v in ("A", "N", "R")
    )
    return f"""
    , logs AS ({logs}),
    sm AS (SELECT rid, y, s, exp(s - max(s) OVER (PARTITION BY rid)) AS e FROM logs),
    out AS (SELECT rid, arg_max(y, s) AS prediction, {cells} FROM sm GROUP BY rid)
    SELECT {keys_sql('r.')}, r.l_returnflag, out.* EXCLUDE (rid) FROM out JOIN r USING (rid)"""


def run(name, t, **params):
    return result(get_operator(name, **params).fit_transform(t))


@query(
    "clf_gaussian_nb",
    f"""WITH {BASE}, {PRIOR},
    st AS (SELECT y, f, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY y, f),
    eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT f, var_pop(x) AS v FROM long GROUP BY f))"""
    + _probabilities(
        """SELECT rid, st.y, any_value(lp) + sum(-0.5 * ln(2 * pi() * (v + e)) - pow(x - m, 2) / (2 * (v + e))) AS s
           FROM long JOIN st ON long.f = st.f JOIN prior ON prior.y = st.y, eps GROUP BY rid, st.y""",
        "GaussianNBClassifier",
    ),
)
def q_gaussian(spark, sf):
    return run("clf_gaussian_nb", lines(spark, sf))


@query(
    "clf_multinomial_nb",
    f"""WITH {BASE}, {PRIOR},
    st AS (SELECT y, f, sum(x) + 1 AS s FROM long GROUP BY y, f),
    w AS (SELECT y, f, ln(s / sum(s) OVER (PARTITION BY y)) AS w FROM st)"""
    + _probabilities(
        "SELECT rid, w.y, any_value(lp) + sum(x * w) AS s FROM long JOIN w ON long.f = w.f JOIN prior ON prior.y = w.y GROUP BY rid, w.y",
        "MultinomialNB",
    ),
)
def q_multinomial(spark, sf):
    return run("clf_multinomial_nb", lines(spark, sf))


@query(
    "clf_complement_nb",
    f"""WITH {BASE},
    tot AS (SELECT f, sum(x) AS s FROM long GROUP BY f),
    st AS (SELECT y, long.f, any_value(tot.s) + 1 - sum(x) AS s FROM long JOIN tot ON tot.f = long.f GROUP BY y, long.f),
    w AS (SELECT y, f, -ln(s / sum(s) OVER (PARTITION BY y)) AS w FROM st)"""
    + _probabilities(
        "SELECT rid, w.y, sum(x * w) AS s FROM long JOIN w ON long.f = w.f GROUP BY rid, w.y",
        "ComplementNBClassifier",
    ),
)
def q_complement(spark, sf):
    return run("clf_complement_nb", lines(spark, sf))


@query(
    "clf_bernoulli_nb",
    f"""WITH {BASE}, {PRIOR},
    st AS (SELECT y, f, (sum((x > 0)::INT) + 1) / (count(*) + 2.0e0) AS p FROM long GROUP BY y, f)"""
    + _probabilities(
        """SELECT rid, st.y, any_value(lp) + sum(CASE WHEN x > 0 THEN ln(p) ELSE ln(1 - p) END) AS s
           FROM long JOIN st ON long.f = st.f JOIN prior ON prior.y = st.y GROUP BY rid, st.y""",
        "BernoulliNBClassifier",
    ),
)
def q_bernoulli(spark, sf):
    return run("clf_bernoulli_nb", lines(spark, sf))


def _flags(title: str) -> str:
    return ", ".join(f"(prediction = '{v}')::INT::DOUBLE AS \"{v}_{title}Pred\"" for v in ("A", "N", "R"))


@query(
    "clf_nearest_centroid",
    f"""WITH {BASE}, ce AS (SELECT y, f, avg(x) AS m FROM long GROUP BY y, f),
    d AS (SELECT rid, ce.y, sum(pow(x - m, 2)) AS d FROM long JOIN ce ON ce.f = long.f GROUP BY rid, ce.y),
    o AS (SELECT rid, arg_min(y, d) AS prediction FROM d GROUP BY rid)
    SELECT {keys_sql('r.')}, l_returnflag, prediction, {_flags('NearestCentroid')} FROM o JOIN r USING (rid)""",
)
def q_centroid(spark, sf):
    return run("clf_nearest_centroid", lines(spark, sf))


# Two features, so that inverses have a closed form in SQL.
TWO = ["l_quantity", "l_discount"]
PAIR = """r AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_quantity AS a, l_discount AS b, * FROM lineitem),
cl AS (SELECT l_returnflag AS y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa,
       var_pop(b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab FROM r GROUP BY 1),
tt AS (SELECT sum(n) AS n, sum(saa) / sum(n) AS vaa, sum(sbb) / sum(n) AS vbb, sum(sab) / sum(n) AS vab FROM cl)"""


@query(
    "clf_lda",
    f"""WITH {PAIR}"""
    + _probabilities(
        """SELECT rid, y, ln(cl.n / tt.n) - 0.5 * (vbb * pow(a - ma, 2) - 2 * vab * (a - ma) * (b - mb) + vaa * pow(b - mb, 2))
           / (vaa * vbb - vab * vab) AS s FROM r, cl, tt""",
        "LinearDiscriminantAnalysisPrim",
    ),
)
def q_lda(spark, sf):
    return run("clf_lda", lines(spark, sf, TWO))


@query(
    "clf_qda",
    f"""WITH {PAIR}, q AS (SELECT y, n, ma, mb, saa / (n - 1) AS vaa, sbb / (n - 1) AS vbb, sab / (n - 1) AS vab FROM cl)"""
    + _probabilities(
        """SELECT rid, y, ln(q.n / tt.n) - 0.5 * ln(q.vaa * q.vbb - q.vab * q.vab)
           - 0.5 * (q.vbb * pow(a - ma, 2) - 2 * q.vab * (a - ma) * (b - mb) + q.vaa * pow(b - mb, 2))
           / (q.vaa * q.vbb - q.vab * q.vab) AS s FROM r, q, tt""",
        "QuadraticDiscriminantAnalysis",
    ),
)
def q_qda(spark, sf):
    return run("clf_qda", lines(spark, sf, TWO))


@query(
    "clf_ridge",
    f"""WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_quantity AS a, l_discount AS b, * FROM lineitem),
    g AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) + 1 AS saa, var_pop(b) * count(*) + 1 AS sbb,
          covar_pop(a, b) * count(*) AS sab FROM r),
    k AS (SELECT DISTINCT l_returnflag AS y FROM r),
    t AS (SELECT k.y, avg(CASE WHEN l_returnflag = k.y THEN 1 ELSE -1 END) AS mt,
          covar_pop(a, CASE WHEN l_returnflag = k.y THEN 1 ELSE -1 END) * count(*) AS ca,
          covar_pop(b, CASE WHEN l_returnflag = k.y THEN 1 ELSE -1 END) * count(*) AS cb FROM r, k GROUP BY k.y),
    s AS (SELECT rid, t.y, mt + ((sbb * ca - sab * cb) * (a - ma) + (saa * cb - sab * ca) * (b - mb)) / (saa * sbb - sab * sab) AS s
          FROM r, t, g),
    o AS (SELECT rid, arg_max(y, s) AS prediction FROM s GROUP BY rid)
    SELECT {keys_sql('r.')}, l_returnflag, prediction, {_flags('RidgeClassifier')} FROM o JOIN r USING (rid)""",
)
def q_ridge(spark, sf):
    return run("clf_ridge", lines(spark, sf, TWO))


# Penalties compared by the summed squared leave-one-out error of all classes.
RIDGE_CV_SQL = f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_quantity AS a, l_discount * 300 AS b, * FROM lineitem),
al AS (SELECT unnest([0.1e0, 1.0e0, 10.0e0]) AS alpha),
g AS (SELECT alpha, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) + alpha AS saa,
      var_pop(b) * count(*) + alpha AS sbb, covar_pop(a, b) * count(*) AS sab FROM r, al GROUP BY alpha),
k AS (SELECT DISTINCT l_returnflag AS y FROM r),
t AS (SELECT k.y, avg(CASE WHEN l_returnflag = k.y THEN 1 ELSE -1 END) AS mt,
      covar_pop(a, CASE WHEN l_returnflag = k.y THEN 1 ELSE -1 END) * count(*) AS ca,
      covar_pop(b, CASE WHEN l_returnflag = k.y THEN 1 ELSE -1 END) * count(*) AS cb FROM r, k GROUP BY k.y),
s AS MATERIALIZED (SELECT alpha, rid, t.y, CASE WHEN l_returnflag = t.y THEN 1 ELSE -1 END AS target,
      mt + ((sbb * ca - sab * cb) * (a - ma) + (saa * cb - sab * ca) * (b - mb)) / (saa * sbb - sab * sab) AS s,
      1.0e0 / n + (sbb * pow(a - ma, 2) - 2 * sab * (a - ma) * (b - mb) + saa * pow(b - mb, 2)) / (saa * sbb - sab * sab) AS h
      FROM r, t, g),
best AS (SELECT alpha FROM (SELECT alpha, sum(pow((target - s) / (1 - h), 2)) AS e FROM s GROUP BY alpha) ORDER BY e LIMIT 1),
o AS (SELECT rid, arg_max(y, s) AS prediction FROM s WHERE alpha = (SELECT alpha FROM best) GROUP BY rid)
SELECT {keys_sql('r.')}, l_returnflag, prediction, {_flags('RidgeClassifierCV')} FROM o JOIN r USING (rid)
"""


@query("clf_ridge_cv", RIDGE_CV_SQL)
def q_ridge_cv(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr(*LINE_KEY, "l_returnflag", "l_quantity AS a", "l_discount * 300 AS b")
    return run("clf_ridge_cv", Table.of(df, LINE_KEY, "l_returnflag", ["a", "b"], CLASSIFICATION))


NEIGHBOURS = f"""
WITH long AS MATERIALIZED ({EMBEDDING_LONG_SQL}),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, any_value(t.label) AS label, sum(pow(q.x - t.x, 2)) AS d2
      FROM long q JOIN long t ON q.i = t.i WHERE (({HASH_SQL.format(key='t.vec_id')}) < 1717986917)
        AND NOT (({HASH_SQL.format(key='q.vec_id')}) < 1717986917) GROUP BY 1, 2),
nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rank FROM d)
"""


@query(
    "clf_knn",
    NEIGHBOURS
    + f""", v AS (SELECT qid, label, count(*) AS n FROM nn WHERE rank <= 5 GROUP BY qid, label),
    o AS (SELECT qid, (max({{'n': n, 'l': -label}})).l * -1 AS prediction,
          {', '.join(f"coalesce(sum(CASE WHEN label = {k} THEN n END), 0) / 5.0e0 AS p{k}" for k in range(10))} FROM v GROUP BY qid)
    SELECT qid AS vec_id, e.label, prediction, {', '.join(f'round(p{k}, 6) + 0.0e0 AS "{k}_KNeighborsClassifierPrimPred"' for k in range(10))}
    FROM o JOIN embeddings e ON e.vec_id = qid""",
)
def q_knn(spark, sf):
    train, test = train_test_split(embeddings(spark, sf))
    return result(get_operator("clf_knn").fit(train).transform(test))


@query(
    "knn_neighbours",
    NEIGHBOURS + f"SELECT qid, rank::INTEGER AS rank, label AS y, {r6('d2', 'd2')} FROM nn WHERE rank <= 5",
)
def q_neighbours(spark, sf):
    """Distances and order, through small cells and blocks so that every path of the join runs."""
    train, test = train_test_split(embeddings(spark, sf))
    found = nearest(train, test, 5, block_rows=100, rows_per_pivot=50)
    return rounded(found.select(F.col("qkey.vec_id").alias("qid"), "rank", "y", "d2"))


@query(
    "ens_majority_vote",
    """
    WITH s AS (SELECT o_orderkey, o_orderstatus, (o_totalprice % 97) / 97 AS a, (o_custkey % 89) / 89.0e0 AS b,
                      (o_orderkey % 83) / 83.0e0 AS c FROM orders),
    v AS (SELECT o_orderkey, o_orderstatus, (a + b) / 2 AS f, (b + c) / 2 AS o, (c + a) / 2 AS p FROM s)
    SELECT o_orderkey, o_orderstatus, CASE WHEN f >= o AND f >= p THEN 'F' WHEN o >= p THEN 'O' ELSE 'P' END AS prediction,
           round(f, 6) + 0.0e0 AS "F_MajorityVotingPred", round(o, 6) + 0.0e0 AS "O_MajorityVotingPred",
           round(p, 6) + 0.0e0 AS "P_MajorityVotingPred" FROM v
    """,
)
def q_majority(spark, sf):
    """Two learners' probability columns, made from key arithmetic."""
    a, b, d = F.col("o_totalprice") % 97 / 97, F.col("o_custkey") % 89 / 89.0, F.col("o_orderkey") % 83 / 83.0
    cols = {"F_onePred": a, "F_twoPred": b, "O_onePred": b, "O_twoPred": d, "P_onePred": d, "P_twoPred": a}
    base = Table.of(load(spark, sf, "orders"), "o_orderkey", "o_orderstatus", [], CLASSIFICATION)
    return result(MajorityVote().fit_transform(base.derive(cols)))


# Metrics on a prediction that is a rule over the row.
RULE = "CASE WHEN l_quantity <= 15 THEN 'A' WHEN l_quantity <= 40 THEN 'N' ELSE 'X' END"


def _ruled(spark, sf):
    return load(spark, sf, "lineitem").selectExpr("l_returnflag AS y", f"{RULE} AS p", "l_quantity", "l_discount * 250 AS guess")


@query("metric_accuracy", f"SELECT {r6(f'avg((l_returnflag = {RULE})::INT)', 'accuracy')} FROM lineitem")
def q_accuracy(spark, sf):
    return rounded(METRICS["accuracy"](_ruled(spark, sf), "y", "p"))


@query(
    "metric_balanced_accuracy",
    f"""WITH v AS (SELECT l_returnflag AS y, {RULE} AS p FROM lineitem),
    k AS (SELECT y AS k FROM v UNION SELECT p FROM v),
    s AS (SELECT k, count(*) FILTER (WHERE y = k) AS t, count(*) FILTER (WHERE y = k AND p = k) AS tp,
                 count(*) FILTER (WHERE y <> k) AS n, count(*) FILTER (WHERE y <> k AND p <> k) AS tn FROM v, k GROUP BY k)
    SELECT {r6('avg(CASE WHEN t = 0 THEN 0 ELSE (tp / t + tn / n) / 2 END)', 'balanced_accuracy')} FROM s""",
)
def q_balanced(spark, sf):
    return rounded(METRICS["balanced_accuracy"](_ruled(spark, sf), "y", "p"))


@query("metric_mse", f"SELECT {r6('avg(pow(l_quantity - l_discount * 250, 2))', 'mse')} FROM lineitem")
def q_mse(spark, sf):
    return rounded(METRICS["mse"](_ruled(spark, sf), "l_quantity", "guess"))


CUSTOMER_CV = """
WITH f AS (SELECT c_custkey, c_mktsegment AS y, c_acctbal AS a, c_nationkey AS b, ntile(5) OVER (ORDER BY c_custkey) - 1 AS fold FROM customer),
k AS (SELECT range AS k FROM range(5)),
m AS (SELECT k, y, avg(a) AS ma, avg(b) AS mb FROM f, k WHERE fold <> k GROUP BY k, y),
d AS (SELECT c_custkey, f.y, k, arg_min(m.y, pow(a - ma, 2) + pow(b - mb, 2)) AS p FROM f JOIN m ON m.k = f.fold GROUP BY ALL),
s AS (SELECT k, avg((y = p)::INT) AS acc FROM d GROUP BY k)
"""


@query("metric_cv", CUSTOMER_CV + f"SELECT {r6('avg(acc)', 'score')} FROM s")
def q_cv(spark, sf):
    """Five contiguous folds of the customers, nearest centroid as the learner."""
    t = Table.of(load(spark, sf, "customer"), "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"], CLASSIFICATION)
    score = cross_validate(t, lambda part: get_operator("clf_nearest_centroid").fit(part), "accuracy", 5)
    return rounded(spark.createDataFrame([(score,)], "score double"))
