"""Pipelines, run tables and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.contracts import CASES_SQL, NEEDS_SQL, RULES_SQL, profiles
from catalog.models import texts
from catalog.registry import GAPS_SQL, gappy_lines, keys_sql, load, query, r6, result, rounded
from tabloom.frame import CLASSIFICATION
from tabloom.plans.leaderboard import (
    baseline_leaderboard,
    best_pipeline,
    candidate_pipelines,
    candidate_steps,
    evaluate_train_test,
    score_vs_baselines,
    search_pipelines,
    trailing_mean,
    union_spec,
)
from tabloom.plans.pipeline import Pipeline, PipelineSpec, Step, pipeline_summary, redundant_steps
from tabloom.sources.splits import train_test_split

K = keys_sql()
KEY_HASH = """(((((42 * 31 + (l_orderkey % 2147483647) * 1103515245 + 12345) % 2147483647) * 31
  + (l_linenumber::BIGINT % 2147483647) * 1103515245 + 12345) % 2147483647 * 31
  + (l_partkey % 2147483647) * 1103515245 + 12345) % 2147483647 * 31
  + (l_suppkey % 2147483647) * 1103515245 + 12345) % 2147483647"""
GAPS_Y = GAPS_SQL.replace("SELECT l_orderkey", "SELECT l_returnflag, l_orderkey")

CENTROID_SQL = f"""
WITH g AS ({GAPS_Y}), h AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, {KEY_HASH} < 1717986917 AS train FROM g),
m AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt FROM h WHERE train),
i AS (SELECT rid, l_returnflag AS y, train, coalesce(qty, mq) AS a, price AS b, coalesce(disc, md) AS c, coalesce(tax, mt) AS d FROM h, m),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md, stddev_pop(a) AS sa, stddev_pop(b) AS sb,
             stddev_pop(c) AS sc, stddev_pop(d) AS sd FROM i WHERE train),
z AS (SELECT rid, y, train, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c, (d - md) / sd AS d FROM i, s),
k AS (SELECT y, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d FROM z WHERE train GROUP BY y),
o AS (SELECT rid, z.y, arg_min(k.y, pow(z.a - k.a, 2) + pow(z.b - k.b, 2) + pow(z.c - k.c, 2) + pow(z.d - k.d, 2)) AS prediction
      FROM z, k WHERE NOT z.train GROUP BY rid, z.y)
"""
CENTROID = PipelineSpec.chain("impute_mean", "standard_scale", "clf_nearest_centroid")


def numbers(spark, sf):
    return gappy_lines(spark, sf, ["qty", "price", "disc", "tax"], "l_returnflag")


@query(
    "pipeline_fit_transform",
    f"""{CENTROID_SQL} SELECT {keys_sql('h.')}, h.l_returnflag, prediction,
    {', '.join(f"(prediction = '{v}')::INT::DOUBLE AS {v}_NearestCentroidPred" for v in 'ANR')} FROM o JOIN h USING (rid)""",
)
def q_pipeline(spark, sf):
    """Fitted on the training rows, applied to the others."""
    train, test = train_test_split(numbers(spark, sf))
    return result(Pipeline(CENTROID).fit(train).transform(test))


@query("evaluate_train_test", f"{CENTROID_SQL} SELECT {r6('avg((y = prediction)::INT)', 'score')} FROM o")
def q_evaluate(spark, sf):
    score = evaluate_train_test(numbers(spark, sf), CENTROID)
    return rounded(spark.createDataFrame([(score,)], "score double"))


HOT = "(coalesce(status, 'NaN') = '{v}')::INT::DOUBLE"


@query(
    "pipeline_graph",
    f"""WITH g AS ({GAPS_SQL}), m AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt FROM g),
    i AS (SELECT *, coalesce(qty, mq) AS q2, coalesce(disc, md) AS d2, coalesce(tax, mt) AS t2 FROM g, m),
    s AS (SELECT min(q2) AS aq, max(q2) AS bq, min(price) AS ap, max(price) AS bp, min(d2) AS ad, max(d2) AS bd,
                 min(t2) AS a_t, max(t2) AS b_t FROM i)
    SELECT {K}, {r6('(q2 - aq) / (bq - aq)', 'qty_imp_mean_mnmxscale')}, {r6('(price - ap) / (bp - ap)', 'price_mnmxscale')},
    {r6('(d2 - ad) / (bd - ad)', 'disc_imp_mean_mnmxscale')}, {r6('(t2 - a_t) / (b_t - a_t)', 'tax_imp_mean_mnmxscale')},
    {', '.join(HOT.format(v=v) + f' AS one_hot__x0_{v}' for v in ('F', 'NaN', 'O'))} FROM i, s""",
)
def q_graph(spark, sf):
    """Two branches from the raw table meet in one scaler; there is no join in the plan."""
    spec = PipelineSpec((Step(1, "impute_mean", (0,)), Step(2, "one_hot", (0,)), Step(3, "minmax_scale", (1, 2))))
    return result(Pipeline(spec).fit(gappy_lines(spark, sf)).output())


# Conversations read as step lists: the role gives the family, each step reads the one two before it.
FAMILY = {"user": "data preprocess", "assistant": "Classifier"}
STEPS_SQL = """WITH s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'data preprocess' WHEN 'assistant' THEN 'Classifier'
  ELSE 'ensemble' END AS family FROM conversations)"""


def _steps(spark, sf):
    family = F.when(F.col("role") == "user", FAMILY["user"]).when(F.col("role") == "assistant", FAMILY["assistant"]).otherwise("ensemble")
    return load(spark, sf, "conversations").select(F.col("conv_id").alias("pipeline"), F.col("turn").alias("step"), family.alias("family"))


@query(
    "pipeline_summary",
    STEPS_SQL
    + """ SELECT conv_id AS pipeline, count(*) AS steps, sum((family = 'data preprocess')::INT)::BIGINT AS data_preprocess,
    0::BIGINT AS feature_preprocess, 0::BIGINT AS feature_selection, 0::BIGINT AS feature_engineering,
    sum((family = 'Classifier')::INT)::BIGINT AS "Classifier", 0::BIGINT AS "Regressor", sum((family = 'ensemble')::INT)::BIGINT AS ensemble,
    sum((family <> 'data preprocess')::INT)::BIGINT AS estimators, sum((family = 'data preprocess')::INT)::BIGINT AS preprocessors,
    round(CASE WHEN sum((family = 'data preprocess')::INT) > 0
         THEN sum((family <> 'data preprocess')::INT) / sum((family = 'data preprocess')::INT) ELSE -1 END, 6) + 0.0e0 AS ratio
    FROM s GROUP BY conv_id""",
)
def q_summary(spark, sf):
    return rounded(pipeline_summary(_steps(spark, sf)))


@query(
    "redundant_steps",
    STEPS_SQL
    + """ SELECT conv_id AS pipeline, turn AS step FROM s WHERE family <> 'Classifier'
    AND NOT EXISTS (SELECT 1 FROM s r WHERE r.conv_id = s.conv_id AND r.turn - 2 = s.turn)""",
)
def q_redundant(spark, sf):
    steps = _steps(spark, sf)
    edges = steps.select("pipeline", "step", (F.col("step") - 2).alias("input"))
    return redundant_steps(steps, edges).select("pipeline", "step")


# Orders and events as run tables: score per run and dataset.
def _runs(spark, sf):
    return load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("run"), F.floor(F.col("o_totalprice") / 1000).alias("score")
    )


@query(
    "best_pipeline",
    """WITH r AS (SELECT o_orderpriority AS dataset, o_orderkey AS run, floor(o_totalprice / 1000)::BIGINT AS score FROM orders)
    SELECT dataset, run, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, run DESC) AS rn FROM r) WHERE rn = 1""",
)
def q_best(spark, sf):
    return best_pipeline(_runs(spark, sf))


@query(
    "trailing_mean",
    f"""WITH r AS (SELECT o_orderpriority AS dataset, o_orderkey AS run, floor(o_totalprice / 1000)::BIGINT AS score FROM orders)
    SELECT dataset, run, {r6('avg(score) OVER (PARTITION BY dataset ORDER BY run ROWS 99 PRECEDING)', 'trailing')} FROM r""",
)
def q_trailing(spark, sf):
    return rounded(trailing_mean(_runs(spark, sf), rows_per_range=500).select("dataset", "run", "trailing"))


BASELINES = "SELECT event_type AS dataset, hour(ts) // 3 AS learner, avg(value) AS score FROM events GROUP BY 1, 2"


@query(
    "score_vs_baselines",
    f"""WITH b AS ({BASELINES}) SELECT e.event_type AS dataset, event_id AS run, {r6('avg((b.score <= value)::INT)', 'reward')}
    FROM events e JOIN b ON b.dataset = e.event_type GROUP BY ALL""",
)
def q_versus(spark, sf):
    """Runs are the events; a dataset's baselines are eight mean values over the day."""
    events = load(spark, sf, "events")
    runs = events.select(F.col("event_type").alias("dataset"), F.col("event_id").alias("run"), F.col("value").alias("score"))
    learner = F.floor(F.hour("ts") / 3)
    base = events.groupBy(F.col("event_type").alias("dataset"), learner.alias("learner")).agg(F.avg("value").alias("score"))
    return rounded(score_vs_baselines(runs, base).select("dataset", "run", "reward"))


OPERATORS_SQL = """ops(operator, contract, need) AS (VALUES
 ('numeric_columns', 'a', 'has_categorical'), ('impute_mean', 'a', 'has_missing'), ('impute_median', 'a', 'has_missing'),
 ('impute_indicator', 'b', 'has_missing'), ('one_hot', 'b', 'has_categorical'), ('label_encode', 'b', 'has_categorical'),
 ('impute_label_encode', 'b', 'has_missing_and_categorical'), ('impute_one_hot', 'b', 'has_missing_and_categorical'),
 ('standard_scale', 'c_t', 'always'), ('kbins_ordinal', 'c_t_kbins', 'always'), ('select_chi2_kbest', 'd', 'three_columns'),
 ('select_f_regression_kbest', 'c_r', 'three_columns'), ('pca_arpack', 'c_t_arpck', 'always'), ('kernel_pca', 'c_t_krnl', 'always'),
 ('clf_gaussian_nb', 'c', 'always'), ('clf_xgb', 'xgb', 'always'), ('reg_ard', 'c_r', 'always'), ('ens_majority_vote', 'c_majority', 'always'))"""
OPERATORS = (
    "numeric_columns impute_mean impute_median impute_indicator one_hot label_encode impute_label_encode impute_one_hot "
    "standard_scale kbins_ordinal select_chi2_kbest select_f_regression_kbest pca_arpack kernel_pca clf_gaussian_nb clf_xgb "
    "reg_ard ens_majority_vote"
).split()


@query(
    "candidate_pipelines",
    CASES_SQL.rstrip()
    + f", {OPERATORS_SQL}, ac AS ("
    + " UNION ALL ".join(f"SELECT name, '{k}' AS contract FROM facts WHERE {v}" for k, v in RULES_SQL.items())
    + "), nd AS ("
    + " UNION ALL ".join(f"SELECT name, '{k}' AS need FROM facts WHERE {v}" for k, v in NEEDS_SQL.items())
    + ") SELECT ac.name AS input, operator FROM ops JOIN ac USING (contract) JOIN nd ON nd.need = ops.need AND nd.name = ac.name",
)
def q_candidates(spark, sf):
    """Which next steps are legal and useful on each of several tables."""
    rows = candidate_steps(profiles(spark, sf), "", CLASSIFICATION, OPERATORS)
    return spark.createDataFrame(rows, "input string, operator string")


@query("baseline_leaderboard")
def q_leaderboard(spark, sf):
    return rounded(baseline_leaderboard(texts(spark, sf), "texts").select("dataset", "pipeline", "score"))


@query("search_pipelines")
def q_search(spark, sf):
    """Candidates from the families, scored on held-out rows, best first."""
    t = texts(spark, sf)
    specs = candidate_pipelines(
        t,
        ["clf_gaussian_nb", "clf_nearest_centroid", "clf_lda"],
        ["feature preprocess", "feature selection"],
        {"feature preprocess": ["standard_scale", "minmax_scale"], "feature selection": ["variance_threshold"]},
    )
    return rounded(search_pipelines(t, specs, "texts", "balanced_accuracy").select("pipeline", "score", "status"))


def _centroid_sql(name: str, columns: list[str]) -> str:
    gap = " + ".join(f"pow(z.{n} - k.{n}, 2)" for n in columns)
    means = ", ".join(f"avg({n}) AS {n}" for n in columns)
    return f"""SELECT '{name}' AS pipeline, {r6('avg((y = prediction)::INT)', 'score')} FROM (SELECT rid, z.y, arg_min(k.y, {gap}) AS prediction
      FROM u z, (SELECT y, {means} FROM u WHERE train GROUP BY y) k WHERE NOT z.train GROUP BY rid, z.y)"""


UNION_SQL = CENTROID_SQL[: CENTROID_SQL.index("k AS (SELECT y, avg(a)")] + """
r AS (SELECT min(a) AS la, min(b) AS lb, min(c) AS lc, min(d) AS ld, max(a) AS ha, max(b) AS hb, max(c) AS hc, max(d) AS hd FROM i WHERE train),
u AS MATERIALIZED (SELECT z.*, (i.a - la) / (ha - la) AS e, (i.b - lb) / (hb - lb) AS f, (i.c - lc) / (hc - lc) AS g,
                   (i.d - ld) / (hd - ld) AS h FROM z JOIN i USING (rid), r)
"""
UNION_CASES = {
    "impute_mean0standard_scale1clf_nearest_centroid2": list("abcd"),
    "impute_mean0minmax_scale1clf_nearest_centroid2": list("efgh"),
    "impute_mean0standard_scale1minmax_scale1clf_nearest_centroid2_3": list("abcdefgh"),
}


@query("search_unions", UNION_SQL + " UNION ALL ".join(_centroid_sql(n, c) for n, c in UNION_CASES.items()))
def q_unions(spark, sf):
    """Two chains and the union of their scales; the imputation that all share is fitted once."""
    scales = [("impute_mean", "standard_scale"), ("impute_mean", "minmax_scale")]
    specs = [*(PipelineSpec.chain(*s, "clf_nearest_centroid") for s in scales), union_spec(scales, "clf_nearest_centroid")]
    return rounded(search_pipelines(numbers(spark, sf), {s.id: s for s in specs}, "lines").select("pipeline", "score"))
