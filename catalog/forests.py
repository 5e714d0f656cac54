"""Own tree learners, checked by SQL: one boosting round, balanced bootstraps, trees that know every row they have seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import embeddings, keys_sql, lines, query, r6, result
from tabloom import get_operator
from tabloom.frame import c
from tabloom.functions.stats import classes
from tabloom.operators.bootstrap import balanced_bootstrap

FEW_VALUED = ("l_quantity", "l_discount", "l_tax")
BOOSTED_LONG = " UNION ALL ".join(f"SELECT rid, l_returnflag AS y, {i} AS f, {n} AS x FROM r" for i, n in enumerate(FEW_VALUED))
PREDICTED = ", ".join(r6(f"max(e / s) FILTER (c = '{v}')", f"{v}_GradientBoostingClassifierPred") for v in ("A", "N", "R"))


# A tree of one cut per class: gradients are share - indicator, curvatures 1.5 share (1 - share) for three classes.
@query(
    "gradient_boosting_round",
    f"""WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM lineitem), long AS MATERIALIZED ({BOOSTED_LONG}),
    cls AS (SELECT l_returnflag AS c, count(*)::DOUBLE AS nc, sum(count(*)) OVER ()::DOUBLE AS n, nc / n AS p FROM r GROUP BY 1),
    v AS (SELECT f, x, c, count(*) AS held, count(*) FILTER (y = c) AS own FROM long, cls GROUP BY f, x, c),
    run AS (SELECT v.f, v.x, c, n, nc, p, sum(held) OVER w AS l, sum(own) OVER w AS lc, max(x) OVER (PARTITION BY f) AS top FROM v JOIN cls USING (c)
            WINDOW w AS (PARTITION BY f, c ORDER BY x)),
    g AS (SELECT *, l * p - lc AS gl, (n - l) * p - (nc - lc) AS gr, 1.5e0 * l * p * (1 - p) AS hl, 1.5e0 * (n - l) * p * (1 - p) AS hr FROM run WHERE x < top),
    best AS (SELECT c, p, f, x AS cut, -0.1e0 * gl / hl AS low, -0.1e0 * gr / hr AS high FROM g
             QUALIFY row_number() OVER (PARTITION BY c ORDER BY gl * gl / hl + gr * gr / hr DESC, f, x) = 1),
    m AS (SELECT rid, c, exp(ln(p) + CASE WHEN long.x <= cut THEN low ELSE high END) AS e FROM best JOIN long USING (f)),
    s AS (SELECT rid, c, e, sum(e) OVER (PARTITION BY rid) AS s FROM m),
    o AS (SELECT rid, arg_max(c, e) AS prediction, {PREDICTED} FROM s GROUP BY rid)
    SELECT {keys_sql('r.')}, l_returnflag, o.* EXCLUDE (rid) FROM o JOIN r USING (rid)""",
)
def q_boosting_round(spark, sf):
    return result(get_operator("clf_gradient_boosting", rounds=1, depth=1).fit_transform(lines(spark, sf, FEW_VALUED)))


@query(
    "balanced_bootstrap_totals",
    """SELECT tree, CAST(l_returnflag AS VARCHAR) AS y, (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)) AS drawn
    FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT CAST(i AS INTEGER) AS tree FROM range(20) g(i))""",
)
def q_bootstrap(spark, sf):
    """Twenty trees draw as many rows of each class as the smallest class has; counts per row and tree add up to that."""
    t = lines(spark, sf, ["l_quantity"])
    names = classes(t)
    rows = balanced_bootstrap(t, names, 20)
    sums = rows.groupBy("y").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(20)])
    label = F.get(F.array(*[F.lit(v) for v in names]), F.col("y"))
    return sums.select(label.alias("y"), F.posexplode(F.array(*[f"w{i}" for i in range(20)])).alias("tree", "drawn"))


# Trees without a depth limit end in pure leaves, so a row that was learned is told right, whatever the cuts.
@query("memorises_clf_extra_trees", "SELECT vec_id, label AS prediction FROM embeddings")
def q_memory(spark, sf):
    out = get_operator("clf_extra_trees", depth=1000).fit_transform(embeddings(spark, sf))
    return out.df.select("vec_id", c("prediction").cast("int").alias("prediction"))
