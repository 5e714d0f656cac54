"""Components, independent components and random tree leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    EMBEDDING_LONG_SQL,
    LINE_KEY,
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
from tabloom.frame import c

K = keys_sql()


def pair(spark, sf) -> Table:
    df = load(spark, sf, "lineitem").selectExpr(*LINE_KEY, "l_quantity AS a", "l_discount * 300 AS b")
    return Table.of(df, LINE_KEY, None, ["a", "b"])


LINES_SQL = f"SELECT {K}, l_quantity AS a, l_discount * 300 AS b FROM lineitem"


def axes_sql(centred: bool, suffix: str, count: int, source: str = LINES_SQL, key: str = K) -> str:
    """Both eigenvectors of a 2 x 2 moment matrix; the larger loading is positive."""
    ma, mb = ("avg(a)", "avg(b)") if centred else ("0 * count(*)", "0 * count(*)")
    first = r6("(a - ma) * ux + (b - mb) * uy", f"a{suffix}")
    second = r6("(a - ma) * wx + (b - mb) * wy", f"b{suffix}")
    return f"""
    WITH r AS ({source}),
    c AS (SELECT {ma} AS ma, {mb} AS mb FROM r),
    m AS (SELECT sum((a - ma) * (a - ma)) AS p, sum((a - ma) * (b - mb)) AS q, sum((b - mb) * (b - mb)) AS s FROM r, c),
    l AS (SELECT p, q, s, (p + s + sqrt(pow(p - s, 2) + 4 * q * q)) / 2 AS top FROM m),
    v AS (SELECT q / sqrt(q * q + pow(top - p, 2)) AS x, (top - p) / sqrt(q * q + pow(top - p, 2)) AS y FROM l),
    u AS (SELECT CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END * x AS ux,
                 CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END * y AS uy FROM v),
    w AS (SELECT ux, uy, CASE WHEN abs(uy) >= abs(ux) THEN sign(-uy) ELSE sign(ux) END * -uy AS wx,
                 CASE WHEN abs(uy) >= abs(ux) THEN sign(-uy) ELSE sign(ux) END * ux AS wy FROM u)
    SELECT {key}, {first}{', ' + second if count == 2 else ''} FROM r, c, w"""


for _name, _centred, _suffix, _count in (
    ("pca_full", True, "_pcalpck", 2),
    ("pca_arpack", True, "_pcaarpck", 1),
    ("pca_randomized", True, "_pcarndmzd", 2),
    ("pca_incremental", True, "_pcaincrmnt", 2),
    ("kernel_pca", True, "_pcakrnl", 1),
    ("truncated_svd", False, "_pcatrnckd", 1),
):

    def _run(spark, sf, op=_name):
        return result(get_operator(op).fit_transform(pair(spark, sf)))

    query(_name, axes_sql(_centred, _suffix, _count))(_run)


@query("pca_wide")
def q_pca_wide(spark, sf):
    """All 64 embedding columns: moments through Arrow batches."""
    return result(get_operator("pca_full").fit_transform(embeddings(spark, sf)))


@query("pca_sketch")
def q_pca_sketch(spark, sf):
    """Eight leading axes of 64 by block subspace iteration."""
    return result(get_operator("pca_randomized", components=8).fit_transform(embeddings(spark, sf)))


@query(
    "pca_sketch_norms",
    f"""WITH long AS ({EMBEDDING_LONG_SQL}), m AS (SELECT i, avg(x) AS m FROM long GROUP BY i)
    SELECT vec_id, {r6('sum(pow(x - m, 2))', 'norm')} FROM long JOIN m USING (i) GROUP BY vec_id""",
)
def q_pca_sketch_norms(spark, sf):
    """All 64 axes, from the triangle of a tall-skinny QR, keep every centred row's length."""
    out = get_operator("pca_randomized").fit_transform(embeddings(spark, sf))
    return rounded(out.df.select("vec_id", _squares(out).alias("norm")))


@query("fast_ica")
def q_ica(spark, sf):
    return result(get_operator("fast_ica").fit_transform(lines(spark, sf, wide=True)))


@query("random_trees_embedding")
def q_trees_embedding(spark, sf):
    return result(get_operator("random_trees_embedding").fit_transform(lines(spark, sf, wide=True)))


@query(
    "pca_wide_norms",
    f"""WITH long AS ({EMBEDDING_LONG_SQL}), m AS (SELECT i, avg(x) AS m FROM long GROUP BY i)
    SELECT vec_id, {r6('sum(pow(x - m, 2))', 'norm')} FROM long JOIN m USING (i) GROUP BY vec_id""",
)
def q_pca_wide_norms(spark, sf):
    """An orthogonal map keeps every centred row's length, over all 64 components."""
    out = get_operator("pca_full").fit_transform(embeddings(spark, sf))
    return rounded(out.df.select("vec_id", _squares(out).alias("norm")))


@query(
    "fast_ica_norms",
    f"""WITH r AS (SELECT {K}, l_quantity AS a, l_discount * 300 AS b FROM lineitem),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS p, covar_pop(a, b) AS q, var_pop(b) AS s FROM r)
    SELECT {K}, {r6('(s * pow(a - ma, 2) - 2 * q * (a - ma) * (b - mb) + p * pow(b - mb, 2)) / (p * s - q * q)', 'norm')} FROM r, m""",
)
def q_ica_norms(spark, sf):
    """Independent components are white: a row's length is its Mahalanobis distance, whatever the rotation."""
    out = get_operator("fast_ica").fit_transform(pair(spark, sf))
    return rounded(out.df.select(*LINE_KEY, _squares(out).alias("norm")))


@query(
    "random_trees_leaf_count",
    f"SELECT {K}, 10.0e0 AS leaves FROM lineitem",
)
def q_leaf_count(spark, sf):
    """Every row ends in exactly one leaf of each of the ten trees."""
    out = get_operator("random_trees_embedding").fit_transform(lines(spark, sf, wide=True))
    total = F.aggregate(F.array(*[c(n) for n in out.features]), F.lit(0.0), lambda a, v: a + v)
    return out.df.select(*LINE_KEY, total.alias("leaves"))


def _squares(t: Table):
    return F.aggregate(F.array(*[c(n) for n in t.features]), F.lit(0.0), lambda a, v: a + v * v)
