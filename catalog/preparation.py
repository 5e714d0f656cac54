"""Imputers, encoders, unions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import GAPS_SQL, gappy_lines, keys_sql, lines, load, query, r6, result, rounded
from tabloom import Table, get_operator
from tabloom.frame import c
from tabloom.operators.prepare import feature_union, sanitize_names
from tabloom.sources.splits import train_test_split

K = keys_sql()
NUM = ["qty", "price", "disc", "tax"]


def run(name, t, **params):
    return result(get_operator(name, **params).fit_transform(t))


@query("numeric_columns", f"WITH g AS ({GAPS_SQL}) SELECT {K}, qty, price, disc, tax FROM g")
def q_numeric(spark, sf):
    return run("numeric_columns", gappy_lines(spark, sf))


def _imputed(stat: str, suffix: str) -> str:
    m = ", ".join(f"{stat.format(n)} AS m_{n}" for n in NUM)
    cells = [r6(f"coalesce({n}, m_{n})", n if n == "price" else n + suffix) for n in NUM]
    return f"WITH g AS ({GAPS_SQL}), m AS (SELECT {m} FROM g) SELECT {K}, {', '.join(cells)} FROM g, m"


@query("impute_mean", _imputed("avg({})", "_imp_mean"))
def q_impute_mean(spark, sf):
    return run("impute_mean", gappy_lines(spark, sf))


@query("impute_median", _imputed("median({})", "_imp_median"))
def q_impute_median(spark, sf):
    return run("impute_median", gappy_lines(spark, sf))


@query(
    "impute_indicator",
    f"""WITH g AS ({GAPS_SQL}), m AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt FROM g)
    SELECT {K}, {r6('coalesce(qty, mq)', 'qty')}, {r6('price', 'price')}, {r6('coalesce(disc, md)', 'disc')},
           {r6('coalesce(tax, mt)', 'tax')}, (qty IS NULL)::INT::DOUBLE AS qty_miss_indicator,
           (disc IS NULL)::INT::DOUBLE AS disc_miss_indicator, (tax IS NULL)::INT::DOUBLE AS tax_miss_indicator
    FROM g, m""",
)
def q_impute_indicator(spark, sf):
    return run("impute_indicator", gappy_lines(spark, sf))


STATUS_HOT = ", ".join(
    f"""(coalesce(status, 'NaN') = '{v}')::INT::DOUBLE AS "one_hot__x0_{v}\"""" for v in ("F", "NaN", "O")
)


@query("one_hot", f"WITH g AS ({GAPS_SQL}) SELECT {K}, {STATUS_HOT} FROM g")
def q_one_hot(spark, sf):
    return run("one_hot", gappy_lines(spark, sf))


@query(
    "label_encode",
    """
    WITH b AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT p_brand AS level FROM part)),
         t AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT p_type AS level FROM part)),
         n AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT p_name AS level FROM part))
    SELECT p_partkey, b.code AS p_brand_lbl_enc, t.code AS p_type_lbl_enc, n.code AS p_name_lbl_enc
    FROM part JOIN b ON p_brand = b.level JOIN t ON p_type = t.level JOIN n ON p_name = n.level
    """,
)
def q_label_encode(spark, sf):
    t = Table.of(load(spark, sf, "part"), "p_partkey", None, ["p_brand", "p_type", "p_name"])
    return run("label_encode", t)


@query(
    "label_encode_long",
    """
    WITH n AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT c_name AS level FROM customer))
    SELECT c_custkey, n.code AS c_name_lbl_enc FROM customer JOIN n ON c_name = n.level
    """,
)
def q_label_encode_long(spark, sf):
    """One level per row: the mapping is a joined table, not a literal."""
    return run("label_encode", Table.of(load(spark, sf, "customer"), "c_custkey", None, ["c_name"]))


@query(
    "impute_label_encode",
    f"""WITH g AS ({GAPS_SQL}), m AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt FROM g)
    SELECT {K}, {r6('coalesce(qty, mq)', 'qty_imp_mean')}, {r6('price', 'price')},
           {r6('coalesce(disc, md)', 'disc_imp_mean')}, {r6('coalesce(tax, mt)', 'tax_imp_mean')},
           CASE coalesce(status, 'NaN') WHEN 'F' THEN 0 WHEN 'NaN' THEN 1 ELSE 2 END::BIGINT AS status_lbl_enc
    FROM g, m""",
)
def q_impute_label_encode(spark, sf):
    return run("impute_label_encode", gappy_lines(spark, sf))


@query(
    "impute_one_hot",
    f"""WITH g AS ({GAPS_SQL}), m AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt FROM g)
    SELECT {K}, {r6('coalesce(qty, mq)', 'qty_imp_mean')}, {r6('price', 'price')},
           {r6('coalesce(disc, md)', 'disc_imp_mean')}, {r6('coalesce(tax, mt)', 'tax_imp_mean')}, {STATUS_HOT}
    FROM g, m""",
)
def q_impute_one_hot(spark, sf):
    return run("impute_one_hot", gappy_lines(spark, sf))


@query(
    "one_hot_min_fraction",
    """
    WITH k AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 0.05 * (SELECT count(*) FROM documents))
    SELECT source, count(*) AS docs, sum((source IN (SELECT source FROM k))::INT)::DOUBLE AS named,
           sum((source NOT IN (SELECT source FROM k))::INT)::DOUBLE AS other FROM documents GROUP BY source
    """,
)
def q_one_hot_min_fraction(spark, sf):
    """Per level: in how many rows its own column or the shared one is set."""
    t = Table.of(load(spark, sf, "documents").withColumn("src", F.col("source")), "doc_id", "src", ["source"])
    o = get_operator("one_hot_min_fraction", minimum_fraction=0.05).fit_transform(t)
    named = F.lit(0.0)
    for n in o.features[:-1]:
        named = named + c(n)
    return o.df.groupBy(F.col("src").alias("source")).agg(
        F.count("*").alias("docs"), F.sum(named).alias("named"), F.sum(c(o.features[-1])).alias("other")
    )


@query(
    "feature_union",
    f"""WITH g AS ({GAPS_SQL}), m AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt FROM g)
    SELECT {K}, {r6('coalesce(qty, mq)', 'qty_imp_mean')}, {r6('price', 'price')},
           {r6('coalesce(disc, md)', 'disc_imp_mean')}, {r6('coalesce(tax, mt)', 'tax_imp_mean')}, {STATUS_HOT},
           CASE coalesce(status, 'NaN') WHEN 'F' THEN 0 WHEN 'NaN' THEN 1 ELSE 2 END::BIGINT AS status_lbl_enc
    FROM g, m""",
)
def q_feature_union(spark, sf):
    """Three branches of one table back together: they share their rows, so no join."""
    t = gappy_lines(spark, sf)
    mean, hot, codes = (get_operator(n) for n in ("impute_mean", "one_hot", "label_encode"))
    outs = [
        mean.columns(t, mean.learn(t)),
        hot.columns(t, hot.learn(t)),
        codes.attach(t, codes.learn(t))[1],
    ]
    wide = t.derive({name: col for out in outs for name, col in out.items()})
    return result(feature_union(*[replace(wide, features=tuple(out)) for out in outs]))


@query(
    "feature_union_join",
    f"""SELECT o_orderkey, {r6('o_totalprice / (SELECT max(o_totalprice) FROM orders)', 'o_totalprice_mxabsscale')},
    (o_orderstatus = 'F')::INT::DOUBLE AS one_hot__x0_F, (o_orderstatus = 'O')::INT::DOUBLE AS one_hot__x0_O,
    (o_orderstatus = 'P')::INT::DOUBLE AS one_hot__x0_P FROM orders""",
)
def q_feature_union_join(spark, sf):
    """Branches with different lineage meet on the row key."""
    t = Table.of(load(spark, sf, "orders"), "o_orderkey", None, ["o_orderstatus", "o_totalprice"])
    left = get_operator("maxabs_scale").fit_transform(t.pick(["o_totalprice"]))
    return result(feature_union(left, get_operator("one_hot").fit_transform(t)))


@query(
    "sanitize_names",
    f"""SELECT {K}, l_quantity AS "qtyabaqa1bebab", l_tax AS "taxcfckc0", l_discount AS "discdmdad.5" FROM lineitem""",
)
def q_sanitize(spark, sf):
    t = lines(spark, sf)
    named = t.derive({"qty[1]": c("l_quantity"), "tax<0": c("l_tax"), "disc>.5": c("l_discount")})
    named = Table(named.df, named.key, None, named.features)
    return result(sanitize_names(named))


@query(
    "fit_on_train_only",
    f"""WITH g AS ({GAPS_SQL}),
    h AS (SELECT *, (((((42 * 31 + (l_orderkey % 2147483647) * 1103515245 + 12345) % 2147483647) * 31
          + (l_linenumber::BIGINT % 2147483647) * 1103515245 + 12345) % 2147483647 * 31
          + (l_partkey % 2147483647) * 1103515245 + 12345) % 2147483647 * 31
          + (l_suppkey % 2147483647) * 1103515245 + 12345) % 2147483647 < 1717986917 AS train FROM g),
    m AS (SELECT avg(qty) AS mq FROM h WHERE train)
    SELECT {K}, {r6('coalesce(qty, mq)', 'qty_imp_mean')} FROM h, m WHERE NOT train""",
)
def q_fit_train(spark, sf):
    """The fill value comes from the training rows only."""
    train, test = train_test_split(gappy_lines(spark, sf, ["qty"]))
    return result(get_operator("impute_mean").fit(train).transform(test))
