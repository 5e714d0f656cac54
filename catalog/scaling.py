"""Scalers, shape transforms, bins and feature products."""

from __future__ import annotations

from catalog.registry import LINE_KEY, LINE_NUMBERS, keys_sql, lines, load, query, r6, result
from tabloom import Table, get_operator

K = keys_sql()


def unlabelled(spark, sf, features=LINE_NUMBERS, wide=False) -> Table:
    t = lines(spark, sf, features, wide=wide)
    return Table(t.df, t.key, None, t.features)


def _scaled(stats: str, cell: str, suffix: str, names=LINE_NUMBERS) -> str:
    """``stats`` and ``cell`` mention {n}; statistics are computed once over the table."""
    s = ", ".join(stats.format(n=n) for n in names)
    cells = ", ".join(r6(cell.format(n=n), n + suffix) for n in names)
    return f"WITH s AS (SELECT {s} FROM lineitem) SELECT {K}, {cells} FROM lineitem, s"


SCALERS = {
    "minmax_scale": _scaled(
        "min({n}) AS a_{n}, max({n}) AS b_{n}",
        "({n} - a_{n}) / CASE WHEN b_{n} = a_{n} THEN 1 ELSE b_{n} - a_{n} END",
        "_mnmxscale",
    ),
    "maxabs_scale": _scaled("max(abs({n})) AS a_{n}", "{n} / CASE WHEN a_{n} = 0 THEN 1 ELSE a_{n} END", "_mxabsscale"),
    "robust_scale": _scaled(
        "median({n}) AS m_{n}, quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) AS w_{n}",
        "({n} - m_{n}) / CASE WHEN w_{n} = 0 THEN 1 ELSE w_{n} END",
        "_rbstscale",
    ),
    "standard_scale": _scaled("avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}", "({n} - m_{n}) / s_{n}", "_stndrdscale"),
}
for _name, _sql in SCALERS.items():

    def _run(spark, sf, op=_name):
        return result(get_operator(op).fit_transform(unlabelled(spark, sf)))

    query(_name, _sql)(_run)

SQUARES = " + ".join(f"{n} * {n}" for n in LINE_NUMBERS)


@query(
    "normalize_rows",
    f"""WITH z AS (SELECT *, sqrt({SQUARES}) AS norm FROM lineitem)
    SELECT {K}, {', '.join(r6(f'{n} / CASE WHEN norm = 0 THEN 1 ELSE norm END', n + '_nrmlzr') for n in LINE_NUMBERS)} FROM z""",
)
def q_normalize(spark, sf):
    return result(get_operator("normalize_rows").fit_transform(unlabelled(spark, sf)))


def _quantile_sql(marks: int) -> str:
    """Repeated landmarks keep their first and last position; each distinct value is placed once."""
    probs = f"[i / {marks - 1}.0e0 for i in range({marks})]"
    parts = []
    for t, n in (("a", "l_quantity"), ("b", "l_extendedprice")):
        parts.append(f"""
m{t} AS (SELECT {t}[i + 1] AS x, min(p) AS first, max(p) AS last FROM q, probs GROUP BY 1),
n{t} AS (SELECT x, first, last, lead(x) OVER (ORDER BY x) AS nx, lead(first) OVER (ORDER BY x) AS nf FROM m{t}),
v{t} AS (SELECT v, CASE WHEN v <= (SELECT min(x) FROM m{t}) THEN 0 WHEN v >= (SELECT max(x) FROM m{t}) THEN 1
              WHEN v = x THEN (first + last) / 2 ELSE last + (nf - last) * (v - x) / (nx - x) END AS y
       FROM (SELECT DISTINCT {n} AS v FROM lineitem) ASOF JOIN n{t} ON v >= x)""")
    return f"""
WITH probs AS (SELECT i, i / {marks - 1}.0e0 AS p FROM range({marks}) g(i)),
q AS (SELECT quantile_cont(l_quantity, {probs}) AS a, quantile_cont(l_extendedprice, {probs}) AS b FROM lineitem),
{",".join(parts)}
SELECT {K}, {r6('va.y', 'l_quantity_qntl')}, {r6('vb.y', 'l_extendedprice_qntl')}
FROM lineitem JOIN va ON va.v = l_quantity JOIN vb ON vb.v = l_extendedprice
"""


@query("quantile_transform", _quantile_sql(1000))
def q_quantile(spark, sf):
    t = unlabelled(spark, sf, ["l_quantity", "l_extendedprice"])
    return result(get_operator("quantile_transform").fit_transform(t))


@query("quantile_transform_100", _quantile_sql(101))
def q_quantile_100(spark, sf):
    t = unlabelled(spark, sf, ["l_quantity", "l_extendedprice"])
    return result(get_operator("quantile_transform", landmarks=101).fit_transform(t))


def _power(n: str, lam: float) -> str:
    return f"(pow({n} + 1, {lam}) - 1) / {lam}"


@query(
    "power_transform_fixed",
    f"""WITH y AS (SELECT {K}, {_power('l_quantity', 0.5)} AS a, {_power('l_extendedprice', 0.25)} AS b FROM lineitem),
    s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM y)
    SELECT {K}, {r6('(a - ma) / sa', 'l_quantity_pwrtrnsfrm')}, {r6('(b - mb) / sb', 'l_extendedprice_pwrtrnsfrm')} FROM y, s""",
)
def q_power_fixed(spark, sf):
    t = unlabelled(spark, sf, ["l_quantity", "l_extendedprice"])
    return result(get_operator("power_transform", exponents=[0.5, 0.25]).fit_transform(t))


@query("power_transform")
def q_power(spark, sf):
    return result(get_operator("power_transform").fit_transform(unlabelled(spark, sf, wide=True)))


BINNED = ["l_quantity", "l_extendedprice", "l_discount"]
EDGES_SQL = "SELECT " + ", ".join(
    f"list_sort(list_distinct(quantile_cont({n}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e_{n}" for n in BINNED
) + " FROM lineitem"


def _bin(n: str) -> str:
    return f"len(list_filter(e_{n}[2:len(e_{n}) - 1], lambda e: e <= {n}))"


@query(
    "kbins_ordinal",
    f"WITH e AS ({EDGES_SQL}) SELECT {K}, "
    + ", ".join(f'{_bin(n)}::DOUBLE AS "{n}_ordnldscrtzr"' for n in BINNED)
    + " FROM lineitem, e",
)
def q_kbins(spark, sf):
    return result(get_operator("kbins_ordinal").fit_transform(unlabelled(spark, sf, BINNED)))


@query(
    "kbins_one_hot",
    f"WITH e AS ({EDGES_SQL}) SELECT {K}, "
    + ", ".join(f'({_bin(n)} = {j})::INT::DOUBLE AS "{n}_onhtbnrzr{j}"' for n in BINNED for j in range(5))
    + " FROM lineitem, e",
)
def q_kbins_hot(spark, sf):
    return result(get_operator("kbins_one_hot").fit_transform(unlabelled(spark, sf, BINNED)))


# Prices in units of 70001, so that six decimals are within double precision.
SMALL = {"q": "l_quantity", "price": "l_extendedprice / 70001", "disc": "l_discount", "tax": "l_tax"}
SMALL_SQL = f"WITH f AS (SELECT {K}, {', '.join(f'{e} AS {n}' for n, e in SMALL.items())} FROM lineitem)"
PAIRS = [(a, b) for i, a in enumerate(SMALL) for b in list(SMALL)[i + 1 :]]


def small(spark, sf) -> Table:
    df = load(spark, sf, "lineitem").selectExpr(*LINE_KEY, *[f"{e} AS {n}" for n, e in SMALL.items()])
    return Table.of(df, LINE_KEY, None, list(SMALL))


def _products(squares: bool) -> str:
    cells = [r6(n, n) for n in SMALL]
    cells += [r6(f"{n} * {n}", f"{n}^2") for n in SMALL] if squares else []
    cells += [r6(f"{a} * {b}", f"{a} {b}") for a, b in PAIRS]
    return f"{SMALL_SQL} SELECT {K}, {', '.join(cells)} FROM f"


@query("polynomial_features", _products(True))
def q_polynomial(spark, sf):
    return result(get_operator("polynomial_features").fit_transform(small(spark, sf)))


@query("interaction_features", _products(False))
def q_interaction(spark, sf):
    return result(get_operator("interaction_features").fit_transform(small(spark, sf)))
