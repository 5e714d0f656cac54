"""Acceptance contracts and need checks on several column sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import GAPS, LINE_NUMBERS, load, query
from tabloom.frame import CLASSIFICATION, REGRESSION
from tabloom.plans.contracts import Case, accepts, needed, profile_cases

# What each case is made of, in SQL over the same tables: one row per case with
# rows, columns, text columns, missing cells, negative cells, fewest distinct values.
CASES_SQL = """
WITH facts AS (
  SELECT 'numbers' AS name, count(*) AS n, 4 AS p, 0 AS texts, 0 AS gaps, 'classification' AS task,
         sum((l_quantity < 0)::INT + (l_extendedprice < 0)::INT + (l_discount < 0)::INT + (l_tax < 0)::INT) AS neg,
         least(count(DISTINCT l_quantity), count(DISTINCT l_extendedprice), count(DISTINCT l_discount), count(DISTINCT l_tax)) AS fewest,
         0 AS preds FROM lineitem
  UNION ALL SELECT 'binnable', count(*), 2, 0, 0, 'classification', 0,
         least(count(DISTINCT l_quantity), count(DISTINCT l_discount)), 0 FROM lineitem
  UNION ALL SELECT 'gaps', count(*), 2, 0,
         count(*) FILTER (WHERE l_linenumber = 3) + count(*) FILTER (WHERE l_tax = 0), 'classification', 0,
         least(count(DISTINCT l_quantity), count(DISTINCT nullif(l_tax, 0))), 0 FROM lineitem
  UNION ALL SELECT 'texts', count(*), 2, 2, 0, 'classification', 0,
         least(count(DISTINCT l_linestatus), count(DISTINCT l_returnflag)), 0 FROM lineitem
  UNION ALL SELECT 'mixed_gaps', count(*), 2, 1,
         count(*) FILTER (WHERE l_linenumber = 3) + count(*) FILTER (WHERE l_linenumber = 2), 'classification', 0,
         least(count(DISTINCT l_quantity), count(DISTINCT l_linestatus)), 0 FROM lineitem
  UNION ALL SELECT 'negatives', count(*), 1, 0, 0, 'classification', count(*) FILTER (WHERE c_acctbal < 0),
         count(DISTINCT c_acctbal), 0 FROM customer
  UNION ALL SELECT 'regression', count(*), 2, 0, 0, 'regression', 0,
         least(count(DISTINCT l_quantity), count(DISTINCT l_discount)), 0 FROM lineitem
  UNION ALL SELECT 'predictions', count(*), 2, 0, 0, 'classification', 0,
         least(count(DISTINCT l_discount), count(DISTINCT l_tax)), 2 FROM lineitem
  UNION ALL SELECT 'empty', count(*), 2, 0, 0, 'classification', 0, 0, 0 FROM lineitem WHERE l_quantity < 0)
"""


def _case_args(*features: str, **named: str) -> tuple[tuple, dict]:
    """Expressions are made when a session is there."""
    return features, named


def _case(*features: str, task: str = CLASSIFICATION, where: str | None = None, **named: str) -> Case:
    columns = {n: F.expr(n) for n in features} | {n: F.expr(e) for n, e in named.items()}
    return Case(columns, task, None if where is None else F.expr(where))


LINE_CASES = {
    "numbers": _case_args(*LINE_NUMBERS),
    "binnable": _case_args("l_quantity", "l_discount"),
    "gaps": _case_args(qty=GAPS["qty"], tax=GAPS["tax"]),
    "texts": _case_args("l_linestatus", "l_returnflag"),
    "mixed_gaps": _case_args(qty=GAPS["qty"], status=GAPS["status"]),
    "regression": _case_args("l_quantity", "l_discount", task=REGRESSION),
    "predictions": _case_args(A_onePred="l_discount", R_onePred="l_tax"),
    "empty": _case_args("l_quantity", "l_discount", where="l_quantity < 0"),
}
CUSTOMER_CASES = {"negatives": _case_args("c_acctbal")}


def profiles(spark, sf) -> dict:
    """The profiles of all cases, from one aggregate over each of the two tables."""
    found = {}
    for name, asked in (("lineitem", LINE_CASES), ("customer", CUSTOMER_CASES)):
        found |= profile_cases(load(spark, sf, name), {k: _case(*a, **b) for k, (a, b) in asked.items()})
    return found


CLEAN = "n > 0 AND texts = 0 AND gaps = 0"
CLS = "task = 'classification'"
RULES_SQL = {
    "a": "n > 0 AND p > texts",
    "b": "n > 0 AND p > 0",
    "c": f"{CLEAN} AND {CLS}",
    "c_r": f"{CLEAN} AND task = 'regression'",
    "c_t": CLEAN,
    "c_t_arpck": f"{CLEAN} AND least(n, p) <> 1",
    "c_t_krnl": f"{CLEAN} AND p >= 2",
    "c_majority": f"{CLEAN} AND {CLS} AND preds = p",
    "d": f"{CLEAN} AND {CLS} AND neg = 0",
    "e": f"{CLEAN} AND {CLS} AND preds = p",
    "c_t_kbins": f"{CLEAN} AND fewest >= 10",
    "kbinsohe": f"{CLEAN} AND fewest >= 10",
    "xgb": f"n > 0 AND texts = 0 AND {CLS}",
}
NEEDS_SQL = {
    "always": "true",
    "has_categorical": "texts > 0",
    "has_missing": "gaps > 0",
    "has_missing_and_categorical": "gaps > 0 AND texts > 0",
    "three_columns": "p >= 3",
}
GROUPS = {
    "accepts_a": ["a"],
    "accepts_b": ["b"],
    "accepts_c": ["c", "c_r", "c_t", "c_t_arpck", "c_t_krnl", "c_majority"],
    "accepts_d": ["d"],
    "accepts_e": ["e"],
    "accepts_kbins": ["c_t_kbins", "kbinsohe"],
    "accepts_xgb": ["xgb"],
}


def _rules_sql(rules: dict[str, str]) -> str:
    return CASES_SQL + " UNION ALL ".join(
        f"SELECT name AS table_case, '{k}' AS rule, ({v})::INT AS holds FROM facts" for k, v in rules.items()
    )


def _answers(spark, sf, rules, test):
    rows = [(n, k, int(test(k, p))) for n, p in profiles(spark, sf).items() for k in rules]
    return spark.createDataFrame(rows, "table_case string, rule string, holds int")


for _name, _codes in GROUPS.items():

    def _run(spark, sf, codes=tuple(_codes)):
        return _answers(spark, sf, codes, accepts)

    query(_name, _rules_sql({k: RULES_SQL[k] for k in _codes}))(_run)


@query("is_needed", _rules_sql(NEEDS_SQL))
def q_is_needed(spark, sf):
    return _answers(spark, sf, NEEDS_SQL, needed)
