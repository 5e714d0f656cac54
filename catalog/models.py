"""Iterative and tree learners: no closed form, so rows only; tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import load, query, result
from tabloom import Table, get_operator
from tabloom.frame import CLASSIFICATION, REGRESSION, c

# Whole texts reduced to counts.
TEXT_COUNTS = {
    "chars": "CAST(n_chars AS DOUBLE)",
    "digits": "CAST(length(regexp_replace(text, '[^0-9]', '')) AS DOUBLE)",
    "lines": "CAST(length(regexp_replace(text, '[^\\n]', '')) AS DOUBLE)",
    "words": "CAST(size(split(text, ' ')) AS DOUBLE)",
    "marks": "CAST(length(regexp_replace(text, '[^!?*#@]', '')) AS DOUBLE)",
    "quality": "CAST(quality AS DOUBLE)",
}


def texts(spark, sf, label="toxic", drop=(), task=CLASSIFICATION) -> Table:
    """Labelled documents only: for fits whose result is about the columns, not about rows."""
    df = load(spark, sf, "documents", wide=True).join(load(spark, sf, "labels"), "doc_id")
    names = [n for n in TEXT_COUNTS if n not in drop and n != label]
    target = f"{TEXT_COUNTS[label]} AS {label}" if label in TEXT_COUNTS else label
    cells = [f"{TEXT_COUNTS[n]} AS {n}" for n in names]
    return Table.of(df.selectExpr("doc_id", target, *cells), "doc_id", label, names, task)


def every_text(spark, sf, label="toxic", task=CLASSIFICATION) -> Table:
    """All documents; the label is null where there is none."""
    df = load(spark, sf, "documents", wide=True).join(load(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    names = [n for n in TEXT_COUNTS if n not in ("quality", label)]
    target = f"{TEXT_COUNTS[label]} AS {label}" if label in TEXT_COUNTS else label
    return Table.of(df.selectExpr("doc_id", target, *[f"{TEXT_COUNTS[n]} AS {n}" for n in names]), "doc_id", label, names, task)


def labelled(t: Table) -> Table:
    return t.where(c(t.label).isNotNull())


def fit_and_score(op: str, t: Table) -> Table:
    """Fitted on the labelled rows, applied to every row."""
    return get_operator(op).fit(labelled(t)).transform(t)


CLASSIFIERS = (
    "clf_random_forest clf_adaboost clf_bagging clf_decision_tree clf_extra_trees clf_gradient_boosting "
    "clf_linear_svc clf_logistic_regression clf_logistic_regression_cv clf_passive_aggressive clf_sgd_log "
    "clf_svc_rbf clf_xgb clf_balanced_random_forest clf_easy_ensemble clf_rusboost clf_lightgbm"
).split()
for _name in CLASSIFIERS:

    def _classify(spark, sf, op=_name):
        return result(fit_and_score(op, every_text(spark, sf)))

    query(_name)(_classify)

for _name in ("reg_ard", "reg_adaboost", "reg_bagging"):

    def _regress(spark, sf, op=_name):
        return result(fit_and_score(op, every_text(spark, sf, "words", REGRESSION)))

    query(_name)(_regress)


def predictions(spark, sf) -> Table:
    """Probability columns of two learners side by side."""
    t = every_text(spark, sf)
    one = fit_and_score("clf_gaussian_nb", t)
    both = get_operator("clf_lda").fit(labelled(t)).transform(
        Table(t.df.join(one.df.drop("toxic", "prediction"), "doc_id"), t.key, t.label, t.features, t.task, None, one.features)
    )
    names = [*one.features, *both.features]
    return Table(both.df, t.key, t.label, tuple(names), CLASSIFICATION)


for _name in ("ens_random_forest", "ens_adaboost", "ens_extra_trees", "ens_gradient_boosting", "ens_xgb"):

    def _stack(spark, sf, op=_name):
        return result(fit_and_score(op, predictions(spark, sf)))

    query(_name)(_stack)


@query("ens_random_forest_regressor")
def q_stack_regressor(spark, sf):
    t = every_text(spark, sf, "words", REGRESSION)
    one = fit_and_score("reg_ard", t)
    stacked = Table(one.df, t.key, "words", one.features, REGRESSION)
    return result(get_operator("ens_random_forest_regressor").fit_transform(stacked))


for _name, _label, _task in (
    ("rfe_random_forest", "toxic", CLASSIFICATION),
    ("rfe_gradient_boosting", "toxic", CLASSIFICATION),
    ("rfe_linear_svr", "words", REGRESSION),
    ("rfe_random_forest_regressor", "words", REGRESSION),
):

    def _eliminate(spark, sf, op=_name, label=_label, task=_task):
        """The labelled rows are the input: elimination chooses columns by them."""
        return result(get_operator(op).fit_transform(texts(spark, sf, label, task=task)))

    query(_name)(_eliminate)


# A class that one few-valued column decides: every learner must find it, row by row.
RECOVERED = "CAST(n_chars % 7 > 3 AS INT)"


def decided(spark, sf) -> Table:
    """Two thirds of the documents carry the class; the others are to be told."""
    rows = load(spark, sf, "documents").selectExpr(
        "doc_id", f"CASE WHEN doc_id % 3 <> 0 THEN {RECOVERED} END AS y", "CAST(n_chars % 7 AS DOUBLE) AS a", "CAST(doc_id % 5 AS DOUBLE) AS b"
    )
    return Table.of(rows, "doc_id", "y", ["a", "b"], CLASSIFICATION)


for _name in CLASSIFIERS:

    def _recover(spark, sf, op=_name):
        return fit_and_score(op, decided(spark, sf)).df.selectExpr("doc_id", "CAST(prediction AS INT) AS prediction")

    query(f"recovers_{_name}", f"SELECT doc_id, {RECOVERED} AS prediction FROM documents")(_recover)


# A target that follows the same column: 2 a + 1.
for _name in ("reg_ard", "reg_adaboost", "reg_bagging"):

    def _recover_target(spark, sf, op=_name):
        rows = load(spark, sf, "documents").selectExpr(
            "doc_id", "CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars % 7 AS DOUBLE) * 2 + 1 END AS y", "CAST(n_chars % 7 AS DOUBLE) AS a", "CAST(doc_id % 5 AS DOUBLE) AS b"
        )
        done = fit_and_score(op, Table.of(rows, "doc_id", "y", ["a", "b"], REGRESSION))
        return done.df.selectExpr("doc_id", f"round(`{done.prediction}`, 2) + 0.0 AS prediction")

    query(f"recovers_{_name}", "SELECT doc_id, CAST(n_chars % 7 AS DOUBLE) * 2 + 1 AS prediction FROM documents")(_recover_target)


# One column of two values: the best margins and probabilities of a group are known from its class shares.
_TWO = "CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END"
_SHARES = f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS y, l_quantity > 20 AS g FROM lineitem),
    s AS (SELECT g, avg((y = 'A')::INT) AS a, avg((y = 'N')::INT) AS n, avg((y = 'R')::INT) AS r FROM r GROUP BY g)"""


def _two_groups(spark, sf) -> Table:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag AS y", f"CAST({_TWO} AS DOUBLE) AS g")
    return Table.of(rows, ["l_orderkey", "l_linenumber"], "y", ["g"], CLASSIFICATION)


@query(
    "linear_svc_margins",
    f"{_SHARES} SELECT l_orderkey, l_linenumber, round(2 * a - 1, 4) + 0.0e0 AS a, round(2 * n - 1, 4) + 0.0e0 AS n, round(2 * s.r - 1, 4) + 0.0e0 AS r FROM r JOIN s USING (g)",
)
def q_svc_margins(spark, sf):
    """Without a penalty of weight, squared hinge puts a group's margin at twice its class share minus one."""
    t = _two_groups(spark, sf)
    fitted = get_operator("clf_linear_svc", C=1e4, tolerance=1e-9).fit(t)
    margins = fitted.operator.margins(t, fitted.state)
    return t.df.select("l_orderkey", "l_linenumber", *[(F.round(m, 4) + 0.0).alias(n) for m, n in zip(margins, "anr")])


@query(
    "logistic_cv_shares",
    f"{_SHARES} SELECT l_orderkey, l_linenumber, round(a, 4) + 0.0e0 AS a, round(n, 4) + 0.0e0 AS n, round(s.r, 4) + 0.0e0 AS r FROM r JOIN s USING (g)",
)
def q_logistic_shares(spark, sf):
    """Without a penalty of weight, a logistic fit gives a group its class shares."""
    t = _two_groups(spark, sf)
    out = get_operator("clf_logistic_regression_cv", grid=[1e6], tolerance=1e-9).fit_transform(t)
    return out.df.select("l_orderkey", "l_linenumber", *[(F.round(c(f), 4) + 0.0).alias(n) for f, n in zip(out.features, "anr")])
