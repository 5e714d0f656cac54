"""Cleaning and encoding: imputers, encoders, column unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.rank import quantiles, running_total
from tabloom.functions.stats import MAX_LEVELS, TooManyLevels, levels, one_row, level_counts
from tabloom.operators.base import Operator, register

# Characters that learners reject in column names, and their stand-ins.
NAME_REPLACEMENTS = {"[": "abaqa", "]": "bebab", "<": "cfckc", ">": "dmdad"}

# Arrays up to this length are searched inside generated code; longer level
# lists become a joined mapping table.
LITERAL_LEVELS = 200


def sanitize_name(name: str) -> str:
    for char, stand_in in NAME_REPLACEMENTS.items():
        name = name.replace(char, stand_in)
    return name


def sanitize_names(t: Table) -> Table:
    return t.derive({sanitize_name(n): c(n) for n in t.features})


def feature_union(*tables: Table) -> Table:
    """Columns of several tables side by side, matched by row key.

    Names already present are dropped, the columns a later table adds are
    sorted, names are sanitised and duplicates removed. Tables that share one
    DataFrame need no join.
    """
    first = tables[0]
    names = list(first.features)
    df = first.df
    for other in tables[1:]:
        fresh = sorted(n for n in set(other.features) if n not in names)
        if other.df is not first.df and fresh:
            left = df
            right = other.df.select(
                *[c(k).alias(f"__k{i}") for i, k in enumerate(other.key)], *[c(n) for n in fresh]
            )
            on = [left[k] == right[f"__k{i}"] for i, k in enumerate(first.key)]
            df = left.join(right, on, "inner").drop(*[f"__k{i}" for i in range(len(first.key))])
        names += fresh
    out: dict[str, Column] = {}
    for n in names:
        out.setdefault(sanitize_name(n), c(n))
    return first.with_df(df).derive(out)


@register
class NumericColumns(Operator):
    name = "numeric_columns"
    contract = "a"
    need = "has_categorical"

    def learn(self, t: Table) -> dict:
        return {"keep": t.numeric}

    def columns(self, t, state):
        return {n: c(n) for n in state["keep"]}


class _Impute(Operator):
    """Numeric columns only; a column that is all missing at fit is dropped."""

    contract = "a"
    need = "has_missing"
    suffix = "_imp"

    def statistic(self, value: Column) -> Column:
        return F.avg(value)

    def learn(self, t):
        # Fill value and gap count come from one aggregate.
        names = t.numeric
        aggs: dict[str, Column] = {}
        for n in names:
            aggs[f"m:{n}"] = self.statistic(t.number(n))
            aggs[f"g:{n}"] = F.sum(t.number(n).isNull().cast("int"))
        return self.state_of(names, one_row(t.df, aggs))

    def state_of(self, names: list[str], row: dict) -> dict:
        kept = [n for n in names if row[f"m:{n}"] is not None]
        return {
            "fill": {n: float(row[f"m:{n}"]) for n in kept},
            "had_missing": [n for n in kept if row[f"g:{n}"]],
        }

    def columns(self, t, state):
        gaps = set(state["had_missing"])
        return {
            n + (self.suffix if n in gaps else ""): F.coalesce(t.number(n), F.lit(v))
            for n, v in state["fill"].items()
        }


@register
class ImputeMean(_Impute):
    name = "impute_mean"
    suffix = "_imp_mean"


@register
class ImputeMedian(_Impute):
    name = "impute_median"
    suffix = "_imp_median"

    def learn(self, t):
        names = t.numeric
        medians = quantiles(t.df, {n: t.number(n) for n in names}, [0.5])
        gaps = one_row(t.df, {f"g:{n}": F.sum(t.number(n).isNull().cast("int")) for n in names})
        return self.state_of(names, {**gaps, **{f"m:{n}": v[0] if v else None for n, v in medians.items()}})


@register
class ImputeIndicator(ImputeMean):
    """Mean-imputed columns, plus a 0/1 flag for each column with gaps at fit."""

    name = "impute_indicator"
    contract = "b"

    def columns(self, t, state):
        out = {n: F.coalesce(t.number(n), F.lit(v)) for n, v in state["fill"].items()}
        for n in state["had_missing"]:
            out[f"{n}_miss_indicator"] = t.number(n).isNull().cast("double")
        return out


def _text(name: str) -> Column:
    return F.coalesce(c(name).cast("string"), F.lit("NaN"))


@register
class OneHot(Operator):
    """One 0/1 column per level of each categorical column.

    Missing is the level ``NaN``; a level not seen at fit gives all zeros.
    Numeric columns are dropped unless ``keep_numeric``. Columns with more than
    ``max_levels`` levels are refused; :func:`one_hot_vector` serves those.
    """

    name = "one_hot"
    need = "has_categorical"

    def learn(self, t):
        return {"levels": levels(t, t.categorical, self.params.get("max_levels", MAX_LEVELS))}

    def columns(self, t, state):
        out = {n: t.number(n) for n in t.numeric} if self.params.get("keep_numeric") else {}
        for i, (n, values) in enumerate(state["levels"].items()):
            for v in values:
                out[f"one_hot__x{i}_{v}"] = F.when(_text(n) == v, 1.0).otherwise(0.0)
        return out

    def attach(self, t: Table, state: dict) -> tuple[DataFrame, dict[str, Column]]:
        return t.df, self.columns(t, state)


def one_hot_vector(t: Table, column: str, out: str):
    """High-cardinality form: a sparse vector column from Spark ML's own encoders."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    stages = [
        StringIndexer(inputCol=column, outputCol="__i", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="__i", outputCol=out, dropLast=True, handleInvalid="keep"),
    ]
    return Pipeline(stages=stages).fit(t.df)


def level_codes(t: Table, column: str) -> DataFrame:
    """(level, code) with codes 0..k-1 in sorted order, for any number of levels."""
    counts = level_counts(t, [column]).select("level")
    return running_total(counts, ["level"], out="code").select("level", F.col("code").cast("bigint").alias("code"))


@register
class LabelEncode(Operator):
    """Sorted levels become 0..k-1; an unseen level is an error.

    Short level lists are literals; long ones are a mapping table joined by
    level, which Spark broadcasts only while it is small.
    """

    name = "label_encode"
    need = "has_categorical"

    def learn(self, t):
        names = t.categorical
        try:
            found = levels(t, names, self.params.get("literal_levels", LITERAL_LEVELS))
            return {"levels": found, "long": []}
        except TooManyLevels:
            sizes = one_row(t.df, {n: F.approx_count_distinct(c(n)) for n in names})
            cut = self.params.get("literal_levels", LITERAL_LEVELS)
            short = [n for n in names if sizes[n] <= cut * 0.9]
            long = [n for n in names if n not in short]
            return {
                "levels": levels(t, short, cut),
                "long": long,
                "tables": {n: level_codes(t, n) for n in long},
            }

    def attach(self, t: Table, state: dict) -> tuple[DataFrame, dict[str, Column]]:
        """The rows with any mapping tables joined, and the code columns over them."""
        df = t.df
        for i, n in enumerate(state["long"]):
            table = state["tables"][n].select(F.col("level").alias(f"__l{i}"), F.col("code").alias(f"__c{i}"))
            df = df.join(table, _text(n) == F.col(f"__l{i}"), "left")
        out = {}
        for n in t.categorical:
            if n in state["levels"]:
                at = F.array_position(F.array(*[F.lit(v) for v in state["levels"][n]]), _text(n))
                code = F.when(at > 0, at - 1).cast("bigint")
            else:
                code = F.col(f"__c{state['long'].index(n)}")
            unseen = F.raise_error(F.concat(F.lit(f"{n}: level not seen at fit: "), _text(n)))
            out[f"{n}_lbl_enc"] = F.coalesce(code, unseen.cast("bigint"))
        return df, out

    def apply(self, t, state):
        df, out = self.attach(t, state)
        if self.params.get("keep_numeric"):
            out = {**{n: t.number(n) for n in t.numeric}, **out}
        return t.with_df(df).derive(out)


class _ImputeThenEncode(Operator):
    """Imputed numeric columns followed by encoded categorical ones."""

    need = "has_missing_and_categorical"
    encoder: type[Operator] = LabelEncode

    def learn(self, t):
        return {"impute": ImputeMean().learn(t), "encode": self.encoder(**self.params).learn(t)}

    def apply(self, t, state):
        filled = ImputeMean().columns(t, state["impute"])
        df, coded = self.encoder(**self.params).attach(t, state["encode"])
        return t.with_df(df).derive({**filled, **coded})


@register
class ImputeLabelEncode(_ImputeThenEncode):
    """Mean-imputed numerics and label-encoded categoricals in one projection."""

    name = "impute_label_encode"
    encoder = LabelEncode


@register
class ImputeOneHot(_ImputeThenEncode):
    """Mean-imputed numerics and one-hot categoricals in one projection."""

    name = "impute_one_hot"
    encoder = OneHot


@register
class OneHotMinFraction(Operator):
    """One-hot where levels rarer than ``minimum_fraction`` share one ``other`` column.

    Unseen levels fall into ``other`` too; missing is a level of its own.
    """

    name = "one_hot_min_fraction"
    need = "has_categorical"

    def learn(self, t):
        least = self.params.get("minimum_fraction", 0.01)
        rows = t.df.count()
        counts = level_counts(t, t.categorical).where(F.col("n") >= F.lit(least * rows))
        kept: dict[str, list[str]] = {n: [] for n in t.categorical}
        for r in counts.collect():  # at most 1 / minimum_fraction levels per column
            kept[r["feature"]].append(r["level"])
        return {"levels": {n: sorted(v) for n, v in kept.items()}}

    def columns(self, t, state):
        out = {}
        for n, values in state["levels"].items():
            for v in values:
                out[f"{n}_{v}"] = F.when(_text(n) == v, 1.0).otherwise(0.0)
            out[f"{n}_other"] = F.when(_text(n).isin(*values), 0.0).otherwise(1.0) if values else F.lit(1.0)
        return out
