"""Acceptance contracts and usefulness checks, all answered by one profile row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.frame import CLASSIFICATION, REGRESSION, Table, c, is_numeric, number
from tabloom.functions.stats import one_row, unpivot

BIN_LEVELS = 10


@dataclass(frozen=True)
class Profile:
    """What the rules need to know about a table: O(features) numbers."""

    rows: int
    features: tuple[str, ...]
    numeric: tuple[str, ...]
    task: str | None
    missing: dict[str, int]  # null or NaN
    infinite: dict[str, int]
    negative: dict[str, int]
    distinct: dict[str, int]  # exact below ``EXACT_BELOW``, estimated above

    @property
    def categorical(self) -> list[str]:
        return [n for n in self.features if n not in self.numeric]


EXACT_BELOW = 100


@dataclass(frozen=True)
class Case:
    """Some columns of a frame as a table of their own: features, task and the rows that count."""

    features: dict[str, Column]
    task: str | None = None
    where: Column | None = None


def profile_cases(df: DataFrame, cases: dict[str, Case]) -> dict[str, Profile]:
    """Profiles of several column sets of one frame: one aggregate, and one count of few-valued columns."""
    cells = {(k, n): x for k, case in cases.items() for n, x in case.features.items()}
    flags = {k: F.lit(True) if case.where is None else F.coalesce(case.where, F.lit(False)) for k, case in cases.items()}
    names = {at: f"x{i}" for i, at in enumerate(cells)}
    inside = {k: f"w{i}" for i, k in enumerate(cases)}
    rows = df.select(*[x.alias(names[at]) for at, x in cells.items()], *[f.alias(inside[k]) for k, f in flags.items()])
    numeric = {at for at in cells if is_numeric(rows.schema[names[at]].dataType)}
    value = {
        at: F.when(c(inside[at[0]]), number(names[at], rows.schema[names[at]].dataType) if at in numeric else c(names[at])) for at in cells
    }
    aggs: dict = {("rows", k): F.sum(c(inside[k]).cast("bigint")) for k in cases}
    for at in cells:
        aggs["m", at] = F.sum((c(inside[at[0]]) & value[at].isNull()).cast("bigint"))
        aggs["d", at] = F.approx_count_distinct(value[at])
        if at in numeric:
            aggs["i", at] = F.sum((F.abs(value[at]) == F.lit(float("inf"))).cast("bigint"))
            aggs["g", at] = F.sum((value[at] < 0).cast("bigint"))
    row = one_row(rows, aggs)
    few = [at for at in cells if row["d", at] < EXACT_BELOW]
    exact = {}
    if few:  # under a few hundred pairs per column survive the partial distinct
        pairs = unpivot(rows, {names[at]: value[at].cast("string") for at in few}).where("value is not null").distinct()
        found = {r["feature"]: r["n"] for r in pairs.groupBy("feature").agg(F.count("*").alias("n")).collect()}
        exact = {at: found.get(names[at], 0) for at in few}
    out = {}
    for k, case in cases.items():
        own = tuple(case.features)
        counts = {code: {n: int(row.get((code, (k, n))) or 0) for n in own} for code in "mig"}
        distinct = {n: exact.get((k, n), row["d", (k, n)]) for n in own}
        kept = tuple(n for n in own if (k, n) in numeric)
        out[k] = Profile(int(row["rows", k] or 0), own, kept, case.task, counts["m"], counts["i"], counts["g"], distinct)
    return out


def profile_table(t: Table) -> Profile:
    return profile_cases(t.df, {"table": Case({n: c(n) for n in t.features}, t.task)})["table"]


def _non_empty(p: Profile) -> bool:
    return p.rows > 0 and len(p.features) > 0


def _clean_numeric(p: Profile) -> bool:
    gaps = any(p.missing[n] or p.infinite[n] for n in p.features)
    return _non_empty(p) and not p.categorical and not gaps


def _numeric_no_null(p: Profile) -> bool:
    return _non_empty(p) and not p.categorical and not any(p.missing.values())


def _enough_levels(p: Profile) -> bool:
    return all(p.distinct[n] >= BIN_LEVELS for n in p.features)


def accepts(contract: str, p: Profile, task: str | None = CLASSIFICATION) -> bool:
    """Whether a table with this profile may enter an operator with this contract."""
    match contract:
        case "a":
            return _non_empty(p) and len(p.numeric) > 0
        case "b":
            return _non_empty(p)
        case "c":
            return _clean_numeric(p) and p.task == CLASSIFICATION
        case "c_r":
            return _clean_numeric(p) and p.task == REGRESSION
        case "c_t":
            return _clean_numeric(p)
        case "c_t_arpck":
            return _clean_numeric(p) and min(p.rows, len(p.features)) - 1 != 0
        case "c_t_krnl":
            return _clean_numeric(p) and int(0.5 * len(p.features)) != 0
        case "c_majority":
            return _clean_numeric(p) and p.task == CLASSIFICATION and all("Pred" in n for n in p.features)
        case "d":
            return _numeric_no_null(p) and p.task == task and not any(p.negative.values())
        case "e":
            return _numeric_no_null(p) and p.task == task and all("Pred" in n for n in p.features)
        case "c_t_kbins":
            return _clean_numeric(p) and _enough_levels(p)
        case "kbinsohe":
            return _numeric_no_null(p) and _enough_levels(p) and not any("one_hot" in n for n in p.features)
        case "xgb":
            return _non_empty(p) and not p.categorical and p.task == CLASSIFICATION
    raise ValueError(f"unknown contract {contract}")


CONTRACTS = (
    "a b c c_r c_t c_t_arpck c_t_krnl c_majority d e c_t_kbins kbinsohe xgb"
).split()


def needed(rule: str, p: Profile) -> bool:
    """Whether an operator with this rule would change anything."""
    missing = any(p.missing.values())
    match rule:
        case "always":
            return True
        case "has_categorical":
            return bool(p.categorical)
        case "has_missing":
            return missing
        case "has_missing_and_categorical":
            return missing and bool(p.categorical)
        case "three_columns":
            return len(p.features) >= 3
    raise ValueError(f"unknown rule {rule}")


NEEDS = ("always", "has_categorical", "has_missing", "has_missing_and_categorical", "three_columns")


def contract_table(t: Table):
    """All contracts and needs of a table as rows (kind, rule, holds)."""
    p = profile_table(t)
    rows = [("accepts", k, int(accepts(k, p))) for k in CONTRACTS]
    rows += [("needed", k, int(needed(k, p))) for k in NEEDS]
    schema = T.StructType.fromDDL("kind string, rule string, holds int")
    return t.df.sparkSession.createDataFrame(rows, schema)
