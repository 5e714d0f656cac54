"""A DataFrame together with the roles of its columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

CLASSIFICATION = "classification"
REGRESSION = "regression"


def c(name: str) -> Column:
    """Column reference that survives dots, blanks and back-ticks in a name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def number(name: str, dtype: T.DataType | None = None) -> Column:
    """The column as a double whose NaN reads as null."""
    value = c(name).cast("double")
    if dtype is None or isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(value, F.lit(None).cast("double"))
    return value


@dataclass(frozen=True)
class Table:
    """Rows with a key, an optional label and an ordered list of features.

    Operators never rely on physical row order: whatever needs an order takes
    it from ``key``. ``prediction`` names the column a learner has added;
    ``carry`` lists further columns that pass through every operator unchanged.
    """

    df: DataFrame
    key: tuple[str, ...]
    label: str | None = None
    features: tuple[str, ...] = ()
    task: str | None = None
    prediction: str | None = None
    carry: tuple[str, ...] = ()

    @staticmethod
    def of(
        df: DataFrame,
        key: str | Sequence[str],
        label: str | None = None,
        features: Sequence[str] | None = None,
        task: str | None = None,
    ) -> "Table":
        keys = (key,) if isinstance(key, str) else tuple(key)
        if features is None:
            features = [n for n in df.columns if n not in keys and n != label]
        bad = [
            f.name
            for f in df.schema.fields
            if f.name in features and not (is_numeric(f.dataType) or is_text(f.dataType))
        ]
        if bad:
            raise TypeError(f"features must be numeric, boolean or string; cast first: {bad}")
        return Table(df, keys, label, tuple(features), task)

    @property
    def roles(self) -> list[str]:
        names = list(self.key)
        for extra in (self.label, self.prediction):
            if extra and extra not in names:
                names.append(extra)
        return [*names, *[n for n in self.carry if n not in names]]

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    @property
    def numeric(self) -> list[str]:
        return [n for n in self.features if is_numeric(self.dtype(n))]

    @property
    def categorical(self) -> list[str]:
        return [n for n in self.features if not is_numeric(self.dtype(n))]

    def number(self, name: str) -> Column:
        return number(name, self.dtype(name))

    def derive(self, columns: Mapping[str, Column]) -> "Table":
        """Replace the features; key, label, prediction and carried columns stay."""
        kept = [c(n) for n in self.roles]
        df = self.df.select(*kept, *[col.alias(n) for n, col in columns.items()])
        return replace(self, df=df, features=tuple(columns))

    def pick(self, names: Sequence[str]) -> "Table":
        return self.derive({n: c(n) for n in names})

    def where(self, condition: Column) -> "Table":
        return replace(self, df=self.df.where(condition))

    def with_df(self, df: DataFrame) -> "Table":
        return replace(self, df=df)
