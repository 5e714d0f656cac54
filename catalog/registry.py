"""Query registration and the shared views of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.frame import CLASSIFICATION, REGRESSION, Table, c
from tabloom.sources.readers import read_frame, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIGITS = 6

# The portable row hash on one integer key, as SQL.
HASH_SQL = "(42 * 31 + ({key} % 2147483647) * 1103515245 + 12345) % 2147483647"


def chained(parts: list[str], seed: int = 42) -> tuple[str, str]:
    """Both portable hashes of key parts (integers below the modulus), as SQL."""
    one = two = str(seed)
    for part in parts:
        one = f"(({one} * 31 + CAST({part} AS BIGINT) * 1103515245 + 12345) % 2147483647)"
        two = f"(({two} * 48271 + CAST({part} AS BIGINT) * 69621 + 1) % 2147483647)"
    return one, f"(({two} * {two} + 1) % 2147483647)"


def wide_sql(*parts: str, seed: int = 42) -> str:
    """The 62-bit row hash."""
    one, two = chained(list(parts), seed)
    return f"({one} * 2147483647 + {two})"


def text_part(column: str) -> str:
    return f"(CAST('0x' || substr(md5({column}), 1, 13) AS BIGINT) % 2147483647)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf: str, name: str, wide: bool = False) -> DataFrame:
    df = read_frame(spark, f"{sf}/{name}.parquet")
    return spread(df) if wide else df


def lines(spark, sf, features=LINE_NUMBERS, label="l_returnflag", task=CLASSIFICATION, wide=False) -> Table:
    return Table.of(load(spark, sf, "lineitem", wide), LINE_KEY, label, features, task)


# Synthetic gaps, the same expressions in SQL (the tables hold no nulls).
GAPS = {
    "qty": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END",
    "price": "l_extendedprice",
    "disc": "nullif(l_discount, 0.0)",
    "tax": "nullif(l_tax, 0.0)",
    "status": "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_linestatus END",
}
GAPS_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"{e} AS {n}" for n, e in GAPS.items()
) + " FROM lineitem"


def gappy_lines(spark, sf, features=tuple(GAPS), label=None) -> Table:
    df = load(spark, sf, "lineitem").selectExpr(
        *LINE_KEY, "l_returnflag", *[f"{e} AS {n}" for n, e in GAPS.items()]
    )
    return Table.of(df, LINE_KEY, label, features, CLASSIFICATION)


def orders(spark, sf, label="o_orderstatus", features=("o_totalprice",)) -> Table:
    return Table.of(load(spark, sf, "orders"), "o_orderkey", label, features, CLASSIFICATION)


def embedding_columns(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(64)])


def embeddings(spark, sf, wide=False) -> Table:
    return Table.of(embedding_columns(load(spark, sf, "embeddings", wide)), "vec_id", "label", task=CLASSIFICATION)


EMBEDDING_LONG_SQL = """
    SELECT vec_id, label, i - 1 AS i, 'e' || lpad((i - 1)::VARCHAR, 2, '0') AS feature, embedding[i]::DOUBLE AS x
    FROM embeddings, range(1, 65) AS g(i)
"""


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of decimals, without negative zero."""
    cells = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        col = c(f.name)
        if kind in ("double", "float"):
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        cells.append(col.alias(f.name))
    return df.select(*cells)


def result(t: Table, digits: int = DIGITS) -> DataFrame:
    """Key, label, prediction and features of a transformed table."""
    return rounded(t.df.select(*[c(n) for n in [*t.roles, *t.features]]), digits)


def r6(expression: str, name: str | None = None) -> str:
    text = f"round({expression}, {DIGITS}) + 0.0e0"
    return f'{text} AS "{name}"' if name else text


def keys_sql(prefix: str = "") -> str:
    return ", ".join(prefix + k for k in LINE_KEY)
