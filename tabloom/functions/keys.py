"""Portable row hashes: the same value in any engine that has 64-bit integers and MD5."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tabloom.frame import c

# Fixed values of the portable hashes; oracle SQL repeats them.
MODULUS = 2147483647
MULTIPLIER = 1103515245
INCREMENT = 12345
CHAIN = 31
SECOND_CHAIN, SECOND_MULTIPLIER = 48271, 69621
#: Wide hashes lie in [0, WIDE).
WIDE = MODULUS * MODULUS

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _part(name: str, kind: str) -> Column:
    """A key column as an integer in [0, MODULUS); no bits of a long are ignored.

    Other types go through the MD5 of their text.
    """
    if kind in INTEGERS:
        value = c(name).cast("bigint")
        high = F.pmod(F.floor(value / F.lit(float(MODULUS))).cast("bigint"), F.lit(MODULUS))
        return F.pmod(F.pmod(value, F.lit(MODULUS)) + F.when(value.between(0, MODULUS - 1), 0).otherwise(high * CHAIN), F.lit(MODULUS))
    digest = F.conv(F.substring(F.md5(c(name).cast("string")), 1, 13), 16, 10).cast("bigint")
    return F.pmod(F.coalesce(digest, F.lit(0)), F.lit(MODULUS))


def row_hash(key: Sequence[str], seed: int = 42, kinds: Mapping[str, str] | None = None) -> Column:
    """Integer in [0, MODULUS) from all key columns (integers, if ``kinds`` is not given)."""
    acc: Column = F.lit(seed).cast("bigint")
    for name in key:
        part = _part(name, (kinds or {}).get(name, "bigint"))
        acc = F.pmod(acc * CHAIN + part * MULTIPLIER + INCREMENT, F.lit(MODULUS))
    return acc


def second_hash(key: Sequence[str], seed: int = 42, kinds: Mapping[str, str] | None = None) -> Column:
    """Another integer in [0, MODULUS) from the same columns: another chain, squared at its end."""
    acc: Column = F.lit(seed).cast("bigint")
    for name in key:
        part = _part(name, (kinds or {}).get(name, "bigint"))
        acc = F.pmod(acc * SECOND_CHAIN + part * SECOND_MULTIPLIER + 1, F.lit(MODULUS))
    return F.pmod(acc * acc + 1, F.lit(MODULUS))


def keyed_hash(df, key: Sequence[str], seed: int = 42) -> Column:
    """``row_hash`` over every key column of a frame, whatever its type."""
    return row_hash(key, seed, dict(df.dtypes))


def wide_hash(df, key: Sequence[str], seed: int = 42) -> Column:
    """Integer in [0, WIDE), about 62 bits: ``keyed_hash`` above, ``second_hash`` below it."""
    kinds = dict(df.dtypes)
    return row_hash(key, seed, kinds) * MODULUS + second_hash(key, seed, kinds)
