"""Numeric expressions: units, sentinels, bearings, transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(key: Column, table: Mapping) -> Column:
    """Value of a small literal map, null when the key is not in it."""
    pairs = ", ".join(_literal(x) for pair in table.items() for x in pair)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def near(value: Column, target: Column | float) -> Column:
    """Equality at a stored type limit, up to float rounding."""
    target = F.lit(target) if isinstance(target, (int, float)) else target
    return F.abs(value - target) <= F.abs(target) * F.lit(1e-6) + F.lit(1e-9)


def mask_sentinels(value: Column, targets: Sequence[float]) -> Column:
    """Null where the stored value sits on one of the limits."""
    out = value
    for t in targets:
        out = F.when(~near(value, float(t)), out)
    return out


def northness(aspect: Column, flat: float = -1.0) -> Column:
    return F.when(aspect == flat, 0.0).otherwise(F.cos(F.radians(aspect)))


def eastness(aspect: Column, flat: float = -1.0) -> Column:
    return F.when(aspect == flat, 0.0).otherwise(F.sin(F.radians(aspect)))


def outcome_transform(value: Column, transform: Column) -> Column:
    """``none`` or ``log1p``; a negative under log1p is an error."""
    v = value.cast("double")
    return (
        F.when(transform == "none", v)
        .when((transform == "log1p") & (v < 0), F.raise_error(
            F.lit("log1p requested on a negative outcome")).cast("double"))
        .when(transform == "log1p", F.log1p(v))
        .otherwise(F.raise_error(F.concat(
            F.lit("unknown transform "), transform)).cast("double")))


def back_transform(value: Column, transform: Column) -> Column:
    """``expm1`` on log rows, null on the others."""
    return F.when(transform == "log1p", F.expm1(value))


def grid_row(cell: Column, n_col: int) -> Column:
    return F.floor((cell - 1) / n_col).cast("long")


def grid_col(cell: Column, n_col: int) -> Column:
    return F.pmod(cell - 1, F.lit(n_col)).cast("long")


def seeded_order(key: Column, seed: int) -> Column:
    """Hex digest giving a random order that no partitioning can change."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
