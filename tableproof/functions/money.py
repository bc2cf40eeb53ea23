"""Line amounts in decimals, so that sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dec(name: str | Column, precision: int = 12, scale: int = 2) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return col.cast(f"decimal({precision},{scale})")


def gross() -> Column:
    """Price of a line before discount."""
    return dec("l_extendedprice")


def discount_amount() -> Column:
    return gross() * dec("l_discount", 4, 2)


def net() -> Column:
    """Price of a line after discount."""
    return gross() * (F.lit(1).cast("decimal(4,2)") - dec("l_discount", 4, 2))


def money(col: Column) -> Column:
    """Rounded two-decimal result column."""
    return F.round(col, 2).cast("decimal(18,2)")
