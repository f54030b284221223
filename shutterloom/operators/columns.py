"""Carrying a caller's columns through inner steps, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, names: list[str] | None = None, alias: str = "_docs") -> Column:
    """The columns as one struct under names of our own, so that theirs clash with nothing and Arrow takes them."""
    names = docs.columns if names is None else names
    return F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(names)] or [F.lit(0).alias("none")]).alias(alias)


def unpacked(names: list[str], alias: str = "_docs") -> list[Column]:
    """The columns that packed() made one, under their names."""
    return [F.col(f"{alias}.c{i}").alias(c) for i, c in enumerate(names)]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
