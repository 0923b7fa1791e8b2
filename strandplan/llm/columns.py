"""Columns of the caller that an operator passes on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its whole name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def kept_as(column: str, results: Iterable[str]) -> str:
    """The name that a kept column gets beside ``results``: its own, with ``_kept`` behind it where a result has that name."""
    while column in set(results):
        column += "_kept"
    return column
