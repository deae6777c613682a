"""Helper columns: names that no input column has, and values that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused_name(docs: DataFrame, like: str) -> str:
    """A name that no column of ``docs`` has, in any case."""
    taken, name = {c.lower() for c in docs.columns}, f"__{like}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it, as in a lambda of its own."""
    return F.transform(F.array(value), body)[0]
