"""Naming an intermediate value inside a column expression, so that it is computed once, and filling sentences with columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tilewright import vocab as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def say(name: str, *values: Column) -> Column:
    """A sentence of the vocabulary with the given columns in its places."""
    first, *rest = V.SENTENCES[name].split("{}")
    return F.concat(F.lit(first), *[p for v, text in zip(values, rest, strict=True) for p in (v.cast("string"), F.lit(text))])
