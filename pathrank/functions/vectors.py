"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_filled(vector: str | Column, size: int) -> Column:
    c = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(c, F.array_repeat(F.lit(0.0), size))


def concatenated(*vectors: str) -> Column:
    return F.concat(*[F.col(v) for v in vectors])


def parsed(text: str | Column) -> Column:
    """``[v, ...]`` or ``(n,[i, ...],[v, ...])`` as an array of doubles; null if it is neither."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)

    dense = F.regexp_extract(c, r"^\[(.*)\]$", 1)
    size = F.regexp_extract(c, r"^\((\d+),", 1).try_cast("int")
    at = F.regexp_extract(c, r"^\(\d+,\s*\[([^\]]*)\]", 1)
    values = F.regexp_extract(c, r",\s*\[([^\]]*)\]\s*\)$", 1)

    def split(s: Column, kind: str) -> Column:
        return F.transform(F.filter(F.split(s, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast(kind))

    held = F.map_from_arrays(split(at, "int"), split(values, "double"))
    sparse = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0.0)))
    return F.when(c.rlike(r"^\[.*\]$"), split(dense, "double")).when(c.rlike(r"^\(\d+,\s*\[[^\]]*\]\s*,\s*\[[^\]]*\]\s*\)$"), sparse)
