"""Seeded uniforms keyed by values, never by position or partition.

A draw is a pure function of its key, so re-running a task, changing the number of partitions or
losing an executor cannot change it. The key is hashed with md5 because the same bytes give the same
number in any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def uniform(*key) -> Column:
    """Uniform in (0, 1) from the first 13 hex digits of md5(key joined with '|')."""
    parts = [col(k).cast("string") if isinstance(k, (str, Column)) else F.lit(str(k)) for k in key]
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def uniform_sql(*key: str) -> str:
    """The same draw as SQL text; every part is a SQL expression."""
    joined = " || '|' || ".join(f"cast({k} as varchar)" for k in key)
    return f"((cast(('0x' || substr(md5({joined}), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double)"


def poisson1_thresholds() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count, up to the first that no draw can pass."""
    total, out = 0.0, []
    while total < 1.0 - 2.0**-53:
        total += math.exp(-1.0) / math.factorial(len(out))
        out.append(total)
    return out


def poisson1(u) -> Column:
    """Poisson(1) count by inverse distribution function."""

    def count(v: Column) -> Column:
        out = F.lit(0)
        for t in poisson1_thresholds():
            out = out + (v > F.lit(t)).cast("int")
        return out

    # binding u to a lambda variable evaluates its hash once instead of once per threshold
    return F.element_at(F.transform(F.array(col(u)), count), 1)


def poisson1_sql(u: str) -> str:
    return "(" + " + ".join(f"cast({u} > {t!r}::double as int)" for t in poisson1_thresholds()) + ")"
