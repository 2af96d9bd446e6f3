"""Student's t as Column expressions, so that intervals and verdicts are columns of any table."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halvings of the angle's range: beyond them a double no longer changes.
HALVINGS = 52


def _inside(angle: Column, df: Column) -> Column:
    """P(|T| <= sqrt(df) tan(angle)), for whole degrees of freedom: the finite sums of the incomplete beta function, folded."""
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = df % 2 == 1
    # Each term is the one before it times cos(angle)**2 and a ratio of two neighbouring whole numbers.
    terms = F.when(odd, (df - 3) / 2).otherwise(df / 2 - 1).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, k: Column) -> Column:
        ratio = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = state["term"] * cosine * cosine * ratio
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(steps, begin, add, lambda s: s["total"])
    many = F.when(df > 1, sine * cosine * total).otherwise(F.lit(0.0))
    return F.when(odd, (2 / math.pi) * (angle + many)).otherwise(sine * total)


def t_inside(t: Column | str, df: Column | str) -> Column:
    """P(|T| <= t)."""
    t, df = (F.col(x) if isinstance(x, str) else x for x in (t, df))
    return _inside(F.atan2(t, F.sqrt(df.cast("double"))), df.cast("int"))


def t_quantile(p: float, df: Column | str) -> Column:
    """Student's t below which a share p lies, by bisection of the angle; null for less than one degree of freedom."""
    if not 0 < p < 1:
        raise ValueError(f"a share lies between 0 and 1, got {p!r}")
    df = (F.col(df) if isinstance(df, str) else df).cast("int")
    share = F.lit(abs(2 * p - 1))
    begin = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        below = _inside(middle, df) < share
        return F.struct(F.when(below, middle).otherwise(state["low"]).alias("low"), F.when(below, state["high"]).otherwise(middle).alias("high"))

    angle = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begin, halve, lambda s: (s["low"] + s["high"]) / 2)
    return F.when(df >= 1, math.copysign(1.0, p - 0.5) * F.sqrt(df.cast("double")) * F.tan(angle))
