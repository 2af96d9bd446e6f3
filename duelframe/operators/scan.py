"""Scans over ordered rows of which one key may hold most: ranks, exact quantiles, values carried on.

Rows are dealt to ranges of (key, order), so a hot key fills many tasks evenly. Each range is
scanned on its own; what it needs of the ranges before it (a count, a last value) comes from an
aggregate with a row for each key and range, scanned in turn.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

RANGE = "__range"


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = RANGE) -> DataFrame:
    """rows with the number of their range, stored, since a range has to stay what it is. Rows alike in keys and order share a range."""
    return cut(rows.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()))


def _met(keys: Sequence[str]) -> Column:
    """Whether a row belongs to a row of counted()."""
    out = F.col(RANGE) == F.col("__of")
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"__of{i}"))
    return out


def counted(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Own (rows there), ahead (rows of the key in earlier ranges), total: a row for each key and range, named __of0 .. and __of."""
    own = ranged.groupBy(*keys, RANGE).agg(F.count("*").alias("__own"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"__of{i}") for i, k in enumerate(keys)]
    return own.select(*named, F.col(RANGE).alias("__of"), "__own", F.coalesce(F.sum("__own").over(before), F.lit(0)).alias("__ahead"), F.sum("__own").over(Window.partitionBy(*keys)).alias("__total"))


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) among those of their keys, no key in one task. Equal rows are numbered in any order."""
    ranged = in_ranges(rows, keys, order)
    placed = ranged.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order)))
    both = placed.join(counted(ranged, keys), _met(keys))
    return both.select(*rows.columns, (F.col("__ahead") + F.col("__at")).alias(name))


def rank_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """keys and, by name, the value at place int(share * n) of each key's values in order, the last at most.

    Exact selection: values are counted by range, and only ranges that hold an asked place are
    sorted. Null values do not count; a key that has no other gives no row.
    """
    keys = list(keys)
    ranged = in_ranges(rows.select(*keys, F.col(value).alias("__v")).where("__v IS NOT NULL"), keys, ["__v"])
    counts = counted(ranged, keys)
    place = {n: F.least(F.floor(F.lit(s) * F.col("__total")), F.col("__total") - 1) for n, s in shares.items()}
    asked = F.lit(False)
    for p in place.values():
        asked = asked | ((p >= F.col("__ahead")) & (p < F.col("__ahead") + F.col("__own")))
    some = ranged.join(counts.where(asked), _met(keys)).select(*keys, RANGE, "__v", "__ahead", "__total")
    at = some.withColumn("__at", F.col("__ahead") + F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy("__v")) - 1)
    return at.groupBy(*keys).agg(*(F.max(F.when(F.col("__at") == p, F.col("__v"))).alias(n) for n, p in place.items()))
