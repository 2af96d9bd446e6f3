"""Last-wins and latest-attributes operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by a total order: replaced records, superseding logs.

    A max_by over one struct: it combines before the shuffle, so a hot key costs a row a task.
    """
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__last"))
    return last.select(*keys, "__last.*").select(*df.columns)


def latest_attributes(df: DataFrame, key: str, attributes: Sequence[str], seen: str, order: str) -> DataFrame:
    """The attributes of each key's row with the latest seen, of ties the later in order; with that seen."""
    best = F.max_by(F.struct(*attributes, F.col(seen).alias("last_seen")), F.struct(seen, order))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("__b")).select(key, "__b.*")


def contiguous(df: DataFrame, by: Sequence[str], offset: str = "offset", rows: str = "n") -> DataFrame:
    """For each group: whether its pages begin at 0 and each begins where the one before ends; their end."""
    w = Window.partitionBy(*by).orderBy(offset)
    after = F.lead(offset).over(w)
    pages = df.withColumn("__ok", after.isNull() | (after == F.col(offset) + F.col(rows)))
    return pages.groupBy(*by).agg((F.every("__ok") & (F.min(offset) == 0)).alias("contiguous"), F.max(F.col(offset) + F.col(rows)).alias("end"), F.sum(rows).alias("rows"))


def superseding_log(log: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The last graded row of each identity: kind, event, model version and the pair or the team."""
    return last_per_key(log, ["kind", "event", "model_version", "a", "b", "team"], [F.col(ordinal)])


def version_deltas(df: DataFrame, by: Sequence[str], version: str, values: Sequence[str]) -> DataFrame:
    """by, version, previous and for each value its change from the previous version of the group; the first has none.

    A group holds versions of one thing, few of them.
    """
    w = Window.partitionBy(*by).orderBy(version)
    moved = df.select(*by, version, F.lag(version).over(w).alias("previous"), *((F.col(v) - F.lag(v).over(w)).alias(f"{v}_change") for v in values))
    return moved.where("previous IS NOT NULL")
