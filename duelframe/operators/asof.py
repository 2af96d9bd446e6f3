"""As-of closing prices: the last snapshot before a match starts, else the earliest, flagged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import team_alias, unordered, utc
from .scan import RANGE, in_ranges

CLOSE_RULE = "v1:last-mid-before-start+minvol"
LEAST_VOLUME = 1000.0


def priced_pairs(snapshots: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Two-sided snapshots with both labels known: lo, hi (the pair), p_lo, p_hi, t, and their own columns."""
    two = snapshots.where(F.size("outcomes") == 2).withColumn("__a", team_alias(F.col("outcomes")[0], aliases)).withColumn("__b", team_alias(F.col("outcomes")[1], aliases))
    lo, hi = unordered("__a", "__b")
    first, second = F.col("prices")[0], F.col("prices")[1]
    straight = F.col("__a") == lo
    sides = F.when(straight, first).otherwise(second).alias("p_lo"), F.when(straight, second).otherwise(first).alias("p_hi")
    return two.select("*", lo.alias("lo"), hi.alias("hi"), *sides, utc("ts").alias("t")).where("lo IS NOT NULL AND lo <> hi").drop("__a", "__b")


def choose(joined: DataFrame, keys: list[str], start: str, t: str, value: Column, ties: list[Column]) -> DataFrame:
    """For each key of joined pairs the value as of start: of the last t before it, else of the first t, flagged.

    For pairs that a stream join gives; as_of() needs no pairs. Two partial aggregates in one pass, so a key with very many snapshots is never in one
    task. ties order snapshots of one t, as they would be read; the last before start wins,
    the first of those after it.
    """
    pre = F.col(t) < F.col(start)
    order = F.struct(F.col(t).alias("t"), *(x.alias(f"x{i}") for i, x in enumerate(ties)))
    best = joined.groupBy(*keys).agg(F.max_by(F.when(pre, value), F.when(pre, order)).alias("__pre"), F.min_by(value, order).alias("__first"), F.count_if(pre).alias("__n"), F.count(t).alias("__m"))
    return best.where("__m > 0").select(*keys, F.when(F.col("__n") > 0, F.col("__pre")).otherwise(F.col("__first")).alias("close"), (F.col("__n") == 0).alias("flagged"))


def as_of(matches: DataFrame, snapshots: DataFrame, keys: Sequence[str], start: str, t: str, value: str, order: Sequence[Column], first: Sequence[Column] | None = None) -> DataFrame:
    """matches with close, the value of the last snapshot of their keys before start, else of the first, and flagged in that case.

    Both null where a match's keys have no snapshot or are null. Snapshots of one time are
    ordered by order (the last before start wins) and by first (the least of the first time
    wins; order by default). No match meets more than one snapshot: both sides are dealt
    together to ranges of (keys, time), the last value is carried forward within a range, and
    what a range begins with comes from a row for each of the keys' ranges. So a key of any
    size is split evenly, whatever its span of time, and shuffles are linear in both sides.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, own, strict=True)]
    rank = lambda by: F.struct(F.col(t).alias("t"), *(x.alias(f"x{i}") for i, x in enumerate(by)))
    s = snapshots.select(*named, F.col(t).alias("__t"), F.col(value).alias("__v"), rank(order).alias("__o"), rank(first or order).alias("__f")).dropna(subset=[*own, "__t"])
    m = matches.select(*named, F.col(start).alias("__t"), F.struct(*matches.columns).alias("__m"))
    # A match comes before snapshots of its own time: they are not before its start.
    both = s.select(*own, "__t", F.lit(1).alias("__kind"), "__o", "__f", F.struct("__v").alias("__v")).unionByName(m.select(*own, "__t", F.lit(0).alias("__kind"), "__m"), allowMissingColumns=True)
    both = in_ranges(both, own, ["__t", "__kind", "__o"])
    cell = [*own, RANGE]
    before = Window.partitionBy(*cell).orderBy("__t", "__kind", "__o").rowsBetween(Window.unboundedPreceding, -1)
    inside = both.select(*cell, "__m", F.last("__v", ignorenulls=True).over(before).alias("__in")).where("__m IS NOT NULL")
    ends = both.groupBy(*cell).agg(F.max_by("__v", "__o").alias("__last"), F.min_by("__v", "__f").alias("__first"), F.min("__f").alias("__ff"))  # a row for each of a key's ranges
    ahead = Window.partitionBy(*own).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(c).alias(f"{c}_") for c in cell), F.last("__last", ignorenulls=True).over(ahead).alias("__ahead"), F.min_by("__first", "__ff").over(Window.partitionBy(*own)).alias("__first"))
    met = F.lit(True)
    for c in cell:
        met = met & (F.col(c) == F.col(f"{c}_"))
    out = inside.join(carried, met, "left").withColumn("__pre", F.coalesce("__in", "__ahead"))
    return out.select("__m.*", F.coalesce("__pre", "__first")["__v"].alias("close"), F.when(F.col("__first").isNotNull(), F.col("__pre").isNull()).alias("flagged"))


def closing_prices(matches: DataFrame, snapshots: DataFrame, aliases: dict[str, str], least_volume: float | None = LEAST_VOLUME) -> DataFrame:
    """matches (match_key, a, b, start as ISO text, ...) with p_a, flagged, close_rule, ts, slug, volume.

    least_volume leaves thin snapshots out; None is the older rule without it, by which
    snapshots of one time are ordered by price. Matches without a snapshot have nulls.
    """
    pairs = priced_pairs(snapshots, aliases)
    if least_volume is not None:
        pairs = pairs.where(F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) >= least_volume)
    lo, hi = unordered("a", "b")
    asked = matches.select(F.struct(*matches.columns).alias("__match"), lo.alias("lo"), hi.alias("hi"), (F.col("a") == lo).alias("__straight"), utc("start").alias("__start"))
    # Which side is a decides a snapshot's price, and by the older rule its order: each snapshot stands for both.
    sided = pairs.withColumn("__straight", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("p_a", F.when(F.col("__straight"), F.col("p_lo")).otherwise(F.col("p_hi")))
    priced = sided.select("lo", "hi", "__straight", "t", F.struct("p_a", "ts", "slug", "volume").alias("__price"), "p_a", "ordinal")
    order = [F.col("ordinal")] if least_volume is not None else [F.col("p_a"), F.col("ordinal")]
    found = as_of(asked, priced, ["lo", "hi", "__straight"], "__start", "t", "__price", order)
    rule = F.when(F.col("flagged").isNotNull(), F.lit(CLOSE_RULE))
    return found.select("__match.*", "close.p_a", F.coalesce("flagged", F.lit(False)).alias("flagged"), rule.alias("close_rule"), "close.ts", "close.slug", "close.volume")
