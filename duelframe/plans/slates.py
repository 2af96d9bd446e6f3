"""Pick slates over simulated stages: scores, exhaustive search, sensitivity to scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .swiss import Event, outcomes, statistics


class Slate(NamedTuple):
    p_pass: float
    expected: float
    exact30: tuple[str, ...]
    exact03: tuple[str, ...]
    advance: tuple[str, ...]


def correct(m30: str = "m30", s30: str = "s30", m03: str = "m03", s03: str = "s03", madv: str = "madv", sadv: str = "sadv"):
    """Right picks of a slate (masks s) in an outcome (masks m)."""
    pairs = ((m30, s30), (m03, s03), (madv, sadv))
    return sum((F.bit_count(F.col(m).bitwiseAND(F.col(s))) for m, s in pairs), F.lit(0))


def best_by(stats: list, column: str, k: int) -> list[str]:
    """The k teams of the highest value; of ties the earlier in the list."""
    return [r["team"] for r in sorted(stats, key=lambda r: -r[column])[:k]]


def candidate_slates(stats: DataFrame, event: Event, k30: int = 5, k03: int = 5, kadv: int = 9, sizes: Sequence[int] = (2, 2, 6)) -> DataFrame:
    """k (place in the search), masks s30, s03, sadv and names exact30, exact03, advance of all slates of the likeliest teams without overlaps."""
    rows = {r["team"]: r for r in stats.collect()}  # sixteen rows
    listed = [rows[t] for t in event.teams]
    bit = {t: 1 << i for i, t in enumerate(event.teams)}
    mask = lambda ts: sum(bit[t] for t in ts)
    top30, top03, topadv = best_by(listed, "p30", k30), best_by(listed, "p03", k03), best_by(listed, "padv", kadv)
    out: list[tuple] = []
    for a in combinations(top30, sizes[0]):
        for b in combinations(top03, sizes[1]):
            if not set(a) & set(b):
                out += [(mask(a), mask(b), mask(c), list(a), list(b), list(c)) for c in combinations([t for t in topadv if t not in (*a, *b)], sizes[2])]
    return stats.sparkSession.createDataFrame([(k, *m) for k, m in enumerate(out)], "k int, s30 int, s03 int, sadv int, exact30 array<string>, exact03 array<string>, advance array<string>")


def score(sims: DataFrame, slates: DataFrame, threshold: int = 5) -> DataFrame:
    """scenario, the slate's columns, p_pass, expected: over different outcomes by their counts."""
    return score_outcomes(outcomes(sims), slates, threshold, ["scenario"])


def score_outcomes(counted: DataFrame, slates: DataFrame, threshold: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """keys, the slate's columns, p_pass, expected over outcomes m30, m03, madv that came n times.

    A few thousand slates at most meet each outcome, broadcast; sums combine before the shuffle.
    """
    both = counted.crossJoin(F.broadcast(slates)).withColumn("right", correct())
    total = F.sum("n")
    return both.groupBy(*keys, *slates.columns).agg((F.sum(F.when(F.col("right") >= threshold, F.col("n")).otherwise(0)) / total).alias("p_pass"), (F.sum(F.col("right") * F.col("n")) / total).alias("expected"))


#: What decides between slates of one score: their names as listed, the greatest first.
NAMES = ("exact30", "exact03", "advance")


def top(scored: DataFrame, k: int = 12, keys: Sequence[str] = ()) -> DataFrame:
    """The k best of scored slates (of each of the keys) with their rank; each task keeps k of a key before rows are shuffled."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*map(F.desc, ("p_pass", "expected", *NAMES))))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def named(event: Event, mask: int) -> tuple[str, ...]:
    return tuple(t for i, t in enumerate(event.teams) if mask >> i & 1)


def optimize(sims: DataFrame, event: Event, threshold: int = 5, **search: int) -> dict[str, Slate]:
    """Each scenario's slate with the best chance to pass, then the most right picks, then first found."""
    stats = statistics(sims, event).cache()
    out = {}
    for scenario in [r[0] for r in stats.select("scenario").distinct().collect()]:
        slates = candidate_slates(stats.where(F.col("scenario") == scenario), event, **search)
        top = score(sims.where(F.col("scenario") == scenario), slates, threshold).orderBy(F.desc("p_pass"), F.desc("expected"), "k").first()
        if top is not None:
            out[scenario] = Slate(top["p_pass"], top["expected"], *(named(event, top[c]) for c in ("s30", "s03", "sadv")))
    return out


def slate_masks(event: Event, slate: Slate) -> tuple[int, int, int]:
    return tuple(sum(1 << event.teams.index(t) for t in part) for part in slate[2:])


def sensitivity(sims: DataFrame, event: Event, base: str, kept: int = 12, threshold: int = 5) -> DataFrame:
    """scenario, best (the slate's place), flipped, margin: of the base's best slates under every scenario.

    The kept rivals of the base are scored again elsewhere, not searched again.
    """
    stats = statistics(sims.where(F.col("scenario") == base), event)
    slates = candidate_slates(stats, event)
    ranked = top(score(sims.where(F.col("scenario") == base), slates, threshold), kept).orderBy("rank")
    rivals = ranked.select(*slates.columns)
    own = ranked.first()["k"]
    scored = score(sims, rivals, threshold)
    best = F.max_by("k", F.struct("p_pass", "expected", *NAMES)).alias("best")
    lead = (F.max("p_pass") - F.max(F.when(F.col("k") == own, F.col("p_pass")))).alias("margin")
    return scored.groupBy("scenario").agg(best, lead).withColumn("flipped", F.col("best") != own)
