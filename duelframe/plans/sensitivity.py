"""What a best slate hangs on: scenarios with one market line or one group's weights moved, and two engines side by side."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship
from . import slates, swiss
from .ratings import Settings, anchored, fit, overrides

#: How far a line moves, what a group's weights are multiplied by, and the bounds of a moved line.
MOVE = 0.03
SCALES = (0.8, 1.2)
BOUNDS = (0.01, 0.99)
Result = tuple[str, str, float, str]  # winner, loser, weight, group


class Scenario(NamedTuple):
    name: str
    anchors: tuple[tuple[str, str, float], ...]
    group: str | None = None
    scale: float = 1.0


def scenarios(results: Sequence[Result], anchors: Sequence[Mapping], move: float = MOVE, scales: Sequence[float] = SCALES) -> list[Scenario]:
    """The base, each line up and down, each group's weights down and up."""
    lines = tuple((a["a"], a["b"], float(a["p"])) for a in anchors)
    shifted = lambda i, by: tuple((a, b, min(BOUNDS[1], max(BOUNDS[0], p + by)) if j == i else p) for j, (a, b, p) in enumerate(lines))
    out = [Scenario("base", lines)]
    out += [Scenario(f"{a}-{b} {by:+g}", shifted(i, by)) for i, (a, b, _) in enumerate(lines) for by in (move, -move)]
    return out + [Scenario(f"{group} x{k:g}", lines, group, k) for group in sorted({r[3] for r in results}) for k in scales]


def fitted(spark: SparkSession, asked: Sequence[Scenario], results: Sequence[Result], priors: Mapping[str, float], settings: Settings, anchor_teams: Sequence[str], share: float = 0.5) -> dict[str, dict[str, float]]:
    """Each scenario's ratings after its lines: a fit for each different weighting, in a task of its own."""
    ship(spark)
    held, prior = list(results), dict(priors)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for group, scale in zip(part["group"], part["scale"], strict=True):
                own = fit([r[0] for r in held], [r[1] for r in held], [r[2] * (scale if r[3] == group else 1.0) for r in held], prior, settings, anchor_teams)
                yield pd.DataFrame({"group": group, "scale": scale, "team": list(own), "rating": list(own.values())})

    kinds = sorted({(s.group or "", s.scale) for s in asked})
    table = spark.createDataFrame(kinds, "`group` string, scale double").repartition(len(kinds), "group", "scale")
    by: dict[tuple, dict[str, float]] = {}
    for r in table.mapInPandas(run, "`group` string, scale double, team string, rating double").collect():  # an event's teams, for each weighting
        by.setdefault((r["group"], r["scale"]), {})[r["team"]] = r["rating"]
    return {s.name: anchored(by[s.group or "", s.scale], [{"a": a, "b": b, "p": p} for a, b, p in s.anchors], share) for s in asked}


def ritual(spark: SparkSession, event: swiss.Event, results: Sequence[Result], anchors: Sequence[Mapping], priors: Mapping[str, float], settings: Settings, n: int = 40_000, each: int = 15_000, seed: int = 11, kept: int = 12, threshold: int = 5) -> DataFrame:
    """scenario, best, flipped, margin: whether the base's best slate stays best among its rivals in every scenario.

    Each scenario plays its own prices where it has them. The base has n simulations, of
    which all are used to find the slates; the others have each.
    """
    asked = scenarios(results, anchors)
    rated = fitted(spark, asked, results, priors, settings, event.teams)
    sims = [swiss.simulate(spark, event, {s.name: rated[s.name]}, n if s.name == "base" else each, seed, priced=overrides([{"a": a, "b": b, "p": p} for a, b, p in s.anchors])) for s in asked]
    return slates.sensitivity(cut(functools.reduce(DataFrame.unionByName, sims)), event, "base", kept, threshold)


def engines(spark: SparkSession, event: swiss.Event, locked: Mapping[str, float], current: Mapping[str, float], n: int = 40_000, seed: int = 11, priced: Mapping[swiss.Match, float] | None = None) -> DataFrame:
    """team and for each statistic its value under locked ratings, under current ones, and the change, over shared luck."""
    stats = swiss.statistics(swiss.simulate(spark, event, {"locked": locked, "current": current}, n, seed, priced=priced), event)
    kinds = ("p30", "padv", "pany", "p03")
    side = lambda name: stats.where(F.col("scenario") == name).select("team", *(F.col(k).alias(f"{k}_{name}") for k in kinds))
    both = side("locked").join(side("current"), "team")
    return both.select("*", *((F.col(f"{k}_current") - F.col(f"{k}_locked")).alias(f"{k}_moved") for k in kinds))
