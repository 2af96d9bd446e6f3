"""Forecasts during a stage: chances from where it stands, what each match would change, and the log entry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import canonical_sha
from . import slates, swiss


def forecast(spark: SparkSession, event: swiss.Event, ratings: Mapping[str, float], slate: slates.Slate, completed: Sequence[swiss.Match], upcoming: Sequence[swiss.Match], n: int = 40_000, seed: int = 11, priced: Mapping[swiss.Match, float] | None = None, threshold: int = 5) -> tuple[DataFrame, DataFrame]:
    """scores (scenario, p_pass, expected) and statistics: now, and with each upcoming match decided either way.

    All scenarios are one set of simulations and share their luck.
    """
    states = {"now": swiss.State.of(event.teams, completed, upcoming), **swiss.conditional(event, completed, upcoming)}
    sims = swiss.simulate(spark, event, dict.fromkeys(states, ratings), n, seed, states, priced)
    masks = spark.createDataFrame([(0, *slates.slate_masks(event, slate))], "k int, s30 int, s03 int, sadv int")
    return slates.score(sims, masks, threshold).select("scenario", "p_pass", "expected"), swiss.statistics(sims.where("scenario = 'now'"), event)


def rooting(scores: DataFrame, upcoming: Sequence[swiss.Match]) -> DataFrame:
    """a, b, p_pass_a, p_pass_b, swing, root_for of the upcoming matches, the widest swing first."""
    pairs = scores.sparkSession.createDataFrame([(a, b, f"{a}>{b}", f"{b}>{a}") for a, b in upcoming], "a string, b string, ka string, kb string")
    own = lambda k, out: scores.select(F.col("scenario").alias(k), F.col("p_pass").alias(out))
    both = pairs.join(own("ka", "p_pass_a"), "ka").join(own("kb", "p_pass_b"), "kb")
    both = both.withColumn("swing", F.abs(F.col("p_pass_a") - F.col("p_pass_b"))).withColumn("root_for", F.when(F.col("p_pass_a") >= F.col("p_pass_b"), F.col("a")).otherwise(F.col("b")))
    return both.select("a", "b", "p_pass_a", "p_pass_b", "swing", "root_for").orderBy(F.desc("swing"), F.desc("a"), F.desc("b"))


def match_forecasts(ratings: Mapping[str, float], upcoming: Sequence[swiss.Match], priced: Mapping[swiss.Match, float] | None = None) -> list[dict[str, Any]]:
    """What the model plays for each pair (the price, if there is one), and the price."""
    prob = swiss.rated_prob(ratings, priced)
    return [{"a": a, "b": b, "model_prob": prob(a, b), "market_prob": (priced or {}).get((a, b))} for a, b in upcoming]


def forecast_manifest(inputs: Mapping[str, Any], code_sha: str | None, code_dirty: bool | None, n_sims: int, seed: int, policies: Mapping[str, str] | None = None) -> dict[str, Any]:
    """What a later replay of a forecast needs: code, seeds, policies, and of each named input its source and content's identity."""
    named = {f"{name}_{part}": value for name, (source, content) in inputs.items() for part, value in (("source", source), ("sha", canonical_sha(content) if content is not None else "unknown"))}
    return {"manifest_version": "v1", "code_sha": code_sha or "unknown", "code_dirty": code_dirty is not False, "n_sims": n_sims, "seed": seed, **named, **(policies or {})}


def log_entry(ts: str, source: str, sha: str, completed: Sequence, upcoming: Sequence, p_pass: float, expected: float, teams: Mapping, guide: Sequence[Mapping], manifest: Mapping | None = None, forecasts: Sequence[Mapping] | None = None, n_anchors: int = 0) -> dict[str, Any]:
    """One line of the forecast log."""
    return {"ts": ts, "ratings_source": source, "ratings_sha": sha, "n_anchors": n_anchors, "n_completed": len(completed), "upcoming": [list(m) for m in upcoming], "p_pass": p_pass, "e_ticks": expected, "teams": dict(teams), "rooting": [dict(g) for g in guide], "manifest": manifest, "match_forecasts": forecasts}


def slate_ticks(records: Mapping[str, tuple[int, int]], slate: slates.Slate) -> int:
    """Right picks of a slate in a finished stage."""
    at = {t: tuple(r) for t, r in records.items()}
    return sum(at[t] == (3, 0) for t in slate.exact30) + sum(at[t] == (0, 3) for t in slate.exact03) + sum(at[t] in ((3, 1), (3, 2)) for t in slate.advance)


def bracket_grade(pick: Sequence[str], actual: Sequence[str]) -> dict[str, Any]:
    """Right picks of a bracket (four, two, one names) against what happened."""
    four, two = len({*pick[:4]} & {*actual[:4]}), len({*pick[4:6]} & {*actual[4:6]})
    champion = pick[6] == actual[6]
    return {"qf": four, "sf": two, "champion": champion, "challenges": four >= 2 and two >= 1 and champion}
