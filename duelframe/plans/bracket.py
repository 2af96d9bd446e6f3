"""Brackets of eight: exact enumeration of all 128 outcomes, and picks ranked over rating draws."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import paired
from ..session import ship
from .swiss import Event, Match, final_seeds

OBJECTIVES = ("challenges", "champion", "expected_correct", "perfect")
#: Places of the seeds that meet in the first round; winners of the first two and the last two meet next.
FIRST = ((0, 7), (3, 4), (1, 6), (2, 5))


def checked(seeds: Sequence[str], known: Sequence[str] | None = None) -> list[str]:
    if len(seeds) != 8 or len(set(seeds)) != 8 or (known is not None and not set(seeds) <= set(known)):
        raise ValueError(f"a bracket needs eight different known teams, got {list(seeds)}")
    return list(seeds)


def paths() -> np.ndarray:
    """All outcomes as seats: four winners, two finalists, the champion. 128 rows of 7."""
    out = []
    for four in product(*FIRST):
        for two in product(four[:2], four[2:]):
            out += [(*four, *two, last) for last in two]
    return np.array(out)


def series_bo5(p3: float) -> float:
    """A best-of-three probability as one of a best-of-five, by the map probability that both imply."""
    p = min(max(p3, 1e-12), 1 - 1e-12)
    q = 0.5 + np.sin(np.arcsin(2 * p - 1) / 3)
    return float(q**3 * (1 + 3 * (1 - q) + 6 * (1 - q) ** 2))


def bracket_prob(ratings: Mapping[str, float], priced: Mapping[Match, float] | None = None) -> Callable[[str, str, bool], float]:
    """P(a beats b, in a best-of-five or not): a price as it is, since it is of the series; else by ratings."""

    def prob(a: str, b: str, five: bool = False) -> float:
        p = (priced or {}).get((a, b))
        if p is not None:
            return p
        p = 1 / (1 + 10 ** (-(ratings[a] - ratings[b]) / 400))
        return series_bo5(p) if five else p

    return prob


def branch_probs(seeds: Sequence[str], prob: Callable[[str, str, bool], float], final_bo5: bool = True) -> np.ndarray:
    """The probability of each row of paths()."""
    win = np.full((8, 8), np.nan)
    last = np.full((8, 8), np.nan)
    for i, j in product(range(8), range(8)):
        if i != j:
            win[i, j], last[i, j] = prob(seeds[i], seeds[j], False), prob(seeds[i], seeds[j], final_bo5)
    p = paths()
    out = np.ones(len(p))
    beats = lambda table, w, a, b: np.where(w == a, table[a, b], 1 - table[a, b])  # noqa: E731  priced one way round
    for k, (a, b) in enumerate(FIRST):
        out *= beats(win, p[:, k], np.full(len(p), a), np.full(len(p), b))
    for k, (a, b) in ((4, (0, 1)), (5, (2, 3))):
        out *= beats(win, p[:, k], p[:, a], p[:, b])
    return out * beats(last, p[:, 6], p[:, 4], p[:, 5])


def pick_scores(branches: np.ndarray) -> np.ndarray:
    """(4 objectives, 128 picks): each pick's score over all branches by their probabilities."""
    p = paths()
    four = sum((p[:, None, k] == p[None, :, k]).astype(int) for k in range(4))
    two = sum((p[:, None, k] == p[None, :, k]).astype(int) for k in (4, 5))
    champion = p[:, None, 6] == p[None, :, 6]
    parts = (champion & (four >= 2) & (two >= 1), champion, four + two + champion, champion & (four == 4) & (two == 2))
    return np.stack([part.astype(float) @ branches for part in parts])


def rank_picks(draws: DataFrame, seeds: Sequence[str], priced: Mapping[Match, float] | None = None, objective: str = "challenges", final_bo5: bool = True) -> DataFrame:
    """pick, its seven names, the mean of each objective over the draws, values (the objective by draw), place.

    draws: draw, ratings. A draw is scored exactly and in one piece; draws are the parallel
    unit. Ties of the objective go by the others, then by the pick's number.
    """
    ship(draws.sparkSession)
    seeds, prices = checked(seeds), dict(priced or {})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for draw, ratings in zip(part["draw"], part["ratings"], strict=True):
                found = pick_scores(branch_probs(seeds, bracket_prob(dict(ratings), prices), final_bo5))
                yield pd.DataFrame({"draw": draw, "pick": range(128)} | dict(zip(OBJECTIVES, found, strict=True)))

    schema = "draw long, pick int, " + ", ".join(f"{o} double" for o in OBJECTIVES)
    each = draws.mapInPandas(run, schema)
    values = F.transform(F.sort_array(F.collect_list(F.struct("draw", objective))), lambda x: x[objective]).alias("values")  # one for each draw
    means = each.groupBy("pick").agg(*(F.avg(o).alias(o) for o in OBJECTIVES), values)
    names = draws.sparkSession.createDataFrame([(i, *(seeds[x] for x in row)) for i, row in enumerate(paths().tolist())], "pick int, qf1 string, qf2 string, qf3 string, qf4 string, sf1 string, sf2 string, champ string")
    order = [objective, *(o for o in ("expected_correct", "champion", "perfect", "challenges") if o != objective)]
    place = F.row_number().over(Window.orderBy(*(F.desc(o) for o in order), "pick")).alias("place")  # of 128 rows
    return means.join(F.broadcast(names), "pick").select("*", place)


def rival(ranked: DataFrame, objective: str = "challenges", same: float = 1e-12) -> dict | None:
    """The best pick whose mean differs from the leader's by more than same, how many tie with it, and the paired margin over the draws.

    Picks that tie differ in what the objective does not see; their margin would be 0 by nature.
    """
    rows = ranked.select("place", "pick", objective, "values").orderBy("place").collect()  # 128 rows
    other = next((r for r in rows if abs(r[objective] - rows[0][objective]) > same), None)
    if other is None:
        return None
    mean, se = paired(rows[0]["values"], other["values"])
    return {"leader": rows[0]["pick"], "tied": other["place"] - rows[0]["place"], "rival": other["pick"], "margin": mean, "se": se}


def announced_or_derived(path: str | Path, event: Event, completed: Sequence[Match]) -> tuple[list[str], str]:
    """The seeds of an announced bracket's file, else of the finished stage; and which."""
    if Path(path).exists():
        return checked(json.loads(Path(path).read_text())["seeds"], event.teams), "announced"
    return checked(final_seeds(event, completed), event.teams), "derived"


def reach(spark: SparkSession, seeds: Sequence[str], branches: np.ndarray) -> DataFrame:
    """team, sf, final, champ: chances to get so far."""
    p = paths()
    rows = []
    for i, t in enumerate(seeds):
        at = [float(branches[(p[:, a:b] == i).any(1)].sum()) for a, b in ((0, 4), (4, 6), (6, 7))]
        rows.append((t, *at))
    return spark.createDataFrame(rows, "team string, sf double, final double, champ double")
