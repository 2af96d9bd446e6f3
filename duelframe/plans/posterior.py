"""The Laplace posterior of ratings, draws from it, structural corners, and its check by Metropolis chains."""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import envelope, win_prob
from ..session import cut, ship
from . import slates, swiss
from .ratings import RATE, Settings, anchored, fit

DRAWS = 200


def hessian(winners: Sequence[str], losers: Sequence[str], weights: Sequence[float], ratings: Mapping[str, float], teams: Sequence[str], sigma: Mapping[str, float]) -> np.ndarray:
    """Of the negative log posterior at ratings; the priors make it positive definite."""
    index = {t: i for i, t in enumerate(teams)}
    r = np.array([ratings[t] for t in teams])
    w, x = np.array([index[t] for t in winners], int), np.array([index[t] for t in losers], int)
    p = 1 / (1 + 10 ** (-(r[w] - r[x]) / 400))
    h = np.asarray(weights, float) * RATE**2 * p * (1 - p)
    out = np.diag([1 / sigma[t] ** 2 for t in teams])
    for rows, columns, sign in ((w, w, 1), (x, x, 1), (w, x, -1), (x, w, -1)):
        np.add.at(out, (rows, columns), sign * h)
    return out


def hessian_entries(pairs: DataFrame, ratings: DataFrame, sigma: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, row, column, value: the entries that are not zero of the Hessian of the negative log posterior.

    pairs: keys, winner, loser, weight (summed or not); ratings: keys, team, rating, and sigma where teams
    have their own. A pair adds four terms, which are summed before they are shuffled.
    """
    own = F.col("sigma") if "sigma" in ratings.columns else F.lit(float(sigma))
    side = lambda c: ratings.select(*keys, F.col("team").alias(c), F.col("rating").alias(f"__{c}"))
    met = pairs.join(side("winner"), [*keys, "winner"]).join(side("loser"), [*keys, "loser"])
    p = win_prob("__winner", "__loser")
    h = F.col("weight") * RATE**2 * p * (1 - p)
    term = lambda r, c, v: F.struct(F.col(r).alias("row"), F.col(c).alias("column"), v.alias("value"))
    terms = met.select(*keys, F.explode(F.array(term("winner", "winner", h), term("loser", "loser", h), term("winner", "loser", -h), term("loser", "winner", -h))).alias("e")).select(*keys, "e.*")
    priors = ratings.select(*keys, F.col("team").alias("row"), F.col("team").alias("column"), (1 / (own * own)).alias("value"))
    return terms.unionByName(priors).groupBy(*keys, "row", "column").agg(F.sum("value").alias("value"))


def _dense(entries: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted(entries["row"].unique())
    index = {t: i for i, t in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    out[entries["row"].map(index), entries["column"].map(index)] = entries["value"]
    return names, out


#: Teams that are tied by matches, directly or through others, up to which their matrix is factored whole (128 MB).
WHOLE = 4000
#: Columns of a larger inverse that are solved for at once.
COLUMNS = 32
#: Tied teams up to which walks are not tried, entries that a step of walks makes at once, and the part of the teams (one in so many) that a column's walks may reach.
PLAIN, STEP, NEAR = 200, 1_000_000, 4


def _parts(row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """The least number among those that entries tie each of 0 to n - 1 to."""
    low = np.arange(n)
    while True:
        least = low.copy()
        np.minimum.at(least, row, low[column])
        np.minimum.at(least, column, low[row])
        np.minimum.at(least, low, least.copy())  # a part's head takes what its members found
        while (least != least[least]).any():
            least = least[least]
        if (least == low).all():
            return low
        low = least


def _local_sd(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, tol: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """Marginal deviations by walks around each team, and the teams for which walks did not do.

    With D the diagonal the matrix is D^1/2 (I - M) D^1/2, so a variance is the sum of M's closed walks over D: with
    v = M^k e it grows by v.v and v.Mv for each k, and what is left lies between v.v / (1 + rho) and v.v / (1 - rho), where
    rho, the greatest share of a row beside its diagonal, bounds M's norm. Walks go on until that is below
    tol. Priors that outweigh a team's matches keep them short: time grows with the teams, not their square.
    """
    own = row == column
    diagonal = np.empty(n)
    diagonal[row[own]] = value[own]
    row, column, value = row[~own], column[~own], value[~own]
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], column[order], value[order]
    rho = float((np.bincount(row, np.abs(value), n) / diagonal).max(initial=0.0))
    if rho >= 1:
        return np.full(n, np.nan), np.arange(n)
    m = -value / np.sqrt(diagonal[row] * diagonal[column])
    starts = np.searchsorted(row, np.arange(n + 1))
    degree = np.diff(starts)
    total, failed = np.zeros(n), []
    todo = [(np.arange(a, min(n, a + 4096)) * (n + 1), np.ones(min(n, a + 4096) - a)) for a in range(0, n, 4096)]  # team * n + place, v there
    while todo:
        key, v = todo.pop()
        while len(key):
            team, place = np.divmod(key, n)
            if len(key) * NEAR > n * (n_teams := len(np.unique(team))):
                failed.append(np.unique(team))
                break
            count = degree[place]
            if count.sum() > STEP and n_teams > 1:  # both halves on their own
                half = np.searchsorted(team, np.unique(team)[n_teams // 2])
                todo.append((key[half:], v[half:]))
                key, v = key[:half], v[:half]
                continue
            at = np.arange(count.sum()) + np.repeat(starts[place] - np.cumsum(count) + count, count)
            to = np.repeat(team * n, count) + column[at]
            step = np.repeat(v, count) * m[at]
            order = np.argsort(to, kind="stable")
            to, step = to[order], step[order]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            to, step = to[first], np.add.reduceat(step, first) if len(first) else step
            low = int(team[0])
            found = np.minimum(np.searchsorted(to, key), max(len(to) - 1, 0))
            cross = np.where(to[found] == key, v * step[found], 0.0) if len(to) else np.zeros(len(key))
            grown = np.bincount(team - low, v * v + cross)
            total[low : low + len(grown)] += grown
            left = np.bincount(to // n - low, step * step, len(grown))
            done = left <= tol * (1 - rho) * total[low : low + len(grown)]
            total[low : low + len(grown)][done] += left[done]
            on = ~done[to // n - low]
            key, v = to[on], step[on]
    out = np.sqrt(total / diagonal)
    return out, np.concatenate(failed) if failed else np.empty(0, int)


def _solved_sd(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, wanted: np.ndarray | None = None, tol: float = 1e-13) -> np.ndarray:
    """Marginal deviations (of wanted) by conjugate gradients, some columns at a time: memory grows with entries and columns, time with n times their number."""
    wanted = np.arange(n) if wanted is None else wanted
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], column[order], value[order, None]
    starts = np.searchsorted(row, np.arange(n))  # every row has its diagonal
    times = lambda x: np.add.reduceat(value * x[column], starts, axis=0)
    scale = np.zeros((n, 1))
    scale[row[row == column], 0] = value[row == column, 0]
    out = np.empty(len(wanted))
    for at in range(0, len(wanted), COLUMNS):
        own = wanted[at : at + COLUMNS]
        x, r = np.zeros((n, len(own))), np.zeros((n, len(own)))
        r[own, np.arange(len(own))] = 1.0
        z = r / scale
        p, rho = z.copy(), (r * z).sum(0)
        first = rho.copy()
        for _ in range(10 * n):
            q = times(p)
            step = rho / np.maximum((p * q).sum(0), 1e-300)
            x += step * p
            r -= step * q
            z = r / scale
            new = (r * z).sum(0)
            if (new <= tol**2 * first).all():
                break
            p = z + new / np.maximum(rho, 1e-300) * p
            rho = new
        out[at : at + COLUMNS] = np.sqrt(x[own, np.arange(len(own))])
    return out


def sparse_sd(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, whole: int = WHOLE) -> np.ndarray:
    """marginal_sd of a matrix of n rows from its entries. Teams that no chain of matches ties are factored apart, so no n by n matrix is made."""
    low = _parts(row, column, n)
    order = np.argsort(low[row], kind="stable")
    row, column, value = row[order], column[order], value[order]
    heads, starts = np.unique(low[row], return_index=True)
    member = np.argsort(low, kind="stable")
    first = np.searchsorted(low[member], heads)
    sizes = np.diff(np.append(first, n))
    local = np.empty(n, int)
    local[member] = np.arange(n) - np.repeat(first, sizes)
    out = np.empty(n)
    for a, b, at, size in zip(starts, np.append(starts[1:], len(row)), first, sizes, strict=True):
        r, c, v = local[row[a:b]], local[column[a:b]], value[a:b]
        own = member[at : at + size]
        if size > min(whole, PLAIN):
            out[own], left = _local_sd(r, c, v, size)
            if not len(left):
                continue
        if size <= whole:
            matrix = np.zeros((size, size))
            matrix[r, c] = v
            out[own] = marginal_sd(np.linalg.cholesky(matrix))
        else:
            out[own[left]] = _solved_sd(r, c, v, size, left)
    return out


def deviations(entries: DataFrame, event: str) -> DataFrame:
    """event, team, sd: marginal posterior deviations, each event's entries in a task of its own.

    A team's walks along its matches are summed until what is left is known to be nothing. Where that goes too far, teams tied
    by matches are factored together, up to WHOLE of them (their number, squared); of more the
    inverse is solved for some columns at a time.
    """
    ship(entries.sparkSession)
    kinds = dict(entries.dtypes)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(rows["row"].unique())
        at = lambda c: np.searchsorted(names, rows[c].to_numpy())
        return pd.DataFrame({event: key[0], "team": names, "sd": sparse_sd(at("row"), at("column"), rows["value"].to_numpy(float), len(names))})

    return entries.groupBy(event).applyInPandas(one, f"{event} {kinds[event]}, team {kinds['row']}, sd double")


def drawn(entries: DataFrame, ratings: DataFrame, event: str, k: int = DRAWS, seed: int = 11) -> DataFrame:
    """event, draw, team, rating: k vectors around each event's ratings (event, team, rating), with the entries' inverse as covariance.

    An event's draws depend on seed and its name alone, not on how rows are dealt.
    """
    ship(entries.sparkSession)
    kinds = dict(entries.dtypes)

    def one(key: tuple, rows: pd.DataFrame, rated: pd.DataFrame) -> pd.DataFrame:
        names, matrix = _dense(rows)
        centre = rated.set_index("team")["rating"].reindex(names).to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        table = centre + offsets(np.linalg.cholesky(matrix), rng.normal(size=(k, len(names))))
        return pd.DataFrame({event: key[0], "draw": np.repeat(np.arange(k), len(names)), "team": np.tile(np.array(names), k), "rating": table.ravel()})

    return entries.groupBy(event).cogroup(ratings.select(event, "team", "rating").groupBy(event)).applyInPandas(one, f"{event} {kinds[event]}, draw long, team {kinds['row']}, rating double")


def offsets(factor: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Draws with covariance inverse(factor @ factor.T), a row for each row of standard normals."""
    return np.linalg.solve(factor.T, np.atleast_2d(normal).T).T


def marginal_sd(factor: np.ndarray) -> np.ndarray:
    return np.sqrt((np.linalg.inv(factor) ** 2).sum(0))


def draws(ratings: Mapping[str, float], factor: np.ndarray, teams: Sequence[str], k: int = DRAWS, seed: int = 11, anchors: Sequence[Mapping] = (), share: float = 0.5) -> list[dict[str, float]]:
    """k rating vectors around the fit, moved towards the market's lines. A seed gives the same offsets for every share."""
    centre = np.array([ratings[t] for t in teams])
    rows = centre + offsets(factor, np.random.default_rng(seed).normal(size=(k, len(teams))))
    return [anchored(dict(zip(teams, map(float, r), strict=True)), anchors, share) for r in rows]


def draw_table(spark: SparkSession, rated: Sequence[Mapping[str, float]]) -> DataFrame:
    """draw, ratings (a map) of a few hundred vectors."""
    return spark.createDataFrame([(i, dict(r)) for i, r in enumerate(rated)], "draw long, ratings map<string,double>")


def structural_corners(matches: Sequence[tuple[str, str, float]], priors: Mapping[str, float], settings: Settings, anchors: Sequence[Mapping], scales: Sequence[float] = (0.7, 1.0, 1.3), shares: Sequence[float] = (0.3, 0.5, 0.7), anchor_teams: Sequence[str] | None = None) -> list[dict]:
    """Ratings at each corner of weight sharpness and market share: refitted by scale, moved by share."""
    out = []
    for scale in scales:
        weights = [max(1e-6, 1 - scale * (1 - w)) for _, _, w in matches]
        base = fit([w for w, _, _ in matches], [x for _, x, _ in matches], weights, priors, settings, anchor_teams)
        out += [{"scale": scale, "share": s, "ratings": anchored(base, anchors, s)} for s in shares]
    return out


def structural_points(spark: SparkSession, event: swiss.Event, corners: Sequence[Mapping], slate: slates.Slate, n: int = 2000, seed: int = 11, threshold: int = 5) -> DataFrame:
    """scale, share, quantity, team, value: a slate's chance (team null) and each team's statistics at every corner of the grid.

    corners as structural_corners gives them. All corners are scenarios of one plan and share
    their luck; outcomes are counted before the slate and the teams meet them.
    """
    names = [f"{c['scale']}|{c['share']}" for c in corners]
    sims = cut(swiss.simulate(spark, event, {k: c["ratings"] for k, c in zip(names, corners, strict=True)}, n, seed))
    own = spark.createDataFrame([(0, *slates.slate_masks(event, slate))], "k int, s30 int, s03 int, sadv int")
    passes = slates.score(sims, own, threshold).select("scenario", F.lit("p_pass").alias("quantity"), F.lit(None).cast("string").alias("team"), F.col("p_pass").alias("value"))
    stats = swiss.statistics(sims, event).unpivot(["scenario", "team"], ["p30", "padv", "p03"], "quantity", "value").select("scenario", "quantity", "team", "value")
    grid = spark.createDataFrame([(k, float(c["scale"]), float(c["share"])) for k, c in zip(names, corners, strict=True)], "scenario string, scale double, share double")
    return passes.unionByName(stats).join(F.broadcast(grid), "scenario").select("scale", "share", "quantity", "team", "value")


def published(points: DataFrame, parameter: DataFrame, floor: float = 0.003) -> DataFrame:
    """quantity, team, point, low, high: each quantity's parameter interval (quantity, team, point, low, high) widened to the grid's values and a least half-width, within 0 and 1."""
    spread = points.groupBy("quantity", "team").agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    met = (F.col("x.quantity") == F.col("y.quantity")) & F.col("x.team").eqNullSafe(F.col("y.team"))
    both = parameter.alias("x").join(spread.alias("y"), met, "left")
    low, high = envelope("x.point", F.least("x.low", "y.__low"), F.greatest("x.high", "y.__high"), floor)
    return both.select("x.quantity", "x.team", "x.point", low.alias("low"), high.alias("high"))


def metropolis(spark: SparkSession, matches: Sequence[tuple[str, str, float]], start: Mapping[str, float], priors: Mapping[str, float], sigma: Mapping[str, float], samples: int = 50_000, burn: int = 10_000, step: float = 22.0, seed: int = 5, chains: int = 4) -> DataFrame:
    """team, mean, sd over all chains of single-team moves; a chain is a task, started at the fit.

    Chains send sums, not samples; samples are shared among them.
    """
    teams = list(priors)
    index = {t: i for i, t in enumerate(teams)}
    games = [[] for _ in teams]
    for w, x, weight in matches:
        games[index[w]].append((index[x], 1.0, weight))
        games[index[x]].append((index[w], -1.0, weight))
    prior, width, begin = np.array([priors[t] for t in teams]), np.array([sigma[t] for t in teams]), np.array([start[t] for t in teams])
    packed = [tuple(map(np.array, zip(*g, strict=True))) if g else (np.zeros(0, int), np.zeros(0), np.zeros(0)) for g in games]
    each = -(-samples // chains)

    def run(parts):
        for part in parts:
            for chain in part["id"]:
                r, rng = begin.copy(), np.random.default_rng([seed, int(chain)])
                # Sums around the start keep their precision.
                total, square, n = np.zeros(len(r)), np.zeros(len(r)), 0

                def local(i, at, r=r):
                    other, sign, weight = packed[i]
                    return float(-(weight * np.log1p(10 ** (-sign * (at - r[other]) / 400))).sum() - (at - prior[i]) ** 2 / (2 * width[i] ** 2))

                for k in range(burn + each):
                    i = int(rng.integers(len(r)))
                    to = r[i] + rng.normal() * step
                    if np.log(rng.random()) < local(i, to) - local(i, r[i]):
                        r[i] = to
                    if k >= burn:
                        d = r - begin
                        total, square, n = total + d, square + d * d, n + 1
                yield pd.DataFrame({"team": teams, "s": total, "q": square, "n": n})

    sums = spark.range(chains).repartition(chains).mapInPandas(run, "team string, s double, q double, n long")
    given = spark.createDataFrame([(t, float(b)) for t, b in zip(teams, begin, strict=True)], "team string, at double")
    out = sums.groupBy("team").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).join(F.broadcast(given), "team")
    mean = F.col("s") / F.col("n")
    return out.select("team", (F.col("at") + mean).alias("mean"), F.sqrt((F.col("q") / F.col("n") - mean * mean) * F.col("n") / (F.col("n") - 1)).alias("sd"))
