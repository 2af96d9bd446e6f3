"""Exact top-k inner products by no-random-access aggregation.

For each component the vectors of a block stand in a list sorted by that component. A query
reads every list from its better end, a tier at a time, and keeps for each vector a lower
and an upper bound of its score: what is read, plus the least or most that its unread
entries can add. It stops when few vectors' upper bounds reach the k-th lower bound;
all others cannot qualify, seen or not. The few get their final scores. Bounds of many
queries are matrix products over the entries that a tier holds.

Queries meet all vectors in blocks: every pair of a query block and a vector block is a
task of bounded size, and each returns k rows a query at most.

Components become floor(scale * x). Vectors that are null or hold null or non-finite
components, and null ids, take no part; shorter vectors count as padded with zeros. An id's
own rows are not its candidates; repeated rows of a query id count once, by the least vector,
repeated candidates each. Scores beyond a long fail the query. Empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, prepare

BLOCK = 4096
BATCH = 256
TIERS = 8
OUT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: array of whole numbers as doubles, for the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return held.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def nra_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best of the block, ties to smaller ids; fewer if there are fewer."""
    n, d = x.shape
    if not n or not len(q):
        return []
    order = np.lexsort((ids,))  # rows by id, so that ties go to the first row
    ids, x = ids[order], x[order]
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, d)
    if most >= 2**53:
        return _exact(ids, x, query_ids, q, k)
    kind = np.float32 if most < 2**24 else np.float64
    ranks = np.empty((n, d), np.int64)
    lists = np.argsort(-x, axis=0, kind="stable")
    np.put_along_axis(ranks, lists, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    tier = np.hstack((ranks * TIERS // n, (n - 1 - ranks) * TIERS // n))  # of an entry, from the top and from the bottom
    both = np.hstack((x, x)).astype(kind)
    down = np.take_along_axis(x, lists, axis=0)
    out: list[tuple[int, int, int]] = []
    for at in range(0, len(q), BATCH):
        out += _batch(ids, x, query_ids[at : at + BATCH], q[at : at + BATCH], k, tier, both, down, kind)
    return out


def _batch(ids, x, query_ids, q, k, tier, both, down, kind) -> list[tuple[int, int, int]]:
    n, out = len(ids), []
    signed = np.vstack((np.maximum(q, 0).T, np.minimum(q, 0).T)).astype(kind)  # each query's weight in each list's two readings
    worst = np.concatenate((down[-1], down[0])).astype(kind)
    own = ids[:, None] == query_ids[None, :]
    known, open_ = np.zeros((n, len(q)), kind), np.arange(len(q))
    for t in range(TIERS):
        known += np.where(tier == t, both, 0).astype(kind) @ signed
        unread = (tier > t).astype(kind)
        end = min(n, -(-n * (t + 1) // TIERS)) - 1
        edge = np.concatenate((down[end], down[n - 1 - end])).astype(kind)
        low = known + unread @ (worst[:, None] * signed)
        high = known + unread @ (edge[:, None] * signed)
        low[own], high[own] = -np.inf, -np.inf
        kth = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf, kind)
        able = high >= kth
        able &= ~own
        done = (able.sum(0) <= 16 * k) | (t == TIERS - 1)
        for j in np.flatnonzero(done):
            rows = np.flatnonzero(able[:, j])
            scores = x[rows] @ q[open_[j]]
            best = np.argsort(-scores, kind="stable")[:k]
            out += [(int(query_ids[j]), int(ids[rows[b]]), int(scores[b])) for b in best]
        stay = ~done
        if not stay.any():
            break
        known, signed, own, query_ids, open_ = known[:, stay], signed[:, stay], own[:, stay], query_ids[stay], open_[stay]
    return out


def _exact(ids, x, query_ids, q, k) -> list[tuple[int, int, int]]:
    """For components so large that doubles would round."""
    out, rows = [], [[int(c) for c in v] for v in x]
    for qid, v in zip(query_ids, q, strict=True):
        w = [int(c) for c in v]
        scores = [(-sum(a * b for a, b in zip(w, r, strict=True)), int(i)) for r, i in zip(rows, ids, strict=True) if i != qid]
        out += [(int(qid), i, -s) for s, i in sorted(scores)[:k]]
    if any(not -(2**63) <= s < 2**63 for _, _, s in out):
        raise OverflowError("a score does not fit a long; take a smaller scale")
    return out


def _matrix(*columns: pd.Series) -> list[np.ndarray]:
    width = max((len(v) for c in columns for v in c), default=0)
    out = []
    for c in columns:
        m = np.zeros((len(c), width))
        for i, v in enumerate(c):
            m[i, : len(v)] = v
        out.append(m)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best vectors. Both sides: vec_id, embedding."""
    prepare(vectors.sparkSession)
    x = cut(quantized(vectors, scale))
    asked = cut(quantized(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, m = max(1, -(-x.count() // block)), max(1, -(-asked.count() // block))
    spread = lambda df, own, parts, other, others: df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = _matrix(left["v"], right["v"])
        found = nra_block(left["vec_id"].to_numpy(np.int64), a, right["vec_id"].to_numpy(np.int64), b, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    rows = spread(x, "xb", n, "qb", m).groupBy("xb", "qb").cogroup(spread(asked, "qb", m, "xb", n).groupBy("xb", "qb"))
    found = rows.applyInPandas(pair, OUT)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
