r"""Ranked lexical search by simultaneous traversal of inverted treaps.

Each term of a block of documents has a treap of its postings: in order it is sorted by
document, and no posting lies below one of smaller impact. A node of a treap therefore bounds
the impacts in its whole subtree. A query starts with the roots of its terms and the range of
all documents. Step by step the most promising ranges are split at the document of their
weightiest root: that document is scored, and each treap is descended to its top node on
either side. A range whose summed maxima cannot enter the query's k best is pruned, with all
subtrees in it. Many ranges of a query are split at once, as rows of a matrix.

Texts are read once. Of each document the numbers of its query terms go to a table, from which
the corpus statistics come and then the blocks; a task takes one block after another and
carries each query's best on as the bar for the next. A task returns k rows for each item at
most, whatever the documents.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
With N documents that have terms, L terms in all of them and df documents holding a term, the
term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms with tf
occurrences gives w * (10**9 tf div (1000 tf + 12 m)) for each occurrence in the query, where
m = 75 + 25 n N div L.

Nulls: a null text has no terms; documents without terms count for nothing and are never found. Items
with a null id take no part, of a repeated item id the least text counts. Documents with a null
id come last among equal scores; repeated rows are documents of their own. Other columns are
left aside, whatever their names. Empty in, empty out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, prepare, written

#: Every byte as a part of a term, in lower case, or as a space.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Items whose terms the executors are given at once, and bytes of their texts; more are ranked in rounds.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Documents and postings of a block, at most (but for a single document).
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 21
#: Ranges of a query that are split at once.
WIDTH = 512
NO_ID = 2**63 - 1
COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item_id long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the number of each term of the vocabulary that occurs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, offsets, own, tfs = [], [0], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = terms(text or b"")
            found = Counter(map(vocabulary.get, words))
            found.pop(None, None)
            n.append(len(words))
            own += found.keys()
            tfs += found.values()
            offsets.append(len(own))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (own, tfs)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, COUNTS)


class Treaps:
    """The treaps of a block: postings sorted by term and document, with their children."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, middle: np.ndarray, vocabulary: int) -> None:
        """ids: of the documents, in any order; lengths: postings of each; middle: its m."""
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        doc = np.repeat(rank, lengths)
        impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * np.repeat(middle, lengths))
        by_term = np.lexsort((doc, term))
        self.order, self.ids = order, ids[order]
        self.doc, self.impact = doc[by_term], impact[by_term]
        self.key = term[by_term].astype(np.int64) * len(ids) + self.doc
        self.starts = np.searchsorted(self.key, np.arange(vocabulary + 1, dtype=np.int64) * len(ids))
        self.left, self.right, self.root = self._linked()

    def _linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children of every posting and each term's root: one pass over each term's postings with a stack of the rightmost path; of equal impacts the first is above."""
        left, right, roots = [-1] * len(self.doc), [-1] * len(self.doc), np.full(len(self.starts) - 1, -1)
        impact = self.impact.tolist()
        for t in np.flatnonzero(np.diff(self.starts)).tolist():
            path: list[int] = []
            for i in range(self.starts[t], self.starts[t + 1]):
                own, below = impact[i], -1
                while path and impact[path[-1]] < own:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            roots[t] = path[0]
        return np.array(left, np.int64), np.array(right, np.int64), roots

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The top node of each subtree whose document lies between low and high, both excluded; -1 if there is none."""
        node, low, high = node.copy(), np.broadcast_to(low, node.shape), np.broadcast_to(high, node.shape)
        open_ = np.flatnonzero(node.ravel() >= 0)
        flat, low, high = node.ravel(), low.ravel(), high.ravel()
        while len(open_):
            at = flat[open_]
            doc = self.doc[at]
            before, behind = doc <= low[open_], doc >= high[open_]
            moved = before | behind
            open_, at = open_[moved], at[moved]
            flat[open_] = np.where(before[moved], self.right[at], self.left[at])
            open_ = open_[flat[open_] >= 0]
        return flat.reshape(node.shape)

    def impacts(self, own: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The impact of each of the terms (columns) in each of the documents (rows)."""
        asked = own[None, :] * len(self.ids) + docs[:, None]
        at = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        return np.where(self.key[at] == asked, self.impact[at], 0)

    def search(self, own: np.ndarray, weight: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of best and this block, highest first, then smaller ids. own: different terms."""
        held = (self.root[own] >= 0) & (weight > 0)
        own, weight = own[held], weight[held]
        scores, ids = best
        if not len(own):
            return best
        low, high, node = np.array([-1]), np.array([len(self.ids)]), self.root[own][None, :]
        bound = (self.impact[node] * weight).sum(1)
        while len(low):
            if len(scores) == k:  # the k-th is the bar: less can't enter, as much only with a smaller id
                able = (bound > scores[-1]) | (bound == scores[-1]) & (self.ids[np.minimum(low + 1, len(self.ids) - 1)] < ids[-1])
                low, high, node, bound = low[able], high[able], node[able], bound[able]
            if not len(low):
                break
            if len(low) > width:
                parted = np.argpartition(-bound, width)
                now, later = parted[:width], parted[width:]
            else:
                now, later = np.arange(len(low)), np.empty(0, np.int64)
            a, b, tops = low[now], high[now], node[now]
            worth = np.where(tops >= 0, self.impact[tops], 0) * weight
            at = self.doc[tops[np.arange(len(now)), worth.argmax(1)]]
            scores, ids = _merged(scores, ids, (self.impacts(own, at) * weight).sum(1), self.ids[at], k)
            sides = np.concatenate((a, at)), np.concatenate((at, b))
            below = self.within(np.concatenate((tops, tops)), sides[0][:, None], sides[1][:, None])
            most = (np.where(below >= 0, self.impact[below], 0) * weight).sum(1)
            some = most > 0
            low, high = np.concatenate((low[later], sides[0][some])), np.concatenate((high[later], sides[1][some]))
            node, bound = np.concatenate((node[later], below[some])), np.concatenate((bound[later], most[some]))
        return scores, ids


def _merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate((scores, more)), np.concatenate((ids, more_ids))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _middles(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    if 25 * int(n.max(initial=0)) * docs < 2**63:
        return 75 + 25 * n * docs // length
    return np.array([75 + 25 * int(x) * docs // length for x in n], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, n, postings of each, terms and numbers of the documents that have postings, in blocks of bounded size."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = postings = 0
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        some = lengths > 0
        if postings and (docs + some.sum() > BLOCK_DOCS or postings + lengths.sum() > BLOCK_POSTINGS):
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, docs, postings = [], 0, 0
        held.append((ids[some], batch.column(1).to_numpy()[some], lengths[some].astype(np.int64), *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))))
        docs, postings = docs + int(some.sum()), postings + int(lengths.sum())
    if postings:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _round(docs: DataFrame, items: list[tuple[int, str]], k: int) -> DataFrame:
    """item_id, doc_id, score: each task's k best of each item."""
    asked = [(item_id, Counter(terms(text.encode()))) for item_id, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in asked for t in own}))}
    counts = written(term_counts(docs, vocabulary))
    total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, length = int(total[0]), int(total[1])
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the items
        weights[r.t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    queries = [(item_id, np.array([vocabulary[t] for t in own], np.int64), np.array([weights[vocabulary[t]] * c for t, c in own.items()], np.int64)) for item_id, own in asked if own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = [(none, none)] * len(queries)
        for ids, n, lengths, own, tfs in _blocks(batches):
            treaps = Treaps(ids, lengths, own, tfs, _middles(n, n_docs, length), len(vocabulary))
            best = [treaps.search(q, w, k, b) for (_, q, w), b in zip(queries, best, strict=True)]
        for (item_id, _, _), (scores, ids) in zip(queries, best, strict=True):
            if len(scores):
                found = pa.array(ids, mask=ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item_id)), found, pa.array(scores)], ["item_id", "doc_id", "score"])

    return counts.mapInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0, equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text. Items beyond ITEMS or ITEM_BYTES are dealt to
    rounds by their id's hash, each of which reads all documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    asked = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rounds = max(1, -(-size[0] // ITEMS), -(-size[1] // ITEM_BYTES))
    found = None
    for r in range(rounds):
        own = [tuple(x) for x in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect()]
        part = _round(docs, own, k)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
