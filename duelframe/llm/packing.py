"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token ids with an end id each; what is longer than a sequence is cut into full
pieces and a rest. The driver holds the histogram of piece lengths (at most ``capacity``
numbers) and solves, by multiplicative weights, the program that covers it with the fewest
configurations of lengths that fit a sequence; the best configuration under the current
weights comes from a knapsack dynamic program, and so does a proven lower bound. The solution
is rounded; what rounding leaves is solved again, and its last rest packed best-fit. The plan
is a table over lengths; pieces find their place by their number among those of equal
length, which is counted in two levels, by buckets of rows dealt out by number, so that
neither a frequent length nor equal rows are in one task.

Nulls: a null text is empty, its one piece is the end id. Repeated rows are packed each.
Ids may repeat or be null. Empty in, empty out.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_texts, texts

CAPACITY = 2048
END_ID = 0
#: Words of which a Python worker remembers the ids; when half are new, those not met since the last time are forgotten.
REMEMBERED = 300_000
BUCKET_ROWS = 8_192
#: A solution this close to the proven bound is good enough.
GAP = 0.002
#: Parts of a length's count that a fractional use is a multiple of where best-fit begins it.
PARTS = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of whole texts by a tokenizer that never looks across ASCII white space.

    Equal words get equal ids wherever they stand, so each is encoded once and remembered.
    Words of Latin letters, digits and signs go through a faster implementation of the same
    merges where the tokenizer's file has the form that it knows; see Merges.
    """

    def __init__(self, path: str) -> None:
        self.path, self.merges = path, Merges.of(path)
        self.known: dict[str | bytes, bytes] = {}  # of words, and of their pieces
        self.older: dict[str | bytes, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.merges is None or "<|" in text:  # may be a special token, which has its own case
            words = text.encode().split()
        else:  # the known form lower-cases anyway
            words = text.lower().split() if text.isascii() else text.encode().lower().split()
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        new = set(words).difference(self.known)
        if new:
            self._learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def _learn(self, words: set[str | bytes]) -> None:
        """Remembers the ids of words that are not among the known."""
        unmet = words.difference(self.older)  # an intersection would pass over all that is remembered
        again = words - unmet
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = list(unmet)
        own = [w if isinstance(w, str) else w.decode() for w in new]
        merged = self.merges.words(own, self.known, self.older) if self.merges else {}
        for word, text in zip(new, own, strict=True):
            out = merged.get(text)
            self.known[word] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if out is None else out


class Merges:
    """Byte-pair merges with word ends, on tiktoken's core.

    The end of a word is the byte 255, which no UTF-8 has; a word's last byte merges with it
    first. tiktoken joins what forms a token in the order of ranks; that equals the listed
    merges if every token's own bytes merge into it, as tests check for the file in use.
    """

    #: The pattern that splits words, and the byte alphabet's printable ranges.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PRINTABLE = (range(33, 127), range(161, 173), range(174, 256))
    END = b"\xff"

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        import regex
        import tiktoken

        plain = [b for r in self.PRINTABLE for b in r]
        rest = [b for b in range(256) if b not in plain]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(alphabet[c] for c in body) + self.END * (body != token)

        ranks = {bytes([b]): b for b in range(256)}
        for token in [bytes([b]) + self.END for b in range(255)] + [raw(x + y) for x, y in merges]:
            ranks.setdefault(token, len(ranks))
        by_raw = {raw(t): i for t, i in vocab.items() if not t.startswith("<|")}
        self.out = [np.array([by_raw.get(t, 0)], "<u4").tobytes() for t in ranks]
        self.core = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(self.PATTERN + r"|\n").findall
        self.latin = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\u024f]+").fullmatch

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """For a tokenizer file of the known form, else None."""
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model, before = own["model"], own["pre_tokenizer"] or {}
        parts = before.get("pretokenizers") or [{}]
        forms = [x.get("type") for x in (own["normalizer"] or {}).get("normalizers", [])]
        if (model.get("type"), model.get("end_of_word_suffix"), parts[0].get("pattern"), parts[-1].get("type"), forms) != ("BPE", "</w>", {"Regex": cls.PATTERN}, "ByteLevel", ["NFC", "Replace", "Lowercase"]):
            return None
        return cls(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def words(self, texts: list[str], known: dict, older: dict) -> dict[str, bytes]:
        """The ids of different words without white space, all cut into pieces at once; of none that the tokenizer itself should judge.

        known has the ids of pieces met before and gets the new ones; older is looked up beside it.
        """
        plain = [t for t in texts if "<|" not in t and (t.isascii() and t.isprintable() or self.latin(t))]
        if not plain:
            return {}
        out, own = [], []
        get, put = known.get, own.append
        for piece in self.split("\n".join(plain).lower()):
            if piece == "\n":  # no piece reaches over the end of a word
                out.append(b"".join(own))
                own.clear()
                continue
            found = get(piece)
            if found is None:
                found = older.get(piece)
                if found is None:
                    found = b"".join([self.out[t] for t in self.core.encode_single_piece(piece.encode() + self.END)])
                known[piece] = found
            put(found)
        out.append(b"".join(own))
        return dict(zip(plain, out, strict=True))


@functools.cache
def _encoder(path: str | Callable[[], str]) -> WordEncoder:
    return WordEncoder(path() if callable(path) else path)


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces. tokenizer: its file's path, or a function that finds it where it is called."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(tokenizer)
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            ids = encoder.ids(text) + end
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                rows.append((doc_id, i, at // 4, len(own) // 4, zlib.crc32(own)))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity up to the given one: the highest value of a multiset that fits, and its last item or -1."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        gains = best[c - lengths[: upto[c]]] + values[: upto[c]]
        i = gains.argmax()
        if gains[i] > best[c - 1]:
            best[c], last[c] = gains[i], i
        else:
            best[c] = best[c - 1]
    return best, last


def _chosen(last: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    out, c = Counter(), capacity
    while c > 0:
        i = int(last[c])
        if i < 0:
            c -= 1
        else:
            out[i] += 1
            c -= int(lengths[i])
    return out


@dataclass
class Program:
    """A solution of the covering program: fractional uses of configurations, and a proven lower bound of any."""

    uses: dict[Config, float]
    bound: float

    @property
    def total(self) -> float:
        return sum(self.uses.values())

    @property
    def gap(self) -> float:
        """How far the uses may be from the fewest, as a share of the bound."""
        return self.total / self.bound - 1 if self.bound else 0.0


def fractional(histogram: dict[int, int], capacity: int, rounds: int = 200, gap: float = GAP, rate: float = 2.0, step: float = 0.25) -> Program:
    """Uses of configurations, full or not, that cover the histogram, at most gap above the dual bound or what rounds reach.

    Prices of lengths follow multiplicative weights: a length's price is its share of a
    sequence times a weight that grows exponentially with how far its cover lags. One knapsack
    program gives the best contents of every capacity under these prices, so the best
    configuration that holds a given length, and a bound: the histogram's price over the best
    configuration's. Lagging lengths get their configurations while full ones are found; what
    is left, often a small share, starts with best-fit's configurations. Where that leaves a
    gap, the weights go on over all configurations found so far, new ones being priced in
    between, until the bound is met.
    """
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[x] for x in lengths], float)
    if not len(lengths):
        return Program({}, 0.0)
    done, used, bound = np.zeros(len(lengths)), Counter(), need @ lengths / capacity
    for _ in range(rounds):
        open_ = np.flatnonzero(done < need * (1 - 1e-9))
        if not len(open_) or (need - done) @ lengths < 0.005 * (need @ lengths):
            break
        lag = (1 - done / need)[open_]
        own = lengths[open_]
        prices = own / capacity * np.exp(rate * (lag - lag.max()))
        best, last = knapsack(prices, own, capacity)
        bound = max(bound, need[open_] @ prices / best[capacity])
        before = done.sum()
        for i in np.argsort(-lag * own, kind="stable")[: max(8, len(open_) // 8)]:
            chosen = _chosen(last, own, capacity - int(own[i]))
            chosen[int(i)] += 1
            rows, counts = open_[list(chosen)], np.array(list(chosen.values()), float)
            n = min((need[rows] * step / counts).min(), ((need - done)[rows] / counts).min()) if own[list(chosen)] @ counts == capacity else 0
            if n > 0:
                done[rows] += n * counts
                used[_config(lengths, dict(zip(rows.tolist(), counts.astype(int).tolist(), strict=True)))] += n
        if done.sum() == before:
            break
    rest = {int(x): int(np.ceil(k * PARTS)) for x, k in zip(lengths, need - done, strict=True) if k > 1e-9 * need.max()}
    for config, n in best_fit(rest, capacity).items():
        used[tuple(sorted(config, reverse=True))] += n / PARTS
    found = Program(dict(used), bound)
    return found if found.gap <= gap or found.total <= math.ceil(bound - 1e-6) else _improved(lengths, need, capacity, found, rounds, gap)


def _config(lengths: np.ndarray, contents: dict[int, int]) -> Config:
    return tuple(sorted(((int(lengths[i]), k) for i, k in contents.items()), reverse=True))


def _improved(lengths: np.ndarray, need: np.ndarray, capacity: int, known: Program, rounds: int, gap: float, inner: int = 400, rate: float = 0.05) -> Program:
    """Multiplicative weights over a growing pool of configurations, begun with those of known."""
    at = {int(x): i for i, x in enumerate(lengths)}
    pool, columns, best = [], np.zeros((len(lengths), 0)), known

    def add(configs: list[Config]) -> None:
        nonlocal columns
        new = [c for c in dict.fromkeys(configs) if c not in seen]
        seen.update(new)
        more = np.zeros((len(lengths), len(new)))
        for j, config in enumerate(new):
            for x, k in config:
                more[at[x], j] = k / need[at[x]]
        pool.extend(new)
        columns = np.concatenate((columns, more), axis=1)

    seen: set[Config] = set()
    add(list(known.uses))
    weights, bound = lengths * need / (lengths @ need), known.bound
    for _ in range(max(1, rounds // 10)):
        taken, cover, mean = np.zeros(len(pool)), np.zeros(len(lengths)), np.zeros(len(lengths))
        log = np.log(weights)
        for t in range(inner):
            weights = np.exp(log - log.max())
            weights /= weights.sum()
            mean += weights
            j = int((weights @ columns).argmax())
            own = columns[:, j] / columns[:, j].max()
            taken[j] += 1 / columns[:, j].max()
            cover += own
            log = log - rate * own
        scale = cover.min()
        if scale > 0 and taken.sum() / scale < best.total:
            best = Program({pool[j]: taken[j] / scale for j in np.flatnonzero(taken)}, bound)
        for w in (mean / mean.sum(), weights):
            prices = w / need
            values, last = knapsack(prices, lengths, capacity)
            bound = max(bound, prices @ need / values[capacity])
            dear = [_chosen(last, lengths, capacity)]
            for i in np.argsort(-(prices + values[capacity - lengths]), kind="stable")[:64]:
                own = _chosen(last, lengths, capacity - int(lengths[i]))
                own[int(i)] += 1
                dear.append(own)
            add([_config(lengths, own) for own in dear])
        best = Program(best.uses, bound)
        weights = np.maximum(mean / mean.sum(), 1e-12)
        if best.gap <= gap or best.total <= math.ceil(bound - 1e-6):
            break
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Configurations of best-fit packing, largest first; bins alike are handled together."""
    bins: dict[int, Counter] = {}  # free space -> contents -> how many
    free: list[int] = []
    out: Counter = Counter()

    def put(space: int, contents: Config, n: int) -> None:
        if space == 0:
            out[contents] += n
        else:
            if space not in bins:
                bins[space] = Counter()
                bisect.insort(free, space)
            bins[space][contents] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(free, length)
            if i == len(free):
                each = min(left, capacity // length)
                n = left // each
                put(capacity - each * length, ((length, each),), n)
                left -= n * each
                continue
            space = free[i]
            contents, n = next(iter(bins[space].items()))
            each = min(space // length, left)
            n = min(n, left // each)
            bins[space][contents] -= n
            if not bins[space][contents]:
                del bins[space][contents]
            if not bins[space]:
                del bins[space]
                free.pop(i)
            put(space - each * length, (*contents, (length, each)), n)
            left -= n * each
    for own in bins.values():
        out.update(own)
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 200) -> list[tuple[Config, int]]:
    """(configuration, how many sequences) that hold the histogram exactly.

    Uses are rounded to whole ones that no length exceeds. What rounding leaves is a smaller
    program of the same kind, solved again; the last rest is packed best-fit.
    """
    out: Counter = Counter()
    left = Counter(histogram)
    for again in range(4):
        held = sum(left.values())
        solved = fractional(+left, capacity, rounds if not again else rounds // 4, GAP if not again else 1.0)
        for config, n in sorted(solved.uses.items(), key=lambda x: -x[1]):
            whole = min([round(n), *(left[x] // k for x, k in config)])
            if whole > 0:
                out[config] += whole
                for x, k in config:
                    left[x] -= k * whole
        if sum(left.values()) > 0.9 * held:
            break
    out.update(best_fit(+left, capacity))
    return sorted(out.items(), reverse=True)


@dataclass
class Plan:
    """For each length, runs of piece numbers and the sequences that they go to."""

    rows: pd.DataFrame  # length, first, per, sequence, offset
    sequences: int


def plan(configs: list[tuple[Config, int]]) -> Plan:
    rows, given, sequence = [], Counter(), 0
    for config, n in configs:
        offset = 0
        for length, per in config:
            rows.append((length, given[length], per, sequence, offset))
            given[length] += per * n
            offset += per * length
        sequence += n
    return Plan(pd.DataFrame(rows, columns=["length", "first", "per", "sequence", "offset"]), sequence)


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = 200) -> DataFrame:
    """PIECES' columns, then sequence_id and offset: each piece's place."""
    return place(pieces(docs, tokenizer, capacity, end_id), capacity, rounds)


def place(found: DataFrame, capacity: int = CAPACITY, rounds: int = 200) -> DataFrame:
    """found (of a column length, at most capacity) with sequence_id and offset."""
    spark = found.sparkSession
    rows = cut(found.withColumn("__row", F.monotonically_increasing_id()))  # the numbers stay as they were stored
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    keyed = rows.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    planned = plan(configurations(histogram, capacity, rounds))
    # The plan has a row for each length of each configuration: those found in rounds of at most
    # capacity / 8 each and best-fit's, which end at most one kind of bin for each length. Neither grows with the pieces.
    shared = spark.sparkContext.broadcast({int(x): tuple(g[c].to_numpy() for c in ("first", "per", "sequence", "offset")) for x, g in planned.rows.groupby("length")})
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "__bucket", ahead.alias("__ahead"))
    own = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__row"))
    numbered = keyed.withColumn("__own", own).join(starts, ["length", "__bucket"]).select(*found.columns, (F.col("__ahead") + F.col("__own") - 1).alias("__k"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        lengths, ks = batch.column(names.index("length")).to_numpy(), batch.column(names.index("__k")).to_numpy()
        seq, off = np.empty(len(ks), np.int64), np.empty(len(ks), np.int64)
        for x in np.unique(lengths):
            rows = np.flatnonzero(lengths == x)
            first, per, sequence, offset = shared.value[int(x)]
            run_ = np.searchsorted(first, ks[rows], "right") - 1
            k = ks[rows] - first[run_]
            seq[rows] = sequence[run_] + k // per[run_]
            off[rows] = offset[run_] + k % per[run_] * x
        kept = [i for i, n in enumerate(names) if n != "__k"]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(seq), pa.array(off)], [*(names[i] for i in kept), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return map_texts(numbered, run, schema)
