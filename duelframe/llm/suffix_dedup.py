"""Exact substring dedup: maximal repeats from the interval tree of an enhanced suffix array.

Two lengths count: strings of ``length`` bytes that start more than once are removed, and
repeats of ``least`` bytes or more are reported as passages. Each window of ``least`` bytes is
dealt to its anchor, the leftmost least hash among its ``GRAM``-byte strings; equal windows
have equal anchors at equal offsets, so what repeats meets under its anchor's hash.
Consecutive windows with one anchor form a segment, whose bytes reach on until a string of
``length`` bytes ends that begins with its last window. Equal segments are counted, not
gathered, and repeat as a whole; one of each, and those that stand alone, go on if their
anchor's hash occurs in another segment.

These segments, some megabytes of whole groups at a time, get a sparse suffix array: only
places are sorted whose window occurs again and whose occurrences differ in the byte to their
left or begin a segment, for all others lie within such a repeat. Common-prefix lengths and a
stack scan yield the tree of common-prefix intervals; an interval whose occurrences differ to
their left is a maximal repeat, reported with all occurrences. Where an anchor has more than
``most`` different segments, which one task should not hold, windows are counted by anchor
and two 64-bit hashes instead; no number of occurrences overloads that.

Texts are UTF-8 bytes; nulls are empty; matches never cross documents. Equal rows are
documents of their own. Texts shorter than ``length`` keep all. Empty in, empty out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, prepare, scratch, written

LENGTH = 400
#: Bytes of the shortest reported passage: about fifty words.
PASSAGE = 256
GRAM = 48
BASE = 0x9E3779B97F4A7C15
PLACE = 24  # bits of a window's place within a part
PART = 1 << (PLACE - 1)  # places of a part at which a window may begin
BATCH_BYTES = 1 << 21
MOST = 8192
#: Neighbouring windows that are ruled out together where windows are counted.
PIECE = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i up to n."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64)))) for b in (BASE, inverse))


BYTE_VALUES = [_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Rolling:
    """Hashes of substrings of a byte array from running sums."""

    def __init__(self, data: np.ndarray, kind: int = 0) -> None:
        size = 1 << max(16, int(len(data)).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[kind][data] * self.up[: len(data)], dtype=np.uint64)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, n: int) -> np.ndarray:
        """Of every n bytes."""
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values."""
    n = len(values) - w + 1
    padded = np.concatenate((values, np.full(-len(values) % w, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


@dataclass
class Segments:
    doc: np.ndarray  # number of the text
    lo: np.ndarray  # first window's start, within the text
    windows: np.ndarray  # how many
    size: np.ndarray  # bytes, to the end of a string of length bytes from the last window
    anchor: np.ndarray  # hash
    whole: np.ndarray  # hash of all bytes


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, least: int = PASSAGE, gram: int = GRAM, limit: int | None = None) -> Segments:
    """The segments of concatenated texts; offsets: where each begins, and the end; limit: places at which a window may begin."""
    empty = np.zeros(0, np.int64)
    if len(data) < least:
        return Segments(*(empty,) * 4, empty.view(np.uint64), empty.view(np.uint64))
    rolling = Rolling(data)
    hashes = rolling.grams(gram)
    mask = np.uint64((1 << PLACE) - 1)
    packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_min(packed, least - gram + 1) & mask).astype(np.int64)  # of each window's anchor
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    ok = np.arange(len(place)) + least <= offsets[doc + 1]
    ok[limit:] &= limit is None
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new & ok)
    last = np.flatnonzero(ok & np.concatenate((new[1:] | ~ok[1:], [True])))
    own = doc[starts]
    ends = np.minimum(last + length, offsets[own + 1])
    return Segments(own, starts - offsets[own], last - starts + 1, ends - starts, hashes[place[starts]], rolling.of(starts, ends))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _parts(offsets: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, numbers of texts) of runs of texts up to most bytes; longer texts in overlapping pieces."""
    at = 0
    while at < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        if end > at:
            yield offsets[at:end], offsets[at + 1 : end + 1], np.arange(at, end)
            at = end
        else:
            for x in np.arange(offsets[at], offsets[at + 1], most):
                yield np.array([x]), np.array([min(offsets[at + 1], x + most + length - 1)]), np.array([at])
            at += 1


KEY = "id bigint, twin bigint"
SEGMENT = f"{KEY}, lo int, windows int, size int, anchor bigint, whole bigint"
#: What equal segments share; two independent hashes of their bytes among it.
SAME = ["anchor", "whole", "size", "windows"]


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that only equal rows share: id, twin."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("twin"))


def _table(columns, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """A batch of numpy columns."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names)


def _segment_rows(keyed: DataFrame, length: int, least: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _bytes_of(batch.column(2))
        ids, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = []
        for starts, ends, numbers in _parts(offsets, length, PART):
            first = int(starts[0])
            s = segments(data[first : int(ends[-1])], np.concatenate((starts, ends[-1:])) - first, length, least, limit=PART)
            number = numbers[s.doc]
            found.append((ids[number], twins[number], s.lo + (starts - offsets[numbers])[s.doc], s.windows, s.size, s.anchor.view(np.int64), s.whole.view(np.int64)))
        return _table(map(np.concatenate, zip(*found, strict=True)), ["id", "twin", "lo", "windows", "size", "anchor", "whole"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])

    return map_texts(keyed.select("id", "twin", "text"), run, SEGMENT)


# --- the enhanced suffix array ---


@dataclass
class Repeat:
    length: int
    places: np.ndarray


def shared_prefix(a: bytes, b: bytes) -> int:
    """How many first bytes a and b share."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[:half] == b[:half] else (low, half - 1)
    return low


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of every common-prefix interval of at least least bytes: the inner nodes of the tree."""
    stack: list[tuple[int, int]] = []  # (length, first), lengths rising
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(texts: list[bytes], least: int) -> list[Repeat]:
    """Every maximal repeat of at least least bytes with all its occurrences, as places in the joined texts.

    A repeat is maximal if neither end can grow for all its occurrences.
    """
    return _maximal_repeats(b"".join(texts), np.cumsum([0, *map(len, texts)]), least)


def _maximal_repeats(data: bytes, offsets: np.ndarray, least: int, windows: np.ndarray | None = None, longest: int | None = None) -> list[Repeat]:
    """windows: at how many of each text's first places an occurrence may begin; longest: bytes that repeats are cut to; no bound, if not given."""
    starts, sizes = offsets[:-1], np.diff(offsets)
    counts = np.maximum(sizes - least + 1, 0) if windows is None else np.minimum(windows, np.maximum(sizes - least + 1, 0))
    total = int(counts.sum())
    if total < 2:
        return []
    text = np.repeat(np.arange(len(starts)), counts)
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    places = starts[text] + within
    own = np.frombuffer(data, np.uint8)
    hashes = Rolling(own).grams(least)[places]
    order = np.argsort(hashes)
    hashes = hashes[order]
    # The byte to the left; -1 - place where a text begins, which differs from all others.
    left = np.where(within == 0, -1 - places, own[np.maximum(places - 1, 0)].astype(np.int64))[order]
    bounds = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    runs = np.diff(np.concatenate((bounds, [total])))
    # Where all of a run agree to the left, the run one byte earlier holds its repeats.
    diverse = np.maximum.reduceat(left, bounds) != np.minimum.reduceat(left, bounds)
    ends = offsets[1:][text]
    out: list[Repeat] = []
    for at in np.flatnonzero(diverse & (runs > 1)):
        members = order[bounds[at] : bounds[at] + runs[at]]
        suffixes = [(data[p:e], i) for p, e, i in zip(places[members].tolist(), ends[members].tolist(), range(bounds[at], bounds[at] + runs[at]), strict=True)]
        suffixes.sort()
        lcp = [0, *(min(shared_prefix(a[0], b[0]), longest or len(data)) for a, b in zip(suffixes, suffixes[1:], strict=False))]
        rank = np.array([i for _, i in suffixes])
        for length, x, y in intervals(lcp, least):
            side = left[rank[x:y]]
            if (side != side[0]).any():
                out.append(Repeat(length, places[order[rank[x:y]]]))
    return out


RANGE = f"{KEY}, `start` int, `end` int"
OCCURRENCE = f"{RANGE}, `group` bigint"
BYTES = f"{KEY}, anchor bigint, lo int, windows int, kinds bigint, bytes binary"


def _ranges(rows: pa.Table, least: int, longest: int | None) -> pa.RecordBatch:
    """Of the segments' repeats: of each place the longest range; if longest is given, every occurrence of each, cut to so many bytes, with its group's number."""
    own = rows.combine_chunks()
    data, offsets = _bytes_of(own.column("bytes").chunk(0)) if own.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    raw = data.tobytes()
    found = _maximal_repeats(raw, offsets, least, own.column("windows").to_numpy(), longest)
    at = np.concatenate([x.places for x in found]) if found else np.zeros(0, np.int64)
    size = np.concatenate([np.full(len(x.places), x.length) for x in found]) if found else np.zeros(0, np.int64)
    names, kinds = ["id", "twin", "start", "end"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    if longest:
        number = Rolling(data).of(at, at + size).view(np.int64)
        names, kinds = [*names, "group"], [*kinds, pa.int64()]
    else:
        order = np.lexsort((-size, at))
        order = order[np.concatenate(([True], np.diff(at[order]) != 0))] if len(at) else order
        at, size = at[order], size[order]
    text = np.searchsorted(offsets, at, "right") - 1
    first = own.column("lo").to_numpy()[text] + at - offsets[text]
    columns = [own.column("id").to_numpy()[text], own.column("twin").to_numpy()[text], first, first + size]
    return _table([*columns, number] if longest else columns, names, kinds)


def _array_ranges(bytes_: DataFrame, least: int, longest: int | None = None) -> DataFrame:
    """What _ranges finds in whole groups of an anchor, some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            anchors = batch.column(0).to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column(5)).to_numpy())
            cuts = np.flatnonzero(np.concatenate(([last is None or anchors[0] != last], anchors[1:] != anchors[:-1])))
            at = 0
            for c in cuts.tolist():
                if size + (sizes[c - 1] if c else 0) - (sizes[at - 1] if at else 0) >= BATCH_BYTES:
                    held.append(batch.slice(at, c - at))
                    yield _ranges(pa.Table.from_batches(held), least, longest)
                    held, size, at = [], 0, c
            held.append(batch.slice(at))
            size += int(sizes[-1] - (sizes[at - 1] if at else 0))
            last = anchors[-1]
        if held:
            yield _ranges(pa.Table.from_batches(held), least, longest)

    prepare(bytes_.sparkSession)
    ordered = bytes_.select("anchor", "id", "twin", "lo", "windows", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, OCCURRENCE if longest else RANGE)


def _counted(rows: DataFrame) -> DataFrame:
    """The rows of one anchor and two equal hashes each, where more than one has them."""
    key = ["anchor", "h1", "h2"]
    return rows.join(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), key, "left_semi")


def _hashed_ranges(bytes_: DataFrame, length: int) -> DataFrame:
    """Ranges of repeats by counting the hashes of windows, by anchor.

    Windows are dealt to pieces by their distance from the anchor. A piece's windows can only
    repeat if the bytes that they all share do; those are counted first.
    """
    own, kinds = ["id", "twin", "lo"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    schema = f"{KEY}, anchor bigint, lo int, at int, h1 bigint, h2 bigint"

    def hashed(batch: pa.RecordBatch, strings) -> pa.RecordBatch:
        """A row for each (number, first byte, end) that strings gives for a row's number, anchor's place and windows."""
        out = []
        for i, (id_, twin, anchor, lo, windows, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
            raw = np.frombuffer(data, np.uint8)
            one = Rolling(raw)
            place = windows - 1 + int(np.argmax(one.grams(GRAM)[windows - 1 :].view(np.int64) == anchor))
            at, a, b = strings(i, place, min(windows, len(raw) - length + 1))
            out.append((*(np.full(len(at), x, np.int64) for x in (id_, twin, anchor, lo)), at, one.of(a, b).view(np.int64), Rolling(raw, 1).of(a, b).view(np.int64)))
        return _table(map(np.concatenate, zip(*out, strict=True)), ["id", "twin", "anchor", "lo", "at", "h1", "h2"], kinds)

    def cores(batch: pa.RecordBatch) -> pa.RecordBatch:
        def strings(_: int, place: int, n: int) -> tuple:
            piece = np.unique((place - np.arange(max(n, 0))) // PIECE)
            last = place - PIECE * piece
            return piece, last, last - PIECE + 1 + length

        return hashed(batch, strings)

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        asked = batch.column(6).to_pylist()

        def strings(i: int, place: int, n: int) -> tuple:
            at = np.arange(max(n, 0))
            at = at[np.isin((place - at) // PIECE, asked[i])]
            return at, at, at + length

        return hashed(batch, strings)

    rows = bytes_.select("id", "twin", "anchor", "lo", "windows", "bytes")
    live = _counted(map_texts(rows, cores, schema)).groupBy(*own).agg(F.collect_list("at").alias("pieces"))  # of one segment
    often = _counted(map_texts(rows.join(live, own).select(*rows.columns, "pieces"), windows, schema))
    start = F.col("lo") + F.col("at")
    return often.select("id", "twin", start.alias("start"), (start + length).alias("end"))


def _candidates(docs: DataFrame, length: int, least: int, twice: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All segments; of the classes of equal ones those that repeat or share their anchor, with a representative; bytes of the latter.

    twice: bytes of every repeating class as well, two times.
    """
    keyed = _identified(docs)
    found = written(_segment_rows(keyed, length, least))
    classes = found.groupBy(*SAME).agg(F.count("*").alias("n"), F.min(F.struct("id", "twin", "lo")).alias("one")).select(*SAME, "n", "one.*")
    groups = classes.groupBy("anchor").agg(F.count("*").alias("kinds"))
    classes = written(classes.join(groups, "anchor").where("n > 1 OR kinds > 1"))
    asked = classes.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("n") > 1, 2).otherwise(1)))) if twice else classes.where("kinds > 1")
    asked = asked.select("id", "twin", F.struct("anchor", "lo", "windows", "size", "kinds").alias("s"))
    lists = asked.groupBy("id", "twin").agg(F.collect_list("s").alias("list"))  # of one document's segments

    def sliced(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, twin, text, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            data = (text or "").encode()
            out += [(doc, twin, s["anchor"], s["lo"], s["windows"], s["kinds"], data[s["lo"] : s["lo"] + s["size"]]) for s in own]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "twin", "anchor", "lo", "windows", "kinds", "bytes"])

    texts = keyed.select("id", "twin", "text").join(lists, ["id", "twin"]).select("id", "twin", "text", "list")
    return found, classes, written(map_texts(texts, sliced, BYTES))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, most: int = MOST, least: int = PASSAGE) -> DataFrame:
    """id, twin (the row's key), start, end: byte ranges of repeats.

    Those of least bytes or more cover what strings of least bytes repeat, those of length or
    more what strings of length bytes repeat.
    """
    found, classes, bytes_ = _candidates(docs, length, least)
    whole = found.join(classes.where("n > 1").select(*SAME), SAME, "left_semi").select("id", "twin", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end"))
    out = whole.unionByName(_array_ranges(bytes_.where(F.col("kinds") <= most), least))
    often = bytes_.where(F.col("kinds") > most)
    for n in sorted({length, least}):
        out = out.unionByName(_hashed_ranges(often, n))
    return out


def repeat_groups(docs: DataFrame, length: int = LENGTH, least: int = PASSAGE) -> DataFrame:
    """group, length, doc_id, start: repeats of least to length bytes with all their occurrences.

    group is a hash of the repeated bytes. What repeats over more than length bytes, or over
    several anchors, appears as overlapping groups of up to length bytes, one at least for each
    anchor. An anchor's different segments are in one task here, unlike in dedup_substrings.
    """
    found, classes, bytes_ = _candidates(docs, length, least, twice=True)
    inner = _array_ranges(bytes_, least, length)
    # A class's members hold what its representative holds, at the same places.
    reps = classes.select(*SAME, F.col("id").alias("__i"), F.col("twin").alias("__t"), F.col("lo").alias("__lo"))
    inside = inner.join(reps, (F.col("id") == F.col("__i")) & (F.col("twin") == F.col("__t")) & (F.col("start") >= F.col("__lo")) & (F.col("start") < F.col("__lo") + F.col("windows")))
    asked = inside.select(*SAME, (F.col("start") - F.col("__lo")).alias("at"), (F.col("end") - F.col("start")).alias("length"), "group").distinct()
    spread = found.join(asked, SAME).select("group", "length", "id", "twin", (F.col("lo") + F.col("at")).alias("start"))
    ids = _identified(docs).select("doc_id", "id", "twin")
    return spread.join(ids, ["id", "twin"]).select("group", "length", "doc_id", "start")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges that don't touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, most: int = MOST, least: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), n_removed, kept (the bytes that are left), passages.

    passages: the byte ranges covered by maximal repeats of least bytes or more (least at
    most length), whether removed or not.
    """
    if not GRAM <= least <= length:
        raise ValueError(f"least must lie between {GRAM} and length")
    with scratch(docs.sparkSession, keep=1):  # of all that is stored on the way the ranges stay, which the result reads
        ranges = repeated_ranges(docs, length, most, least)
        lists = written(ranges.groupBy("id", "twin").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))  # of one document
    joined = _identified(docs).join(lists, ["id", "twin"], "left").select("doc_id", "text", "ranges")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data, found = (text or "").encode(), [(r["start"], r["end"]) for r in own or ()]
            spans = merged([(a, b) for a, b in found if b - a >= length])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((doc_id, len(data), [{"start": a, "end": b} for a, b in spans], len(data) - len(kept), kept, [{"start": a, "end": b} for a, b in merged(found)]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (batch.schema.field(0).type, pa.int64(), span, pa.int64(), pa.binary(), span)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "spans", "n_removed", "kept", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<`start`: int, `end`: int>>"
    return map_texts(joined, run, f"doc_id {kind}, n_bytes bigint, spans {span}, n_removed bigint, kept binary, passages {span}")
