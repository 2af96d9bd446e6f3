"""Reversible line dedup: sharded cuckoo filters over an exact reference-count table.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. The index
holds, for each key, the number of documents that contain it. A key is *hot* when at least
``min_docs`` documents hold it; every hot key has a fingerprint in the cuckoo filter of its
shard. Insertions and deletions of documents change the counts, and the filters follow
(cuckoo filters can delete). Keys of the table that a filter would report wrongly are kept
beside it in an exact list, so for indexed documents a filter answers exactly.

Nulls: a null text is one empty line. Empty keys are never dropped. Repeated rows are
documents of their own. An empty table gives an empty index and an empty result.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, texts

SLOTS = 4
KEYS_PER_SHARD = 100_000
BROADCAST_BYTES = 32 << 20


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # for bytes both look at ASCII alone


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; keys are 16-byte digests."""

    def __init__(self, buckets: int) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, int(keys / (SLOTS * 0.8)) + 1)
        return cls(1 << (need - 1).bit_length())

    @staticmethod
    def parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (n, 2) uint64 digests: fingerprint, first bucket hash, the offset between both buckets."""
        prints = (digests[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, digests[:, 1] >> np.uint64(16), CuckooFilter.jump(prints)

    @staticmethod
    def jump(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        prints, first, jump = self.parts(digests)
        mask = np.uint64(len(self.table) - 1)
        a = first & mask
        b = a ^ (jump & mask)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def _places(self, digest: np.ndarray) -> tuple[int, int, int]:
        prints, first, jump = self.parts(digest[None, :])
        mask = len(self.table) - 1
        a = int(first[0]) & mask
        return int(prints[0]), a, a ^ (int(jump[0]) & mask)

    def insert(self, digest: np.ndarray) -> bool:
        """False if no place was found; the filter then has to be built anew, larger."""
        fingerprint, a, b = self._places(digest)
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return True
        bucket, mask = b, len(self.table) - 1
        for kick in range(500):
            slot = kick % SLOTS
            fingerprint, self.table[bucket, slot] = int(self.table[bucket, slot]), fingerprint
            bucket ^= int(self.jump(np.array([fingerprint], np.uint16))[0]) & mask
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return True
        return False

    def delete(self, digest: np.ndarray) -> bool:
        fingerprint, a, b = self._places(digest)
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == fingerprint)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    @classmethod
    def built(cls, digests: np.ndarray) -> CuckooFilter:
        out, size = cls.sized(len(digests)), len(digests)
        while not all(out.insert(d) for d in digests):
            size = size * 2 + 4
            out = cls.sized(size)
        return out

    def dumps(self) -> bytes:
        return struct.pack("<q", len(self.table)) + self.table.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        out = cls(struct.unpack_from("<q", data)[0])
        out.table = np.frombuffer(data, np.uint16, offset=8).reshape(-1, SLOTS).copy()
        return out


def _as_digests(keys: pa.ChunkedArray) -> np.ndarray:
    """Binary keys of 16 bytes as (n, 2) uint64, without a Python object for each."""
    parts = []
    for chunk in keys.chunks:
        if len(chunk):
            start = np.frombuffer(chunk.buffers()[1], np.int32, 1, 4 * chunk.offset)[0]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint64, 2 * len(chunk), int(start)))
    return np.concatenate(parts).reshape(-1, 2) if parts else np.zeros((0, 2), np.uint64)


def _update_shard(key: tuple, filters: pa.Table, refs: pa.Table) -> pa.Table:
    """A shard's filter after its keys changed, with the exact list of keys it would report wrongly."""
    digests = _as_digests(refs["key"])
    hot, was = (np.array(refs[c].combine_chunks().to_numpy(zero_copy_only=False), bool) for c in ("hot", "was"))
    kept = CuckooFilter.loads(filters["filter"][0].as_py()) if len(filters) else None
    if kept is not None and hot.sum() <= kept.table.size * 0.9:
        for d in digests[was & ~hot]:
            kept.delete(d)
        if not all(kept.insert(d) for d in digests[hot & ~was]):
            kept = None
    else:
        kept = None
    if kept is None:
        kept = CuckooFilter.built(digests[hot])
    cold = digests[~hot]
    wrong = cold[kept.contains(cold)]
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([kept.dumps()], pa.binary()), "wrong": pa.array([wrong.tobytes()], pa.binary())})


@dataclass
class LineIndex:
    """refs: key binary, refs long, shard int. filters: shard int, filter binary, wrong binary."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        counted = cut(_keys(docs, min_chars).groupBy("key").agg(F.count("*").alias("refs")))
        shards = max(1, -(-counted.count() // KEYS_PER_SHARD))
        empty = cls.empty(docs.sparkSession, shards, min_docs, min_chars)
        return empty._changed(counted.select("key", "refs", F.lit(0).cast("long").alias("before")))

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 1, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        return cls(spark.createDataFrame([], "key binary, refs long, shard int"), spark.createDataFrame([], "shard int, filter binary, wrong binary"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs added."""
        return self._add(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without docs, which must have been inserted; lines they alone made hot come back."""
        return self._add(docs, -1)

    def _add(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = _keys(docs, self.min_chars).groupBy("key").agg((F.count("*") * sign).alias("delta"))
        both = self.refs.select("key", "refs").join(delta, "key", "full")
        before = F.coalesce("refs", F.lit(0)).cast("long")
        rows = cut(both.select("key", (before + F.coalesce("delta", F.lit(0))).alias("refs"), before.alias("before")))
        shards = max(1, -(-rows.count() // KEYS_PER_SHARD))
        # An index that has outgrown its shards gets new ones, their filters built from the counts.
        index = self if shards <= 2 * self.shards else LineIndex.empty(docs.sparkSession, shards, self.min_docs, self.min_chars)
        return index._changed(rows)

    def _changed(self, both: DataFrame) -> LineIndex:
        shard = (F.conv(F.hex(F.substring("key", 3, 3)), 16, 10).cast("long") % self.shards).cast("int")
        flagged = both.select("key", shard.alias("shard"), (F.col("refs") >= self.min_docs).alias("hot"), (F.col("before") >= self.min_docs).alias("was"))
        filters = cut(self.filters.groupBy("shard").cogroup(flagged.groupBy("shard")).applyInArrow(_update_shard, "shard int, filter binary, wrong binary"))
        return LineIndex(both.where("refs > 0").select("key", "refs", shard.alias("shard")), filters, self.shards, self.min_docs, self.min_chars)

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs' columns with the text of its kept lines, then n_lines and n_dropped. docs must be in the index.

        The filters travel to every task while they are small; beyond BROADCAST_BYTES the
        lines go to the count table instead, with the same result. The two counts replace columns
        of these names.
        """
        docs = docs.drop("n_lines", "n_dropped")
        size = self.filters.agg(F.sum(F.length("filter") + F.length("wrong"))).first()[0] or 0
        return self._by_filters(docs) if size <= BROADCAST_BYTES else self._by_table(docs)

    def _by_filters(self, docs: DataFrame) -> DataFrame:
        held = [(r["shard"], bytes(r["filter"]), bytes(r["wrong"])) for r in self.filters.collect()]
        shared, min_chars, shards = docs.sparkSession.sparkContext.broadcast(held), self.min_chars, self.shards
        opened: list = []

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not opened:
                opened.append(_Filters(shared.value, shards))
            return _drop_lines(batch, opened[0].hot, min_chars)

        return map_texts(docs, run, _out_schema(docs))

    def _by_table(self, docs: DataFrame) -> DataFrame:
        min_chars, names = self.min_chars, docs.columns
        tagged = docs.withColumn("__id", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))))

        def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                own = _digests(text, min_chars) - {b""}
                ids += [i] * len(own)
                keys += own
            return pa.RecordBatch.from_pydict({"__id": pa.array(ids, pa.string()), "key": pa.array(keys, pa.binary())})

        pairs = map_texts(tagged.select("__id", "text").dropDuplicates(["__id"]), listed, "__id string, key binary")
        hot = pairs.join(self.refs.where(F.col("refs") >= self.min_docs).select("key"), "key", "left_semi")
        found = hot.groupBy("__id").agg(F.collect_list("key").alias("__hot"))  # at most a document's own lines
        joined = tagged.join(found, "__id", "left").select(*names, "__hot")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.column(batch.num_columns - 1).to_pylist()
            inner = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            known = {bytes(k) for keys in own for k in keys or ()}
            return _drop_lines(inner, lambda ds: np.array([d in known for d in ds], bool), min_chars)

        return map_texts(joined, run, _out_schema(docs))


class _Filters:
    """All shards' filters as one array; its first bucket is empty and stands for shards without keys."""

    def __init__(self, held: list[tuple[int, bytes, bytes]], shards: int) -> None:
        self.wrong = {w[i : i + 16] for _, _, w in held for i in range(0, len(w), 16)}
        self.start, self.mask = np.zeros(shards, np.uint64), np.zeros(shards, np.uint64)
        tables, at = [np.zeros((1, SLOTS), np.uint16)], 1
        for shard, data, _ in held:
            tables.append(CuckooFilter.loads(data).table)
            self.start[shard], self.mask[shard] = at, len(tables[-1]) - 1
            at += len(tables[-1])
        self.table = np.concatenate(tables)

    def hot(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        d = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        raw = d.view(np.uint8).reshape(-1, 16).astype(np.int64)
        shard = (raw[:, 2] * 65536 + raw[:, 3] * 256 + raw[:, 4]) % len(self.start)
        prints, first, jump = CuckooFilter.parts(d)
        a = first & self.mask[shard]
        b = a ^ (jump & self.mask[shard])
        out = (self.table[a + self.start[shard]] == prints[:, None]).any(1) | (self.table[b + self.start[shard]] == prints[:, None]).any(1)
        for i in np.flatnonzero(out):
            out[i] = digests[i] not in self.wrong
        return out


def _digests(text: str, min_chars: int) -> set[bytes]:
    return {_digest(k) for k in map(line_key, text.encode().split(b"\n")) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)}


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each document and each different key of it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([d for t in texts(batch) for d in _digests(t, min_chars)], pa.binary())})

    return map_texts(docs.select("text"), run, "key binary")


def _drop_lines(batch: pa.RecordBatch, hot, min_chars: int) -> pa.RecordBatch:
    split = [t.encode().split(b"\n") for t in texts(batch)]
    keys = [k for lines in split for k in map(line_key, lines)]
    asked = [i for i, k in enumerate(keys) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]
    drop = np.zeros(len(keys), bool)
    drop[asked] = hot([_digest(keys[i]) for i in asked])
    kept, dropped, at = [], [], 0
    for lines in split:
        own = drop[at : at + len(lines)]
        at += len(lines)
        dropped.append(int(own.sum()))
        kept.append(b"\n".join(x for x, d in zip(lines, own, strict=True) if not d).decode())
    i = batch.schema.names.index("text")
    columns = [*batch.columns[:i], pa.array(kept, pa.string()), *batch.columns[i + 1 :], pa.array(map(len, split), pa.int64()), pa.array(dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_lines", "n_dropped"])


def _out_schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Index all documents and drop their hot lines; see LineIndex.dedup for the columns."""
    return LineIndex.build(docs, min_docs, min_chars).dedup(docs)
