"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the hashes of its word shingles.
Fingerprints that differ in at most ``radius`` bits link. Each distinct fingerprint emits
every variant within half the radius; two linked ones share a variant, and what shares a
variant is at most ``radius`` apart. A variant's group holds at most 65 fingerprints for
radius 2 and is linked as a star, each colliding pair verified. Components come from
alternating large-star and small-star steps over the links, by joins and sums alone.

Nulls: a null or empty text has no words; its fingerprint is zero and links like any other.
A null doc_id is never the smallest. Repeated rows share a fingerprint. Empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop, hex_long, map_texts, small, texts, tidy, written

CHUNK = 1 << 16
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned fingerprint of a whole text."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    joined, stops = b" ".join(words), ends[min(shingle, len(words)) - 1 :] - 1
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        own = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + CHUNK)].tolist(), stops[at : at + CHUNK].tolist(), strict=True)]
        counts += _bits(np.array(own, "<u8"))
    return int(_over_half(counts, n))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _over_half(counts: np.ndarray, n: int) -> np.uint64:
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def ball(half: int) -> list[int]:
    """The signed masks of at most half bits out of 64."""
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: stars that connect all different fingerprints at most radius bits apart (radius even)."""
    if radius % 2:
        raise ValueError("the radius must be even")
    variants = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, ball(radius // 2))), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    groups = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").distinct()
    return stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _lowest(edges: DataFrame, at: str, other: str) -> DataFrame:
    return edges.groupBy(at).agg(F.least(F.min(other), F.col(at)).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for edges a > b of longs.

    No step gathers a node's neighbours: a smallest neighbour is a sum over edges, and a
    join hands it back, so a hub costs no more than its edges.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None  # what a step read is deleted when the next is stored
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(both, "a", "b"), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = _lowest(large, "a", "b")
        small = large.join(low, "a").select("b", "low").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        older, edges = edges, cut(small.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        drop(older)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    known = cut(fingerprints(docs, shingle))
    distinct = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    members = distinct.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = members.join(classes, "root").select("fp", "component_id")
    return known.join(by_fp, "fp").select("doc_id", hex_long("fp").alias("fingerprint"), "component_id")


def _first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs' rows that stand for their component. Texts are compared only where an id repeats."""
    kept = cut(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__n")))
    once = docs.join(kept.where("__n = 1"), "doc_id", "left_semi")
    often = docs.join(small(kept.where("__n > 1")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(often.select(*docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each component, that of its smallest doc_id; equal rows count once.

    Rows without an id can't stand for a component and stay as they are.
    """
    found = near_duplicates(docs.where("doc_id IS NOT NULL"), shingle, radius)
    return _first_of_each(docs, found)


# --- similar texts: an exact prefix filter proposes pairs, shingle sets verify them ---

#: Of so many rows one is sampled to learn which shingles are frequent. Any order of shingles gives the same pairs; rare ones first give few candidates.
SAMPLE = 16
#: Frequent shingles that the order knows at most.
COMMON = 200_000
#: Longs of parity bits: each shingle that only one of two texts has flips one bit, so differing bits never exceed differing shingles.
PARITY = 8
PREFIX = "doc_id long, same binary, fp long, n long, parity array<long>, prefix array<long>"


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included, as signed longs."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - shingle + 1)]
    joined, stops, digest = b" ".join(words), ends[min(shingle, len(words)) - 1 :] - 1, xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64).view(np.int64)


def _different(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64).view(np.int64)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The different hashes of a text's shingles, as sorted signed longs."""
    return _different(shingle_hashes(text, shingle))


def prefix_size(n: int, similarity: float) -> int:
    """Two sets at the similarity share one of their first so many elements, in any order common to all."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles seen more than once in a sample of rows, the most frequent last; at most COMMON."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, shingle) for t in texts(batch)]))], ["s"])

    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = map_texts(sampled, run, "s long").groupBy("s").count().where("count > 1")
    return np.array([r.s for r in counts.orderBy(F.desc("count"), "s").limit(COMMON).collect()][::-1], np.int64)


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, a digest that texts of equal words share, fingerprint, number of shingles, parity bits and the prefix of the ordered shingles."""
    ranked = frequent(docs, shingle)
    by_value = np.argsort(ranked)
    values = ranked[by_value]

    def ordered(own: np.ndarray) -> np.ndarray:
        rank = np.full(len(own), -1)
        if len(values):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            rank = np.where(values[at] == own, by_value[at], -1)
        return own[np.argsort(rank, kind="stable")[: prefix_size(len(own), similarity)]]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, fp, n, parity, prefix = [], [], [], [], []
        for t in texts(batch):
            every = shingle_hashes(t, shingle)
            fp.append(_over_half(sum((_bits(every[at : at + CHUNK]) for at in range(0, len(every), CHUNK)), np.zeros(64, np.int64)), len(every)))
            own = _different(every)
            same.append(xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())))
            n.append(len(own))
            parity.append(np.packbits(np.bincount(own & (64 * PARITY - 1), minlength=64 * PARITY) & 1).view(np.int64))
            prefix.append(ordered(own))
        columns = [batch.column(0), pa.array(same, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "same", "fp", "n", "parity", "prefix"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, PREFIX)


def members(reps: DataFrame) -> DataFrame:
    """s, doc_id, pos, n, parity: a row for each prefix shingle that two texts or more have in their prefixes."""
    rows = reps.select("doc_id", F.posexplode("prefix").alias("pos", "s"))
    shared = rows.withColumn("k", F.count("*").over(Window.partitionBy("s"))).where("k > 1").drop("k")
    return written(shared.join(reps.select("doc_id", "n", "parity"), "doc_id"))


def _alike(similarity: float) -> Column:
    """Whether rows x and y can reach the similarity, by size and parity bits."""
    whole, differing = F.col("x.n") + F.col("y.n"), F.lit(0)
    for i in range(PARITY):
        differing = differing + F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i]))
    return (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity - 1e-6) & (differing <= whole * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _near(similarity: float) -> Column:
    """Whether rows x and y of one shingle can reach the similarity, by position, size and parity bits."""
    # If s is the first shingle that the ordered sets share, no more than the shorter rest is shared.
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (most >= (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6) & _alike(similarity)


def met_in_balls(reps: DataFrame, similarity: float, radius: int = 2) -> DataFrame:
    """a, b: texts that can be similar and whose fingerprints a ball of links() joins.

    A fingerprint's texts meet its smallest id, and so do those ids of linked fingerprints.
    """
    own = reps.select("doc_id", "fp", "n", "parity")
    firsts = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    equal = own.join(firsts, "fp").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    linked = links(firsts.select("fp"), radius).join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    pairs = equal.union(linked.select(F.greatest("x", "y"), F.least("x", "y"))).alias("p")
    both = pairs.join(own.alias("x"), F.col("p.a") == F.col("x.doc_id")).join(own.alias("y"), F.col("p.b") == F.col("y.doc_id"))
    out = cut(both.where(_alike(similarity)).select("p.a", "p.b").distinct())
    drop(firsts)
    return out


def stars(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: of each shingle's texts, those that can be similar to its smallest id."""
    centers = rows.join(rows.groupBy("s").agg(F.min("doc_id").alias("doc_id")), ["s", "doc_id"])
    met = rows.alias("x").join(centers.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.doc_id") > F.col("y.doc_id")) & _near(similarity))
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


#: Texts of a shingle that meet each other in one task; a shingle of more is dealt in pairs of blocks.
BLOCK = 1000


def between(rows: DataFrame, roots: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b: all pairs of a shingle's texts that can be similar and lie in different components.

    A shingle of many texts is cut into blocks of about block texts by their ids' hashes; every
    pair of blocks is a key of its own, so no task meets more than the square of a block.
    """
    rooted = lambda df: df.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    # Which shingles are in question takes two columns; only their rows are carried on whole.
    mixed = rooted(rows.select("s", "doc_id")).groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo <> hi")
    live = written(rooted(rows.join(mixed.select("s", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "s")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    low = live.withColumn("other", F.explode(F.expr("sequence(own, blocks - 1)")))
    high = live.withColumn("other", F.explode(F.expr("sequence(0, own)")))
    same = (F.col("x.s") == F.col("y.s")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    once = (F.col("x.own") < F.col("y.own")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    met = low.alias("x").join(high.alias("y"), same & once & (F.col("x.root") != F.col("y.root")) & _near(similarity))
    found = cut(met.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct())
    drop(live)
    return found


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets have a Jaccard similarity of at least similarity."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, shingle) for t in texts(batch)], pa.list_(pa.int64()))], ["doc_id", "s"])

    asked = docs.select(F.col("doc_id").cast("long"), "text").join(small(ids), "doc_id", "left_semi")
    sets = written(map_texts(asked, run, "doc_id long, s array<long>").dropDuplicates(["doc_id"]))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    found = cut(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))
    drop(sets)
    tidy(docs.sparkSession)
    return found


def joined(first: DataFrame, rest: Callable[[DataFrame], DataFrame], docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, root: components of the verified pairs among first and rest.

    rest takes the components (node, root) of first's links and returns all further pairs
    (a, b) whose sides lie in different ones; pairs inside a component can't change it. Both
    sides' pairs are stored tables, and deleted here.
    """
    found = verified(first, docs, shingle, similarity)
    roots = components(found)
    all_more = rest(roots)
    more = cut(all_more.join(first, ["a", "b"], "left_anti"))
    drop(first, all_more, roots)
    tidy(docs.sparkSession)
    also = verified(more, docs, shingle, similarity)
    drop(more)
    out = components(found.union(also))
    drop(found, also)
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: groups of documents linked by a similarity of their shingle sets.

    Texts of equal words are one to begin with. Fingerprints of the others meet in balls by the
    method of links(). A pair at the similarity may lie outside every ball, so an exact filter
    follows: such a pair shares a shingle of its prefixes. Of each of these all texts first meet
    the smallest id; then all its pairs meet whose components still differ. Every link is
    verified, whichever way it was met, so no link is lost and none is added. Ids
    must be given and differ; equal texts may repeat. Of what is stored on the way only the
    table of the result stays.
    """
    full = written(prefixes(docs, shingle, similarity))
    reps = written(full.groupBy("same").agg(F.min(F.struct("doc_id", "fp", "n", "parity", "prefix")).alias("one")).select("same", "one.*"))
    known = written(full.select("doc_id", "same"))
    drop(full)
    met = met_in_balls(reps, similarity)
    rows = members(reps)
    first_ids = written(reps.select("same", "doc_id"))
    drop(reps)
    tidy(docs.sparkSession)
    first = cut(met.union(stars(rows, similarity)).distinct())
    drop(met)
    found = joined(first, lambda roots: between(rows, roots, similarity), docs, shingle, similarity)
    drop(rows)
    grouped = first_ids.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("same", F.coalesce("root", "doc_id").alias("component_id"))
    out = written(known.select("doc_id", "same").join(grouped, "same").select("doc_id", "component_id"))
    drop(known, first_ids, found)
    tidy(docs.sparkSession)
    return out


def keep_one_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar_groups, that of its smallest doc_id; see keep_one for nulls."""
    found = similar_groups(docs.where("doc_id IS NOT NULL"), shingle, similarity)
    return _first_of_each(docs, found)
