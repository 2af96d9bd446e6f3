"""Mixing sources to target weights along a time-varying curriculum.

A source's size is the number of its words. Each source has a schedule over training time 0
to 1, linear between knots; its weight at a time is its own constant weight times that. The
integral of these weights is the source's demand, so a schedule sets how much is read as well
as when. Targets are shares of ``share`` times all words by demand; none exceeds ``most`` times
its source's size, and what lies above is dealt again by demand. Documents of a source stand in
a fixed order (md5 of the id) and are read again from its start when the target exceeds the
size. A document's training position is where the inverted demand reaches the words before it;
curriculum() tells the words that each source's readings begin in each interval of time.

Running sums are taken in two levels, source and slice of the order, so no source is in one
task; an id that repeats often, or is null often, has slices of its own. Nulls: a null text has size 0; the null source is a source, ordered last; a null id
sorts as the empty text. Rows alike in id, source and size are interchangeable. Sources
without words get target 0. Empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scan import ranked as ranked_rows
from .common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that a slice of its order holds, about; a slice is summed in one task.
SLICE_ROWS = 20_000
#: Weight over time: early, even, late; cycled over the sources.
RAMPS = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))

Knots = Sequence[tuple[float, float]]


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank: 0, 1, ... by source in code point order, null last. No task sees all sources."""
    parts = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return parts.withColumn("own", own).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("own") - 1).drop("part", "own", "offset")


def integral(knots: Knots, until: float = 1.0) -> float:
    """The area under the piecewise linear weights up to a time."""
    return math.fsum((x - a) * (w + (v - w) * (x - a) / (b - a) / 2) for (a, w), (b, v) in zip(knots, knots[1:], strict=False) if (x := min(until, b)) > a)


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float, schedules: Sequence[Knots] = RAMPS) -> DataFrame:
    """sources (source, source_size, ...) with rank, weight (its integral over time) and target. Only sums reach the driver."""
    kinds = math.lcm(len(weights), len(schedules))
    demands = [float(weights[i % len(weights)]) * integral(schedules[i % len(schedules)]) for i in range(kinds)]
    kind = (F.col("rank") % kinds).cast("int")
    known = cut(ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, demands)), kind + 1)))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight
    capped = -1
    while True:
        over = F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size") if capped >= 0 else F.lit(False)
        # Counts by kind: a sum of fractions would depend on the order of rows.
        sums = known.groupBy(kind.alias("kind")).agg(F.sum(over.cast("long")), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.sum((~over).cast("long"))).collect()
        n, full, rest = sum(r[1] for r in sums), sum(r[2] for r in sums), math.fsum(demands[r[0]] * r[3] for r in sums)
        if n == capped or not rest:
            break
        level, capped = (share * total - most * full) / rest, n
    return known.withColumn("target", F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight")).cast("double"))


def invert(knots: Column, share: Column) -> Column:
    """The time at which the integral of the piecewise linear weights has the given share of its whole.

    knots: array of (t, w). The integral is quadratic between knots and inverted in closed form.
    """
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t"), F.element_at(knots, i)["w"].alias("w"),
            (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("dt"), (F.element_at(knots, i + 1)["w"] - F.element_at(knots, i)["w"]).alias("dw"),
        ),
    )
    area = lambda p: p["dt"] * (p["w"] + p["dw"] / 2)
    whole = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + area(p))

    def within(p: Column, need: Column) -> Column:
        slope = p["dw"] / p["dt"]
        flat = F.abs(p["dw"]) < 1e-12
        return p["t"] + F.when(flat, need / p["w"]).otherwise((F.sqrt(F.greatest(p["w"] * p["w"] + 2 * slope * need, F.lit(0.0))) - p["w"]) / slope)

    none = F.lit(None).cast("double")
    start = F.struct((share * whole).alias("need"), none.alias("t"))
    step = lambda s, p: F.struct(
        (s["need"] - area(p)).alias("need"),
        F.when(s["t"].isNull() & (s["need"] <= area(p)), F.greatest(p["t"], F.least(p["t"] + p["dt"], within(p, s["need"])))).otherwise(s["t"]).alias("t"),
    )
    last = F.element_at(knots, -1)["t"]
    return F.aggregate(pieces, start, step, lambda s: F.coalesce(s["t"], last))


def _split(sliced: DataFrame, largest: int) -> DataFrame:
    """sliced, where one id's rows of a source (null ids, repeated ones) are more than a slice: those in slices of their own.

    They are ordered by size and alike in all else, so they are dealt out by size and number;
    slices' names keep sorting in the order of the rows.
    """
    named = lambda df: df.withColumnsRenamed({"source": "__of", "slice": "__slice"})
    same = F.col("source").eqNullSafe(F.col("__of")) & (F.col("slice") == F.col("__slice"))
    crowded = cut(sliced.groupBy("source", "slice").count().where(F.col("count") > 4 * SLICE_ROWS).select("source", "slice"))
    if crowded.isEmpty():
        return sliced
    often = sliced.join(small(named(crowded)), same, "left_semi").groupBy("source", "slice", "order").count().where(F.col("count") > SLICE_ROWS)
    lists = cut(named(often.groupBy("source", "slice").agg(F.collect_list("order").alias("__hot"))))  # at most one for each SLICE_ROWS rows
    placed = sliced.join(small(lists), same, "left")
    behind = F.array_max(F.filter("__hot", lambda h: h < F.col("order")))
    part = F.pmod(F.xxhash64("__row"), F.lit(max(1, -(-largest // SLICE_ROWS))))
    own = F.concat("slice", "order", F.lit("a"), F.lpad(F.col("size").cast("string"), 20, "0"), F.lpad(part.cast("string"), 12, "0"))
    after = F.when(behind.isNotNull(), F.concat("slice", behind, F.lit("b"))).otherwise(F.col("slice"))
    return placed.withColumn("slice", F.when(F.coalesce(F.array_contains("__hot", F.col("order")), F.lit(False)), own).otherwise(after)).drop("__of", "__slice", "__hot")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedules: Sequence[Knots] = RAMPS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions: one row for each row of docs.

    positions: the training times of the document's readings, each in 0 to 1; the last may be a part.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = cut(docs.select("doc_id", "source", word_count().alias("size"), F.md5(ids.cast("binary")).alias("order")).withColumn("__row", F.monotonically_increasing_id()))
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    largest = sources.agg(F.max("rows")).first()[0] or 0
    digits = 1
    while largest / 16**digits > SLICE_ROWS / 8:
        digits += 1
    sliced = _split(sized.withColumn("slice", F.substring("order", 1, digits)), largest)
    knots = F.array(*(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in k)) for k in schedules))
    known = targets(sources.drop("rows"), weights, share, most, schedules).withColumn("knots", F.element_at(knots, (F.col("rank") % len(schedules)).cast("int") + 1))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("own")).withColumnRenamed("source", "of")
    ahead = F.sum("own").over(Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = sums.join(small(known), F.col("of").eqNullSafe(F.col("source"))).drop("source").withColumn("ahead", F.coalesce(ahead, F.lit(0))).withColumnRenamed("slice", "of_slice")
    # Null sources meet in the join on the null-safe pair; the slice keeps any one source out of one task.
    joined = sliced.join(slices, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("of_slice")))
    within = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("ahead") + within - F.col("size")
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("passes") * F.col("source_size") - F.col("before")))
    out = joined.withColumns({"before": before, "goal": goal, "passes": passes}).withColumn("rest", rest.cast("long"))
    readings = F.col("passes") + (F.col("rest") > 0).cast("long")
    times = F.when((readings > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0).cast("long"), readings - 1), lambda k: invert(F.col("knots"), (F.col("before") + k * F.col("source_size")) / F.col("goal"))))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("rest")).cast("long").alias("taken"), F.coalesce(times, F.array().cast("array<double>")).alias("positions"))


def curriculum(mixed: DataFrame, intervals: int = 10) -> DataFrame:
    """source, interval (from 0), words: those of the readings that begin in each equal interval of training time.

    Their share of an interval's words is the mixture that the schedules give at that time.
    """
    read = mixed.select("source", "size", "taken", F.posexplode("positions").alias("k", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("k") * F.col("size"))
    place = F.least(F.floor(F.col("position") * intervals), F.lit(intervals - 1)).cast("int")
    return read.groupBy("source", place.alias("interval")).agg(F.sum(words).alias("words"))


def training_order(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns, a row for each reading, range-sorted by position.

    The last reading of a document that is taken in part holds its text up to the end of the
    last word that the mix takes. mixed and docs are matched by doc_id; where ids repeat or are null, by
    source and size too, and rows alike in all three are numbered, so each has its own readings.
    """
    names = docs.columns
    own = cut(mixed.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("positions").alias("__positions")))
    often = cut(own.groupBy(F.col("__id").alias("__often")).count().where("count > 1 OR __often IS NULL").select("__often"))
    repeats = small(often)
    same = lambda c: F.col(c).eqNullSafe(F.col("__often"))
    read = docs.join(own.where("__taken > 0").join(repeats, same("__id"), "left_anti"), F.col("doc_id") == F.col("__id")).select(*names, "__taken", "__size", "__positions")
    if not often.isEmpty():
        # Rows alike in id, source and size may be most of all: they are numbered in ranges, not in one task.
        theirs = ranked_rows(own.join(repeats, same("__id"), "left_semi"), ["__id", "__source", "__size"], ["__taken", "__positions"], "__row")
        rows = ranked_rows(docs.join(repeats, same("doc_id"), "left_semi").withColumn("__words", word_count()), ["doc_id", "source", "__words"], ["text"], "__number")
        match = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")) & (F.col("__number") == F.col("__row"))
        read = read.unionByName(rows.join(theirs.where("__taken > 0"), match).select(*names, "__taken", "__size", "__positions"))
    read = read.select(*names, "__taken", "__size", F.posexplode("__positions").alias("__k", "__position"))
    words = F.least(F.col("__size"), F.col("__taken") - F.col("__k") * F.col("__size"))
    cutoff = F.when(words < F.col("__size"), _first_words(words)).otherwise(F.col("text"))
    cols = [cutoff.alias("text") if n == "text" else F.col(n) for n in names]
    return read.select(*cols, "__position").repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id").drop("__position")


def _first_words(n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    return F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), n.cast("int")), "")
