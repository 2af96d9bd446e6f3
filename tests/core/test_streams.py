import itertools
import json
import random

import pandas as pd
import pytest
from duelframe.operators import asof, latest
from duelframe.sources import commits, files, paged
from duelframe.streaming import closes
from pyspark.sql import functions as F

ROWS = [{"id": i} for i in range(7)]


def fetch(offset, limit):
    return json.dumps({"total": {"count": len(ROWS)}, "results": ROWS[offset : offset + limit]})


def test_superseding_stream_equals_batch(spark, tmp_path):
    schema = "k string, v int, n long"
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    for batch in ([("a", 1, 1), ("b", 1, 2)], [("a", 2, 3)], [("a", 3, 0), ("c", 9, 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        q = closes.superseding(spark.readStream.schema(schema).parquet(source), ["k"], "n", table, f"{tmp_path}/cp")
        q.awaitTermination()
    got = {r.k: r.v for r in closes.latest(spark, table, spark.createDataFrame([], schema).schema).collect()}
    assert got == {"a": 2, "b": 1, "c": 9}


def test_stream_join_folds_to_the_batch_close(spark, tmp_path):
    m = spark.createDataFrame([(1, "p", "2026-01-01 12:00:00"), (2, "q", "2026-01-01 12:00:00")], "match_key long, pair string, start string").withColumn("start", F.col("start").cast("timestamp"))
    p = spark.createDataFrame([("p", "2026-01-01 10:00:00", 0.5), ("p", "2026-01-01 11:00:00", 0.6), ("p", "2026-01-01 13:00:00", 0.9), ("q", "2026-01-01 13:00:00", 0.7)], "pair string, ts string, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    for df, name in ((m, "m"), (p, "p")):
        df.write.parquet(f"{tmp_path}/{name}")
    joined = closes.closes(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/m"), spark.readStream.schema(p.schema).parquet(f"{tmp_path}/p"))
    q = joined.writeStream.format("memory").queryName("joined").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert {r.match_key: (r.close, r.flagged) for r in closes.fold(spark.table("joined")).collect()} == {1: (0.6, False), 2: (0.7, True)}
    counts = closes.windows(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/p"), "ts", "1 hour", "1 minute", ["pair"])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == 4


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    options = {"fetch": f"{__name__}:fetch", "limit": "3"}
    pages = spark.read.format("pages").options(**options).load()
    assert pages.count() == 3 and [json.loads(r.row)["id"] for r in paged.rows(pages).orderBy("offset", "position").collect()] == list(range(7))
    q = spark.readStream.format("pages").options(**options).load().writeStream.format("memory").queryName("pages").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(json.loads(r.row)["id"] for r in paged.rows(spark.table("pages")).collect()) == list(range(7))


def test_superseding_rewrites_touched_parts_alone(spark, tmp_path):
    schema = "k long, v int, n long"
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    want = {}
    for i in range(6):
        batch = [(k, 10 * i + k, i) for k in range(i, i + 3)]
        want.update({k: v for k, v, _ in batch})
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        closes.superseding(spark.readStream.schema(schema).parquet(source), ["k"], "n", table, f"{tmp_path}/cp", buckets=4).awaitTermination()
    assert {r.k: r.v for r in closes.latest(spark, table, spark.createDataFrame([], schema).schema).collect()} == want
    own = commits.Table(spark, table)
    versions = [own.at(n) for n in own._numbers()]
    assert len(versions) == closes.KEPT and own.head().notes == {f"{tmp_path}/cp": 5}
    assert all(sum(a.parts.get(k) != f for k, f in b.parts.items()) <= 3 for a, b in itertools.pairwise(versions)) and len(own.head().parts) > 1
    held = {f.name for f in (tmp_path / "table/data").iterdir()}
    assert held == {f.split("/data/")[1].split("/")[0] for v in versions for f in v.parts.values()}


def test_appended_lines_keep_their_order(spark, tmp_path):
    """Later batches win, however large they are and however many files."""
    path = f"{tmp_path}/log"
    for i, n in enumerate((500, 3, 40, 1)):
        files.append_lines(spark.range(n).selectExpr("1L AS k", f"{i} AS batch", "id", f"repeat('x', {100 - 20 * i}) AS pad").repartition(2, "id").sortWithinPartitions("id"), path)
    log = files.json_lines(spark, path, "k long, batch int, id long, pad string")
    assert log.count() == 544 and latest.last_per_key(log.select("k", "batch", "ordinal"), ["k"], [F.col("ordinal")]).first().batch == 3
    order = [r.batch for r in log.orderBy("ordinal").collect()]
    assert order == sorted(order)


def test_settling_a_pair():
    frame = lambda rows, last: pd.DataFrame(rows, columns=["us", last]).astype({"us": "int64"})
    rows = lambda df: list(df.itertuples(index=False, name=None))
    prices, open_ = frame([(10, 0.1), (30, 0.3), (20, 0.2)], "price"), frame([(25, 1), (50, 2), (5, 3)], "match_key")
    closed, kept, still = closes.settle(prices, open_, (10, 0.1), 26)
    assert rows(closed) == [(3, 5, 0.1, True), (1, 25, 0.2, False)] and rows(kept) == [(20, 0.2), (30, 0.3)] and rows(still) == [(50, 2)]
    closed, kept, still = closes.settle(pd.concat((kept, frame([(50, 0.9)], "price"))), still, (10, 0.1), 50)
    assert rows(closed) == [(2, 50, 0.3, False)] and not len(still) and rows(kept) == [(30, 0.3), (50, 0.9)]
    closed, kept, still = closes.settle(frame([], "price").astype({"price": float}), frame([(5, 1)], "match_key"), None, 9)
    assert not len(closed) and rows(still) == [(5, 1)]


@pytest.fixture
def keyed(spark):
    spark.conf.set(*closes.STATE_STORE)
    yield spark
    spark.conf.unset(closes.STATE_STORE[0])


def streamed(spark, batches, schema, folder, late):
    """What closes_by_state has written after all batches, each a micro-batch; the query is stopped and started again between them."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/in/b{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("ts", F.timestamp_micros("us"))
        m = stream.where("kind = 'm'").select("match_key", "pair", F.col("ts").alias("start"))
        q = closes.closes_by_state(m, stream.where("kind = 'p'").select("pair", "ts", "price"), late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(closes.CLOSED).parquet(f"{folder}/out").select("match_key", F.unix_micros("start").alias("us"), "close", "flagged").collect()


STREAM = "kind string, match_key long, pair string, us long, price double"


def test_closes_by_state_equal_as_of(keyed, tmp_path):
    """Random prices and matches that differ by microseconds, in and out of order; the last ones push the watermark past all."""
    r = random.Random(9)
    base = 1_767_225_600_000_000
    rows = [("p", None, r.choice("ab"), base + r.randrange(4) * 1000 + r.randrange(6), float(r.randrange(9)) / 8) for _ in range(60)]
    rows += [("m", i, r.choice("abc"), base + r.randrange(4) * 1000 + r.randrange(6), None) for i in range(60)]
    r.shuffle(rows)
    far = [("p", None, "z", base + 3_600_000_000 * k, 0.5) for k in (1, 2, 3)]
    batches = [rows[:50], rows[50:], *([f] for f in far)]
    got = {x.match_key: (x.us, x.close, x.flagged) for x in streamed(keyed, batches, STREAM, tmp_path, "1 minute")}
    df = keyed.createDataFrame(rows, STREAM).withColumn("ts", F.timestamp_micros("us"))
    batch = asof.as_of(df.where("kind = 'm'").select("match_key", "us", "pair", "ts"), df.where("kind = 'p'").select("pair", F.col("ts").alias("t"), "price"), ["pair"], "ts", "t", "price", [F.col("price")]).collect()
    assert got == {x.match_key: (x.us, x.close, x.flagged) for x in batch if x.close is not None} and any(x.flagged for x in batch) and len(got) > 20


def test_late_prices_have_no_say_and_each_match_closes_once(keyed, tmp_path):
    h = lambda n: 1_767_225_600_000_000 + n * 3_600_000_000
    batches = [
        [("m", 1, "p", h(4), None), ("p", None, "p", h(2), 0.2), ("p", None, "p", h(1), 0.1)], [("p", None, "p", h(3), 0.3), ("p", None, "p", h(4), 0.4), ("m", 2, "q", h(5), None), ("m", 4, "p", h(6), None)],
        [("p", None, "q", h(6), 0.6), ("p", None, "q", h(7), 0.7), ("p", None, "p", h(5), 0.5)], [("p", None, "z", h(20), 0.9)], [("p", None, "p", h(5) + 1, 0.99), ("p", None, "z", h(21), 0.9)], [("p", None, "z", h(22), 0.9)],
    ]
    got = streamed(keyed, batches, STREAM, tmp_path, "2 hours")
    assert sorted((x.match_key, x.close, x.flagged) for x in got) == [(1, 0.3, False), (2, 0.6, True), (4, 0.5, False)]


def test_keyed_closes_say_what_they_need(spark):
    rate = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="RocksDB"):
        closes.closes_by_state(rate.selectExpr("value AS match_key", "'p' AS pair", "timestamp AS start"), rate.selectExpr("'p' AS pair", "timestamp AS ts", "0.5D AS price"))
