"""Queries through files and streams: what Spark derives from the tables is written, read back by the library's readers, or streamed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .operators import latest
from .session import checkpoints, made
from .sources import archive, files
from .streaming import closes


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which scratch() deletes as it does those."""
    path = f"{checkpoints(spark)}/query-{uuid.uuid4().hex}"
    made(path)
    return path


def typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a file of results kept by hand, quotes and commas and all; read typed, and as texts, and summed up by event."""
    path = _folder(spark)
    o = Q._table(spark, sf_dir, "orders")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('said "'), F.col("o_orderstatus"), F.lit('", twice'))).otherwise("plain")
    rows = o.select(F.concat(F.lit("c"), "o_custkey").alias("winner"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("loser"), F.format_string("%.2f", F.col("o_orderkey") % 90 / 100.0).alias("weight"), F.col("o_orderpriority").alias("event"), note.alias("note"))
    rows.write.csv(path, header=True)
    typed = files.fit_rows(spark, path).groupBy("event").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.countDistinct("winner").alias("winners"))
    texts = files.csv_texts(spark, path).groupBy("event").agg(F.count_if(F.col("note").contains('"')).alias("quoted"), F.max("weight").alias("greatest"))
    return typed.join(texts, "event")


def logged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to a log in three batches, later ones changing some: the last line of each key."""
    path = _folder(spark)
    o = Q._table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    for i in range(3):
        own = o.where((F.col("o_orderkey") + i) % (i + 2) == 0).groupBy("k").agg(F.max("o_orderkey").alias("order_id"), F.lit(i).alias("batch"))
        files.append_lines(own, path)
    log = files.json_lines(spark, path, "k long, order_id long, batch int")
    return latest.last_per_key(log, ["k"], [F.col("ordinal")]).select("k", "order_id", "batch")


def zipped_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of pages in compressed files, by chunk and line: where the rows that count stand."""
    from .queries_models import _page_lines

    path = _folder(spark)
    lines = _page_lines(spark, sf_dir).withColumn("file", F.substring("chunk", 1, 1))
    body = lines.select("file", "line", F.to_json(F.struct("fetched_at", "url", "offset", "body")).alias("value"))
    for i, name in enumerate("ab"):  # a chunk is one file, its lines in order, a blank one among them
        own = body.where(F.col("file") == name).select("line", "value").unionByName(spark.createDataFrame([(1, "")], "line long, value string"))
        own.repartitionByRange(1, "line").sortWithinPartitions("line").select("value").write.option("compression", "gzip").text(f"{path}/{files.BATCH}{i:09d}")
    rows = archive.archive_rows(archive.read_lines(spark, path))
    return rows.select(F.get_json_object("match", "$.id").cast("long").alias("id"), "position", "src_offset", "fetched_at")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream of three micro-batches: the last row of each customer, as the kept table has it."""
    path = _folder(spark)
    o = Q._table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.round("o_totalprice", 2).alias("price"))
    for i in range(3):
        o.where(F.col("n") % 3 == i).coalesce(1).write.parquet(f"{path}/in/{i}")
    stream = spark.readStream.schema(o.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    closes.superseding(stream, ["k"], "n", f"{path}/table", f"{path}/cp", buckets=8).awaitTermination()
    return closes.latest(spark, f"{path}/table", o.schema)


@contextmanager
def _keyed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(closes.STATE_STORE[0], None)
    spark.conf.set(*closes.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(closes.STATE_STORE[0], before) if before else spark.conf.unset(closes.STATE_STORE[0])


def stream_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and views of fifty groups of users as one stream in four micro-batches of two days' delay: what has closed when it ends."""
    path = _folder(spark)
    e = Q._table(spark, sf_dir, "events").withColumns({"pair": (F.col("user_id") % 50).cast("string"), "ts": F.col("ts").cast("timestamp")})
    rows = e.where("event_type IN ('purchase', 'view')").select("event_id", "event_type", "pair", "ts", "value")
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - low) * 4 / (high - low + 1))
    for i in range(4):
        rows.where(part == i).coalesce(1).write.parquet(f"{path}/in/{i}")
    with _keyed(spark):
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        m = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("match_key"), "pair", F.col("ts").alias("start"))
        p = stream.where("event_type = 'view'").select("pair", "ts", F.col("value").alias("price"))
        q = closes.closes_by_state(m, p, "2 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(closes.CLOSED).parquet(f"{path}/out").select("match_key", F.round("close", 6).alias("close_value"), "flagged")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (typed_csv, logged_lines, zipped_archive, stream_latest, stream_closes)}


def oracle_sql() -> dict[str, str]:
    from .queries_models import PAGE, PAGES_SQL

    return {
        "typed_csv": """SELECT o_orderpriority AS event, COUNT(*) AS n, round(CAST(SUM(o_orderkey % 90 / 100.0) AS DOUBLE), 4) AS weight, COUNT(DISTINCT o_custkey) AS winners, COUNT(*) FILTER (o_orderkey % 3 = 0) AS quoted, printf('%.2f', MAX(o_orderkey % 90 / 100.0)) AS greatest FROM orders GROUP BY 1""",
        "logged_lines": """WITH b AS (SELECT o_custkey AS k, MAX(o_orderkey) AS order_id, i AS batch FROM orders, (VALUES (0), (1), (2)) t(i) WHERE (o_orderkey + i) % (i + 2) = 0 GROUP BY o_custkey, i)
          SELECT k, order_id, CAST(batch AS INTEGER) AS batch FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch DESC) = 1""",
        "zipped_archive": f"""WITH c AS ({PAGES_SQL}) SELECT id, CAST(row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS INTEGER) AS position, page * {PAGE} AS src_offset, CASE WHEN page % 3 = 0 THEN '2026-01-02' ELSE '2026-01-01' END AS fetched_at
          FROM c WHERE NOT (page % 3 = 0 AND id % 7 = 0)""",
        "stream_latest": "SELECT o_custkey AS k, o_orderkey AS n, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
        "stream_closes": """WITH e AS (SELECT event_id, event_type, user_id % 50 AS pair, ts, value FROM events WHERE event_type IN ('purchase', 'view') AND user_id IS NOT NULL),
          w AS (SELECT epoch_ms(MAX(ts)) - 2 * 86400000 AS ms FROM e), p AS (SELECT pair, ts, value FROM e WHERE event_type = 'view'),
          f AS (SELECT pair, arg_min(value, (ts, value)) AS value, epoch_us(MIN(ts)) AS us FROM p GROUP BY pair),
          m AS (SELECT event_id, pair, ts FROM e WHERE event_type = 'purchase' AND epoch_us(ts) <= (SELECT ms * 1000 FROM w)),
          b AS (SELECT m.event_id, p.value FROM m JOIN p ON p.pair = m.pair AND p.ts < m.ts QUALIFY row_number() OVER (PARTITION BY m.event_id ORDER BY p.ts DESC, p.value DESC) = 1)
          SELECT m.event_id AS match_key, round(coalesce(b.value, f.value), 6) AS close_value, b.event_id IS NULL AS flagged FROM m LEFT JOIN b ON b.event_id = m.event_id JOIN f ON f.pair = m.pair WHERE b.event_id IS NOT NULL OR f.us <= (SELECT ms * 1000 FROM w)""",
    }
