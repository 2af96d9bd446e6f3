"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import checkpoints, cut, delete, drop, made, scratch, ship

__all__ = ["checkpoints", "crc_remainder", "cut", "drop", "hex_long", "map_texts", "prepare", "release", "scratch", "ship", "small", "stream", "table", "texts", "tidy", "written"]


#: Texts that a Python worker holds at once, at most.
BATCH_ROWS = 400
#: Bytes of them, where the session does not say.
BATCH_BYTES = str(32 << 20)


def prepare(spark: SparkSession) -> None:
    """Make checkpoint() usable, give executors this package, and keep Arrow batches of texts small.

    The batch size is the session's setting, since Spark has none for a single query; it is
    only ever lowered.
    """
    checkpoints(spark)
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more; drop() deletes tables and checkpoints.

    It learns of them when the driver's JVM collects garbage, which a roomy heap puts off
    while the disks fill; call it between the steps of a long operator.
    """
    gc.collect()
    spark._jvm.System.gc()


_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the shared checkpoint folder, for what is large; drop(), scratch() or release() delete it."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{checkpoints(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    made(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables of written(); call it when the results that read them are stored."""
    while _tables:
        delete(spark, _tables.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to every Arrow batch of df."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


#: Rows that a stream hands on together, and characters of them.
STREAM_ROWS, STREAM_CHARS = 256, 1 << 20


def stream(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """fn over the rows of each partition as they come; it takes and gives tuples, and neither side is ever held whole."""
    prepare(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in fn(rows(batches)):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(held) >= STREAM_ROWS or size >= STREAM_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as the empty text."""
    return ["" if t is None else t for t in batch.column(batch.schema.names.index(column)).to_pylist()]


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor; null ids count as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor).cast("int")


def hex_long(column: str) -> Column:
    """A 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it is counted to have at most most_rows rows, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
