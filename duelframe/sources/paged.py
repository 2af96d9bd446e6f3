"""Paged services as Spark sources: pages are fetched by executors, by an injected function, and archived as they are.

Nothing here opens a connection; option ``fetch`` names the function (offset, limit) -> body
as module:function, where executors can import it.
"""

from __future__ import annotations

import importlib
import itertools
import json
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import cut, ship
from .archive import read_lines
from .files import append_lines

PAGES = "offset long, total long, n long, fetched_at timestamp, body string"
#: Seconds between tries: doubling, at most so many each.
LONGEST_WAIT = 60.0


def patient(call: Callable[[], str], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    """call's result; where it raises OSError it is called again, tries times in all, with doubling waits from two seconds."""
    waits = itertools.chain((min(2.0 * 2**k, LONGEST_WAIT) for k in range(tries - 1)), [None])
    for wait in waits:
        try:
            return call()
        except OSError:
            if wait is None:
                raise
            sleep(wait)
    raise ValueError("tries has to be positive")


def page_of(body: str) -> tuple[int, list]:
    """A page's total and rows; ValueError if it isn't the agreed form."""
    try:
        page = json.loads(body)
        return page["total"]["count"], page["results"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a page with total and results: {body[:200]!r}") from e


class _Service:
    """Fetches pages by the options fetch, limit and tries."""

    def __init__(self, options: dict) -> None:
        self.options, self.limit = dict(options), int(options.get("limit", 50))

    def page(self, offset: int) -> tuple:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        body = patient(lambda: fetch(offset, self.limit), int(self.options.get("tries", 5)))
        total, rows = page_of(body)
        return offset, total, len(rows), datetime.now(timezone.utc).replace(tzinfo=None), body

    def total(self) -> int:
        return self.page(0)[1]

    def parts(self, start: int, end: int) -> list[InputPartition]:
        """A partition for each page of the rows from start to end."""
        return [InputPartition(at) for at in range(start, end, self.limit)]


class PagedSource(DataSource):
    """spark.read.format("pages") or readStream, with options fetch, limit, tries and start: a row for each page."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.service, self.start = _Service(options), int(options.get("start", 0))

    def partitions(self) -> list[InputPartition]:
        return self.service.parts(self.start, self.service.total())

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is not None:  # there may be no page
            yield self.service.page(partition.value)


class _Stream(DataSourceStreamReader):
    """A micro-batch holds the rows that the service gained; the checkpoint keeps how many were there."""

    def __init__(self, options: dict) -> None:
        self.service, self.start = _Service(options), int(options.get("start", 0))

    def initialOffset(self) -> dict:
        return {"rows": self.start}

    def latestOffset(self) -> dict:
        return {"rows": self.service.total()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.service.parts(start["rows"], end["rows"])

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is not None:  # there may be no page
            yield self.service.page(partition.value)


def rows(pages: DataFrame) -> DataFrame:
    """offset, position and row (JSON text) of fetched pages."""
    results = F.from_json("body", "results array<string>")["results"]
    return pages.select("offset", F.posexplode(results).alias("position", "row"))


def _pages(spark: SparkSession, options: dict) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PagedSource)
    return cut(spark.read.format("pages").options(**{k: str(v) for k, v in options.items()}).load())  # each page is fetched once


def _lines(pages: DataFrame, **more) -> DataFrame:
    stamp = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    extra = {k: F.lit(v) for k, v in more.items()}
    return pages.orderBy("offset").select(stamp.alias("fetched_at"), F.concat(F.lit("offset="), F.col("offset")).alias("url"), "offset", "body", *(v.alias(k) for k, v in extra.items()))


def listings(spark: SparkSession, passes: Sequence[dict]) -> DataFrame:
    """pass, page, position and row (JSON text) of several listings of one service, each by options of its own.

    A listing that is sorted one way may not reach what another does (new markets have no
    volume yet); market_snapshot() keeps the first of what is listed twice.
    """
    found = None
    for number, options in enumerate(passes):
        own = rows(_pages(spark, options)).select(F.lit(number).alias("pass"), F.floor(F.col("offset") / int(options.get("limit", 50))).cast("int").alias("page"), "position", "row")
        found = own if found is None else found.unionByName(own)
    return found


#: The fields of a listed market that market_snapshot() takes, by their names in the service's rows.
MARKET = {"question": "question", "slug": "slug", "outcomes": "outcomes", "prices": "outcomePrices", "volume": "volumeNum", "liquidity": "liquidityNum", "end_date": "endDate"}


def listed_markets(listed: DataFrame) -> DataFrame:
    """listings() of markets as market_snapshot() takes them; lists may be JSON or texts that hold JSON."""
    return listed.select("pass", "page", "position", *(F.get_json_object("row", f"$.{k}").alias(name) for name, k in MARKET.items()))


def crawl(spark: SparkSession, options: dict, archive: str, least: float = 0.9) -> dict:
    """Archives the pages that the service gained since the last crawl; pages, rows and total of this one.

    The archive itself says where to go on: behind the rows received, since the last page is
    partial and grows later. A total below least of the greatest seen raises before anything
    is written. A crawl writes its pages in one append, so after a crash they are all there or
    are fetched again; readers let the last fetch win.
    """
    held = _archived(spark, archive)
    start, before = held.agg(F.max(F.col("offset") + F.col("n")), F.max("total")).first() if held is not None else (0, 0)
    pages = _pages(spark, {**options, "start": start or 0})
    total = pages.agg(F.max("total"), F.min("total")).first()[1]
    total = _Service(options).total() if total is None else total
    if total < least * (before or 0):
        raise ValueError(f"the total fell from {before} to {total}")
    good = pages.where("n > 0")
    count, gained = good.agg(F.count("*"), F.sum("n")).first()
    if count:
        append_lines(_lines(good), archive, compression="gzip")
    return {"pages": count, "rows": gained or 0, "total": total, "next_offset": (start or 0) + (gained or 0)}


def _archived(spark: SparkSession, archive: str) -> DataFrame | None:
    """offset, n and total of an archive's pages."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(archive)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    page = F.from_json("body", "total struct<count:long>, results array<string>")
    return read_lines(spark, archive).select("offset", page["total"]["count"].alias("total"), F.size(page["results"]).alias("n"))


def snapshot(spark: SparkSession, options: dict, archive: str, snapshot_id: str) -> str:
    """Archives one full listing under a snapshot id; a total that changes between its pages raises, and nothing is written.

    What a task raises (a service that stays down, a page that is none) comes as Spark's
    PythonException, also before anything is written.
    """
    pages = _pages(spark, {**options, "start": 0})
    totals = [r[0] for r in pages.select("total").distinct().limit(3).collect()]
    if len(totals) > 1:
        raise ValueError(f"the total changed within snapshot {snapshot_id}: {totals}")
    append_lines(_lines(pages, snapshot_id=snapshot_id), archive, compression="gzip")
    return snapshot_id
