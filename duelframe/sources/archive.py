"""The raw page archive: compressed JSON lines that paged.crawl() writes, read with last fetch wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import contiguous, last_per_key, latest_attributes
from ..operators.quarantine import demand_contract, quarantine_reason
from .files import BATCH

LINE = "fetched_at string, url string, offset long, body string, snapshot_id string"
PAGE = "total struct<count:long>, results array<string>"


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """LINE's columns, then chunk (the file's name, with the appended batch that it belongs to) and line (its place in the file).

    A compressed file is one split, so its rows arrive in order within one task and their
    ordinal is the part of monotonically_increasing_id below the partition.
    """
    chunk = F.regexp_extract("_metadata.file_path", rf"((?:{BATCH}[0-9]+/)?[^/]+)$", 1)
    raw = spark.read.option("recursiveFileLookup", True).text(paths).select("value", chunk.alias("chunk"))
    numbered = raw.withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return numbered.select(F.from_json("value", LINE).alias("r"), "chunk", "line").select("r.*", "chunk", "line")


def pages(lines: DataFrame) -> DataFrame:
    """The last fetched line of each offset, with total, results (each as JSON text) and n; broken pages fail the query."""
    page = F.from_json("body", PAGE)
    good = F.array_contains(F.json_object_keys("body"), "total") & F.array_contains(F.json_object_keys("body"), "results")
    checked = F.when(F.coalesce(good, F.lit(False)), page).otherwise(F.raise_error(F.concat(F.lit("a page lacks total or results at offset "), F.col("offset").cast("string"))).cast(PAGE_TYPE))
    last = last_per_key(lines, ["offset"], [F.col("chunk"), F.col("line")])
    return last.select("*", checked.alias("p")).select(*lines.columns, F.col("p.total.count").alias("total"), F.col("p.results").alias("results"), F.size("p.results").alias("n"))


PAGE_TYPE = "struct<total:struct<count:bigint>,results:array<string>>"


def archive_rows(lines: DataFrame) -> DataFrame:
    """match (JSON text) with src_chunk, src_offset, fetched_at and its place in the page."""
    return pages(lines).select(F.posexplode("results").alias("position", "match"), F.col("chunk").alias("src_chunk"), F.col("offset").alias("src_offset"), "fetched_at", "line")


def verify(lines: DataFrame) -> dict:
    """Pages, rows, whether each page begins where the one before ended, first and last offset.

    A chain is whole if every page but the last is followed by one and every page but the
    first follows one; both are anti-joins, so no task sees the whole chain.
    """
    own = pages(lines).select("offset", "n", (F.col("offset") + F.col("n")).alias("end"))
    count, rows, first, last, end = own.agg(F.count("*"), F.sum("n"), F.min("offset"), F.max("offset"), F.max("end")).first()
    follows = own.join(own.select(F.col("end").alias("offset")).distinct(), "offset", "left_anti").where(F.col("offset") != F.lit(first))
    followed = own.join(own.select(F.col("offset").alias("end")), "end", "left_anti").where(F.col("end") != F.lit(end))
    whole = not count or follows.limit(1).count() + followed.limit(1).count() == 0
    return {"pages": count, "rows": rows or 0, "offsets_contiguous": whole, "first_offset": first, "last_offset": last}


def complete_snapshots(lines: DataFrame) -> DataFrame:
    """snapshot_id, seen (its first line), complete: one total throughout, an unbroken chain from 0 that covers it."""
    page = F.from_json("body", PAGE)
    own = lines.select("snapshot_id", "offset", "chunk", "line", page["total"]["count"].alias("total"), F.size(page["results"]).alias("n"))
    chain = contiguous(own, ["snapshot_id"])
    totals = own.groupBy("snapshot_id").agg(F.min("total").alias("low"), F.max("total").alias("high"), F.min(F.struct("chunk", "line")).alias("seen"))
    good = F.col("contiguous") & (F.col("low") == F.col("high")) & (F.col("end") >= F.col("low"))
    return chain.join(totals, "snapshot_id").select("snapshot_id", "seen", good.alias("complete"))


def latest_snapshot(lines: DataFrame) -> tuple[str | None, DataFrame]:
    """The id and rows (JSON texts) of the complete snapshot that began last in the file, whatever its id."""
    best = complete_snapshots(lines).where("complete").orderBy(F.desc("seen")).select("snapshot_id").first()
    sid = best[0] if best else None
    rows = lines.where(F.col("snapshot_id") == sid) if sid is not None else lines.limit(0)
    return sid, rows.select(F.posexplode(F.from_json("body", PAGE)["results"]).alias("position", "row"), "offset")


def parsed_matches(rows: DataFrame, reason: Column | None = None) -> DataFrame:
    """The match table of archive_rows: one row for each id, the last fetched one, with its quarantine reason."""
    fields = "id long, slug string, start_date string, end_date string, bo_type int, team1 struct<id:long,name:string,slug:string,country_id:long>, team2 struct<id:long,name:string,slug:string,country_id:long>, team1_id long, team2_id long, team1_score int, team2_score int, winner_team_id long, tier string, tournament_id long, stage_id long, round_id long, parsed_status string"
    m = F.from_json("match", fields)
    own = demand_contract(rows, "match").select("*", m.alias("m"), F.get_json_object("match", "$.maps_score").alias("maps_score"))
    flat = own.select(
        F.col("m.id").alias("match_id"), *(f"m.{c}" for c in ("slug", "start_date", "end_date", "bo_type", "team1_id", "team2_id")), F.col("m.team1.name").alias("team1_name"), F.col("m.team2.name").alias("team2_name"),
        *(f"m.{c}" for c in ("team1_score", "team2_score", "winner_team_id", "tier", "tournament_id", "stage_id", "round_id")), "maps_score", "m.parsed_status", "m.team1", "m.team2", "src_chunk", "src_offset", "fetched_at", "line", "position",
    )
    last = last_per_key(flat, ["match_id"], [F.col("src_chunk"), F.col("line"), F.col("position")])
    given = reason if reason is not None else quarantine_reason(F.col("team1").isNull() | F.col("team2").isNull())
    return last.withColumn("quarantine_reason", given)


def teams(matches: DataFrame) -> DataFrame:
    """team_id, name, slug, country_id, last_seen: as of each team's latest match, of ties the later fetched."""
    order = F.struct("src_chunk", "line", "position")
    sides = matches.select(F.explode(F.array("team1", "team2")).alias("t"), "start_date", order.alias("at")).where("t IS NOT NULL")
    return latest_attributes(sides.select("t.*", "start_date", "at").withColumnRenamed("id", "team_id"), "team_id", ["name", "slug", "country_id"], "start_date", "at")


# The keys that every event of a snapshot has.
EVENT_KEYS = ("id", "name", "slug", "short_name", "start_date", "end_date", "tier", "tier_rank", "region_id", "country_id", "event_type", "event_scope", "event_level", "prize", "status", "pickem_presence")


def tournaments(rows: DataFrame, snapshot_id: str) -> DataFrame:
    """The event table of latest_snapshot's rows: one row for each id, the last listed; a row that lacks a key fails the query."""
    whole = demand_contract(rows, "row", EVENT_KEYS, start=None)
    texts = [F.get_json_object("row", f"$.{k}").alias(k) for k in EVENT_KEYS if k not in ("id", "tier_rank", "region_id", "country_id")]
    numbers = [F.get_json_object("row", f"$.{k}").cast("long").alias(k) for k in ("tier_rank", "region_id", "country_id")]
    flat = whole.select(F.get_json_object("row", "$.id").cast("long").alias("tournament_id"), *texts, *numbers, F.col("offset").alias("__o"), F.col("position").alias("__p"))
    last = last_per_key(flat, ["tournament_id"], [F.col("__o"), F.col("__p")])
    order = [c if c != "id" else "tournament_id" for c in EVENT_KEYS]
    return last.select(*order).withColumn("snapshot_fetched_at", F.lit(snapshot_id))
