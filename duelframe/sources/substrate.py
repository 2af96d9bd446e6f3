"""The parsed tables as a store: whole builds of matches, teams, aliases and events, with the stamps that say what they mean."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import Audit, stale_references
from ..operators.quarantine import consumer_view, quarantine_counts, reconcile
from . import archive
from .commits import moved_if_absent

PARSE_VERSION = "1:contract+quarantine+last-fetch"
BUILD = "build-"
STAMP = "key string, value string"


@dataclass
class Substrate:
    """A build's tables and its stamps; tables that were not made are None."""

    path: str
    matches: DataFrame
    teams: DataFrame
    aliases: DataFrame
    tournaments: DataFrame | None = None
    flags: DataFrame | None = None
    meta: dict[str, str] = field(default_factory=dict)

    def consumed(self) -> DataFrame:
        """The consumer view; raises where no audit ran."""
        return consumer_view(self.matches, self.flags)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _there(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _builds(spark: SparkSession, root: str) -> list[int]:
    fs, p = _folder(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(BUILD)) for n in names if n.startswith(BUILD))


def _stamp(spark: SparkSession, path: str, meta: Mapping[str, str]) -> None:
    spark.createDataFrame(sorted(meta.items()), STAMP).coalesce(1).write.mode("overwrite").parquet(path)


def build(spark: SparkSession, lines: DataFrame, aliases: DataFrame, root: str) -> dict[str, str]:
    """Writes all tables of an archive (LINE's columns, see archive) as a new build below root; its stamps.

    aliases: canonical, team_id, source. A build is written aside and takes the next free number
    when it is whole, so of two at a time each gets its own; older builds stay as they are.
    The same archive gives the same tables.
    """
    out = f"{root}/_building-{uuid.uuid4().hex}"
    rows = archive.archive_rows(lines)
    archive.parsed_matches(rows).withColumn("parse_version", F.lit(PARSE_VERSION)).write.parquet(f"{out}/matches")
    matches = spark.read.parquet(f"{out}/matches")
    archive.teams(matches).write.parquet(f"{out}/teams")
    aliases.write.parquet(f"{out}/aliases")
    chain = archive.verify(lines)
    n, fetched = matches.agg(F.count("*"), F.max("fetched_at")).first()
    reasons = {r["quarantine_reason"]: r["n"] for r in quarantine_counts(matches).collect()}  # a row for each reason
    seen = rows.count()
    ok, wrong = reconcile(matches, seen, chain["rows"], chain["offsets_contiguous"], n)
    clean = reasons.pop(None, 0)
    meta = {
        "parse_version": PARSE_VERSION, "archive_max_fetched_at": fetched or "", "tournaments_snapshot_id": "none", "rows_seen": str(seen), "unique_ids": str(n), "clean_n": str(clean), "quarantined_n": str(n - clean),
        "reason_counts": json.dumps(reasons, sort_keys=True), "reconciled": "true" if ok else "false", "reconcile_failures": json.dumps(wrong),
    }
    _stamp(spark, f"{out}/parse_meta", meta)
    number = (_builds(spark, root) or [-1])[-1] + 1
    while not moved_if_absent(spark, out, f"{root}/{BUILD}{number:06d}"):
        number += 1
    return meta


def newest(spark: SparkSession, root: str) -> str:
    """The folder of the last whole build."""
    for n in reversed(_builds(spark, root)):
        if _there(spark, path := f"{root}/{BUILD}{n:06d}/parse_meta"):
            return path.removesuffix("/parse_meta")
    raise FileNotFoundError(f"no whole build below {root}")


def load(spark: SparkSession, root: str) -> Substrate:
    """The last whole build; later stamps (events, audit) go before the parse's."""
    path = newest(spark, root)
    read = lambda name: spark.read.parquet(f"{path}/{name}") if _there(spark, f"{path}/{name}") else None
    meta: dict[str, str] = {}
    for name in ("parse_meta", "tournament_meta", "audit_meta"):
        if (own := read(name)) is not None:
            meta |= {r["key"]: r["value"] for r in own.collect()}  # a few stamps
    return Substrate(path, read("matches"), read("teams"), read("aliases"), read("tournaments") if _there(spark, f"{path}/tournament_meta") else None, read("flags") if _there(spark, f"{path}/audit_meta") else None, meta)


def add_tournaments(spark: SparkSession, root: str, lines: DataFrame, excused: DataFrame | None = None) -> dict:
    """Puts the newest whole snapshot's events into the last build; a report with the events that matches name and it lacks.

    Nothing of the matches changes, whatever the snapshot holds.
    """
    snapshot, rows = archive.latest_snapshot(lines)
    if snapshot is None:
        raise ValueError("no whole snapshot of events")
    path = newest(spark, root)
    archive.tournaments(rows, snapshot).withColumn("parse_version", F.lit(PARSE_VERSION)).write.mode("overwrite").parquet(f"{path}/tournaments")
    held = spark.read.parquet(f"{path}/tournaments")
    n, unnamed = held.agg(F.count("*"), F.count_if(F.col("name").isNull())).first()
    lost = stale_references(spark.read.parquet(f"{path}/matches"), held, snapshot, excused)
    counts = {r["state"]: r["n"] for r in lost.groupBy("state").agg(F.count("*").alias("n")).collect()}
    _stamp(spark, f"{path}/tournament_meta", {"tournaments_snapshot_id": snapshot})
    return {"snapshot_id": snapshot, "tournaments_n": n, "null_names": unnamed, "states": counts, "ok": not counts.get("gone")}


def add_audit(spark: SparkSession, root: str, audit: Audit) -> None:
    """Puts an audit's flags and stamps into the last build, in place of an older audit's."""
    path = newest(spark, root)
    audit.flags.write.mode("overwrite").parquet(f"{path}/flags")
    _stamp(spark, f"{path}/audit_meta", audit.meta)
