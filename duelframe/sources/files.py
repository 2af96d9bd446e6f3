"""Small files: results, anchors, configurations, logs and run folders."""

from __future__ import annotations

import csv
import json
import shutil
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import normalized, team_alias

#: What the folders of a log's batches are called, before their number.
BATCH = "append-"
FIT_ROW = "winner string, loser string, weight double, event string, note string"


def fit_rows(spark: SparkSession, path: str) -> DataFrame:
    """Hand-kept results with weights."""
    return spark.read.csv(path, header=True, schema=FIT_ROW)


def csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every field as its text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def fit_list(path: str | Path) -> list[tuple[str, str, float]]:
    with open(path, newline="", encoding="utf-8") as f:
        return [(r["winner"], r["loser"], float(r["weight"])) for r in csv.DictReader(f)]


def numbered_results(spark: SparkSession, path: str | Path) -> DataFrame:
    """row_id (the place in the file), winner, loser, event of results kept by hand, for the audit."""
    with open(path, newline="", encoding="utf-8") as f:
        rows = [(i, r["winner"], r["loser"], r.get("event")) for i, r in enumerate(csv.DictReader(f))]
    return spark.createDataFrame(rows, "row_id long, winner string, loser string, event string")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A log of JSON lines, blank lines left out, with ordinal: the place of the line (file, block, line), which sorts in log order.

    Files count in the order of their paths, which is that of append_lines(); Spark itself
    reads large files first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    text = spark.read.option("recursiveFileLookup", True).text(path).select("value", place.alias("ordinal")).where(F.trim("value") != "")
    if schema is None:
        return text
    return text.select(F.from_json("value", schema).alias("r"), "ordinal").select("r.*", "ordinal")


def append_lines(rows: DataFrame, path: str, **options: str) -> str:
    """Appends rows to a log of JSON lines as a batch of its own below path; the batch's folder.

    Batches are numbered and never overwritten: where another writer takes a number first,
    the next one is tried.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    held = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    number = max((int(n.removeprefix(BATCH)) for n in held if n.startswith(BATCH)), default=-1) + 1
    while True:
        try:
            rows.write.mode("errorifexists").options(**options).json(out := f"{path}/{BATCH}{number:09d}")
            return out
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            number += 1


def references(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """ref_id, a, b, winner, start of several result files; ref_id says the file and the place in it, however Spark packs files."""
    raw = spark.read.option("multiLine", True).schema("matches array<struct<a:string,b:string,winner:string,start:string>>").json(list(paths)).select("matches", F.col("_metadata.file_path").alias("file"))
    each = raw.select("file", F.posexplode("matches").alias("place", "m"))
    return each.select(F.concat_ws("#", F.regexp_extract("file", "([^/]+)$", 1), F.lpad(F.col("place").cast("string"), 9, "0")).alias("ref_id"), "m.*")


def anchors(path: str | Path) -> list[dict]:
    """Priced pairs; none if there is no file."""
    return json.loads(Path(path).read_text())["anchors"] if Path(path).exists() else []


def market_snapshot(listed: DataFrame, must_hold: Sequence[str], ts: str) -> DataFrame:
    """Snapshot rows of listed markets: pass, page, position, question, slug, outcomes, prices (JSON texts), volume ...

    Only questions that hold every text; of a slug listed again, the first.
    """
    kept = listed
    for text in must_hold:
        kept = kept.where(F.coalesce(F.col("question").contains(text), F.lit(False)))
    first = kept.groupBy("slug").agg(F.min_by(F.struct(*[c for c in kept.columns if c != "slug"]), F.struct("pass", "page", "position")).alias("m")).select("slug", "m.*")
    raw = F.transform(F.from_json("prices", "array<string>"), lambda x: x.cast("double"))
    return first.select(F.lit(ts).alias("ts"), "slug", "question", F.from_json("outcomes", "array<string>").alias("outcomes"), F.coalesce(normalized(raw), raw).alias("prices"), raw.alias("raw_prices"), F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"), F.coalesce(F.col("liquidity").cast("double"), F.lit(0.0)).alias("liquidity"), "end_date")


def anchor_rows(snapshot: DataFrame, aliases: dict[str, str], least_volume: float = 1000.0, settled: float = 0.95) -> DataFrame:
    """a, b, p, slug, volume of two-sided liquid markets that are not settled and whose labels are known."""
    sides = [team_alias(F.col("outcomes")[i], aliases) for i in (0, 1)]
    open_ = snapshot.where((F.col("volume") >= least_volume) & (F.size("outcomes") == 2) & (F.array_max("prices") <= settled))
    return open_.select(sides[0].alias("a"), sides[1].alias("b"), F.round(F.col("prices")[0], 4).alias("p"), "slug", F.round("volume").cast("long").alias("volume")).where("a IS NOT NULL AND b IS NOT NULL")


def write_anchors(rows: DataFrame, path: str | Path, comment: str = "") -> list[dict]:
    """An event's few anchors as one JSON file."""
    own = [r.asDict() for r in rows.orderBy("slug").collect()]
    Path(path).write_text(json.dumps({"comment": comment, "anchors": own}, indent=2))
    return own


def write_results(records: Mapping[str, tuple[int, int]], path: str | Path, finished: Mapping[tuple[int, int], int]) -> None:
    """A finished stage's records; an unfinished one raises."""
    if Counter(tuple(r) for r in records.values()) != Counter(finished):
        raise ValueError("the stage is not complete")
    Path(path).write_text(json.dumps({t: list(r) for t, r in records.items()}, indent=2))


@dataclass
class EventConfig:
    """One event's facts, checked on loading."""

    event_id: str
    name: str
    teams: tuple[str, ...]
    round1: tuple[tuple[str, str], ...]
    seeds: dict[str, int]
    scoring: dict[str, int]
    grand_final_bo5: bool = True
    tournament_id: int | None = None

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> EventConfig:
        for key in ("event_id", "name", "teams", "round1", "seeds", "scoring", "playoffs"):
            if key not in raw:
                raise ValueError(f"an event needs {key}")
        teams = tuple(raw["teams"])
        pairs = tuple(tuple(p) for p in raw["round1"])
        checks = (
            (len(teams) == 16 and len(set(teams)) == 16, "sixteen different teams"),
            (all(len(p) == 2 for p in pairs) and sorted(t for p in pairs for t in p) == sorted(teams), "a first round of all teams"),
            (set(raw["seeds"]) == set(teams) and len(set(raw["seeds"].values())) == len(teams), "one seed for each team"),
            (all(type(v) is int for k, v in raw["scoring"].items()) and {"exact_3_0", "exact_0_3", "advance", "pass_threshold"} <= set(raw["scoring"]), "whole numbers in its scoring"),
            (isinstance(raw["playoffs"].get("grand_final_bo5"), bool), "the final's format"),
        )
        for ok, what in checks:
            if not ok:
                raise ValueError(f"an event needs {what}")
        return cls(raw["event_id"], raw["name"], teams, pairs, dict(raw["seeds"]), dict(raw["scoring"]), raw["playoffs"]["grand_final_bo5"], raw.get("tournament_id"))

    @classmethod
    def load(cls, path: str | Path) -> EventConfig:
        return cls.from_dict(json.loads(Path(path).read_text()))


def write_run(directory: str | Path, documents: Mapping[str, Any], lines: Mapping[str, Iterable[Any]], configs: Sequence[str | Path] = ()) -> Path:
    """A run's folder: JSON documents, JSON lines, and the configurations as they were."""
    out = Path(directory)
    (out / "configs").mkdir(parents=True, exist_ok=True)
    for name, value in documents.items():
        (out / f"{name}.json").write_text(json.dumps(value, indent=2, sort_keys=True) + "\n")
    for name, rows in lines.items():
        (out / f"{name}.jsonl").write_text("".join(json.dumps(r, sort_keys=True) + "\n" for r in rows))
    for path in configs:
        shutil.copyfile(path, out / "configs" / Path(path).name)
    return out
