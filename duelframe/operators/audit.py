"""The integrity audit: flags as one table, from promotions, impossible records and cross-checks."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import unordered
from .quarantine import promotion

AUDIT_VERSION = "v1:promotion+impossible+tier+reference+csv"


def _flags(df: DataFrame, flag: str | Column, severity: str, detail: Column, match_id: Column | None = None) -> DataFrame:
    mid = F.col("match_id") if match_id is None else match_id
    name = F.lit(flag) if isinstance(flag, str) else flag
    return df.select(mid.cast("long").alias("match_id"), name.alias("flag"), F.lit(severity).alias("severity"), detail.alias("detail"), F.lit(AUDIT_VERSION).alias("audit_version"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts))


def promotions(matches: DataFrame) -> DataFrame:
    """A flag for each score that does not fit its format."""
    kind = promotion()
    return _flags(matches.where(kind.isNotNull()), kind, "report", _text("best of ", F.col("bo_type"), " scored ", F.col("team1_score"), "-", F.col("team2_score")))


def impossible(matches: DataFrame) -> DataFrame:
    """Flags of teams that play themselves, negative scores, ends before starts, and double listings."""
    own = _flags(matches.where("team1_id = team2_id"), "self_play", "fail", _text("team ", F.col("team1_id"), " plays itself"))
    negative = _flags(matches.where("team1_score < 0 OR team2_score < 0"), "negative_score", "fail", _text("score ", F.col("team1_score"), "-", F.col("team2_score")))
    order = _flags(matches.where("end_date < start_date"), "date_order", "report", _text("ends ", F.col("end_date"), ", starts ", F.col("start_date")))
    lo, hi = unordered("team1_id", "team2_id")
    keyed = matches.select("match_id", lo.alias("lo"), hi.alias("hi"), "start_date").where("lo IS NOT NULL")
    groups = keyed.groupBy("lo", "hi", "start_date").agg(F.sort_array(F.collect_list("match_id")).alias("ids")).where("size(ids) > 1")
    double = groups.select(F.explode("ids").alias("match_id"), "ids")
    listed = _flags(double, "duplicate_pairing", "report", _text("same pair and start as ", F.array_join(F.col("ids").cast("array<string>"), ", ")))
    return own.unionByName(negative).unionByName(order).unionByName(listed)


def tier_check(matches: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Flags where the highest tier of an event's matches is not the event's; one flag if there are no events at all."""
    both = matches.where("tier IS NOT NULL").join(tournaments.where("tier IS NOT NULL").select("tournament_id", F.col("tier").alias("event_tier")), "tournament_id")
    unlike = both.groupBy("tournament_id", "event_tier").agg(F.max("tier").alias("tier")).where("tier <> event_tier")
    found = _flags(unlike, "tier_divergence", "report", _text("tournament ", F.col("tournament_id"), ": matches say ", F.col("tier"), ", the event says ", F.col("event_tier")), F.lit(None))
    none = tournaments.agg(F.count("*").alias("n")).where("n = 0")
    return found.unionByName(_flags(none, "tier_check_vacuous", "report", F.lit("no tournaments to compare with"), F.lit(None)))


def _resolved(rows: DataFrame, aliases: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with the ids of the named columns; the alias table is small and Spark broadcasts it by its size."""
    for column, out in names.items():
        rows = rows.join(aliases.select(F.col("canonical").alias(column), F.col("team_id").alias(out)), column, "left")
    return rows


def reference_check(matches: DataFrame, reference: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags, and coverage (name, expected, found), of results known from elsewhere: ref_id, a, b, winner, start.

    A reference needs exactly one match of its pair on its day, with its winner. A name
    without an alias fails the query.
    """
    named = _resolved(reference, aliases, {"a": "a_id", "b": "b_id", "winner": "w_id"})
    known = F.col("a_id").isNotNull() & F.col("b_id").isNotNull() & F.col("w_id").isNotNull()
    named = named.where(F.when(known, True).otherwise(F.raise_error(_text("a reference name has no alias: ", F.col("a"), ", ", F.col("b"), ", ", F.col("winner"))).cast("boolean")))
    lo, hi = unordered("a_id", "b_id")
    mlo, mhi = unordered("team1_id", "team2_id")
    days = matches.select(mlo.alias("lo"), mhi.alias("hi"), F.substring("start_date", 1, 10).alias("day"), "match_id", "winner_team_id")
    asked = named.select("*", lo.alias("lo"), hi.alias("hi"), F.substring("start", 1, 10).alias("day"))
    met = asked.join(days, ["lo", "hi", "day"], "left").groupBy("ref_id", "a", "b", "winner", "w_id", "day").agg(F.count("match_id").alias("n"), F.min_by("winner_team_id", "match_id").alias("got"), F.min("match_id").alias("match_id"))
    label = _text(F.col("a"), " vs ", F.col("b"), " on ", F.col("day"))
    kind = F.when(F.col("n") == 0, "reference_missing").when(F.col("n") > 1, "reference_ambiguous").when(~F.col("got").eqNullSafe(F.col("w_id")), "orientation_mismatch")
    at = F.when(kind == "orientation_mismatch", F.col("match_id"))
    flags = _flags(met.where(kind.isNotNull()), kind, "fail", _text(label, ": ", F.col("n"), " matches, winner ", F.col("got")), at)
    sides = met.select(F.explode(F.array("a", "b")).alias("name"), "n")
    return flags, sides.groupBy("name").agg(F.count("*").alias("expected"), F.count_if(F.col("n") > 0).alias("found"))


def csv_check(matches: DataFrame, rows: DataFrame, aliases: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
    """Flags, and outcomes (outcome, n), of hand-kept results without dates: row_id, winner, loser, event.

    Each needs exactly one clean match of its pair since then, with its winner. Raw start
    texts are compared, as the table keeps them.
    """
    named = _resolved(rows, aliases, {"winner": "w_id", "loser": "l_id"})
    lo, hi = unordered("w_id", "l_id")
    mlo, mhi = unordered("team1_id", "team2_id")
    recent = matches.where(F.col("start_date") >= since).select(mlo.alias("lo"), mhi.alias("hi"), "match_id", "winner_team_id", "quarantine_reason")
    clean = F.col("match_id").isNotNull() & F.col("quarantine_reason").isNull()
    met = named.select("*", lo.alias("lo"), hi.alias("hi")).join(recent, ["lo", "hi"], "left")
    held = F.collect_list(F.when(F.col("match_id").isNotNull() & ~clean, F.struct("match_id", "quarantine_reason"))).alias("held")
    met = met.groupBy("row_id", "winner", "loser", "event", "w_id", "l_id").agg(F.count("match_id").alias("n"), F.count_if(clean).alias("good"), F.min_by(F.when(clean, F.col("winner_team_id")), F.when(clean, F.col("match_id"))).alias("got"), F.min(F.when(clean, F.col("match_id"))).alias("match_id"), held)
    outcome = (
        F.when(F.col("w_id").isNull() | F.col("l_id").isNull(), "unresolvable").when(F.col("n") == 0, "unmatched").when(F.col("good") > 1, "ambiguous")
        .when((F.col("good") == 1) & ~F.col("got").eqNullSafe(F.col("w_id")), "mismatch").when(F.col("good") == 1, "verified").otherwise("quarantined")
    )
    met = met.withColumn("outcome", outcome)
    label = _text(F.col("winner"), " over ", F.col("loser"), " (", F.col("event"), ")")
    flags = _flags(met.where("outcome = 'unmatched'"), "csv_row_unmatched", "fail", _text(label, ": no match since ", since), F.lit(None))
    flags = flags.unionByName(_flags(met.where("outcome = 'ambiguous'"), "csv_ambiguous", "report", _text(label, ": ", F.col("good"), " clean matches"), F.lit(None)))
    flags = flags.unionByName(_flags(met.where("outcome = 'mismatch'"), "csv_orientation_mismatch", "fail", _text(label, ": the parsed winner is ", F.col("got"))))
    each = met.where("outcome = 'quarantined'").select("winner", "loser", "event", F.explode("held").alias("h"))
    flags = flags.unionByName(_flags(each, "csv_match_quarantined", "report", _text(label, ": quarantined as ", F.col("h.quarantine_reason")), F.col("h.match_id")))
    weight = F.when(F.col("outcome") == "quarantined", F.size("held")).otherwise(1)
    return flags, met.groupBy("outcome").agg(F.sum(weight).alias("n"))


@dataclass
class Audit:
    flags: DataFrame
    ok: bool
    counts: dict[str, int]
    meta: dict[str, str]


def flag_counts(flags: DataFrame) -> DataFrame:
    """flag, n, failures (those of severity fail)."""
    return flags.groupBy("flag").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "fail").alias("failures"))


def run_audit(matches: DataFrame, tournaments: DataFrame, aliases: DataFrame, reference: DataFrame | None, csv: DataFrame | None, since: str, partial: bool = False) -> Audit:
    """All checks. ok is False iff a flag has severity fail. Empty inputs prove nothing and raise, unless partial."""
    counted = {"reference_n": reference.count() if reference is not None else 0, "csv_n": csv.count() if csv is not None else 0}
    if not partial and not all(counted.values()):
        raise ValueError(f"the cross-checks would compare nothing: {counted}; give both inputs or ask for a partial audit")
    flags = promotions(matches).unionByName(impossible(matches)).unionByName(tier_check(matches, tournaments))
    if reference is not None:
        flags = flags.unionByName(reference_check(matches, reference, aliases)[0])
    if csv is not None:
        flags = flags.unionByName(csv_check(matches, csv, aliases, since)[0])
    by = flag_counts(flags).collect()  # a row for each kind of flag
    counts = {r["flag"]: r["n"] for r in sorted(by, key=lambda r: r["flag"])}
    ok = not any(r["failures"] for r in by)
    meta = {"audit_version": AUDIT_VERSION, "audit_ok": "true" if ok else "false", "audit_flag_counts": json.dumps(counts), "audit_input_counts": json.dumps(counted)}
    return Audit(flags, ok, counts, meta)


def stale_references(matches: DataFrame, tournaments: DataFrame, snapshot_id: str, excused: DataFrame | None = None) -> DataFrame:
    """tournament_id, fetched_at, state of events that matches name and the snapshot lacks.

    stale: a match was fetched after the snapshot began; excused: listed; gone: a failure.
    """
    named = matches.where("tournament_id IS NOT NULL").select("tournament_id", "fetched_at")
    lost = named.join(tournaments.select("tournament_id"), "tournament_id", "left_anti").groupBy("tournament_id").agg(F.max("fetched_at").alias("fetched_at"))
    state = F.when(F.col("fetched_at") > snapshot_id, "stale")
    if excused is not None:
        lost = lost.join(excused.select("tournament_id", F.lit(True).alias("__e")).distinct(), "tournament_id", "left")
        state = state.when(F.col("__e"), "excused")
    return lost.select("tournament_id", "fetched_at", state.otherwise("gone").alias("state"))
