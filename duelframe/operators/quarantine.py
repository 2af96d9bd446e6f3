"""Validation of matches: key contract, quarantine reasons, promotion, consumer view, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import utc

# Maps to win and maps at most, by series format.
WINS_NEEDED = {1: 1, 2: 2, 3: 2, 5: 3}
MOST_MAPS = {1: 1, 2: 2, 3: 3, 5: 5}
MOST_QUARANTINED = 0.02

# The keys that every raw match has, those that are read first, then the others observed.
MATCH_KEYS = (
    "id", "slug", "start_date", "end_date", "bo_type", "team1", "team2", "team1_id", "team2_id", "team1_score", "team2_score", "winner_team_id", "tier", "tournament_id", "stage_id", "round_id", "maps_score", "status", "parsed_status",
    "bet_updates", "comments", "comments_count", "discipline_id", "game_version", "live_coverage", "live_coverage_advantage", "live_coverage_source", "live_updates", "loser_team_id", "points", "position", "prev_match1_id", "prev_match1_winner",
    "prev_match2_id", "prev_match2_winner", "rating", "stars", "team1_last_game_score", "team1_new_participant", "team2_last_game_score", "team2_new_participant", "tier_rank", "winner_team",
)
CONSUMER = ("match_id", "start_date", "bo_type", "team1_id", "team2_id", "team1_score", "team2_score", "winner_team_id", "tier", "tournament_id", "stage_id", "round_id", "quarantine_reason")


def missing_keys(json_text: Column | str, keys: Sequence[str] = MATCH_KEYS) -> Column:
    """The required keys that a JSON object lacks; a key with a null value is there."""
    return F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>")))


def demand_contract(df: DataFrame, json_text: str, keys: Sequence[str] = MATCH_KEYS, start: str | None = "$.start_date") -> DataFrame:
    """df; a row that lacks a key, or whose start is absent or no date, fails the query when read."""
    lacking = missing_keys(F.col(json_text), keys)
    checks = [F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("missing contract keys: "), F.array_join(lacking, ", "))))]
    if start:
        value = F.get_json_object(json_text, start)
        checks.append(F.when(utc(value).isNull(), F.raise_error(F.concat(F.lit("no usable start_date: "), F.coalesce(value, F.lit("null"))))))
    ok = F.coalesce(*(c.cast("boolean") for c in checks), F.lit(True))
    return df.where(ok)


def _by_format(values: dict[int, int]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in values.items():
        out = out.when(F.col("bo_type") == k, F.lit(v))
    return out


def oriented() -> tuple[Column, Column]:
    """The winner's and the loser's score."""
    first = F.col("winner_team_id").eqNullSafe(F.col("team1_id"))
    return F.when(first, F.col("team1_score")).otherwise(F.col("team2_score")), F.when(first, F.col("team2_score")).otherwise(F.col("team1_score"))


def quarantine_reason(no_team: Column | None = None) -> Column:
    """Why a match is degenerate, by the first rule that it breaks; null if none.

    no_team: where a side is absent; by default where its id is null.
    """
    need, most = _by_format(WINS_NEEDED), _by_format(MOST_MAPS)
    s1, s2, w = F.col("team1_score"), F.col("team2_score"), F.col("winner_team_id")
    no_team = no_team if no_team is not None else F.col("team1_id").isNull() | F.col("team2_id").isNull()
    won, lost = oriented()
    side = w.eqNullSafe(F.col("team1_id")) | w.eqNullSafe(F.col("team2_id"))
    return (
        F.when(need.isNull(), "unknown_bo_type")
        .when(no_team, "null_team")
        .when(s1.isNull() | s2.isNull(), "missing_score")
        .when((F.col("bo_type") == 2) & (s1 == 1) & (s2 == 1), "bo2_draw")
        .when(w.isNull() | ~side, "null_winner")
        .when(~((won == need) & (lost < need) & (s1 + s2 <= most)), "score_bo_mismatch")
    )


def promotion() -> Column:
    """For a score that does not fit its format: whether it proves several maps; else null."""
    won, lost = oriented()
    proven = (won >= 2) & (won > lost)
    return F.when(F.col("quarantine_reason") == "score_bo_mismatch", F.when(proven, "inferred_multi_map").otherwise("forfeit_signature"))


def consumer_view(matches: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Clean matches and those whose score proves several maps. Without an audit there is no view."""
    if flags is None:
        raise ValueError("the audit has to run before matches are consumed: without its flags promoted rows would be lost")
    promoted = flags.where(F.col("flag") == "inferred_multi_map").select("match_id", F.lit(True).alias("__promoted")).distinct()
    return matches.join(promoted, "match_id", "left").where(F.col("quarantine_reason").isNull() | F.col("__promoted")).select(*CONSUMER)


def consumable() -> Column:
    """The consumer view's condition where the audit's classification is at hand as an expression: no join, no shuffle."""
    return F.col("quarantine_reason").isNull() | F.coalesce(promotion() == "inferred_multi_map", F.lit(False))


def quarantine_counts(matches: DataFrame) -> DataFrame:
    """Reasons with their counts; the null reason counts clean matches."""
    return matches.groupBy("quarantine_reason").agg(F.count("*").alias("n"))


def reconcile(matches: DataFrame, rows_seen: int, archive_rows: int, archive_contiguous: bool, unique_ids: int) -> tuple[bool, list[str]]:
    """Whether every archived row landed once, clean or quarantined, and the share of the latter is as usual; what is wrong."""
    n, q, draws = matches.agg(F.count("*"), F.count("quarantine_reason"), F.count_if(F.col("quarantine_reason") == "bo2_draw")).first()
    checks = (
        (archive_contiguous, "archive offsets are not contiguous"),
        (rows_seen == archive_rows, f"{rows_seen} rows were seen, the archive has {archive_rows}"),
        (n == unique_ids, f"{unique_ids} ids were parsed, the table has {n}"),
        (draws > 0, "no draw among best-of-twos"),
        (not n or q / n <= MOST_QUARANTINED, f"{q} of {n} matches are quarantined"),
    )
    wrong = [why for ok, why in checks if not ok]
    return not wrong, wrong
