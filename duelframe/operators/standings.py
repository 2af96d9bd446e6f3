"""Standings of events from their matches: records, strength of opponents, places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sides(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, team, opponent, won: both sides of each match (winner, loser)."""
    side = lambda a, b, won: F.struct(F.col(a).alias("team"), F.col(b).alias("opponent"), F.lit(won).alias("won"))
    return matches.select(*keys, F.explode(F.array(side("winner", "loser", 1), side("loser", "winner", 0))).alias("s")).select(*keys, "s.*")


def records(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, team, wins, losses, buchholz: the sum, over a team's matches, of its opponents' wins less losses.

    Matches are summed up by pair before they meet the opponents' records, so a team's
    opponents count once each, however often they met.
    """
    met = sides(matches, keys).groupBy(*keys, "team", "opponent").agg(F.count("*").alias("n"), F.sum("won").alias("won"))
    own = met.groupBy(*keys, "team").agg(F.sum("won").alias("wins"), F.sum(F.col("n") - F.col("won")).alias("losses"))
    theirs = own.select(*keys, F.col("team").alias("opponent"), (F.col("wins") - F.col("losses")).alias("__d"))
    strength = met.join(theirs, [*keys, "opponent"]).groupBy(*keys, "team").agg(F.sum(F.col("n") * F.col("__d")).alias("buchholz"))
    return own.join(strength, [*keys, "team"])


def placed(table: DataFrame, keys: Sequence[str], seed: str) -> DataFrame:
    """records with group_place (within the record: strongest opponents first, then seed) and final_place (fewest losses first).

    An event's teams, hundreds at most, are placed together.
    """
    order = [F.desc("buchholz"), F.asc(seed)]
    within = Window.partitionBy(*keys, "wins", "losses").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy("losses", F.desc("wins"), *order)
    return table.withColumns({"group_place": F.row_number().over(within), "final_place": F.row_number().over(overall)})
