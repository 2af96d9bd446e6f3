"""Queries over the driver's tables that exercise the operators, with their SQL.

Orders stand for matches between suppliers and events for price snapshots; see the views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import scoring as S
from .operators import asof, audit, events, grading, latest, quarantine, scan
from .session import cut

#: Months before an event whose matches count for it.
MONTHS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views ---

SERIES_SQL = """
SELECT o_orderkey AS match_id, o_orderdate AS start_ts,
 CASE o_orderkey % 100 WHEN 0 THEN 2 WHEN 1 THEN 7 ELSE CASE WHEN o_orderkey % 5 = 0 THEN 1 WHEN o_orderkey % 5 = 1 THEN 5 ELSE 3 END END AS bo_type,
 LEAST(w, COALESCE(l, w)) AS team1_id, CASE WHEN l IS NULL THEN NULL ELSE GREATEST(w, l) END AS team2_id, w AS winner_team_id,
 CASE WHEN o_orderpriority='1-URGENT' THEN 's' WHEN o_orderpriority='2-HIGH' THEN 'a' WHEN o_orderpriority='3-MEDIUM' THEN 'b' WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'c' END AS tier,
 CAST(EXTRACT(YEAR FROM o_orderdate)*100+EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS tournament_id
FROM orders JOIN (SELECT l_orderkey, MAX(CASE WHEN r=1 THEN l_suppkey END) AS w, MAX(CASE WHEN r=2 THEN l_suppkey END) AS l
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY px DESC, l_suppkey) AS r
    FROM (SELECT l_orderkey, l_suppkey, SUM(CAST(l_extendedprice * 100 AS BIGINT)) AS px FROM lineitem GROUP BY l_orderkey, l_suppkey) a) b
  GROUP BY l_orderkey) p ON o_orderkey = l_orderkey
"""
#: Scores by number: those that fit the format, and some of every kind that does not.
SCORED_SQL = f"""
SELECT s.*, CAST(CASE WHEN match_id % 37 = 0 THEN NULL WHEN match_id % 41 = 0 THEN 1 WHEN bo_type = 2 THEN 1 WHEN match_id % 43 = 0 THEN -1
   WHEN winner_team_id = team1_id THEN CASE bo_type WHEN 1 THEN 1 WHEN 5 THEN 3 ELSE 2 END ELSE match_id % 2 END AS INT) AS team1_score,
 CAST(CASE WHEN bo_type = 2 THEN 1 WHEN winner_team_id = team1_id THEN CASE WHEN bo_type = 1 THEN 0 ELSE match_id % 2 END ELSE CASE bo_type WHEN 1 THEN 1 + match_id % 2 WHEN 5 THEN 3 ELSE 2 END END AS INT) AS team2_score
FROM ({SERIES_SQL}) s
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: the two suppliers with the highest sums, the first as winner."""
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")  # a cast alone cuts 0.29 to 28 cents
    side = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum(cents).alias("px"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("px"), "l_suppkey"))  # within an order's few suppliers
    place = lambda r: F.max(F.when(F.col("r") == r, F.col("l_suppkey")))
    pair = side.withColumn("r", rank).where("r <= 2").groupBy("l_orderkey").agg(place(1).alias("w"), place(2).alias("l"))
    sides = pair.select("l_orderkey", F.least("w", F.coalesce("l", "w")).alias("team1_id"), F.when(F.col("l").isNotNull(), F.greatest("w", "l")).alias("team2_id"), F.col("w").alias("winner_team_id"))
    k = F.col("o_orderkey")
    bo = F.when(k % 100 == 0, 2).when(k % 100 == 1, 7).when(k % 5 == 0, 1).when(k % 5 == 1, 5).otherwise(3)
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", "s").when(F.col("o_orderpriority") == "2-HIGH", "a").when(F.col("o_orderpriority") == "3-MEDIUM", "b").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "c")
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    # Columns are made on their side of the join: above it they would be inlined into every expression that uses them.
    orders = _table(spark, sf_dir, "orders").select(k.alias("match_id"), F.col("o_orderdate").alias("start_ts"), bo.alias("bo_type"), tier.alias("tier"), month.alias("tournament_id"))
    return orders.join(sides, F.col("match_id") == F.col("l_orderkey")).drop("l_orderkey")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, first, odd = F.col("match_id"), F.col("winner_team_id") == F.col("team1_id"), (F.col("match_id") % 2)
    need = F.when(F.col("bo_type") == 1, 1).when(F.col("bo_type") == 5, 3).otherwise(2)
    s1 = F.when(m % 37 == 0, None).when(m % 41 == 0, 1).when(F.col("bo_type") == 2, 1).when(m % 43 == 0, -1).when(first, need).otherwise(odd)
    s2 = F.when(F.col("bo_type") == 2, 1).when(first, F.when(F.col("bo_type") == 1, 0).otherwise(odd)).otherwise(F.when(F.col("bo_type") == 1, 1 + odd).otherwise(need))
    return series(spark, sf_dir).withColumns({"team1_score": s1.cast("int"), "team2_score": s2.cast("int")})


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored with a quarantine reason, and the start as text."""
    own = scored(spark, sf_dir).withColumn("quarantine_reason", quarantine.quarantine_reason())
    stamp = F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss")
    return own.withColumns({"start_date": stamp, "end_date": F.when(F.col("match_id") % 11 == 0, F.date_format(F.col("start_ts") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss")), "stage_id": F.col("match_id") % 4, "round_id": F.col("match_id") % 5})


REASON_SQL = f"""
SELECT s.*, CASE WHEN bo_type NOT IN (1,2,3,5) THEN 'unknown_bo_type' WHEN team1_id IS NULL OR team2_id IS NULL THEN 'null_team' WHEN team1_score IS NULL OR team2_score IS NULL THEN 'missing_score'
  WHEN bo_type = 2 AND team1_score = 1 AND team2_score = 1 THEN 'bo2_draw' WHEN winner_team_id IS NULL OR winner_team_id NOT IN (team1_id, team2_id) THEN 'null_winner'
  WHEN NOT (ws = need AND ls < need AND team1_score + team2_score <= bo_type) THEN 'score_bo_mismatch' END AS quarantine_reason
FROM (SELECT *, CASE WHEN winner_team_id = team1_id THEN team1_score ELSE team2_score END AS ws, CASE WHEN winner_team_id = team1_id THEN team2_score ELSE team1_score END AS ls,
  CASE bo_type WHEN 1 THEN 1 WHEN 5 THEN 3 ELSE 2 END AS need FROM ({SCORED_SQL}) x) s
"""
CONSUMED_SQL = f"SELECT * FROM ({REASON_SQL}) q WHERE quarantine_reason IS NULL OR (quarantine_reason = 'score_bo_mismatch' AND ws >= 2 AND ws > ls)"


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = judged(spark, sf_dir).where(quarantine.consumable()).select(*quarantine.CONSUMER)
    return view.withColumn("start_ts", F.to_timestamp("start_date"))


# --- queries ---


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.quarantine_counts(judged(spark, sf_dir))


def promotion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.promotions(judged(spark, sf_dir)).select("match_id", "flag", "severity")


def consumer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumed(spark, sf_dir).drop("start_ts", "stage_id", "round_id", "start_date")


def impossible_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = judged(spark, sf_dir).withColumn("start_date", F.substring("start_date", 1, 10)).withColumn("end_date", F.substring("end_date", 1, 10))
    return audit.impossible(m).groupBy("flag", "severity").agg(F.count("*").alias("n"), F.sum("match_id").alias("ids"))


def tier_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = judged(spark, sf_dir)
    listed = m.select("tournament_id").distinct().withColumn("tier", F.when(F.col("tournament_id") % 3 == 0, "s").otherwise("a"))
    return audit.tier_check(m, listed).select("flag", "severity", F.regexp_extract("detail", r"tournament (\d+)", 1).try_cast("long").alias("tournament_id"))


def latest_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return latest.latest_attributes(e, "user_id", ["event_type", "value"], "day", "event_id")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.last_per_key(_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


def superseding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return latest.last_per_key(c.select("conv_id", "role", "turn", F.length("text").alias("chars")), ["conv_id", "role"], [F.col("turn"), F.col("chars")])


def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.lit(1).cast("long").alias("n")).withColumn("offset", F.col("turn"))
    return latest.contiguous(own, ["conv_id"]).select("conv_id", "contiguous", F.col("rows").cast("long").alias("n_rows"))


def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.groupBy(F.size(quarantine.missing_keys("props", ["k"])).cast("long").alias("missing")).agg(F.count("*").alias("n"))


def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = judged(spark, sf_dir)
    lo, hi = S.unordered("team1_id", "team2_id")
    return m.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"), F.min("match_id").alias("first_id")).where("lo IS NOT NULL AND n > 1")


def stale_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, held = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    m = orders.select((F.col("o_custkey") * 3 % 2003).alias("tournament_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fetched_at"))
    return audit.stale_references(m, held.select(F.col("c_custkey").alias("tournament_id")), "1998-01-01")


def _close_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    m = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("start_ts"))
    q = e.where("event_type IN ('view', 'click') AND value >= 10.0").select(F.col("event_id").alias("q_id"), "user_id", "ts", "value")
    # Of one time the smaller id counts, before the start and after it.
    found = asof.as_of(m, q.withColumn("price", F.struct("q_id", "value")), ["user_id"], "start_ts", "ts", "price", [-F.col("q_id")], [F.col("q_id")])
    return found.select("event_id", "start_ts", "close.q_id", "close.value", "flagged")


def asof_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _close_rows(spark, sf_dir).select("event_id", "q_id", F.round("value", 4).alias("close_value"), "flagged")


CLOSE_SQL = """
SELECT m.event_id, r.q_id, r.value, NOT r.pre AS flagged FROM (SELECT event_id, user_id, ts AS start_ts FROM events WHERE event_type='purchase') m LEFT JOIN (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY CASE WHEN pre THEN 0 ELSE 1 END, CASE WHEN pre THEN ts END DESC, CASE WHEN NOT pre THEN ts END ASC, q_id) AS rn
  FROM (SELECT m.event_id, q.event_id AS q_id, q.ts, q.value, q.ts < m.ts AS pre FROM events m JOIN events q ON q.user_id = m.user_id
    WHERE m.event_type='purchase' AND q.event_type IN ('view','click') AND q.value >= 10.0) c) r ON r.event_id = m.event_id AND r.rn = 1
"""


def graded_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as forecasts: scores of the model (a shrunk price) and the market, by eligibility."""
    rows = _close_rows(spark, sf_dir).withColumn("close_prob", F.col("value") / (F.col("value") + 100)).withColumn("model_prob", 0.5 + (F.coalesce("close_prob", F.lit(0.5)) - 0.5) * 0.8)
    rows = rows.select("event_id", F.lit("x").alias("a"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("winner"), "close_prob", "model_prob", F.col("flagged").alias("close_flagged"))
    prov = F.create_map(F.lit("code_dirty"), F.when(F.col("event_id") % 7 == 0, "true").otherwise("false"), F.lit("reconstruction_mode"), F.lit("immutable_forecast"), F.lit("code_sha"), F.when(F.col("event_id") % 5 == 0, "pending-x").otherwise("abc"))
    return grading.grade_matches(rows.withColumn("provenance", prov))


def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.summarize(graded_closes(spark, sf_dir))
    return out.select(*(F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def event_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_universe(consumed(spark, sf_dir))[0]


def event_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.split(events.event_universe(consumed(spark, sf_dir))[0], "1996-01-15")
    return found.select("tournament_id", "part")


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = cut(consumed(spark, sf_dir))  # read once, whatever is made of it
    ev = cut(events.event_universe(m)[0])
    return m, ev, cut(events.window_matches(ev, m, MONTHS))


def _universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = cut(consumed(spark, sf_dir))
    return m, cut(events.event_universe(m)[0])


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, ev = _universe(spark, sf_dir)
    return events.trailing(ev, m, MONTHS, [], {"n": (F.count("*"), F.sum), "first_id": (F.min("match_id"), F.min), "last_start": (F.max("start_ts"), F.max)})


def hop_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, ev = _universe(spark, sf_dir)
    bits = events.numbered(ev)
    w = cut(events.window_masks(bits, m.select("team1_id", "team2_id", "start_ts"), MONTHS))
    grown = events.expand_masks(bits, events.participants(ev, m), w, 2)
    return events.unmasked(grown, bits).groupBy("event_id", "hop").agg(F.count("*").alias("n"), F.sum("team").alias("teams"))


def modal_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, ev = _universe(spark, sf_dir)
    return events.team_windows(ev, m, MONTHS).select("event_id", "team", "n", "modal_tier")


def leave_one_out_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("event_id"), F.concat(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("modal_tier"), F.col("c_acctbal").alias("rating"))
    return events.leave_one_out(c, 1000.0).select("c_custkey", F.round("prior", 6).alias("prior"))


def rating_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over pairs of part prices read as ratings."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size") * 30.0).alias("b"))
    q = p.withColumn("p", S.win_prob("a", "b")).withColumn("y", (F.col("p_partkey") % 2).cast("double"))
    cols = {"p": F.col("p"), "gap": S.logit_gap("p"), "fair": S.devig(1 + F.col("a"), 1 + F.col("b")), "brier": S.brier("p", "y"), "log_loss": S.log_loss("p", "y"), "bo5": S.bo5("p"), "weight": S.match_weight(F.col("p_partkey") % 900, F.col("p_partkey") % 3, 180.0, 0.6), "sigma": S.stale_sigma(50.0, 20.0, F.col("p_partkey") % 900 + 0.0), "sharp": S.sharpened("p", 1.3)}
    return q.select("p_partkey", *(F.round(v, 7).alias(k) for k, v in cols.items()))


SCORES_SQL = """
SELECT p_partkey, round(p, 7) AS p, round(400 * log10(p / (1 - p)), 7) AS gap, round((1 / (1 + a)) / (1 / (1 + a) + 1 / (1 + b)), 7) AS fair, round((p - y) * (p - y), 7) AS brier,
 round(-(y * ln(greatest(least(p, 1 - 1e-9), 1e-9)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-9), 1e-9))), 7) AS log_loss, round(q*q*q*(1 + 3*(1-q) + 6*(1-q)*(1-q)), 7) AS bo5,
 round(pow(0.5, (p_partkey % 900) / 180.0) * CASE WHEN p_partkey % 3 = 1 THEN 0.6 ELSE 1.0 END, 7) AS weight, round(50 + 20 * (p_partkey % 900) / 365.0, 7) AS sigma, round(greatest(1e-6, 1 - 1.3 * (1 - p)), 7) AS sharp
FROM (SELECT *, 0.5 + sin(asin(2 * greatest(least(p, 1 - 1e-12), 1e-12) - 1) / 3) AS q, CAST(p_partkey % 2 AS DOUBLE) AS y FROM (
  SELECT p_partkey, a, b, 1 / (1 + pow(10.0, (b - a) / 400.0)) AS p FROM (SELECT p_partkey, p_retailprice AS a, p_size * 30.0 AS b FROM part) x) z) v
"""


def gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of a rating fit from flat priors, as relational sums over matches."""
    m = consumed(spark, sf_dir).where("team2_id IS NOT NULL")
    half = F.lit(0.5 * 2000.0) * F.log(F.lit(10.0)) / 400
    sides = m.select(F.explode(F.array(F.struct(F.col("team1_id").alias("team"), F.when(F.col("winner_team_id") == F.col("team1_id"), 1).otherwise(-1).alias("s")), F.struct(F.col("team2_id").alias("team"), F.when(F.col("winner_team_id") == F.col("team2_id"), 1).otherwise(-1).alias("s")))).alias("x")).select("x.*")
    return sides.groupBy("team").agg(F.count("*").alias("n"), F.round(F.sum("s") * half + 1000, 6).alias("rating"))


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {r[0].lower(): r[0] for r in _table(spark, sf_dir, "region").select("r_name").collect()}  # five rows
    r = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.concat(F.lit("  "), F.initcap("r_name"), F.when(F.col("n_nationkey") % 4 == 0, "?").otherwise(" "))
    return r.select("n_nationkey", S.team_alias(label, names).alias("name"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.months_before("o_orderdate", 7).alias("back"), F.round(S.age_days("o_orderdate", F.lit("1999-01-01 00:00:00").cast("timestamp")), 6).alias("age"))


def paired_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded closes as a paired comparison by day of the month, with a coverage floor."""
    g = graded_closes(spark, sf_dir).join(_table(spark, sf_dir, "events").select("event_id", "ts"), "event_id").withColumn("month", F.dayofmonth("ts"))
    rows = g.select(F.col("month").alias("event_id"), F.col("event_id").alias("match_id"), "delta_brier", "delta_log", "adoption_eligible")
    out = grading.event_summaries(rows.where("adoption_eligible"), rows.where("NOT adoption_eligible"), 0.68)
    return out.select(F.col("event_id").cast("long").alias("day"), "n_graded", "n_skipped", F.round("mean_delta_brier", 8).alias("mean_delta_brier"), F.round("coverage", 8).alias("coverage"), "excluded")


def _fit_windows(spark: SparkSession, sf_dir: str):
    from .plans.windows import by_month, windows

    m = by_month(consumed(spark, sf_dir))  # read once, whatever is made of it
    return windows(m.where("team2_id IS NOT NULL"), events.event_universe(m)[0], MONTHS)


def fitted_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both configurations' fits of every event, over the 24 months before it."""
    from .plans.windows import fit_windows

    model = {"priors_scheme": "flat1000", "prior_mean": 1000, "sigma": 50.0, "iters": 2000, "lr": 100.0, "converge_tol": 0.01}
    tiered = model | {"priors_scheme": "tier-empirical-2pass", "staleness": {"sigma_per_year": 50.0}}
    weighted = {"scheme": "weighted", "half_life_days": 180, "bo1_discount": 0.6}
    fits = fit_windows(_fit_windows(spark, sf_dir), {"flat": {"model": model, "data_prep": {"weighting": "uniform"}}, "tiered": {"model": tiered, "data_prep": {"weighting": weighted}}})
    return fits.select("event_id", "config", "team", F.round("rating", 6).alias("rating"))


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, their sides by name with a day that half the time is another, and the alias table."""
    m = judged(spark, sf_dir)
    names = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("canonical"), F.col("s_suppkey").alias("team_id"))
    known = m.where("team1_id IS NOT NULL AND team2_id IS NOT NULL")
    side = lambda c: names.select(F.col("team_id").alias(f"{c}_team_id" if c == "winner" else f"{c}_id"), F.col("canonical").alias(c))
    loser = F.when(F.col("winner_team_id") == F.col("team1_id"), F.col("team2_id")).otherwise(F.col("team1_id")).alias("loser_id")
    rows = known.select("match_id", "start_ts", "bo_type", "tier", "winner_team_id", "team1_id", "team2_id", loser)
    return m, rows.join(side("team1"), "team1_id").join(side("team2"), "team2_id").join(side("winner"), "winner_team_id").join(side("loser"), "loser_id"), names


def _reference(named: DataFrame) -> DataFrame:
    """Results as another source lists them: those of best-of-ones a day late, those of best-of-fives with the other winner."""
    winner = F.when(F.col("bo_type") == 5, F.col("loser")).otherwise(F.col("winner"))
    day = F.when(F.col("bo_type") == 1, F.date_add("start_ts", 1)).otherwise(F.to_date("start_ts"))
    return named.select(F.col("match_id").alias("ref_id"), F.col("team1").alias("a"), F.col("team2").alias("b"), winner.alias("winner"), day.cast("string").alias("start"))


def reference_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, named, aliases = _named(spark, sf_dir)
    flags = audit.reference_check(m, _reference(named), aliases)[0]
    return flags.groupBy("flag", "severity").agg(F.count("*").alias("n"), F.sum("match_id").alias("ids"))


def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, named, aliases = _named(spark, sf_dir)
    return audit.reference_check(m, _reference(named), aliases)[1]


SINCE = "1996-06-01"


def _kept_by_hand(named: DataFrame) -> DataFrame:
    """Results kept by hand: winner and loser without a day, some of them unknown names."""
    return named.select(F.col("match_id").alias("row_id"), F.col("winner"), F.when(F.col("bo_type") == 1, F.concat(F.col("loser"), F.lit("?"))).otherwise(F.col("loser")).alias("loser"), F.coalesce("tier", F.lit("none")).alias("event"))


def csv_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, named, aliases = _named(spark, sf_dir)
    return audit.csv_check(m, _kept_by_hand(named), aliases, SINCE)[1]


def csv_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, named, aliases = _named(spark, sf_dir)
    flags = audit.csv_check(m, _kept_by_hand(named), aliases, SINCE)[0]
    return flags.groupBy("flag", "severity").agg(F.count("*").alias("n"), F.sum("match_id").alias("ids"))


def promoted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consumer view by the join on the audit's flags."""
    m = cut(judged(spark, sf_dir))
    view = quarantine.consumer_view(m, audit.promotions(m))
    return view.select("match_id", "bo_type", "team1_score", "team2_score", "winner_team_id", "quarantine_reason")


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that have to add up, and whether they do."""
    m = cut(judged(spark, sf_dir))
    n = m.count()
    ok, wrong = quarantine.reconcile(m, n, n, True, m.select("match_id").distinct().count())
    return quarantine.quarantine_counts(m).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("quarantine_reason").isNull(), F.col("n"))).alias("clean")).select("total", "clean", F.lit(ok).alias("ok"), F.lit(len(wrong)).alias("failures"))


def _books(spark: SparkSession, sf_dir: str, least: float | None) -> DataFrame:
    """Purchases as matches of two labels, views and clicks as two-sided snapshots, every third the other way round; users share PAIRS pairs."""
    e = _table(spark, sf_dir, "events").withColumn("pair", F.col("user_id") % PAIRS)
    label = lambda c: F.concat(F.lit(" U"), F.col("pair").cast("string"), F.lit(c))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    m = e.where("event_type = 'purchase'").select(F.col("event_id").alias("match_key"), F.concat(F.lit("U"), F.col("pair"), F.lit("A")).alias("a"), F.concat(F.lit("U"), F.col("pair"), F.lit("B")).alias("b"), iso.alias("start"))
    turned, price = F.col("event_id") % 3 == 0, F.col("value") / (F.col("value") + 100)
    outcomes = F.when(turned, F.array(label("b"), label("a"))).otherwise(F.array(label("a"), label("b")))
    prices = F.when(turned, F.array(1 - price, price)).otherwise(F.array(price, 1 - price))
    s = e.where("event_type IN ('view', 'click')").select(F.col("event_id").alias("ordinal"), iso.alias("ts"), F.concat(F.lit("s"), F.col("event_id")).alias("slug"), outcomes.alias("outcomes"), prices.alias("prices"), F.col("value").alias("volume"))
    known = {f"u{i}{c.lower()}": f"U{i}{c}" for i in range(PAIRS) for c in "AB"}
    return asof.closing_prices(m, s, known, least).select("match_key", F.round("p_a", 8).alias("p_a"), "flagged", "slug")


#: Pairs of labels of the closing-price queries.
PAIRS = 20


def closing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir, 50.0)


def closing_prices_older_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir, None)


def inside_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window matches between teams that their event's best teams have met."""
    m, ev = _universe(spark, sf_dir)
    bits = events.numbered(ev)
    w = cut(events.window_masks(bits, m.select("match_id", "team1_id", "team2_id", "start_ts"), MONTHS))
    best = events.participants(ev, m.where("tier = 's'"))
    held = events.inside_masks(w, events.expand_masks(bits, best, w, 1)).select("word", "mask", "match_id")
    return events.unmasked(held, bits).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("match_id").alias("ids"))


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m, ev = _universe(spark, sf_dir)
    own = m.join(ev.select("tournament_id"), "tournament_id", "left_semi").where("team2_id IS NOT NULL").withColumn("event_id", F.col("tournament_id"))
    seen = cut(events.team_windows(ev, m, MONTHS).drop("tiers"))
    rated = lambda k: seen.select("event_id", "team", (1000.0 + F.col("team") % k).alias("rating"))
    return grading.walk_forward(own, rated(97), rated(89), seen, 40)


def walk_forward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _walked(spark, sf_dir)[0]
    return graded.select("event_id", "match_id", "result", *(F.round(c, 8).alias(c) for c in ("p_cand", "p_inc", "brier_cand", "brier_inc", "delta_brier", "delta_log")))


def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.event_summaries(*map(cut, _walked(spark, sf_dir)), 0.6)
    return out.select("event_id", "n_graded", "n_skipped", "excluded", *(F.round(c, 8).alias(c) for c in ("coverage", "mean_delta_brier", "mean_delta_log")))


def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each priority's monthly counts and greatest sums change."""
    o = _table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    rows = o.groupBy("o_orderpriority", "month").agg(F.count("*").alias("n"), F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return latest.version_deltas(rows, ["o_orderpriority"], "month", ["n", "cents"])


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of named sides, with prices of every customer against the next and prices as closes."""
    c = _table(spark, sf_dir, "customer")
    o = _table(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    results = o.select(F.col("o_orderkey").alias("match_key"), name(F.col("o_custkey")).alias("a"), name(F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("b"), name(F.col("o_custkey") + F.when(F.col("o_orderstatus") == "F", 0).otherwise(1 + F.col("o_orderkey") % 3)).alias("winner"))
    keys = c.select("c_custkey", "c_acctbal").unionByName(c.select((F.col("c_custkey") + 100_000_000).alias("c_custkey"), "c_acctbal"))
    overrides = c.select(name(F.col("c_custkey")).alias("a"), name(F.col("c_custkey") + 1).alias("b"), (0.25 + (F.col("c_custkey") % 50) / 100.0).alias("p"))
    ratings = keys.select(name(F.col("c_custkey")).alias("team"), (1000 + F.col("c_acctbal") / 50).alias("rating"))
    held = results.join(ratings.select(F.col("team").alias("b")), "b", "left_semi").join(ratings.select(F.col("team").alias("a")), "a", "left_semi")
    closes = o.select(F.col("o_orderkey").alias("match_key"), F.when(F.col("o_orderkey") % 4 != 0, 0.2 + (F.col("o_orderkey") % 60) / 100.0).alias("p_a"), (F.col("o_orderkey") % 5 == 0).alias("flagged"))
    return grading.forecast_rows(held, overrides, ratings, closes)


def forecast_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    prov = F.create_map(F.lit("code_dirty"), F.lit("false"), F.lit("reconstruction_mode"), F.lit("immutable_forecast"), F.lit("code_sha"), F.lit("abc"))
    g = grading.grade_matches(_forecasts(spark, sf_dir).withColumn("provenance", prov))
    return g.select("match_key", "result", "adoption_eligible", *(F.round(c, 8).alias(c) for c in ("market_prob", "model_prob", "brier_model", "log_model", "brier_market", "delta_brier")))


def log_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy in which some are lost, some are new and some have another status or no sum."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    k = F.col("o_orderkey")
    other = o.where(k % 10 != 3).select(F.when(k % 10 == 4, -k - 1).otherwise(k).alias("o_orderkey"), F.when(k % 10 == 5, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 10 == 6, None).otherwise(F.col("o_custkey")).alias("o_custkey"))
    found = grading.differences(o, other, ["o_orderkey"], ["o_orderstatus", "o_custkey"])
    return found.select("o_orderkey", "field", F.col("found").alias("was"), F.col("committed").alias("held"))


def team_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as teams with a forecast table, their orders' counts as final records."""
    records = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    results = records.select(F.col("o_custkey").cast("string").alias("team"), F.when(F.col("k") % 2 == 0, 3).otherwise(F.col("k") % 3).cast("int").alias("wins"), F.when(F.col("k") % 2 == 0, F.col("k") % 3).otherwise(3).cast("int").alias("losses"))
    table = records.select(F.col("o_custkey").cast("string").alias("team"), *((0.05 + (F.col("o_custkey") % m) / 50.0).alias(c) for c, m in (("p30", 7), ("padv", 23), ("p03", 11))))
    return grading.grade_teams(grading.team_rows(table, results)).select("team", "wins", "losses", *(F.round(f"{c}_brier", 8).alias(f"{c}_brier") for c in ("p30", "padv", "p03")))


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of a nation's balances and the envelope of an estimate."""
    c = _table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    found = scan.rank_quantiles(c, ["c_nationkey"], "c_acctbal", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    means = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    low, high = S.envelope(F.col("m") / 10_000, F.col("m") / 10_000 - 0.001, F.col("m") / 10_000 + 0.02)
    return means.join(found, "c_nationkey", "left").select("c_nationkey", "p10", "p50", "p99", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions: short identities, intervals, days of stamps and lists held as JSON."""
    o = _table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    share = F.col("o_custkey") % 100 / 100.0
    listed = S.string_array(F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", "'), F.col("o_orderstatus"), F.lit('"]')))
    return o.select("o_orderkey", S.short_sha(F.col("o_orderpriority").cast("binary")).alias("sha"), S.interval_text(share, share / 3, share + 0.25).alias("interval_text"), F.substring(stamp, 1, 10).alias("start_day"), S.utc(stamp).alias("start_utc"), F.element_at(listed, 2).alias("second_item"), F.round(S.normalized(F.array(share, F.lit(0.5)))[0], 8).alias("fair"))


def fit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of the rating fit over all matches as one event, weighted by age and format."""
    from .plans import ratings

    m = consumed(spark, sf_dir).where("team2_id IS NOT NULL AND team1_id <> team2_id")
    first = F.col("winner_team_id") == F.col("team1_id")
    sides = m.select(F.lit(1).cast("long").alias("event_id"), F.when(first, F.col("team1_id")).otherwise(F.col("team2_id")).alias("winner"), F.when(first, F.col("team2_id")).otherwise(F.col("team1_id")).alias("loser"), S.age_days("start_ts", F.lit("2001-01-01 00:00:00").cast("timestamp")).alias("age_days"), "bo_type")
    config = {"data_prep": {"weighting": {"scheme": "weighted", "half_life_days": 365, "bo1_discount": 0.5}}}
    pairs = ratings.pair_sums(sides, {"c": config}).select("event_id", "winner", "loser", F.col("weights")["c"].alias("weight"))
    found = ratings.fit_steps(pairs, 1000.0, 50.0, 3, 100.0)
    return found.select(F.col("team").cast("string").alias("team"), F.round("rating", 6).alias("rating"))


def market_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listed markets between regions, some listed again: the anchors of those that are liquid, two-sided and not settled."""
    from .sources.files import anchor_rows, market_snapshot

    names = {r[0]: r[1] for r in _table(spark, sf_dir, "region").collect()}  # five rows
    label = lambda i: F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), i)
    k, price = F.col("p_partkey"), F.format_string("%.2f", F.col("p_size") / 50.0)
    first = (k % 5).cast("int")
    outcomes = F.when(k % 11 == 0, F.concat(F.lit('["'), label(first), F.lit('"]'))).otherwise(F.concat(F.lit('["'), label(first), F.lit('", "'), label((first + 1) % 5), F.lit('"]')))
    listed = _table(spark, sf_dir, "part").select((k % 2).cast("int").alias("pass"), F.floor(k / 7).cast("int").alias("page"), (k % 7).cast("int").alias("position"), F.concat(F.lit("part: "), F.col("p_name"), F.lit(" of "), F.col("p_type")).alias("question"), F.concat(F.lit("s"), F.floor(k / 3)).alias("slug"), outcomes.alias("outcomes"), F.concat(F.lit('["'), price, F.lit('", "0.50"]')).alias("prices"), F.col("p_retailprice").cast("string").alias("volume"), F.lit(None).cast("string").alias("liquidity"), F.lit("1").alias("end_date"))
    snapshot = market_snapshot(listed, ["part", "widget"], "2026-01-01T00:00:00Z")
    return anchor_rows(snapshot, {v.lower(): v for v in names.values()}, 950.0, 0.6)


def bracket_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of eight rated teams to get through an exact bracket, its final a best-of-five."""
    from .plans import bracket

    event, ratings = _event(spark, sf_dir)
    branches = bracket.branch_probs(event.teams[:8], bracket.bracket_prob(ratings))
    return bracket.reach(spark, event.teams[:8], branches).select("team", *(F.round(c, 8).alias(c) for c in ("sf", "final", "champ")))


def _event(spark: SparkSession, sf_dir: str):
    from .plans import swiss

    rows = _table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_acctbal").limit(16).collect()  # an event has sixteen
    teams = tuple(f"team{r[0]}" for r in rows)
    ratings = {t: 1000 + r[1] / 50 for t, r in zip(teams, rows, strict=True)}
    return swiss.Event(teams, tuple(zip(teams[:8], teams[8:], strict=True)), {t: i + 1 for i, t in enumerate(teams)}), ratings


def swiss_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import swiss

    event, ratings = _event(spark, sf_dir)
    return swiss.statistics(swiss.simulate(spark, event, {"base": ratings}, 4000, 11), event)


def best_slates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import slates, swiss

    event, ratings = _event(spark, sf_dir)
    flat = {t: 1000 + (r - 1000) / 2 for t, r in ratings.items()}
    sims = swiss.simulate(spark, event, {"base": ratings, "flat": flat}, 2000, 11).cache()
    return slates.sensitivity(sims, event, "base")


def bracket_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import bracket

    event, ratings = _event(spark, sf_dir)
    draws = [(i, {t: r + (i - 100) / 10 * (k % 3 - 1) for k, (t, r) in enumerate(ratings.items())}) for i in range(200)]
    ranked = bracket.rank_picks(spark.createDataFrame(draws, "draw long, ratings map<string,double>"), event.teams[:8])
    return ranked.drop("values")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        asof_close, calibration_summary, quarantine_reasons, promotion_flags, consumer_rows, impossible_scan, tier_divergence, latest_attributes, last_wins, superseding_log, contiguity, json_contract, unordered_pairs, stale_references,
        event_universe, event_splits, window_counts, hop_universe, modal_tiers, leave_one_out_priors, rating_scores, gradient_step, alias_lookup, calendar, paired_summaries, fitted_ratings, swiss_statistics, best_slates, bracket_picks,
        reference_flags, reference_coverage, csv_outcomes, csv_flags, promoted_view, reconciliation, closing_prices, closing_prices_older_rule, inside_universe, walk_forward_rows, event_coverage, version_changes, forecast_grades, log_differences,
        team_grades, quantiles, texts, fit_steps, bracket_reach, market_anchors,
    )
    return {f.__name__: f for f in own}


UNIVERSE_SQL = f"SELECT tournament_id, MAX(tier) AS tier, COUNT(*) AS n, MIN(start_ts) AS boundary, MAX(start_ts) AS last_start FROM ({CONSUMED_SQL}) c GROUP BY tournament_id HAVING MAX(tier) IN ('s','a') AND COUNT(*) >= 8"
WINDOW_SQL = f"SELECT c.*, u.tournament_id AS event_id, u.boundary FROM ({CONSUMED_SQL}) c JOIN ({UNIVERSE_SQL}) u ON c.start_ts >= CAST(u.boundary AS DATE) - INTERVAL {MONTHS} MONTH AND c.start_ts < u.boundary"
GRADED_SQL = f"""
SELECT *, (mp - y) * (mp - y) AS bm, -(y * ln(mp) + (1 - y) * ln(1 - mp)) AS lm, (cp - y) * (cp - y) AS bk, -(y * ln(cp) + (1 - y) * ln(1 - cp)) AS lk,
  event_id % 7 <> 0 AND event_id % 5 <> 0 AS man FROM (SELECT *, 0.5 + (coalesce(cp, 0.5) - 0.5) * 0.8 AS mp, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS y FROM (
    SELECT event_id, value / (value + 100) AS cp, coalesce(flagged, false) AS flagged FROM ({CLOSE_SQL}) z) a) b
"""


#: Sides by name, winner and loser, and the day of each match that has both.
NAMED_SQL = f"""SELECT m.*, CAST(start_ts AS DATE) AS d, least(team1_id, team2_id) AS lo, greatest(team1_id, team2_id) AS hi, CASE WHEN winner_team_id = team1_id THEN team2_id ELSE team1_id END AS loser_id FROM ({REASON_SQL}) m WHERE team1_id IS NOT NULL AND team2_id IS NOT NULL"""
REFERENCE_SQL = f"""
SELECT r.match_id AS ref_id, r.team1_id, r.team2_id, r.w, COUNT(x.match_id) AS n, arg_min(x.winner_team_id, x.match_id) AS got, MIN(x.match_id) AS mid
FROM (SELECT *, CASE WHEN bo_type = 5 THEN loser_id ELSE winner_team_id END AS w, CASE WHEN bo_type = 1 THEN d + 1 ELSE d END AS day FROM ({NAMED_SQL}) a) r
LEFT JOIN ({NAMED_SQL}) x ON x.lo = r.lo AND x.hi = r.hi AND x.d = r.day GROUP BY ALL
"""
BY_HAND_SQL = f"""
SELECT r.match_id AS row_id, r.winner_team_id AS w, CASE WHEN r.bo_type = 1 THEN NULL ELSE r.loser_id END AS l, COUNT(x.match_id) AS n, COUNT(x.match_id) FILTER (WHERE x.quarantine_reason IS NULL) AS good,
 arg_min(x.winner_team_id, x.match_id) FILTER (WHERE x.quarantine_reason IS NULL) AS got, MIN(x.match_id) FILTER (WHERE x.quarantine_reason IS NULL) AS mid,
 COUNT(x.match_id) FILTER (WHERE x.quarantine_reason IS NOT NULL) AS held, CAST(SUM(x.match_id) FILTER (WHERE x.quarantine_reason IS NOT NULL) AS BIGINT) AS held_ids
FROM ({NAMED_SQL}) r LEFT JOIN (SELECT * FROM ({NAMED_SQL}) y WHERE start_ts >= TIMESTAMP '{SINCE}') x ON x.lo = r.lo AND x.hi = r.hi AND r.bo_type <> 1 GROUP BY ALL
"""
OUTCOME_SQL = f"SELECT *, CASE WHEN l IS NULL THEN 'unresolvable' WHEN n = 0 THEN 'unmatched' WHEN good > 1 THEN 'ambiguous' WHEN good = 1 AND got IS DISTINCT FROM w THEN 'mismatch' WHEN good = 1 THEN 'verified' ELSE 'quarantined' END AS outcome FROM ({BY_HAND_SQL}) z"


def _book_sql(floor: str, tie: str) -> str:
    """tie: of snapshots of one time the order of reading."""
    return f"""
WITH s AS (SELECT event_id AS ordinal, user_id % {PAIRS} AS pair, ts, 's' || event_id AS slug, value / (value + 100) AS p_a FROM events WHERE event_type IN ('view','click') {floor}),
c AS (SELECT m.event_id AS match_key, s.*, s.ts < m.ts AS pre FROM events m JOIN s ON s.pair = m.user_id % {PAIRS} WHERE m.event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY CASE WHEN pre THEN 0 ELSE 1 END, CASE WHEN pre THEN ts END DESC, CASE WHEN NOT pre THEN ts END, {tie}) AS rn FROM c)
SELECT m.event_id AS match_key, round(r.p_a, 8) AS p_a, coalesce(NOT r.pre, false) AS flagged, r.slug FROM events m LEFT JOIN r ON r.match_key = m.event_id AND r.rn = 1 WHERE m.event_type = 'purchase'"""


WALK_SQL = f"""
WITH w AS (SELECT * FROM ({WINDOW_SQL}) x), t AS (SELECT event_id, team, COUNT(*) AS n FROM (SELECT event_id, unnest([team1_id, team2_id]) AS team FROM w) y GROUP BY ALL),
o AS (SELECT c.*, c.tournament_id AS event_id FROM ({CONSUMED_SQL}) c WHERE team2_id IS NOT NULL AND tournament_id IN (SELECT tournament_id FROM ({UNIVERSE_SQL}) u)),
j AS (SELECT o.*, coalesce(a.n, 0) >= 40 AND coalesce(b.n, 0) >= 40 AS ok, 1 / (1 + pow(10.0, ((team2_id % 97) - (team1_id % 97)) / 400.0)) AS pc, 1 / (1 + pow(10.0, ((team2_id % 89) - (team1_id % 89)) / 400.0)) AS pi, CASE WHEN winner_team_id = team1_id THEN 1.0 ELSE 0.0 END AS y
  FROM o LEFT JOIN t a ON a.event_id = o.event_id AND a.team = o.team1_id LEFT JOIN t b ON b.event_id = o.event_id AND b.team = o.team2_id),
g AS (SELECT *, (pc - y) * (pc - y) AS bc, (pi - y) * (pi - y) AS bi, -(y * ln(pc) + (1 - y) * ln(1 - pc)) + (y * ln(pi) + (1 - y) * ln(1 - pi)) AS dl FROM j)
"""
FIT_SQL = f"""
WITH m AS (SELECT winner_team_id AS w, CASE WHEN winner_team_id = team1_id THEN team2_id ELSE team1_id END AS l, pow(0.5, epoch(TIMESTAMP '2001-01-01' - start_ts) / 86400.0 / 365) * CASE WHEN bo_type = 1 THEN 0.5 ELSE 1.0 END AS k FROM ({CONSUMED_SQL}) c WHERE team2_id IS NOT NULL AND team1_id <> team2_id),
r0 AS (SELECT t, CAST(1000 AS DOUBLE) AS r FROM (SELECT w AS t FROM m UNION SELECT l FROM m) x),
""" + ",\n".join(f"""g{i} AS (SELECT t, SUM(s) AS g FROM (SELECT w AS t, k * (1 - 1 / (1 + pow(10.0, (b.r - a.r) / 400))) * ln(10) / 400 AS s FROM m JOIN r{i} a ON a.t = w JOIN r{i} b ON b.t = l
  UNION ALL SELECT l, -k * (1 - 1 / (1 + pow(10.0, (b.r - a.r) / 400))) * ln(10) / 400 FROM m JOIN r{i} a ON a.t = w JOIN r{i} b ON b.t = l) z GROUP BY t),
r{i + 1} AS (SELECT r.t, r.r + 100.0 * (g.g - (r.r - 1000) / 2500) AS r FROM r{i} r JOIN g{i} g ON g.t = r.t)""" for i in range(3)) + """
SELECT CAST(t AS VARCHAR) AS team, round(r + 1000 - (SELECT avg(r) FROM r3), 6) AS rating FROM r3
"""
#: Places 0 to 7 of the seeds; seat: quarter of the bracket, half: half of it.
REACH_SQL = """
WITH t AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, 'team' || c_custkey AS team, 1000 + c_acctbal / 50 AS r FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 8) c),
s AS (SELECT *, CASE WHEN i IN (0, 7) THEN 0 WHEN i IN (3, 4) THEN 1 WHEN i IN (1, 6) THEN 2 ELSE 3 END AS seat FROM t), h AS (SELECT *, seat // 2 AS half FROM s),
p AS (SELECT a.i AS a, b.i AS b, 1 / (1 + pow(10.0, (b.r - a.r) / 400)) AS p FROM t a JOIN t b ON a.i <> b.i),
f AS (SELECT a, b, q * q * q * (1 + 3 * (1 - q) + 6 * (1 - q) * (1 - q)) AS p FROM (SELECT a, b, 0.5 + sin(asin(2 * greatest(least(p, 1 - 1e-12), 1e-12) - 1) / 3) AS q FROM p) z),
q AS (SELECT x.i, x.half, x.seat, p.p AS c FROM h x JOIN h y ON x.seat = y.seat AND x.i <> y.i JOIN p ON p.a = x.i AND p.b = y.i),
e AS (SELECT x.i, x.half, x.c * SUM(y.c * p.p) AS c FROM q x JOIN q y ON x.half = y.half AND x.seat <> y.seat JOIN p ON p.a = x.i AND p.b = y.i GROUP BY x.i, x.half, x.c),
w AS (SELECT x.i, x.c * SUM(y.c * f.p) AS c FROM e x JOIN e y ON x.half <> y.half JOIN f ON f.a = x.i AND f.b = y.i GROUP BY x.i, x.c)
SELECT team, round(q.c, 8) AS sf, round(e.c, 8) AS final, round(w.c, 8) AS champ FROM t JOIN q ON q.i = t.i JOIN e ON e.i = t.i JOIN w ON w.i = t.i
"""


def oracle_sql() -> dict[str, str]:
    return {
        "asof_close": f"SELECT event_id, q_id, ROUND(value, 4) AS close_value, flagged FROM ({CLOSE_SQL}) c",
        "calibration_summary": f"""SELECT COUNT(*) FILTER (WHERE u) AS n, COUNT(*) FILTER (WHERE NOT flagged AND man) AS eligible_n, COUNT(*) FILTER (WHERE flagged) AS excluded_flagged_n, COUNT(*) FILTER (WHERE NOT flagged AND NOT man) AS excluded_unmanifested_n,
          ROUND(AVG(bm) FILTER (WHERE u), 8) AS model_brier, ROUND(AVG(lm) FILTER (WHERE u), 8) AS model_log, ROUND(AVG(bk) FILTER (WHERE u), 8) AS market_brier, ROUND(AVG(lk) FILTER (WHERE u), 8) AS market_log,
          ROUND(AVG(bk) FILTER (WHERE u) - AVG(bm) FILTER (WHERE u), 8) AS delta_brier, ROUND(AVG(lk) FILTER (WHERE u) - AVG(lm) FILTER (WHERE u), 8) AS delta_log
          FROM (SELECT *, man AND NOT flagged AS u FROM ({GRADED_SQL}) g WHERE cp IS NOT NULL) h""",
        "quarantine_reasons": f"SELECT quarantine_reason, COUNT(*) AS n FROM ({REASON_SQL}) r GROUP BY quarantine_reason",
        "promotion_flags": f"SELECT match_id, CASE WHEN ws >= 2 AND ws > ls THEN 'inferred_multi_map' ELSE 'forfeit_signature' END AS flag, 'report' AS severity FROM ({REASON_SQL}) r WHERE quarantine_reason = 'score_bo_mismatch'",
        "consumer_rows": f"SELECT match_id, bo_type, team1_id, team2_id, team1_score, team2_score, winner_team_id, tier, tournament_id, quarantine_reason FROM ({CONSUMED_SQL}) c",
        "impossible_scan": f"""WITH s AS (SELECT *, CAST(start_ts AS DATE) AS d FROM ({SCORED_SQL}) x), f AS (
          SELECT 'self_play' AS flag, 'fail' AS severity, match_id FROM s WHERE team1_id = team2_id UNION ALL SELECT 'negative_score', 'fail', match_id FROM s WHERE team1_score < 0 OR team2_score < 0
          UNION ALL SELECT 'date_order', 'report', match_id FROM s WHERE match_id % 11 = 0
          UNION ALL SELECT 'duplicate_pairing', 'report', s.match_id FROM s JOIN (SELECT least(team1_id, team2_id) AS lo, greatest(team1_id, team2_id) AS hi, d FROM s WHERE team1_id IS NOT NULL AND team2_id IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) > 1) g
            ON least(s.team1_id, s.team2_id) = g.lo AND greatest(s.team1_id, s.team2_id) = g.hi AND s.d = g.d WHERE s.team2_id IS NOT NULL)
          SELECT flag, severity, COUNT(*) AS n, CAST(SUM(match_id) AS BIGINT) AS ids FROM f GROUP BY flag, severity""",
        "tier_divergence": f"SELECT 'tier_divergence' AS flag, 'report' AS severity, tournament_id FROM ({SERIES_SQL}) s GROUP BY tournament_id HAVING MAX(tier) <> CASE WHEN tournament_id % 3 = 0 THEN 's' ELSE 'a' END",
        "latest_attributes": "SELECT user_id, event_type, value, day AS last_seen FROM (SELECT *, CAST(ts AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) e WHERE rn = 1",
        "last_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) e WHERE rn = 1",
        "superseding_log": "SELECT conv_id, role, turn, chars FROM (SELECT conv_id, role, turn, CAST(length(text) AS INTEGER) AS chars, ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC) AS rn FROM conversations) c WHERE rn = 1",
        "contiguity": "SELECT conv_id, bool_and(nxt IS NULL OR nxt = turn + 1) AND MIN(turn) = 0 AS contiguous, COUNT(*) AS n_rows FROM (SELECT conv_id, turn, LEAD(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations) d) c GROUP BY conv_id",
        "json_contract": "SELECT CAST(CASE WHEN list_contains(json_keys(props), 'k') THEN 0 ELSE 1 END AS BIGINT) AS missing, COUNT(*) AS n FROM events GROUP BY 1",
        "unordered_pairs": f"SELECT least(team1_id, team2_id) AS lo, greatest(team1_id, team2_id) AS hi, COUNT(*) AS n, MIN(match_id) AS first_id FROM ({SERIES_SQL}) s WHERE team1_id IS NOT NULL AND team2_id IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1",
        "stale_references": "SELECT tournament_id, fetched_at, CASE WHEN fetched_at > '1998-01-01' THEN 'stale' ELSE 'gone' END AS state FROM (SELECT o_custkey * 3 % 2003 AS tournament_id, strftime(MAX(o_orderdate), '%Y-%m-%d') AS fetched_at FROM orders GROUP BY 1) t WHERE tournament_id NOT IN (SELECT c_custkey FROM customer)",
        "event_universe": UNIVERSE_SQL,
        "event_splits": f"SELECT tournament_id, CASE WHEN last_start < TIMESTAMP '1996-01-15' THEN 'dev' WHEN boundary >= TIMESTAMP '1996-01-15' THEN 'holdout' ELSE 'straddler' END AS part FROM ({UNIVERSE_SQL}) u",
        "window_counts": f"SELECT event_id, COUNT(*) AS n, MIN(match_id) AS first_id, MAX(start_ts) AS last_start FROM ({WINDOW_SQL}) w GROUP BY event_id",
        "hop_universe": f"""WITH w AS (SELECT * FROM ({WINDOW_SQL}) x), e AS (SELECT event_id, team1_id AS a, team2_id AS b FROM w UNION SELECT event_id, team2_id, team1_id FROM w),
          h0 AS (SELECT DISTINCT tournament_id AS event_id, unnest([team1_id, team2_id]) AS t FROM ({CONSUMED_SQL}) c WHERE tournament_id IN (SELECT tournament_id FROM ({UNIVERSE_SQL}) u)),
          h1 AS (SELECT DISTINCT e.event_id, b AS t FROM e JOIN h0 ON e.event_id = h0.event_id AND e.a = h0.t WHERE b IS NOT NULL EXCEPT SELECT * FROM h0),
          h2 AS (SELECT DISTINCT e.event_id, b AS t FROM e JOIN h1 ON e.event_id = h1.event_id AND e.a = h1.t WHERE b IS NOT NULL EXCEPT (SELECT * FROM h0 UNION SELECT * FROM h1))
          SELECT event_id, CAST(hop AS INTEGER) AS hop, COUNT(*) AS n, CAST(SUM(t) AS BIGINT) AS teams FROM (SELECT *, 0 AS hop FROM h0 WHERE t IS NOT NULL UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) z GROUP BY event_id, hop""",
        "modal_tiers": f"""WITH s AS (SELECT event_id, unnest([team1_id, team2_id]) AS team, tier FROM ({WINDOW_SQL}) w), k AS (SELECT event_id, team, tier, COUNT(*) AS c FROM s WHERE tier IS NOT NULL GROUP BY ALL),
          m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, team ORDER BY c DESC, coalesce(list_position(['s','a','b','c','d'], tier), 9), tier) AS rn FROM k)
          SELECT t.event_id, t.team, t.n, m.tier AS modal_tier FROM (SELECT event_id, team, COUNT(*) AS n FROM s GROUP BY ALL) t LEFT JOIN m ON m.event_id = t.event_id AND m.team = t.team AND rn = 1""",
        "leave_one_out_priors": "SELECT c_custkey, ROUND(CASE WHEN k > 1 THEN (t - c_acctbal) / (k - 1) ELSE 1000.0 END, 6) AS prior FROM (SELECT *, SUM(c_acctbal) OVER (PARTITION BY c_nationkey, c_mktsegment) AS t, COUNT(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) c",
        "rating_scores": SCORES_SQL,
        "gradient_step": f"SELECT team, COUNT(*) AS n, ROUND(SUM(CASE WHEN team = winner_team_id THEN 1 ELSE -1 END) * (0.5 * 2000.0 * ln(10.0) / 400) + 1000, 6) AS rating FROM (SELECT unnest([team1_id, team2_id]) AS team, winner_team_id FROM ({CONSUMED_SQL}) c WHERE team2_id IS NOT NULL) s GROUP BY team",
        "alias_lookup": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN r_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "calendar": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 7 MONTH AS DATE) AS back, ROUND(epoch(TIMESTAMP '1999-01-01' - o_orderdate) / 86400.0, 6) AS age FROM orders",
        "paired_summaries": f"""SELECT CAST(month AS BIGINT) AS day, COUNT(*) FILTER (WHERE e) AS n_graded, COUNT(*) FILTER (WHERE NOT e) AS n_skipped, ROUND(AVG(bk - bm) FILTER (WHERE e), 8) AS mean_delta_brier, ROUND(CAST(COUNT(*) FILTER (WHERE e) AS DOUBLE) / COUNT(*), 8) AS coverage,
          CAST(COUNT(*) FILTER (WHERE e) AS DOUBLE) / COUNT(*) < 0.68 AS excluded FROM (SELECT g.*, cp IS NOT NULL AND NOT g.flagged AND man AS e, EXTRACT(DAY FROM ts) AS month FROM ({GRADED_SQL}) g JOIN events v ON v.event_id = g.event_id) h GROUP BY month""",
        "reference_flags": f"""SELECT CASE WHEN n = 0 THEN 'reference_missing' WHEN n > 1 THEN 'reference_ambiguous' ELSE 'orientation_mismatch' END AS flag, 'fail' AS severity, COUNT(*) AS n, CAST(SUM(CASE WHEN n = 1 THEN mid END) AS BIGINT) AS ids
          FROM ({REFERENCE_SQL}) r WHERE n <> 1 OR got IS DISTINCT FROM w GROUP BY 1""",
        "reference_coverage": f"SELECT s_name AS name, COUNT(*) AS expected, COUNT(*) FILTER (WHERE n > 0) AS found FROM (SELECT unnest([team1_id, team2_id]) AS t, n FROM ({REFERENCE_SQL}) r) z JOIN supplier ON s_suppkey = t GROUP BY s_name",
        "csv_outcomes": f"SELECT outcome, CAST(SUM(CASE WHEN outcome = 'quarantined' THEN held ELSE 1 END) AS BIGINT) AS n FROM ({OUTCOME_SQL}) o GROUP BY outcome",
        "csv_flags": f"""SELECT 'csv_row_unmatched' AS flag, 'fail' AS severity, COUNT(*) AS n, CAST(NULL AS BIGINT) AS ids FROM ({OUTCOME_SQL}) o WHERE outcome = 'unmatched' HAVING COUNT(*) > 0
          UNION ALL SELECT 'csv_ambiguous', 'report', COUNT(*), NULL FROM ({OUTCOME_SQL}) o WHERE outcome = 'ambiguous' HAVING COUNT(*) > 0
          UNION ALL SELECT 'csv_orientation_mismatch', 'fail', COUNT(*), CAST(SUM(mid) AS BIGINT) FROM ({OUTCOME_SQL}) o WHERE outcome = 'mismatch' HAVING COUNT(*) > 0
          UNION ALL SELECT 'csv_match_quarantined', 'report', CAST(SUM(held) AS BIGINT), CAST(SUM(held_ids) AS BIGINT) FROM ({OUTCOME_SQL}) o WHERE outcome = 'quarantined' HAVING COUNT(*) > 0""",
        "promoted_view": f"SELECT match_id, bo_type, team1_score, team2_score, winner_team_id, quarantine_reason FROM ({CONSUMED_SQL}) c",
        "reconciliation": f"SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE quarantine_reason IS NULL) AS clean, COUNT(*) FILTER (WHERE quarantine_reason = 'bo2_draw') > 0 AND COUNT(quarantine_reason) / COUNT(*) <= {quarantine.MOST_QUARANTINED} AS ok, CAST(CASE WHEN COUNT(*) FILTER (WHERE quarantine_reason = 'bo2_draw') > 0 THEN 0 ELSE 1 END + CASE WHEN COUNT(quarantine_reason) / COUNT(*) <= {quarantine.MOST_QUARANTINED} THEN 0 ELSE 1 END AS INTEGER) AS failures FROM ({REASON_SQL}) r",
        "closing_prices": _book_sql("AND value >= 50.0", "CASE WHEN pre THEN -ordinal ELSE ordinal END"),
        "closing_prices_older_rule": _book_sql("", "CASE WHEN pre THEN -p_a ELSE p_a END, CASE WHEN pre THEN -ordinal ELSE ordinal END"),
        "inside_universe": f"""WITH w AS (SELECT * FROM ({WINDOW_SQL}) x), e AS (SELECT event_id, team1_id AS a, team2_id AS b FROM w UNION SELECT event_id, team2_id, team1_id FROM w),
          h AS (SELECT DISTINCT tournament_id AS event_id, unnest([team1_id, team2_id]) AS t FROM ({CONSUMED_SQL}) c WHERE tier = 's' AND tournament_id IN (SELECT tournament_id FROM ({UNIVERSE_SQL}) u)),
          v AS (SELECT * FROM h WHERE t IS NOT NULL UNION SELECT e.event_id, b FROM e JOIN h ON e.event_id = h.event_id AND e.a = h.t WHERE b IS NOT NULL)
          SELECT w.event_id, COUNT(*) AS n, CAST(SUM(match_id) AS BIGINT) AS ids FROM w JOIN v a ON a.event_id = w.event_id AND a.t = w.team1_id JOIN v b ON b.event_id = w.event_id AND b.t = w.team2_id GROUP BY w.event_id""",
        "walk_forward_rows": f"{WALK_SQL} SELECT event_id, match_id, y AS result, round(pc, 8) AS p_cand, round(pi, 8) AS p_inc, round(bc, 8) AS brier_cand, round(bi, 8) AS brier_inc, round(bc - bi, 8) AS delta_brier, round(dl, 8) AS delta_log FROM g WHERE ok",
        "event_coverage": f"{WALK_SQL} SELECT event_id, COUNT(*) FILTER (WHERE ok) AS n_graded, COUNT(*) FILTER (WHERE NOT ok) AS n_skipped, COUNT(*) FILTER (WHERE ok) / COUNT(*) < 0.6 AS excluded, round(COUNT(*) FILTER (WHERE ok) / COUNT(*), 8) AS coverage, round(AVG(bc - bi) FILTER (WHERE ok), 8) AS mean_delta_brier, round(AVG(dl) FILTER (WHERE ok), 8) AS mean_delta_log FROM g GROUP BY event_id",
        "version_changes": """SELECT o_orderpriority, month, previous, n - n0 AS n_change, cents - cents0 AS cents_change FROM (SELECT *, lag(month) OVER w AS previous, lag(n) OVER w AS n0, lag(cents) OVER w AS cents0 FROM (
          SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n, MAX(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL) a WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)) b WHERE previous IS NOT NULL""",
        "forecast_grades": """WITH r AS (SELECT o_orderkey AS k, o_custkey AS a, o_custkey + 1 + o_orderkey % 3 AS b, o_orderstatus = 'F' AS won FROM orders),
          j AS (SELECT k, CASE WHEN won THEN 1.0 ELSE 0.0 END AS y, CASE WHEN b = a + 1 THEN 0.25 + (a % 50) / 100.0 END AS mk, 1 / (1 + pow(10.0, (y.c_acctbal / 50 - x.c_acctbal / 50) / 400)) AS md, CASE WHEN k % 4 <> 0 THEN 0.2 + (k % 60) / 100.0 END AS cp, k % 5 = 0 AS fl FROM r JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b),
          g AS (SELECT *, coalesce(mk, md) AS p FROM j)
          SELECT k AS match_key, y AS result, cp IS NOT NULL AND NOT fl AS adoption_eligible, round(mk, 8) AS market_prob, round(p, 8) AS model_prob, round((p - y) * (p - y), 8) AS brier_model,
            round(-(y * ln(greatest(least(p, 1 - 1e-9), 1e-9)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-9), 1e-9))), 8) AS log_model, round((cp - y) * (cp - y), 8) AS brier_market, round((cp - y) * (cp - y) - (p - y) * (p - y), 8) AS delta_brier FROM g""",
        "log_differences": """WITH c AS (SELECT CASE WHEN o_orderkey % 10 = 4 THEN -o_orderkey - 1 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 10 = 6 THEN NULL ELSE o_custkey END AS u FROM orders WHERE o_orderkey % 10 <> 3),
          b AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, o.o_orderkey IS NULL AS no_new, c.k IS NULL AS no_old, o.o_orderstatus, s, o.o_custkey, u FROM orders o FULL JOIN c ON o.o_orderkey = c.k)
          SELECT o_orderkey, 'row' AS field, CASE WHEN no_new THEN NULL ELSE 'there' END AS was, CASE WHEN no_old THEN NULL ELSE 'there' END AS held FROM b WHERE no_new OR no_old
          UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, s FROM b WHERE NOT no_new AND NOT no_old AND o_orderstatus IS DISTINCT FROM s
          UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(u AS VARCHAR) FROM b WHERE NOT no_new AND NOT no_old AND o_custkey IS DISTINCT FROM u""",
        "team_grades": """WITH k AS (SELECT o_custkey AS t, COUNT(*) AS k FROM orders GROUP BY o_custkey), r AS (SELECT t, CAST(CASE WHEN k % 2 = 0 THEN 3 ELSE k % 3 END AS INTEGER) AS wins, CAST(CASE WHEN k % 2 = 0 THEN k % 3 ELSE 3 END AS INTEGER) AS losses, 0.05 + (t % 7) / 50.0 AS a, 0.05 + (t % 23) / 50.0 AS b, 0.05 + (t % 11) / 50.0 AS c FROM k)
          SELECT CAST(t AS VARCHAR) AS team, wins, losses, round(pow(a - CASE WHEN wins = 3 AND losses = 0 THEN 1 ELSE 0 END, 2), 8) AS p30_brier, round(pow(b - CASE WHEN wins = 3 AND losses IN (1, 2) THEN 1 ELSE 0 END, 2), 8) AS padv_brier, round(pow(c - CASE WHEN wins = 0 AND losses = 3 THEN 1 ELSE 0 END, 2), 8) AS p03_brier FROM r""",
        "quantiles": """SELECT c_nationkey, v[least(CAST(floor(0.1 * n) AS INTEGER), n - 1) + 1] AS p10, v[least(CAST(floor(0.5 * n) AS INTEGER), n - 1) + 1] AS p50, v[least(CAST(floor(0.99 * n) AS INTEGER), n - 1) + 1] AS p99,
          round(greatest(0.0, least(m / 10000 - 0.001, m / 10000 - 0.003)), 8) AS low, round(least(1.0, greatest(m / 10000 + 0.02, m / 10000 + 0.003)), 8) AS high FROM (SELECT c_nationkey, list_sort(list(c_acctbal)) AS v, CAST(COUNT(*) AS INTEGER) AS n, AVG(c_acctbal) AS m FROM customer GROUP BY c_nationkey) c""",
        "texts": """SELECT o_orderkey, substr(sha1(o_orderpriority), 1, 12) AS sha, printf('%.2f [%.2f-%.2f]', s, s / 3, s + 0.25) AS interval_text, strftime(o_orderdate, '%Y-%m-%d') AS start_day, o_orderdate - INTERVAL 2 HOUR AS start_utc, o_orderstatus AS second_item, round(s / (s + 0.5), 8) AS fair FROM (SELECT *, o_custkey % 100 / 100.0 AS s FROM orders) o""",
        "fit_steps": FIT_SQL,
        "bracket_reach": REACH_SQL,
        "market_anchors": """WITH l AS (SELECT *, p_partkey % 2 AS pass, p_partkey // 7 AS page, p_partkey % 7 AS pos, 's' || (p_partkey // 3) AS slug FROM part WHERE 'part: ' || p_name || ' of ' || p_type LIKE '%widget%'),
          f AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pass, page, pos) AS rn, CAST(printf('%.2f', p_size / 50.0) AS DOUBLE) AS x FROM l)
          SELECT a.r_name AS a, b.r_name AS b, round(x / (x + 0.5), 4) AS p, slug, CAST(round(p_retailprice) AS BIGINT) AS volume FROM f JOIN region a ON a.r_regionkey = p_partkey % 5 JOIN region b ON b.r_regionkey = (p_partkey % 5 + 1) % 5
          WHERE rn = 1 AND p_partkey % 11 <> 0 AND p_retailprice >= 950 AND greatest(x, 0.5) / (x + 0.5) <= 0.6""",
    }
