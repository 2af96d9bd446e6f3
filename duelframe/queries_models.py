"""More queries with SQL: verdicts, evidence, posteriors, standings, slates, archives and snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .operators import audit, events, grading, standings
from .plans import posterior, ratings, slates
from .session import cut, stored
from .sources import archive

#: The age at which a match counts half, and the day that ages end on.
HALF_LIFE, TODAY = 365.0, "2001-01-01"
AGED = {"data_prep": {"weighting": {"scheme": "weighted", "half_life_days": HALF_LIFE, "bo1_discount": 0.5}}}


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.event_summaries(*map(cut, Q._walked(spark, sf_dir)), 0.6)
    return out.where("NOT excluded").withColumn("family", F.floor(F.col("event_id") / 100).cast("long"))


def family_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as families of events: paired statistics, t intervals and verdicts, all as columns."""
    found = grading.verdicts(grading.paired_families(_summaries(spark, sf_dir), ["family"]), 0.0005, 8, objective_ok=F.col("family") % 2 == 0, split=F.when(F.col("family") < 1998, "dev").otherwise("holdout"))
    return found.select("family", "n_events", "verdict", *(F.round(c, 8).alias(c) for c in ("mean", "se", "t_crit", "ci_low", "ci_high")))


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of both forecasts and of a constant one, by event."""
    found = grading.evidence(Q._walked(spark, sf_dir)[0], {"uniform": 0.5}, ["event_id"])
    return found.select("event_id", "who", "n", F.round("brier", 8).alias("brier"), F.round("log", 8).alias("log"))


def _pairs(spark: SparkSession, sf_dir: str, by_event: bool) -> DataFrame:
    """Consumer matches summed up by winner and loser, weighted by age and format."""
    first = F.col("winner_team_id") == F.col("team1_id")
    m = Q.consumed(spark, sf_dir).where("team2_id IS NOT NULL AND team1_id <> team2_id")
    key = F.col("tournament_id") if by_event else F.lit(0).cast("long")
    sided = m.select(key.alias("event_id"), F.when(first, F.col("team1_id")).otherwise(F.col("team2_id")).alias("winner"), F.when(first, F.col("team2_id")).otherwise(F.col("team1_id")).alias("loser"), Q.S.age_days("start_ts", F.lit(TODAY).cast("timestamp")).alias("age_days"), "bo_type")
    return ratings.pair_sums(sided, {"c": AGED}).select("event_id", "winner", "loser", F.col("weights")["c"].alias("weight"))


def _rated(pairs: DataFrame) -> DataFrame:
    teams = pairs.select("event_id", F.explode(F.array("winner", "loser")).alias("team")).distinct()
    return teams.withColumn("rating", 1000.0 + F.col("team") % 97)


def rating_hessian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hessian of the posterior of all teams' ratings, from sums over pairs."""
    pairs = cut(_pairs(spark, sf_dir, False))
    found = posterior.hessian_entries(pairs, _rated(pairs), 50.0, ["event_id"])
    return found.select(F.col("row").alias("team"), F.col("column").alias("other"), F.round(F.col("value") * 1e6, 4).alias("scaled"))


def posterior_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal deviations of each event's teams, from the event's own matches."""
    pairs = cut(_pairs(spark, sf_dir, True))
    found = posterior.deviations(posterior.hessian_entries(pairs, _rated(pairs), 50.0, ["event_id"]), "event_id")
    return found.select("event_id", "team", F.round("sd", 6).alias("sd"))


def fit_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many teams each event's fit has, and whether its gradient vanishes there: it is worked out anew, by joins over matches."""
    from .plans import windows

    found = Q._fit_windows(spark, sf_dir)
    config = {"model": {"priors_scheme": "flat1000", "prior_mean": 1000, "sigma": 50.0, "iters": 4000, "lr": 100.0, "converge_tol": 1e-6}, "data_prep": {"weighting": "uniform"}}
    fits = stored(windows.fit_windows(found, {"c": config}), "event_id")
    left = windows.residuals(found, fits, config, 50.0, 1000.0)
    return left.select("event_id", "n_teams", (F.col("largest") < 1e-6).alias("settled"))


def event_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, opponents' strength and places of each event's teams."""
    first = F.col("winner_team_id") == F.col("team1_id")
    m = Q.consumed(spark, sf_dir).where("team2_id IS NOT NULL AND tournament_id IS NOT NULL").select("tournament_id", F.when(first, F.col("team1_id")).otherwise(F.col("team2_id")).alias("winner"), F.when(first, F.col("team2_id")).otherwise(F.col("team1_id")).alias("loser"))
    table = standings.placed(standings.records(m, ["tournament_id"]), ["tournament_id"], "team")
    return table.select("tournament_id", "team", "wins", "losses", "buchholz", "group_place", "final_place")


def best_twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slates made of suppliers' numbers over outcomes made of orders' numbers: the twelve best, with many equal scores."""
    o = Q._table(spark, sf_dir, "orders")
    bit = lambda c: F.expr(f"shiftleft(1, CAST(({c}) % 16 AS INT))")
    outcome = o.select(bit("o_custkey").bitwiseOR(bit("o_custkey DIV 16")).alias("m30"), bit("o_orderkey").bitwiseOR(bit("o_orderkey DIV 16")).alias("m03"), ((F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104729) % 65536).cast("int").alias("madv"))
    counted = outcome.groupBy("m30", "m03", "madv").agg(F.count("*").alias("n"))
    s = Q._table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 16).cast("int").alias("x"), (F.col("s_nationkey") % 3).cast("int").alias("y")).distinct()
    listed = {"exact30": ("x", "x + 1 + y"), "exact03": ("x + 5", "x + 8 + y"), "advance": ("x + 4", "x + 6", "x + 7", "x + 11", "x + 12", "x + 13")}
    names = {n: F.array(*(F.concat(F.lit("t"), F.lpad(F.expr(f"CAST(({p}) % 16 AS STRING)"), 2, "0")) for p in places)) for n, places in listed.items()}
    masks = {m: sum((bit(p) for p in listed[n]), F.lit(0)) for m, n in (("s30", "exact30"), ("s03", "exact03"), ("sadv", "advance"))}
    made = s.select(*(v.alias(k) for k, v in (names | masks).items())).distinct()
    best = slates.top(slates.score_outcomes(counted, made, 5), 12)
    return best.select("rank", *(F.array_join(c, " ").alias(c) for c in slates.NAMES), F.round("p_pass", 8).alias("p_pass"), F.round("expected", 8).alias("expected"))


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches on the wrong side of their event's boundary, when every third event's boundary is taken five days early or late."""
    m, ev, w = Q._windows(spark, sf_dir)
    moved = lambda df, sign: df.withColumn("boundary", F.when(F.col("event_id") % 3 == 0, F.col("boundary") + F.expr(f"INTERVAL {sign * 5} DAY")).otherwise(F.col("boundary")))
    own = m.join(ev.select("tournament_id", "boundary"), "tournament_id").withColumn("event_id", F.col("tournament_id"))
    return events.leaks(moved(w, -1), moved(own, 1))


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of promotions, impossible records and tiers, counted by kind."""
    m = cut(Q.judged(spark, sf_dir).withColumn("start_date", F.substring("start_date", 1, 10)).withColumn("end_date", F.substring("end_date", 1, 10)))
    listed = m.select("tournament_id").distinct().withColumn("tier", F.when(F.col("tournament_id") % 3 == 0, "s").otherwise("a"))
    return audit.flag_counts(audit.promotions(m).unionByName(audit.impossible(m)).unionByName(audit.tier_check(m, listed)))


#: Customers on a page of the archive that the next queries make.
PAGE = 40


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an archive of pages of JSON; every third page was fetched again later, without its customers whose keys seven divides."""
    c = Q._table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / PAGE).alias("page"), "c_nationkey")
    again = c.where("page % 3 = 0 AND k % 7 <> 0").withColumn("chunk", F.lit("b.jsonl.gz"))
    both = c.withColumn("chunk", F.lit("a.jsonl.gz")).unionByName(again)
    result = F.to_json(F.struct(F.col("k").alias("id"), F.col("c_nationkey").alias("nation")))
    listed = F.array_sort(F.collect_list(F.struct("k", result.alias("r"))))  # a page
    body = F.concat(F.lit('{"total": {"count": 99}, "results": ['), F.array_join(F.transform(listed, lambda x: x["r"]), ","), F.lit("]}"))
    pages = both.groupBy("page", "chunk").agg(body.alias("body"))
    return pages.select(F.concat(F.lit("2026-01-0"), F.when(F.col("chunk") == "a.jsonl.gz", 1).otherwise(2)).alias("fetched_at"), F.lit("u").alias("url"), (F.col("page") * PAGE).alias("offset"), "body", F.lit(None).cast("string").alias("snapshot_id"), "chunk", F.col("page").alias("line"))


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an archive of pages: of pages fetched twice those of the later fetch."""
    rows = archive.archive_rows(_page_lines(spark, sf_dir))
    return rows.select(F.get_json_object("match", "$.id").cast("long").alias("id"), F.get_json_object("match", "$.nation").cast("long").alias("nation"), F.col("position").cast("long").alias("position"), "src_chunk", "src_offset", "fetched_at")


def archive_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an archive's pages follow each other: pages fetched again without some customers leave gaps."""
    lines = _page_lines(spark, sf_dir)
    found = [("all", archive.verify(lines)), ("first fetch", archive.verify(lines.where("chunk = 'a.jsonl.gz'")))]
    return spark.createDataFrame([(name, v["pages"], v["rows"], v["offsets_contiguous"], v["first_offset"], v["last_offset"]) for name, v in found], "part string, pages long, n_rows long, contiguous boolean, first_offset long, last_offset long")


def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers as a snapshot of pages of five: some say another total on one page, some lack a page."""
    c = Q._table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s"), F.col("c_custkey").alias("k"))
    at = F.row_number().over(Q.Window.partitionBy("s").orderBy("k")) - 1  # of a nation
    paged = c.withColumn("at", at).withColumn("n", F.count("*").over(Q.Window.partitionBy("s"))).withColumn("page", F.floor(F.col("at") / 5))
    pages = paged.groupBy("s", "n", "page").agg(F.array_sort(F.collect_list("k")).alias("ks")).where("NOT (s % 4 = 1 AND page = 1)")
    total = F.when((F.col("s") % 4 == 2) & (F.col("page") == 0), F.col("n") + 1).otherwise(F.col("n"))
    body = F.concat(F.lit('{"total": {"count": '), total, F.lit('}, "results": ["'), F.array_join("ks", '","'), F.lit('"]}'))
    lines = pages.select(F.lit("x").alias("fetched_at"), F.lit("u").alias("url"), (F.col("page") * 5).alias("offset"), body.alias("body"), F.col("s").cast("string").alias("snapshot_id"), F.lit("a").alias("chunk"), (F.col("s") * 1000 + F.col("page")).alias("line"))
    return archive.complete_snapshots(lines).select("snapshot_id", "complete")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (family_verdicts, evidence_rows, rating_hessian, posterior_deviations, fit_residuals, event_standings, best_twelve, leakage, audit_counts, archive_rows, archive_chain, snapshot_states)
    return {f.__name__: f for f in own}


# --- SQL ---

#: P(|T| <= sqrt(df) tan(x)) of an angle x, by the terms of its finite sum in closed form.
INSIDE_SQL = """CASE WHEN df % 2 = 1 THEN 2 / pi() * (x + CASE WHEN df > 1 THEN sin(x) * cos(x) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(lgamma(1.5) + lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos(x), 2 * k))) ELSE 0 END)
  ELSE sin(x) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(cos(x), 2 * k))) END"""
MATCHES_SQL = f"SELECT tournament_id, start_ts, bo_type, winner_team_id AS w, CASE WHEN winner_team_id = team1_id THEN team2_id ELSE team1_id END AS l FROM ({Q.CONSUMED_SQL}) c WHERE team2_id IS NOT NULL AND team1_id <> team2_id"
PAGES_SQL = f"SELECT c_custkey AS id, c_nationkey AS nation, c_custkey // {PAGE} AS page FROM customer"


def oracle_sql() -> dict[str, str]:
    return {
        "family_verdicts": f"""{Q.WALK_SQL.replace("WITH w AS", "WITH RECURSIVE w AS", 1)}, e AS (SELECT event_id, event_id // 100 AS family, AVG(bc - bi) FILTER (WHERE ok) AS d FROM g GROUP BY event_id HAVING COUNT(*) FILTER (WHERE ok) / COUNT(*) >= 0.6),
          f AS (SELECT family, COUNT(d) AS n, AVG(d) AS mean, stddev_samp(d) / sqrt(COUNT(d)) AS se FROM e WHERE d IS NOT NULL GROUP BY family),
          b AS (SELECT df, CAST(0 AS DOUBLE) AS lo, pi() / 2 AS hi, 0 AS i FROM (SELECT DISTINCT n - 1 AS df FROM f WHERE n > 1) q
            UNION ALL SELECT df, CASE WHEN p < 0.95 THEN x ELSE lo END, CASE WHEN p < 0.95 THEN hi ELSE x END, i + 1 FROM (SELECT *, {INSIDE_SQL} AS p FROM (SELECT *, (lo + hi) / 2 AS x FROM b) y) z WHERE i < 52),
          r AS (SELECT f.*, sqrt(CAST(df AS DOUBLE)) * tan((lo + hi) / 2) AS t FROM f LEFT JOIN b ON b.df = f.n - 1 AND b.i = 52), v AS (SELECT *, mean - t * se AS low, mean + t * se AS high FROM r)
          SELECT family, n AS n_events, CASE WHEN n < 8 THEN 'BLOCKED' WHEN high < 0 AND abs(mean) >= 0.0005 THEN CASE WHEN family % 2 <> 0 THEN 'INCONCLUSIVE' WHEN family < 1998 THEN 'DEV-SCREENED' ELSE 'ADOPTED' END WHEN low > 0 THEN 'REJECT' ELSE 'INCONCLUSIVE' END AS verdict,
            round(mean, 8) AS mean, round(se, 8) AS se, round(t, 8) AS t_crit, round(low, 8) AS ci_low, round(high, 8) AS ci_high FROM v""",
        "evidence_rows": f"""{Q.WALK_SQL}, k AS (SELECT *, -(y * ln(pc) + (1 - y) * ln(1 - pc)) AS lc, -(y * ln(pi) + (1 - y) * ln(1 - pi)) AS li FROM g WHERE ok)
          SELECT event_id, 'candidate' AS who, COUNT(*) AS n, round(AVG(bc), 8) AS brier, round(AVG(lc), 8) AS log FROM k GROUP BY event_id UNION ALL SELECT event_id, 'incumbent', COUNT(*), round(AVG(bi), 8), round(AVG(li), 8) FROM k GROUP BY event_id
          UNION ALL SELECT event_id, 'uniform', COUNT(*), 0.25, round(ln(2), 8) FROM k GROUP BY event_id""",
        "rating_hessian": f"""WITH m AS ({MATCHES_SQL}), k AS (SELECT w, l, pow(0.5, epoch(TIMESTAMP '{TODAY}' - start_ts) / 86400.0 / {HALF_LIFE}) * CASE WHEN bo_type = 1 THEN 0.5 ELSE 1.0 END AS weight, 1 / (1 + pow(10.0, ((l % 97) - (w % 97)) / 400.0)) AS p FROM m),
          h AS (SELECT w, l, SUM(weight * pow(ln(10) / 400, 2) * p * (1 - p)) AS h FROM k GROUP BY w, l), t AS (SELECT w AS a, w AS b, h FROM h UNION ALL SELECT l, l, h FROM h UNION ALL SELECT w, l, -h FROM h UNION ALL SELECT l, w, -h FROM h
            UNION ALL SELECT t, t, 1 / 2500.0 FROM (SELECT w AS t FROM h UNION SELECT l FROM h) z) SELECT a AS team, b AS other, round(SUM(h) * 1e6, 4) AS scaled FROM t GROUP BY a, b""",
        "fit_residuals": f"""WITH w AS (SELECT * FROM ({Q.WINDOW_SQL}) x WHERE team2_id IS NOT NULL), e AS (SELECT event_id, team1_id AS a, team2_id AS b FROM w UNION SELECT event_id, team2_id, team1_id FROM w),
          h AS (SELECT DISTINCT tournament_id AS event_id, unnest([team1_id, team2_id]) AS t FROM ({Q.CONSUMED_SQL}) c WHERE team2_id IS NOT NULL AND tournament_id IN (SELECT tournament_id FROM ({Q.UNIVERSE_SQL}) u)),
          u AS (SELECT * FROM h UNION SELECT e.event_id, e.b FROM e JOIN h ON e.event_id = h.event_id AND e.a = h.t) SELECT event_id, COUNT(*) AS n_teams, true AS settled FROM u GROUP BY event_id""",
        "event_standings": f"""WITH m AS (SELECT tournament_id, winner_team_id AS w, CASE WHEN winner_team_id = team1_id THEN team2_id ELSE team1_id END AS l FROM ({Q.CONSUMED_SQL}) c WHERE team2_id IS NOT NULL AND tournament_id IS NOT NULL),
          s AS (SELECT tournament_id, w AS t, l AS o, 1 AS won FROM m UNION ALL SELECT tournament_id, l, w, 0 FROM m), r AS (SELECT tournament_id, t, SUM(won) AS wins, COUNT(*) - SUM(won) AS losses FROM s GROUP BY ALL),
          b AS (SELECT s.tournament_id, s.t, SUM(r.wins - r.losses) AS d FROM s JOIN r ON r.tournament_id = s.tournament_id AND r.t = s.o GROUP BY ALL)
          SELECT r.tournament_id, r.t AS team, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(d AS BIGINT) AS buchholz, CAST(row_number() OVER (PARTITION BY r.tournament_id, wins, losses ORDER BY d DESC, r.t) AS INTEGER) AS group_place,
            CAST(row_number() OVER (PARTITION BY r.tournament_id ORDER BY losses, wins DESC, d DESC, r.t) AS INTEGER) AS final_place FROM r JOIN b ON b.tournament_id = r.tournament_id AND b.t = r.t""",
        "best_twelve": """WITH o AS (SELECT (1 << CAST(o_custkey % 16 AS INTEGER)) | (1 << CAST(o_custkey // 16 % 16 AS INTEGER)) AS m30, (1 << CAST(o_orderkey % 16 AS INTEGER)) | (1 << CAST(o_orderkey // 16 % 16 AS INTEGER)) AS m03, CAST((o_custkey * 7919 + o_orderkey * 104729) % 65536 AS INTEGER) AS madv FROM orders),
          p AS (SELECT DISTINCT CAST(s_suppkey % 16 AS INTEGER) AS x, CAST(s_nationkey % 3 AS INTEGER) AS y FROM supplier), l AS (SELECT [x % 16, (x + 1 + y) % 16] AS a, [(x + 5) % 16, (x + 8 + y) % 16] AS b, [(x + 4) % 16, (x + 6) % 16, (x + 7) % 16, (x + 11) % 16, (x + 12) % 16, (x + 13) % 16] AS c FROM p),
          s AS (SELECT DISTINCT list_sum(list_transform(a, lambda i: 1 << i)) AS s30, list_sum(list_transform(b, lambda i: 1 << i)) AS s03, list_sum(list_transform(c, lambda i: 1 << i)) AS sadv,
            list_transform(a, lambda i: 't' || lpad(CAST(i AS VARCHAR), 2, '0')) AS a, list_transform(b, lambda i: 't' || lpad(CAST(i AS VARCHAR), 2, '0')) AS b, list_transform(c, lambda i: 't' || lpad(CAST(i AS VARCHAR), 2, '0')) AS c FROM l),
          r AS (SELECT a, b, c, bit_count(m30 & CAST(s30 AS INTEGER)) + bit_count(m03 & CAST(s03 AS INTEGER)) + bit_count(madv & CAST(sadv AS INTEGER)) AS k FROM o, s), q AS (SELECT a, b, c, AVG(CASE WHEN k >= 5 THEN 1.0 ELSE 0.0 END) AS p, AVG(CAST(k AS DOUBLE)) AS e FROM r GROUP BY a, b, c)
          SELECT CAST(row_number() OVER (ORDER BY p DESC, e DESC, a DESC, b DESC, c DESC) AS INTEGER) AS rank, array_to_string(a, ' ') AS exact30, array_to_string(b, ' ') AS exact03, array_to_string(c, ' ') AS advance, round(p, 8) AS p_pass, round(e, 8) AS expected FROM q QUALIFY rank <= 12""",
        "leakage": f"""WITH f AS (SELECT event_id FROM ({Q.WINDOW_SQL}) w WHERE event_id % 3 = 0 AND start_ts >= boundary - INTERVAL 5 DAY), g AS (SELECT c.tournament_id AS event_id FROM ({Q.CONSUMED_SQL}) c JOIN ({Q.UNIVERSE_SQL}) u ON u.tournament_id = c.tournament_id WHERE c.tournament_id % 3 = 0 AND start_ts < boundary + INTERVAL 5 DAY)
          SELECT event_id, CAST(SUM(late) AS BIGINT) AS late, CAST(SUM(early) AS BIGINT) AS early FROM (SELECT event_id, 1 AS late, 0 AS early FROM f UNION ALL SELECT event_id, 0, 1 FROM g) z GROUP BY event_id""",
        "audit_counts": f"""WITH i AS ({Q.oracle_sql()["impossible_scan"]}), p AS ({Q.oracle_sql()["promotion_flags"]}), t AS ({Q.oracle_sql()["tier_divergence"]})
          SELECT flag, CAST(n AS BIGINT) AS n, CASE WHEN severity = 'fail' THEN CAST(n AS BIGINT) ELSE 0 END AS failures FROM i UNION ALL SELECT flag, COUNT(*), 0 FROM p GROUP BY flag UNION ALL SELECT flag, COUNT(*), 0 FROM t GROUP BY flag""",
        "archive_rows": f"""WITH c AS ({PAGES_SQL}), k AS (SELECT *, page % 3 = 0 AS twice FROM c WHERE NOT (page % 3 = 0 AND id % 7 = 0))
          SELECT id, nation, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS position, CASE WHEN twice THEN 'b.jsonl.gz' ELSE 'a.jsonl.gz' END AS src_chunk, page * {PAGE} AS src_offset, CASE WHEN twice THEN '2026-01-02' ELSE '2026-01-01' END AS fetched_at FROM k""",
        "archive_chain": f"""WITH c AS ({PAGES_SQL}), p AS (SELECT 'all' AS part, page, COUNT(*) AS n FROM c WHERE NOT (page % 3 = 0 AND id % 7 = 0) GROUP BY page UNION ALL SELECT 'first fetch', page, COUNT(*) FROM c GROUP BY page),
          q AS (SELECT *, lead(page) OVER (PARTITION BY part ORDER BY page) AS nxt FROM p) SELECT part, COUNT(*) AS pages, CAST(SUM(n) AS BIGINT) AS n_rows, bool_and(nxt IS NULL OR page * {PAGE} + n = nxt * {PAGE}) AS contiguous, MIN(page) * {PAGE} AS first_offset, MAX(page) * {PAGE} AS last_offset FROM q GROUP BY part""",
        "snapshot_states": """SELECT CAST(c_nationkey AS VARCHAR) AS snapshot_id, NOT (c_nationkey % 4 = 1 AND COUNT(*) > 5) AND NOT (c_nationkey % 4 = 2 AND COUNT(*) > 5) AND NOT (c_nationkey % 4 = 2 AND COUNT(*) <= 5) AS complete FROM customer GROUP BY c_nationkey""",
    }
