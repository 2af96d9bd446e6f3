"""Core kernels and the entry from another folder, and without what the corpus operators need."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
KERNELS = """
import sys
sys.path.insert(0, {root!r})
from duelframe.session import session
from duelframe.plans import bracket, posterior, ratings, swiss
spark = session(spark_master="local[2]", spark_ui_enabled="false", spark_sql_shuffle_partitions="2")
teams = tuple(f"t{{i}}" for i in range(16))
event = swiss.Event(teams, tuple(zip(teams[:8], teams[8:])), {{t: i for i, t in enumerate(teams)}})
rated = {{t: 1000.0 + i for i, t in enumerate(teams)}}
assert swiss.simulate(spark, event, {{"x": rated}}, 20).count() == 20
assert bracket.rank_picks(posterior.draw_table(spark, [rated]), teams[:8]).count() == 128
m = spark.createDataFrame([(1, 1, "a", "b", 1.0, 3)], "event_id long, match_id long, winner string, loser string, age_days double, bo_type int")
t = spark.createDataFrame([(1, "a", "s", 1.0), (1, "b", "s", 1.0)], "event_id long, team string, modal_tier string, idle_days double")
config = {{"model": {{"priors_scheme": "flat1000", "prior_mean": 1000, "sigma": 50.0, "iters": 50, "lr": 100.0}}, "data_prep": {{"weighting": "uniform"}}}}
assert ratings.fit_events(m, t, {{"c": config}}).count() == 2
print("all ran")
"""
HIDDEN = """
import sys, warnings
warnings.simplefilter("ignore")
sys.modules[{name!r}] = None
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert "asof_close" in e.queries() and not any(k.startswith("op") for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
print("all ran")
"""


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_kernels_reach_executors_from_another_folder(tmp_path):
    out = run(KERNELS.format(root=str(ROOT)), tmp_path)
    assert "all ran" in out.stdout, out.stderr[-2000:]


def test_the_core_stands_without_the_corpus_operators(tmp_path):
    for name in ("xxhash", "public_tokenizers", "duelframe.llm", "corpus_pipeline"):
        out = run(HIDDEN.format(root=str(ROOT), name=name), tmp_path)
        assert "all ran" in out.stdout, out.stderr[-2000:]
