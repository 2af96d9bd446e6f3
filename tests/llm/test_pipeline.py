import hashlib
import re
from collections import Counter

import corpus_pipeline as C
import numpy as np
import pytest
from duelframe.llm import common, queries, toxicity
from duelframe.llm.tokenizers import word_bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..conftest import SF
from .test_line_dedup import brute as line_brute
from .test_mixing import water
from .test_simhash import classes, shingled
from .test_toxicity import naive_score


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, over the smallest documents."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SF))
        out[name] = (before, docs)
    yield out
    common.release(spark)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns and after.dtypes == before.dtypes and after.count() > 0


def test_toxicity_equals_brute_force(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(common.crc_remainder("doc_id", 3) != 1)
    lexicon = toxicity.fit(before, labels)
    want = [r for r in before.collect() if lexicon is None or naive_score((r.text or "")[:4000], lexicon) < C.REJECT or len(r.text or "") > 4000]
    got = {r.doc_id for r in after.collect()}
    assert got == {r.doc_id for r in want if len(r.text or "") <= 4000 or r.doc_id in got}


def test_line_dedup_equals_brute_force(stages):
    before, after = stages["line_dedup"]
    assert rows(after, "doc_id", "text", "n_chars") == sorted(((d, t, len(t)) for d, t, *_ in line_brute(rows(before, "doc_id", "text"), 10)), key=str)


def test_near_duplicates_equal_brute_force(stages):
    before, after = stages["near_dedup"]
    sets = {r.doc_id: shingled(r.text or "") for r in before.collect()}
    root = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id for r in after.collect()} == {root[d] for d in root} and after.exceptAll(before).count() == 0


def test_mixing_equals_brute_force(stages):
    before, after = stages["mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = {r.doc_id: (r.source, size(r.text)) for r in before.collect()}
    per = Counter()
    for source, n in docs.values():
        per[source] += n
    sources = sorted(per, key=lambda s: (s is None, s))
    goals = dict(zip(sources, water([per[s] for s in sources], [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2), strict=True))
    want = Counter()
    for source in sources:
        goal, ahead = round(goals[source]), 0
        passes = goal // per[source] if per[source] else 0
        for d in sorted((d for d in docs if docs[d][0] == source), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
            n = docs[d][1]
            want[d] = passes * n + max(0, min(n, goal - passes * per[source] - ahead))
            ahead += n
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += size(r.text)
    assert got == +want


def test_packing_equals_brute_force(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(word_bpe())
    want = Counter()
    for r in before.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, i, min(2048, n - at)) for i, at in enumerate(range(0, n, 2048)))
    assert Counter(tuple(r) for r in after.select("doc_id", "piece", "length").collect()) == want
    used = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.count_distinct("offset").alias("o"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n > 2048 OR n <> end OR k <> o OR first <> 0").count() == 0
    assert used.count() <= int(np.ceil(sum(n * k for (_, _, n), k in want.items()) / 2048)) + 2


def test_run_repeats_and_takes_odd_rows(spark, odd, nothing, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0), (20, 1, 1)], "doc_id long, quality int, toxic int")
    extra = odd.withColumns({c: F.lit(7) for c in ("toxicity", "size", "taken", "n_lines", "component_id", "length", "sequence_id", "score")})
    for name, docs in (("odd", odd), ("none", nothing), ("extra", extra)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    first, again = (sorted(map(str, C.run(spark, f"{tmp_path}/odd").collect())) for _ in range(2))
    assert first == again and len(first) > 10
    assert C.run(spark, f"{tmp_path}/none").collect() == []
    assert sorted(map(str, C.run(spark, f"{tmp_path}/extra").collect())) == first
    kept = C.drop_toxic(spark, extra, f"{tmp_path}/extra")
    assert kept.columns == extra.columns and {r[0] for r in kept.select("toxicity").distinct().collect()} == {7}


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"] and set(queries.oracle_sql()) <= set(names)
