import math

import numpy as np
import pytest
from duelframe.llm import topk as T


def brute(vectors, asked, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in ok if i in asked}.items():
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_equals_brute_force(spark, block):
    r = np.random.default_rng(block)
    vectors = [(i, [float(x) for x in r.normal(size=12)]) for i in range(150)]
    vectors += [(200 + i, vectors[3][1]) for i in range(20)]  # ties
    vectors += [(300, None), (301, [1.0, None]), (302, [math.nan] * 12), (303, [math.inf] * 12), (304, []), (305, [1.0]), (None, [1.0] * 12), (306, [0.0] * 12)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    out = T.top_k(df.selectExpr("*", "1 AS rank", "2 AS score", "3 AS v"), df.where("vec_id % 10 = 0"), 5, 256, block)
    assert sorted(tuple(x) for x in out.collect()) == brute(vectors, range(0, 400, 10), 5)


def test_few_empty_and_huge(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in T.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 65536)]
    assert T.top_k(df.limit(0), df).collect() == [] and T.top_k(df, df.limit(0)).collect() == []
    ids, x = np.array([5, 6, 7]), np.array([[1e12, 3.0], [1e12, 3.0], [1.0, 1.0]])
    assert T.nra_block(ids, x, np.array([9]), np.array([[1e6, 1.0]]), 2) == [(9, 5, 10**18 + 3), (9, 6, 10**18 + 3)]
    with pytest.raises(OverflowError):
        T.nra_block(ids, x, np.array([9]), np.array([[1e9, 1.0]]), 2)


def test_a_repeated_query_id_counts_by_its_least_vector(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 5.0])], "vec_id long, embedding array<double>")
    for parts in (1, 3):
        assert [(r.query_id, r.vec_id) for r in T.top_k(v, v.where("vec_id = 0").repartition(parts, "embedding"), k=1).collect()] == [(0, 2)]
