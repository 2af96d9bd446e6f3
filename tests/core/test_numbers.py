import math

import pytest
from duelframe.functions import numeric as N
from duelframe.functions import scoring as S
from pyspark.sql import functions as F


def test_t_quantiles():
    for df, want in ((1, 12.7062), (2, 4.3027), (10, 2.2281), (30, 2.0423), (100, 1.9840)):
        assert N.t_quantile(0.975, df) == pytest.approx(want, abs=6e-5)
        assert N.t_quantile(0.025, df) == pytest.approx(-want, abs=6e-5)
    assert N.t_quantile(0.5, 7) == pytest.approx(0, abs=1e-9) and N.t_quantile(0.975, 39_999) == pytest.approx(1.960009, abs=1e-4)
    for p, df in ((0.0, 3), (1.0, 3), (0.9, 0), (0.9, 2.0)):
        with pytest.raises(ValueError):
            N.t_quantile(p, df)


def test_identities_and_differences():
    assert N.canonical_sha({"b": 1, "a": [1, 2.5]}) == N.canonical_sha({"a": [1, 2.5], "b": 1}) != N.canonical_sha({"a": [2.5, 1], "b": 1})
    a, b = {"m": {"s": 1, "t": {"u": 2}}, "l": [1, 2], "id": "x"}, {"m": {"s": 2, "t": {}}, "l": [1, 3], "id": "y"}
    assert N.differing_paths(a, b, frozenset({"id"})) == ["l", "m.s", "m.t.u"] and N.differing_paths(a, a) == []
    assert N.has_placeholder({"x": [{"y": "pending-w"}]}) and N.has_placeholder("unknown") and not N.has_placeholder({"x": "abc", "n": None})


def test_intervals():
    assert N.paired([1.0, 2.0, 4.0], [0.0, 0.0, 0.0]) == (pytest.approx(7 / 3), pytest.approx(math.sqrt(7 / 3) / math.sqrt(3)))
    assert N.paired([1.0], [0.5]) == (0.5, 0.0)
    assert N.rank_quantile([1, 2, 3, 4], 0.5) == 3 and N.rank_quantile([1, 2], 1.0) == 2
    assert N.envelope(0.5, 0.4, 0.45, [0.3]) == (0.3, 0.503) and N.envelope(0.999, 0.99, 0.999, [], 0.01)[1] == 1.0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_columns(spark):
    assert value(spark, S.interval_text(F.lit(0.418), F.lit(0.37), F.lit(0.452))) == "0.42 [0.37-0.45]"
    for p in (1e-15, 0.1, 0.5, 0.77, 1.0):
        q = value(spark, S.map_prob(F.lit(p)))
        assert q * q * (3 - 2 * q) == pytest.approx(min(max(p, 1e-12), 1 - 1e-12), abs=1e-9)
    assert value(spark, S.devig(F.lit(1.5), F.lit(3.0))) == pytest.approx(2 / 3)
    assert [str(value(spark, S.months_before(F.lit(d), n))) for d, n in (("2024-03-31", 1), ("2023-02-28", 24), ("2024-01-15", 13))] == ["2024-02-29", "2021-02-28", "2022-12-15"]
    early, late = (value(spark, S.utc(F.lit(t))) for t in ("2025-01-02T00:30:00+02:00", "2025-01-01T23:00:00Z"))
    assert early < late and value(spark, S.utc(F.lit("nonsense"))) is None
    assert value(spark, S.unordered(F.lit(3), F.lit(None).cast("int"))[0]) is None
    assert value(spark, S.normalized(F.array(F.lit(1.0), F.lit(3.0)))) == [0.25, 0.75] and value(spark, S.normalized(F.array(F.lit(0.0)))) is None
    assert value(spark, S.short_sha(F.lit("a").cast("binary"))) == "86f7e437faa5"
    assert value(spark, S.stale_sigma(50.0, 20.0, F.lit(None).cast("double"))) == 50.0 and value(spark, S.stale_sigma(50.0, 20.0, F.lit(365.0))) == 70.0
    assert value(spark, S.string_array(F.lit('["a", "b"]'))) == ["a", "b"]
