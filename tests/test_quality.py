"""Quality score (M1, M8, M11) and the distributed exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mopup.operators import quality as Q
from mopup.operators import stats


def test_score_m1(spark):
    data = [(0, "a", "10", "x"), (1, "a", "10", "x"), (2, "b", "n/a", "x"), (3, None, "12abc", "x"),
            (4, "c", "1,200", None)]
    df = spark.createDataFrame(data, "row_id bigint, name string, score string, city string")
    c = Q.components(df).collect()[0].asDict()
    assert c["missing_pct"] == round(2 / 15 * 100, 4)
    assert c["placeholder_pct"] == round(3 / 15 * 100, 4)
    assert c["dup_pct"] == 20.0
    assert c["numeric_issue_pct"] == round(1 / 15 * 100, 4)
    assert c["row_placeholder_pct"] == 0.0 and c["outlier_pct"] == 0.0
    assert c["const_col_pct"] == round(100 / 3, 4)
    assert c["score"] == 83.33


def test_candidate_by_name_m8(spark):
    df = spark.createDataFrame([(0, "US1")], "row_id bigint, country string")
    r = Q.numeric_candidates(df).collect()[0]
    assert r["by_name"] and r["is_candidate"] and r["numeric_issues"] == 1


@pytest.mark.parametrize("failed,expected", [(0, 100.0), (1, 80.0), (6, 0.0)])
def test_completeness_m11(spark, failed, expected):
    rows = [(i, "x_failed" if i < failed else "ok", True) for i in range(max(failed, 1) + 1)]
    log = spark.createDataFrame(rows, "seq int, action string, success boolean")
    assert Q.cleaning_completeness(log).collect()[0]["completeness"] == expected


def _np_q(vals, p):
    return float(np.quantile(np.array(vals, dtype=float), p))


@pytest.mark.parametrize("accuracy,cap", [(10000, 200_000), (100, 10), (50, 5)])
def test_exact_quantiles_match_numpy(spark, accuracy, cap):
    rnd = random.Random(7)
    vals = [float(rnd.choice([rnd.gauss(0, 1), rnd.randint(0, 5), 3.0])) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "row_id bigint, x double").repartition(7)
    q = stats.quantiles(df, ["x"], probs=(0.25, 0.5, 0.75), accuracy=accuracy, cap=cap)
    for p in (0.25, 0.5, 0.75):
        assert q["x"][p] == pytest.approx(_np_q(vals, p), abs=1e-12)


def test_quantiles_tiny_and_empty(spark):
    df = spark.createDataFrame([(0, 5.0), (1, None)], "row_id bigint, x double")
    q = stats.quantiles(df, ["x"])
    assert q["x"][0.25] == 5.0 and q["x"][0.75] == 5.0
    e = df.where(F.col("x") > 100)
    assert stats.quantiles(e, ["x"])["x"][0.25] is None


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.one_of(st.integers(-5, 5).map(float),
                               st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                     min_size=1, max_size=400),
       accuracy=st.sampled_from([20, 100, 10000]), cap=st.sampled_from([3, 50, 200_000]))
def test_exact_quantiles_property(spark, vals, accuracy, cap):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "row_id bigint, x double").repartition(3)
    q = stats.quantiles(df, ["x"], probs=(0.25, 0.5, 0.75), accuracy=accuracy, cap=cap)
    for p in (0.25, 0.5, 0.75):
        assert q["x"][p] == pytest.approx(_np_q(vals, p), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("cap", [1, 2, 3, 65536])
def test_exact_quantiles_end_at_every_cap(spark, cap):
    """Values and settings that once sent the search round for ever; extremes of DOUBLE; big integers."""
    vals = [float(i) for i in range(10)] + [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308,
                                            1.0, float(np.nextafter(1.0, 2)), float("inf")]
    df = spark.createDataFrame([(i, float(i), v, 2 ** 62 + i) for i, v in enumerate(vals)],
                               "row_id bigint, small double, wide double, big bigint").repartition(3)
    q = stats.quantiles(df, ["small", "wide", "big"], probs=(0.0, 0.25, 0.5, 0.75), accuracy=20, cap=cap)
    for p in (0.0, 0.25, 0.5, 0.75):
        assert q["small"][p] == _np_q(range(len(vals)), p)
        assert q["wide"][p] == _np_q(vals, p)
        assert q["big"][p] == pytest.approx(_np_q([2 ** 62 + i for i in range(len(vals))], p), rel=1e-15)
    assert q["wide"]["max"] == float("inf") and q["wide"]["n"] == len(vals)


def test_quantiles_collect_no_values(spark, monkeypatch):
    """However many values a column has, the driver gets a row for each wanted rank."""
    from pyspark.sql.classic.dataframe import DataFrame
    sizes = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda r: (sizes.append(len(r)), r)[1])(collect(self)))
    df = spark.range(50_000).select((F.rand(3) * 1e6).alias("a"), (F.col("id") % 7).alias("b"))
    q = stats.quantiles(df, ["a", "b"])
    assert q["a"]["n"] == q["b"]["n"] == 50_000
    assert len(sizes) <= 4 and max(sizes) <= 8
