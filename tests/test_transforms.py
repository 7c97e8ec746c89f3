"""Micro tables for the cleaning operators (FIXTURES §2; expected values by hand)."""

import pytest

from mopup.operators import outliers as O
from mopup.operators import transforms as TR
from mopup.plans.clean import clean
from mopup.plans.options import SCOPED_DEFAULTS, CleanOptions

from .conftest import rows


def scoped(**kw):
    d = dict(SCOPED_DEFAULTS)
    d.update(kw)
    return CleanOptions.from_dict(d)


def test_iqr_m2(spark):
    data = [(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 100])] + [(10, None)]
    df = spark.createDataFrame(data, "row_id bigint, x double")
    b = O.iqr_bounds(df)["x"]
    assert (b["q1"], b["q3"], b["lower"], b["upper"]) == (3.25, 7.75, -3.5, 14.5)
    kept, gone, _ = O.remove_outliers(df)
    assert [r["row_id"] for r in gone.collect()] == [9]
    assert kept.count() == 10  # the null row stays
    clipped, _ = O.clip_outliers(df)
    got = {r["row_id"]: r["x"] for r in clipped.collect()}
    assert got[9] == 14.5 and got[10] is None and got[0] == 1.0


def test_label_encode_m3(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b"), (4, "a")], "row_id bigint, c string")
    out, enc = TR.label_encode(df)
    assert enc == ["c"]
    assert [r["c"] for r in rows(out)] == [1, 0, 2, 1, 0]


def test_auto_numeric_m4(spark):
    seven = [str(i) for i in range(7)] + ["a", "b", "c"]
    six = [str(i) for i in range(6)] + ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, seven[i], six[i]) for i in range(10)], "row_id bigint, s7 string, s6 string")
    out = clean(df, scoped(rename_columns=False, convert_dtypes=True)).df
    types = dict(out.dtypes)
    assert types["s7"] == "double" and types["s6"] == "string"
    assert sum(1 for r in out.collect() if r["s7"] is None) == 3
    # dtype_map auto needs 95 %: the 7-of-10 column stays text
    out2 = clean(df, scoped(rename_columns=False, dtype_map={"s7": "auto"})).df
    assert dict(out2.dtypes)["s7"] == "string"


def test_renames_m7(spark):
    df = spark.createDataFrame([(0, 1, 2)], "row_id bigint, a int, b int")
    _, safe = TR.rename_columns(df, {"a": "b"})
    assert safe == {}
    out, safe = TR.rename_columns(df, {"a": "b", "b": "c"})
    assert safe == {"a": "b", "b": "c"} and out.columns == ["row_id", "b", "c"]


def test_all_null_fills_m10(spark):
    df = spark.createDataFrame([(0, None, None), (1, None, None)], "row_id bigint, x double, t string")
    r = clean(df, scoped(rename_columns=False, missing_strategy="fill", fill_numeric="mean",
                         fill_categorical="mode"))
    got = rows(r.df)
    assert [g["x"] for g in got] == [None, None]
    assert [g["t"] for g in got] == ["Unknown", "Unknown"]
    fill = [e for e in r.entries if e.action == "fill_numeric"][0]
    assert fill.detail["skipped"][0]["column"] == "x"


def test_dedupe_keep_first_m12(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, None, "x"), (2, "a", "x")], "row_id bigint, a string, b string")
    assert sorted(r["row_id"] for r in TR.dedupe(df).collect()) == [0, 2]
    assert [(r["row_id"], r["duplicate_of"]) for r in TR.duplicate_removals(df).collect()] == [(1, 0)]


def test_empty_vs_constant_m13(spark):
    df = spark.createDataFrame([(0, None, "k", "k"), (1, None, "k", None)],
                               "row_id bigint, e string, c string, cn string")
    empty, const = TR.empty_and_constant(df)
    assert empty == ["e"] and const == ["c", "cn"]


def test_cell_updates_m14(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "row_id bigint, n double")
    ups = [{"row_index": 1, "column": "n", "value": "7"}, {"row_index": 2, "column": "n", "value": "x"},
           {"row_index": 0, "column": "n", "value": " "}, {"row_index": 9, "column": "n", "value": 1},
           {"row_index": 1, "column": "zz", "value": 1}]
    ce = TR.apply_cell_updates(df, ups)
    assert len(ce.applied) == 3 and ce.retyped == ["n"]
    got = {r["row_id"]: r["n"] for r in ce.df.collect()}
    assert dict(ce.df.dtypes)["n"] == "string"
    assert got == {0: None, 1: "7", 2: "x"}
    ce2 = TR.apply_cell_updates(df, ups[:1])
    assert {r["row_id"]: r["n"] for r in ce2.df.collect()} == {0: 1.0, 1: 7.0, 2: 3.0}


def test_fill_numeric_skip_m16(spark):
    df = spark.createDataFrame([(0, 10.0, "a"), (1, None, None)], "row_id bigint, n double, t string")
    r = clean(df, scoped(rename_columns=False, missing_strategy="fill", fill_numeric="skip",
                         fill_categorical="mode"))
    got = rows(r.df)
    assert got[1]["n"] is None and got[1]["t"] == "a"


def test_empty_table_m19(spark):
    from mopup.operators import profile as P
    from mopup.operators import quality as Q
    df = spark.createDataFrame([], "row_id bigint, a string, b double")
    assert Q.data_quality_score(df).collect()[0]["score"] == 0.0
    assert P.profile_summary(df).collect()[0]["missing_percent"] == 0.0
    r = clean(df, CleanOptions())
    assert r.df.columns == ["row_id"]


def test_categorical_constant_and_drop(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "row_id bigint, t string")
    out, det, _ = TR.fill_categorical(df, "constant", None)
    assert [r["t"] for r in rows(out)] == ["a", "Unknown", "b"]
    out, _, dropped = TR.fill_categorical(df, "drop")
    assert [r["row_id"] for r in rows(out)] == [0, 2] and [r["row_id"] for r in dropped.collect()] == [1]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "a"), (4, None)], "row_id bigint, t string")
    assert TR.modes(df, ["t"]) == {"t": "a"}


def test_remove_rows_ignores_unknown(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_id bigint, t string")
    assert [r["row_id"] for r in TR.remove_rows(df, [1, 99]).collect()] == [0]


def test_fill_constant_rejects_text(spark):
    df = spark.createDataFrame([(0, None)], "row_id bigint, x double")
    with pytest.raises(ValueError):
        TR.fill_numeric(df, "abc")


def test_outlier_listing_cap_and_totals(spark):
    data = [(i, float(v), float(w)) for i, (v, w) in enumerate(
        [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (100, 1000), (-50, 5)])]
    df = spark.createDataFrame(data, "row_id bigint, x double, y double")
    rows, summary = O.outlier_listing(df, max_rows=1)
    assert [(r["row_id"], r["column"]) for r in rows.collect()] == [(9, "x")]
    s = summary.collect()[0]
    assert (s["total_rows"], s["total_cells"], s["columns_checked"]) == (2, 3, "x,y")


def test_profile_bundle(spark):
    from mopup.operators.profile import profile
    df = spark.createDataFrame([(0, "a", None), (1, "N/A", 2.0), (2, "a", None)], "row_id bigint, t string, x double")
    p = profile(df)
    s = p["summary"].collect()[0]
    assert (s["rows"], s["cols"], s["missing_count"], s["duplicate_count"]) == (3, 2, 3, 1)
    assert [r["row_id"] for r in p["missing_rows"].orderBy("row_id").collect()] == [0, 1, 2]
    assert p["preview"].count() == 3
