"""Properties: idempotence, row accounting, replay of changed
cells, partition invariance, score range."""

import pytest
from pyspark.sql import functions as F

from mopup.operators import quality as Q
from mopup.operators import transforms as TR
from mopup.plans.clean import clean
from mopup.plans.fixtures import load_view
from mopup.plans.options import CleanOptions

SF = "/root/testdata/sf0.001"


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def cust(spark):
    return load_view(spark, SF, "customer_dirty")


def test_idempotent_steps(spark, cust):
    once = TR.replace_placeholders(cust)
    assert _sorted(TR.replace_placeholders(once)) == _sorted(once)
    n1, _ = TR.normalize_columns(once)
    n2, m = TR.normalize_columns(n1)
    assert m == {} and n2.columns == n1.columns
    t1, _ = TR.trim_whitespace(once)
    assert _sorted(TR.trim_whitespace(t1)[0]) == _sorted(t1)
    d1 = TR.dedupe(load_view(spark, SF, "orders_dup"))
    assert _sorted(TR.dedupe(d1)) == _sorted(d1)
    e1, _ = TR.drop_empty_columns(once)
    assert TR.drop_empty_columns(e1)[1] == []
    c1, _ = TR.drop_constant_columns(once)
    assert TR.drop_constant_columns(c1)[1] == []


def test_row_accounting_and_removed_rows(spark):
    v = load_view(spark, SF, "orders_dup")
    r = clean(v, CleanOptions(missing_strategy="drop", stage="none"))
    before, after = v.count(), r.df.count()
    removed = r.removed_rows
    assert before - after == removed.count()
    kept_ids = {x["row_id"] for x in r.df.collect()}
    assert kept_ids.isdisjoint({x["row_id"] for x in removed.collect()})


def test_changed_cells_replay(spark, cust):
    opts = CleanOptions(remove_duplicates=False, convert_dtypes=False, drop_empty_columns=False,
                        drop_constant_columns=False, rename_columns=False, fill_numeric="zero",
                        stage="none")
    r = clean(cust, opts)
    base = TR.replace_placeholders(cust)
    edits = [{"row_index": x["row_id"], "column": x["column"], "value": x["new_value"]}
             for x in r.changed_cells.collect()]
    # replaying the audit on the placeholder-free input gives the cleaned table (text columns)
    replay = TR.apply_cell_updates(base, [e for e in edits if e["column"] != "acctbal"]).df
    cols = ["row_id", "Name", "Mkt Segment", "nation_txt", "notes", "origin", "Unnamed: 7", "Unnamed: 8"]
    assert _sorted(replay.select(*[F.col(f"`{c}`") for c in cols])) == \
        _sorted(r.df.select(*[F.col(f"`{c}`") for c in cols]))


@pytest.mark.parametrize("n", [1, 7, 64])
def test_partition_invariance(spark, cust, n):
    base = clean(cust, CleanOptions()).df
    again = clean(cust.repartition(n), CleanOptions()).df
    rnd = lambda df: df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`")  # noqa
                                 for c, t in df.dtypes])
    assert _sorted(rnd(base)) == _sorted(rnd(again))
    s1 = Q.data_quality_score(cust).collect()[0]["score"]
    s2 = Q.data_quality_score(cust.repartition(n)).collect()[0]["score"]
    assert s1 == s2 and 0 <= s1 <= 100


def test_cell_diff_rows_and_columns(spark):
    from mopup.operators.audit import cell_diff
    b = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "c", None)], "row_id bigint, t string, x double")
    a = spark.createDataFrame([(0, "a", "new"), (1, "B", "z"), (3, "d", "q")], "row_id bigint, t string, y string")
    got = sorted(tuple(r) for r in cell_diff(b, a).collect())
    assert got == [
        (0, "x", "1.0", None, "removed"), (0, "y", None, "new", "added"),
        (1, "t", "b", "B", "changed"), (1, "x", "2.0", None, "removed"), (1, "y", None, "z", "added"),
        (2, "t", "c", None, "removed"), (2, "x", None, None, "removed"),
        (3, "t", None, "d", "added"), (3, "y", None, "q", "added")]


def test_audits_same_with_and_without_codegen(spark, cust):
    def audit():
        r = clean(cust, CleanOptions(stage="none", fill_numeric="zero"))
        return sorted(tuple(x) for x in r.changed_cells.collect())
    with_cg = audit()
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        without = audit()
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "true")
    assert with_cg == without and len(with_cg) > 0


def test_cell_search_filters(spark):
    from mopup.operators.audit import cell_search
    df = spark.createDataFrame([(0, "Build", "x"), (1, None, "rebuild"), (2, "a", "b")], "row_id bigint, p string, q string")
    assert sorted(tuple(r) for r in cell_search(df, "BUILD").collect()) == [(0, "p", "Build"), (1, "q", "rebuild")]
    assert [tuple(r) for r in cell_search(df, "build", column="q").collect()] == [(1, "q", "rebuild")]
    assert sorted(tuple(r) for r in cell_search(df, "", row_id=1).collect()) == [(1, "p", ""), (1, "q", "rebuild")]


def test_chunked_aggregates_equal_single(spark, cust):
    """Very wide tables split their fused aggregates; the results must not change."""
    from mopup.functions import frames
    from mopup.operators import profile as P
    base = (Q.components(cust).collect(), P.profile_summary(cust).collect(),
            sorted(tuple(r) for r in clean(cust, CleanOptions(stage="none")).df.collect()))
    old = frames.AGG_CHUNK
    frames.AGG_CHUNK = 5
    try:
        chunked = (Q.components(cust).collect(), P.profile_summary(cust).collect(),
                   sorted(tuple(r) for r in clean(cust, CleanOptions(stage="none")).df.collect()))
    finally:
        frames.AGG_CHUNK = old
    assert base == chunked


def test_counts_equal_the_frames(spark, cust):
    """Numbers of the log and the summary against the frames they describe, in runs that use every row filter."""
    for opts in (CleanOptions(missing_strategy="drop", handle_outliers={"method": "iqr", "action": "remove"}),
                 CleanOptions(missing_strategy="fill", fill_categorical="drop", selected_outlier_rows=(1, 2, 3)),
                 CleanOptions(missing_strategy="ignore", convert_dtypes=False, drop_empty_columns=False,
                              drop_constant_columns=False, selected_outlier_rows=tuple(range(20_000)))):
        r = clean(cust.filter("row_id <> 2"), opts)
        log = {x["action"]: x["affected"] for x in r.log.collect()}
        s = r.summary.first()
        removed = {x["action"]: x["count"] for x in r.removed_rows.groupBy("action").count().collect()}
        for action, n in removed.items():
            assert log["fill_categorical" if action == "fill_categorical_drop" else action] == n, (action, log)
        assert s["rows_before"] == cust.count() - 1 and s["rows_after"] == r.df.count()
        changed = {x["action"]: x["count"] for x in r.changed_cells.groupBy("action").count().collect()}
        assert log["trim_whitespace"] == changed.get("trim_whitespace", 0)


def test_changes_of_every_step(spark):
    df = spark.createDataFrame(
        [(i, f" {i} " if i < 9 else "N/A", "x" if i == 3 else str(i), float(i) if i < 9 else 1000.0) for i in range(10)],
        "row_id bigint, a string, b string, c double")
    r = clean(df, CleanOptions(audit="all", remove_duplicates=False, handle_outliers={"method": "iqr", "action": "clip"},
                               missing_strategy="fill", fill_numeric="zero", stage="none"))
    got = {(x["row_id"], x["column"], x["action"]): (x["old_value"], x["new_value"]) for x in r.changed_cells.collect()}
    assert got[9, "a", "replace_placeholders"] == ("N/A", None)
    assert got[4, "a", "trim_whitespace"] == (" 4 ", "4")
    assert got[3, "b", "convert_dtypes"] == ("x", None)
    assert got[9, "c", "outlier_clip"] == ("1000.0", str(r.df.where("row_id = 9").first()["c"]))
    assert got[9, "a", "fill_numeric"][0] is None and got[3, "b", "fill_numeric"][0] is None
    assert len(got) == 1 + 9 + 1 + 1 + 2


def test_edits_from_a_table_equal_a_list(spark):
    df = spark.createDataFrame([(0, 1.0, "p", 5), (1, 2.0, "q", 6), (2, 3.0, None, 7)], "row_id bigint, n double, t string, i int")
    edits = [(1, "n", "7"), (2, "n", "x"), (0, "n", " "), (9, "n", "1"), (1, "zz", "1"), (0, "t", "one"), (0, "t", "two"),
             (2, "i", "9000000000"), (1, "i", "")]
    listed = [{"row_index": r, "column": c, "value": v} for r, c, v in edits]
    table = spark.createDataFrame([(r, c, v, k) for k, (r, c, v) in enumerate(edits)],
                                  "row_index bigint, column string, value string, seq int")
    a, b = TR.apply_cell_updates(df, listed), TR.apply_cell_updates(df, table)
    assert a.df.dtypes == b.df.dtypes and _sorted(a.df) == _sorted(b.df)
    assert a.count == b.count == 7 and a.retyped == b.retyped == ["n"] and set(a.columns) == set(b.columns)
    none = TR.apply_cell_updates(df, table.limit(0))
    assert none.count == 0 and _sorted(none.df) == _sorted(df)
