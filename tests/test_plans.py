"""Plan shape: one fused scan aggregate for profiling, no Python
UDF anywhere, no unpartitioned window, filters and pruning reach the scan."""

import pytest

from mopup.operators import profile as P
from mopup.operators import quality as Q
from mopup.operators import transforms as TR
from mopup.plans.catalog import QUERIES
from mopup.plans.clean import clean
from mopup.plans.fixtures import load_view
from mopup.plans.options import CleanOptions

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_by_column_is_one_aggregate(spark):
    p = plan(P.missing_by_column(load_view(spark, SF, "customer_dirty")))
    assert p.count("HashAggregate") <= 2          # partial + final of the single fused agg
    assert "Exchange hashpartitioning" not in p   # global agg: single partition exchange only


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_and_no_global_window(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    for line in p.splitlines():
        if "SortAggregate(" in line:           # only key-less (streaming) global aggregates
            assert "SortAggregate(key=[]" in line, line
    for line in p.splitlines():
        if "Window [" in line:
            assert "partitionBy" in line or "specifiedwindowframe" in line.lower()


def test_dedupe_uses_partial_aggregation(spark):
    p = plan(TR.dedupe(load_view(spark, SF, "orders_dup")))
    assert p.count("HashAggregate") >= 2 or "ObjectHashAggregate" in p


def test_remove_rows_pushes_key_filter(spark):
    v = load_view(spark, SF, "events_gaps")
    p = plan(TR.remove_rows(v, [1, 2, 3]))
    assert "PushedFilters" in p and "event_id" in p


def test_scan_prunes_columns(spark):
    v = load_view(spark, SF, "events_gaps").select("row_id", "value")
    p = plan(v)
    assert "ReadSchema: struct<event_id:bigint,value:double>" in p


def test_clean_default_plan_has_no_cartesian(spark):
    r = clean(load_view(spark, SF, "documents_labeled"), CleanOptions(stage="none"))
    p = plan(r.df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    sc = plan(Q.components(load_view(spark, SF, "customer_dirty")))
    assert "CartesianProduct" not in sc


def test_audit_frames_read_the_table_once(spark):
    """The counts of the log and the summary come from the passes that decide the steps; changed cells take one
    pass over the input and one over the deduplicated table."""
    r = clean(load_view(spark, SF, "customer_dirty"), CleanOptions())
    assert plan(r.log).count("FileScan") == 0 and plan(r.summary).count("FileScan") == 0
    assert plan(r.changed_cells).count("FileScan") <= 2
    every = clean(load_view(spark, SF, "customer_dirty"), CleanOptions(
        audit="all", handle_outliers={"method": "iqr", "action": "clip"}))
    assert plan(every.changed_cells).count("FileScan") <= 2
    scoped = clean(load_view(spark, SF, "customer_dirty"), CleanOptions(
        drop_empty_columns=False, drop_constant_columns=False, convert_dtypes=False, remove_duplicates=False,
        missing_strategy="drop", stage="none"))
    assert plan(scoped.log).count("FileScan") <= 2


def test_dedupe_shuffles_no_text(spark):
    docs = load_view(spark, SF, "documents_labeled")
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "row_id").select("row_id", "text", "lang")
    for p in (plan(TR.dedupe(df)), plan(TR.duplicate_removals(df))):
        for line in p.splitlines():
            if "Exchange hashpartitioning" in line:
                assert "text#" not in line and "lang#" not in line, line
    assert "text" in df.columns and docs.columns


def _exchanged(df) -> str:
    """The plan's lines at and below each shuffle that name a column of the table."""
    return "\n".join(line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line)


def test_modes_shuffle_no_values(spark, monkeypatch):
    """A near-unique text column is counted by digest."""
    from pyspark.sql.classic.dataframe import DataFrame
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (plans.append(plan(self)), collect(self))[1])
    df = spark.range(4000).selectExpr("id as row_id", "concat('text ', cast(id div 2 * 2 + (case when id > 3996 then id else 0 end) as string)) as t",
                                      "cast(id % 3 as string) as few", "cast(id as string) as unique")
    assert TR.modes(df, ["t", "few", "unique"]) == {"t": "text 0", "few": "0", "unique": "0"}
    assert len(plans) == 2
    for p in plans:
        for line in p.splitlines():
            if "Exchange hashpartitioning" in line:
                assert ", v#" not in line and "(v#" not in line, line


def test_labels_of_a_wide_column_stop_early(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (plans.append(plan(self)), collect(self))[1])
    df = spark.range(20_000).selectExpr("id as row_id", "cast(id as string) as wide", "cast(id % 999 as string) as near",
                                        "case when id % 2 = 0 then 'x' end as gaps", "'same' as one")
    out, done = TR.label_encode(df)
    assert done == ["near", "gaps", "one"]
    assert all("wide" not in p or "hashpartitioning(wide" not in p for p in plans)
    assert sorted({r["near"] for r in out.collect()}) == list(range(999))
    edge = spark.range(10_000).selectExpr("id as row_id", "cast(id % 1000 as string) as thousand", "cast(id % 1001 as string) as more")
    assert TR.label_encode(edge)[1] == ["thousand"]


def test_cell_diff_shuffles_changed_rows_only(spark):
    from mopup.operators.audit import cell_diff
    before = spark.range(5000).selectExpr("id as row_id", "concat('t', id) as text", "id * 2.5 as x")
    after = before.selectExpr("row_id", "case when row_id % 1000 = 7 then 'new' else text end as text", "x").where("row_id <> 3")
    d = cell_diff(before, after)
    assert sorted((r["row_id"], r["column"], r["change"]) for r in d.collect()) == sorted(
        [(i, "text", "changed") for i in range(7, 5000, 1000)] + [(3, "text", "removed"), (3, "x", "removed")])
    assert "BroadcastHashJoin" in plan(d) and "LeftSemi" in plan(d)
