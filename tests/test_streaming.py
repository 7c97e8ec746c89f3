"""Row-local cleaning and the running profile on a file stream over the driver's
parquet tables, checked against the batch operators."""

import pytest

from mopup.operators import profile as P
from mopup.plans.clean import clean
from mopup.plans.fixtures import load_view, view_sql
from mopup.plans.options import SCOPED_DEFAULTS, CleanOptions
from mopup.streaming.narrow import clean_stream, running_profile

SF = "/root/testdata/sf0.001"


def _stream_view(spark, name, table):
    schema = spark.read.parquet(f"{SF}/{table}.parquet").schema
    s = (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
         .option("maxFilesPerTrigger", 1).parquet(SF))
    s.createOrReplaceTempView(table)
    return spark.sql(view_sql(name))


def _run(df, mode, qname):
    q = df.writeStream.format("memory").queryName(qname).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"select * from {qname}")


def test_clean_stream_matches_batch(spark):
    opts = dict(SCOPED_DEFAULTS, trim_whitespace=True, missing_strategy="drop",
                # every kept column listed: in batch, unlisted columns are "auto", which a
                # stream cannot decide without statistics of the whole table
                dtype_map={"nation_txt": "numeric", "unnamed:_7": "string", "name": "string",
                           "mkt_segment": "string", "acctbal": "numeric", "origin": "string"},
                column_renames={"mkt_segment": "segment"},
                drop_selected_columns=["notes", "unnamed:_8"])
    out = _run(clean_stream(_stream_view(spark, "customer_dirty", "customer"), opts), "append", "cs_out")
    ref = clean(load_view(spark, SF, "customer_dirty"), CleanOptions.from_dict(opts)).df
    assert out.columns == ref.columns and ref.count() > 0
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in ref.collect())


def test_stream_refuses_table_steps(spark):
    with pytest.raises(ValueError):
        clean_stream(_stream_view(spark, "customer_dirty", "customer"), CleanOptions())


def test_running_profile(spark):
    out = _run(running_profile(_stream_view(spark, "customer_dirty", "customer")), "complete", "prof_out")
    r = out.collect()[0].asDict()
    ref = {x["column"]: x["missing"] for x in P.missing_by_column(load_view(spark, SF, "customer_dirty")).collect()}
    assert r["rows"] == 150
    assert r["missing__mkt_segment"] == ref["Mkt Segment"] and r["missing__notes"] == ref["notes"]
