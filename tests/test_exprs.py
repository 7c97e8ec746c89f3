"""Expression builders: placeholder vocabularies (M15), names (M5, M17),
lenient and strict number parses (M9, §2.10), bool mapping (M6)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mopup.functions import exprs as X
from mopup.operators import transforms as TR


def _one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id bigint, v {typ}")


def test_placeholder_vocabularies_m15(spark):
    vals = ["unknown", "Unknown", " - ", "###x", "##"]
    df = _one_col(spark, vals)
    got = df.orderBy("row_id").select(
        X.placeholder_expr("v", "clean").alias("clean"),
        X.placeholder_expr("v", "analyze").alias("analyze"),
        X.score_placeholder_expr("v", T.StringType()).alias("score"),
        X.placeholder_expr("v", "outlier").alias("outlier")).collect()
    assert [r["clean"] for r in got] == [True, False, True, True, False]
    assert [r["analyze"] for r in got] == [False, False, True, True, False]
    assert [r["score"] for r in got] == [True, True, True, False, True]
    assert [r["outlier"] for r in got] == [False, False, True, True, False]


def test_normalize_names_m5_m17():
    assert X.normalize_name(" First Name ") == "first_name"
    assert X.normalize_name("Prix €") == "prix__"
    assert TR.normalized_names(["A b", "a_b"]) == {"A b": "a_b", "a_b": "a_b_2"}


def test_coerce_numeric_like_m9(spark):
    vals = ["$1,200", "1.234.567", "1.234", "1.234.5", "12.5", "€ 3", "x1"]
    df = _one_col(spark, vals)
    got = [r[0] for r in df.orderBy("row_id").select(X.coerce_numeric_like(F.col("v"), T.StringType())).collect()]
    assert got == [1200.0, 1234567.0, 1234.0, 12345.0, 12.5, 3.0, None]


def test_strict_number_parse(spark):
    vals = [".5", "5.", "+3", "1e5", " 5 ", "1d", "1f", "1_000", "0x10", "1,000", "inf", "nan", ""]
    df = _one_col(spark, vals)
    got = [r[0] for r in df.orderBy("row_id").select(X.parse_number(F.col("v"))).collect()]
    assert got == [0.5, 5.0, 3.0, 100000.0, 5.0, None, None, None, None, None, None, None, None]


def test_unicode_strip(spark):
    df = _one_col(spark, [" x　", "\t y \n", "z"])
    got = [r[0] for r in df.orderBy("row_id").select(X.strip_ws(F.col("v"))).collect()]
    assert got == ["x", "y", "z"]


def test_bool_tokens_m6(spark):
    df = _one_col(spark, ["yes", "NO", "1", "0", "maybe", "tRue", None])
    got = [r[0] for r in df.orderBy("row_id").select(X.to_bool(F.col("v"), T.StringType())).collect()]
    assert got == [True, False, True, False, None, None, None]


def test_timestamp_layouts(spark):
    df = _one_col(spark, ["2024-01-02", "2024-01-02 03:04:05", "01/02/2024", "2024/01/02", "05-Mar-2024",
                          "2024", "not a date", "2024-13-45"])
    got = [r[0] for r in df.orderBy("row_id").select(X.parse_timestamp(F.col("v"))).collect()]
    assert [g.isoformat() if g else None for g in got] == [
        "2024-01-02T00:00:00", "2024-01-02T03:04:05", "2024-01-02T00:00:00", "2024-01-02T00:00:00",
        "2024-03-05T00:00:00", None, None, None]


def test_timestamp_parse_ignores_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = _one_col(spark, ["2024-03-10 02:30", "03/10/2024 02:30:00", "10-Mar-2024"])
        got = [r[0] for r in df.orderBy("row_id").select(X.parse_timestamp(F.col("v"))).collect()]
        sql = [r[0] for r in df.orderBy("row_id").select(X.timestamp_expr("v")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [g.isoformat() for g in got] == ["2024-03-10T02:30:00", "2024-03-10T02:30:00", "2024-03-10T00:00:00"]
    assert got == sql
