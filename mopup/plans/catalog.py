"""Named queries over the dirty views: one callable per operator,
each ``(spark, sf_dir) -> DataFrame``.  Oracles live in ``oracles.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col
from ..operators import audit as A
from ..operators import outliers as O
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import transforms as TR
from .clean import clean
from .fixtures import load_view
from .options import SCOPED_DEFAULTS, CleanOptions, merge_recipe

# --- fixed parameters of the catalogue queries (inputs a user would type)
CELL_EDITS = [
    {"row_index": 3, "column": "acctbal", "value": "7"},
    {"row_index": 5, "column": "acctbal", "value": " "},
    {"row_index": 99999999, "column": "acctbal", "value": "1"},
    {"row_index": 6, "column": "zz", "value": "1"},
    {"row_index": 10, "column": "nation_txt", "value": "NEW"},
    {"row_index": 12, "column": "Name", "value": "Renamed Co"},
]
MISSING_EDITS = [
    {"row_index": 7, "column": "acctbal", "value": "100"},
    {"row_index": 14, "column": "acctbal", "value": "200.5"},
    {"row_index": 21, "column": "acctbal", "value": "300"},
]
RENAMES = {"acctbal": "balance", "origin": "nation_txt", "nope": "x", "notes": "notes"}
DROP_COLS = ["notes", "origin", "missing_col"]
REMOVE_IDS = [0, 1, 2, 5, 99999999]
SEARCH = "build"
RECIPE_STEPS = [
    {"trim_whitespace": True},
    {"fill_numeric": "median"},
    {"drop_selected_columns": ["Unnamed: 7"]},
    {"column_renames": {"Mkt Segment": "segment"}},
]
CHANGED_CELLS_OPTS = {"fill_numeric": "zero", "cell_updates": [{"row_index": 1, "column": "acctbal", "value": "5"}]}
CONVERT_MAPS = {
    "convert_numeric": {"total_txt": "numeric"},
    "convert_datetime": {"order_date_txt": "datetime"},
    "convert_string": {"total_txt": "string"},
    "convert_category": {"flag_txt": "category"},
    "convert_bool": {"flag_txt": "bool"},
    "convert_auto": {"order_date_txt": "auto"},
}
REPORT_MAP = {"total_txt": "numeric", "flag_txt": "bool", "order_date_txt": "datetime"}


def scoped(**kw) -> CleanOptions:
    d = dict(SCOPED_DEFAULTS)
    d.update(kw)
    return CleanOptions.from_dict(d)


def _round(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(col(c), digits).alias(c) if c in cols else col(c)) for c in df.columns])


def _v(name):
    return lambda spark, sf: load_view(spark, sf, name)


cust, odup, otext, evg, docl, doct = (_v("customer_dirty"), _v("orders_dup"), _v("orders_text"),
                                      _v("events_gaps"), _v("documents_labeled"), _v("documents_text"))


# ------------------------------------------------------------------ customer_dirty
def q_replace_placeholders(spark, sf):
    return TR.replace_placeholders(cust(spark, sf))


def q_normalize_columns(spark, sf):
    return TR.normalize_columns(cust(spark, sf))[0]


def q_rename_columns(spark, sf):
    return TR.rename_columns(cust(spark, sf), RENAMES)[0]


def q_trim_whitespace(spark, sf):
    return clean(cust(spark, sf), scoped(rename_columns=False, trim_whitespace=True)).df


def q_auto_numeric(spark, sf):
    return clean(cust(spark, sf), scoped(rename_columns=False, convert_dtypes=True)).df


def q_drop_columns(spark, sf):
    return TR.drop_columns(cust(spark, sf), DROP_COLS)[0]


def q_drop_empty_columns(spark, sf):
    return clean(cust(spark, sf), scoped(rename_columns=False, drop_empty_columns=True)).df


def q_drop_constant_columns(spark, sf):
    return clean(cust(spark, sf), scoped(rename_columns=False, drop_constant_columns=True)).df


def _fill(strategy):
    def q(spark, sf):
        r = clean(cust(spark, sf), scoped(rename_columns=False, missing_strategy="fill",
                                          fill_numeric=strategy, fill_categorical="skip"))
        return _round(r.df, ["acctbal"])
    return q


def q_label_encode(spark, sf):
    return clean(cust(spark, sf), scoped(rename_columns=False, encode_categoricals="label")).df


def q_profile_summary(spark, sf):
    return P.profile_summary(cust(spark, sf))


def q_profile_columns(spark, sf):
    return P.profile_columns(cust(spark, sf))


def q_missing_by_column(spark, sf):
    return P.missing_by_column(cust(spark, sf))


def q_missing_rows(spark, sf):
    return P.missing_rows(cust(spark, sf))


def q_unnamed_columns(spark, sf):
    return P.unnamed_columns(cust(spark, sf))


def q_missing_remaining(spark, sf):
    return P.missing_remaining(clean(cust(spark, sf), scoped()).df)


def q_placeholder_cells(spark, sf):
    return Q.placeholder_cells(cust(spark, sf))


def q_numeric_candidates(spark, sf):
    return Q.numeric_candidates(cust(spark, sf))


def q_dq_components(spark, sf):
    return Q.components(cust(spark, sf))


def q_data_quality_score(spark, sf):
    return Q.data_quality_score(cust(spark, sf))


def q_dq_improvement(spark, sf):
    v = cust(spark, sf)
    return Q.dq_improvement(v, clean(v, CleanOptions()).df)


def q_cell_updates(spark, sf):
    return clean(cust(spark, sf), scoped(rename_columns=False, cell_updates=CELL_EDITS)).df


def q_missing_cell_updates(spark, sf):
    return clean(cust(spark, sf), scoped(rename_columns=False, missing_cell_updates=MISSING_EDITS)).df


def q_cell_search(spark, sf):
    return A.cell_search(cust(spark, sf), SEARCH)


def q_cell_diff(spark, sf):
    v = cust(spark, sf)
    return A.cell_diff(v, clean(v, scoped(rename_columns=False, trim_whitespace=True)).df)


def q_changed_cells(spark, sf):
    return clean(cust(spark, sf), CleanOptions.from_dict(CHANGED_CELLS_OPTS)).changed_cells


CHANGED_ALL_OPTS = {**CHANGED_CELLS_OPTS, "audit": "all", "handle_outliers": {"method": "iqr", "action": "clip", "multiplier": 0.5}}


def q_changed_cells_all(spark, sf):
    """A2 with the cells of C1, C7 and C15 as well."""
    return clean(cust(spark, sf), CleanOptions.from_dict(CHANGED_ALL_OPTS)).changed_cells


def table_edits(spark, sf):
    """Edits of every seventh customer's balance and market segment, some cells twice, made from the table itself."""
    v = cust(spark, sf).filter("row_id % 7 = 0")
    first = v.select(F.col("row_id").alias("row_index"), F.lit("acctbal").alias("column"),
                     F.lit("17").alias("value"), F.lit(1).alias("seq"))
    then = v.filter("row_id % 2 = 0").select("row_id", F.lit("acctbal"), F.concat(F.col("row_id").cast("string"), F.lit(".5")), F.lit(2))
    words = v.select("row_id", F.lit("Mkt Segment"), F.when(F.col("row_id") % 3 == 0, " ").otherwise(F.lit("EDITED")), F.lit(1))
    lost = v.select(F.col("row_id") + 1_000_000_000, F.lit("acctbal"), F.lit("1"), F.lit(9))
    return first.union(then).union(words).union(lost)


def q_cell_updates_table(spark, sf):
    """C3 with a table of edits."""
    return clean(cust(spark, sf), scoped(rename_columns=False, cell_updates=table_edits(spark, sf))).df


def q_operation_log(spark, sf):
    return clean(cust(spark, sf), CleanOptions()).log.select("seq", "action", "affected", "columns", "success")


def q_cleaning_completeness(spark, sf):
    return Q.cleaning_completeness(clean(cust(spark, sf), CleanOptions()).log)


def q_clean_minimal(spark, sf):
    return clean(cust(spark, sf), scoped()).df


def q_clean_recipe(spark, sf):
    return _round(clean(cust(spark, sf), merge_recipe(RECIPE_STEPS)).df, ["acctbal"])


# ------------------------------------------------------------------ orders_dup
def q_duplicate_count(spark, sf):
    return P.duplicate_count(odup(spark, sf))


def q_dedupe_full(spark, sf):
    return TR.dedupe(odup(spark, sf))


def q_dedupe_subset(spark, sf):
    return TR.dedupe(odup(spark, sf), ["cust_bucket", "o_orderstatus"])


def q_removed_rows(spark, sf):
    return clean(odup(spark, sf), scoped(remove_duplicates=True)).removed_rows


def q_drop_missing_rows(spark, sf):
    return clean(odup(spark, sf), scoped(missing_strategy="drop")).df


def q_fill_categorical_drop(spark, sf):
    return clean(odup(spark, sf), scoped(missing_strategy="fill", fill_numeric="skip",
                                         fill_categorical="drop")).df


# ------------------------------------------------------------------ orders_text
def _convert(name):
    def q(spark, sf):
        return clean(otext(spark, sf), scoped(dtype_map=CONVERT_MAPS[name])).df
    return q


def q_convert_report(spark, sf):
    return clean(otext(spark, sf), scoped(dtype_map=REPORT_MAP)).report["conversions"]


def q_coerce_numeric_like(spark, sf):
    from ..functions.exprs import coerce_numeric_like
    v = otext(spark, sf)
    return v.select("row_id", "total_txt", coerce_numeric_like(F.col("total_txt"), T.StringType()).alias("coerced"))


def q_numeric_issues(spark, sf):
    return Q.numeric_candidates(otext(spark, sf))


# ------------------------------------------------------------------ events_gaps
def q_iqr_bounds(spark, sf):
    v = evg(spark, sf)
    b = O.iqr_bounds(v)
    return _round(O.bounds_frame(v, b), ["q1", "q3", "lower", "upper"])


def q_detect_outliers(spark, sf):
    return O.detect_outliers(evg(spark, sf))


def q_outlier_review(spark, sf):
    """O2 as a review screen shows it: the first 100 flagged rows, column by column
    then by row id (the cap is the feature: a top-k, not a sample)."""
    rows, _ = O.outlier_listing(evg(spark, sf), max_rows=100)
    return rows


def q_remove_rows(spark, sf):
    return clean(evg(spark, sf), scoped(selected_outlier_rows=REMOVE_IDS)).df


def q_outlier_remove(spark, sf):
    return clean(evg(spark, sf), scoped(handle_outliers={"method": "iqr", "action": "remove"})).df


def q_outlier_clip(spark, sf):
    r = clean(evg(spark, sf), scoped(handle_outliers={"method": "iqr", "action": "clip"})).df
    return _round(r, ["user_id", "value"])


def q_fill_categorical_mode(spark, sf):
    return clean(evg(spark, sf), scoped(missing_strategy="fill", fill_numeric="skip",
                                        fill_categorical="mode")).df


def q_fill_categorical_constant(spark, sf):
    return clean(evg(spark, sf), scoped(missing_strategy="fill", fill_numeric="skip",
                                        fill_categorical="constant", categorical_constant="no_type")).df


def q_preview(spark, sf):
    return P.preview(evg(spark, sf))


# ------------------------------------------------------------------ documents
def q_clean_default(spark, sf):
    return _round(clean(docl(spark, sf), CleanOptions()).df, ["quality", "toxic"])


def q_clean_summary(spark, sf):
    return clean(docl(spark, sf), CleanOptions()).summary


def q_detect_outliers_after_clean(spark, sf):
    return O.detect_outliers(clean(docl(spark, sf), scoped()).df)


def q_read_csv_roundtrip(spark, sf):
    """The dirty customer view written as a ';'-separated latin-1 file set
    in the shared scratch folder, then read back with separator sniffing, charset
    choice, header repair, read-time NA tokens and type inference."""
    from ..session import scratch_path
    from ..sources.readers import read_table
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "customer_dirty") + ".csv"
    write_csv(cust(spark, sf), path, key=None, sep=";", encoding="ISO-8859-1")
    return read_table(spark, path, fmt="csv", key="row_id").df


# ------------------------------------------------------------------ exact integers, mixed dates
def q_auto_bigint(spark, sf):
    """C7 over ids beyond 2^53, neighbours of which share a DOUBLE."""
    return clean(load_view(spark, sf, "orders_ids"), scoped(convert_dtypes=True)).df


def q_clean_bigint_ids(spark, sf):
    return clean(load_view(spark, sf, "orders_ids"), CleanOptions()).df


BIG_EDITS = [{"row_index": 1, "column": "big_id", "value": "1234567890123456789"},
             {"row_index": 2, "column": "big_id", "value": " "}]


def q_cell_update_bigint(spark, sf):
    return clean(load_view(spark, sf, "orders_bigint"), scoped(cell_updates=BIG_EDITS)).df


def q_convert_datetime_mixed(spark, sf):
    return clean(load_view(spark, sf, "orders_dates"), scoped(dtype_map={"when_txt": "datetime"})).df


# ------------------------------------------------------------------ readers over written files
def q_read_header_order(spark, sf):
    """A folder of files whose headers differ in order, and in one column each."""
    from ..session import scratch_path
    from ..sources.readers import read_table
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "headers")
    v = load_view(spark, sf, "customer_notes")
    mine = [c for c in v.columns if c != "row_id"]
    write_csv(v.where("row_id % 2 = 0").withColumn("even", F.lit("e")), path + "/a.csv", key=None)
    write_csv(v.where("row_id % 2 = 1").select("row_id", *mine[::-1], F.lit("o").alias("odd")), path + "/b.csv", key=None, sep=";")
    return read_table(spark, path + "/*.csv", fmt="csv", key="row_id").df


def q_read_quoted_newlines(spark, sf):
    """Quoted cells with separators, quotes and line breaks."""
    from ..session import scratch_path
    from ..sources.readers import read_table
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "quoted") + ".csv"
    write_csv(load_view(spark, sf, "customer_notes"), path, key=None, sep=";")
    return read_table(spark, path, fmt="csv", key="row_id").df


def q_read_mixed_charset(spark, sf):
    """One folder of UTF-8 files, one of ISO-8859-1 files, read as one table."""
    from ..session import scratch_path
    from ..sources.readers import read_table
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "charsets")
    v = load_view(spark, sf, "customer_notes")
    write_csv(v.where("row_id % 2 = 0"), f"{path}/a", key=None)
    write_csv(v.where("row_id % 2 = 1"), f"{path}/b", key=None, encoding="ISO-8859-1")
    return read_table(spark, f"{path}/*", fmt="csv", key="row_id").df


def q_read_json_array(spark, sf):
    """S3: files that each hold an array of up to a thousand records."""
    from ..session import scratch_path
    from ..sources.readers import read_table
    path = scratch_path(spark, "arrays") + ".json"
    v = load_view(spark, sf, "customer_notes")
    arrays = v.groupBy(F.floor(F.col("row_id") / 1000)).agg(
        F.to_json(F.collect_list(F.struct("row_id", "note", "name"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_table(spark, path, key="row_id").df


def q_read_tsv(spark, sf):
    """S2."""
    from ..session import scratch_path
    from ..sources.readers import read_table
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "tabs") + ".tsv"
    write_csv(load_view(spark, sf, "orders_dup"), path, key=None, sep="\t")
    return read_table(spark, path, key="row_id").df


def _write_raw(spark, lines: DataFrame, header: str, name: str) -> str:
    """Lines written as they are, below a header line in each file."""
    from ..session import scratch_path
    path = scratch_path(spark, name) + ".csv"
    (lines.toDF(header).write.option("header", True).option("quote", "").option("sep", "\x01")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def q_read_rejects(spark, sf):
    """The lines with more fields than the header."""
    from ..sources.readers import read_table
    v = load_view(spark, sf, "orders_dup")
    line = F.concat_ws(",", "row_id", "o_orderstatus", F.when(F.col("row_id") % 10 == 0, "surplus"))
    path = _write_raw(spark, v.select(line), "row_id,o_orderstatus", "rejects")
    return read_table(spark, path, key="row_id").rejects.select("line")


def q_read_header_repair(spark, sf):
    """A blank name and a repeated one."""
    from ..sources.readers import read_table
    v = load_view(spark, sf, "orders_dup")
    line = F.concat_ws(",", "row_id", "cust_bucket", "o_orderstatus", F.lit("x"))
    path = _write_raw(spark, v.select(line), "row_id,a,a,", "header")
    return read_table(spark, path, key="row_id").df


def q_write_report(spark, sf):
    """A cleaning report's removed rows, written as JSON and read again."""
    import os
    from ..session import scratch_path
    from ..sources.sinks import write_report
    path = scratch_path(spark, "report")
    r = clean(load_view(spark, sf, "orders_dup"), scoped(remove_duplicates=True))
    write_report({"removed_rows": r.report_frames()["removed_rows"]}, path)
    return spark.read.json(os.path.join(path, "removed_rows")).select("row_id", "action", "detail")


def q_json_safe(spark, sf):
    from ..sources.sinks import json_safe
    return json_safe(load_view(spark, sf, "events_odd"))


def q_missing_rows_data(spark, sf):
    """P7 with the rows' cells."""
    out = P.missing_rows(load_view(spark, sf, "orders_dup"), include_row_data=True)
    return out.select("row_id", "missing_columns", "missing_count", F.col("row_data")["cust_bucket"].alias("cust_bucket"),
                      F.col("row_data")["o_orderpriority"].alias("o_orderpriority"))


def q_completeness_with_failure(spark, sf):
    """D12 where a requested conversion has an unknown target: that step fails, the others go on."""
    opts = scoped(dtype_map={"total_txt": "no_such_type", "flag_txt": "bool"}, trim_whitespace=True)
    return Q.cleaning_completeness(clean(otext(spark, sf), opts).log)


def q_cell_diff_versions(spark, sf):
    """A3 with rows and columns on one side only."""
    v = cust(spark, sf)
    before = v.where("row_id % 5 <> 0").select("row_id", "nation_txt", "origin")
    after = v.where("row_id % 7 <> 0").select("row_id", F.upper("nation_txt").alias("nation_txt"), F.lit("n").alias("note"))
    return A.cell_diff(before, after)


def q_missing_remaining_after_fill(spark, sf):
    """P10 after empty columns are dropped and numbers filled."""
    return P.missing_remaining(clean(cust(spark, sf), scoped(
        drop_empty_columns=True, missing_strategy="fill", fill_numeric="zero", fill_categorical="skip")).df)


def q_detect_outliers_after_fill(spark, sf):
    """O3: the outliers of a table whose gaps were filled."""
    return O.detect_outliers(clean(evg(spark, sf), scoped(
        missing_strategy="fill", fill_numeric="zero", fill_categorical="skip")).df)


def q_outlier_totals(spark, sf):
    """O2: the totals of the review screen."""
    return O.outlier_listing(evg(spark, sf), max_rows=100)[1]


def q_lineitem_quality(spark, sf):
    """D1-D10 over every row of the largest table.  It has no unique key, and the
    score needs no row identity (every count is over values), so no ids are built
    and nothing is staged: a scan, the quantile passes and one aggregate."""
    import os
    return Q.components(spark.read.parquet(os.path.join(sf, "lineitem.parquet")))


STREAM_OPTS = dict(trim_whitespace=True, missing_strategy="drop", dtype_map={"nation_txt": "numeric"},
                   column_renames={"mkt_segment": "segment"}, drop_selected_columns=["notes", "unnamed:_8"])


def _customer_stream(spark, sf):
    """The dirty customer view over a stream of the customer table, a file or a folder of files."""
    import os
    from .fixtures import view_over
    schema = spark.read.parquet(os.path.join(sf, "customer.parquet")).schema
    # a pattern that fits just this name: a stream's plain path must be a folder
    src = spark.readStream.schema(schema).parquet(os.path.join(sf, "customer.parque[t]"))
    return view_over(spark, "customer_dirty", {"customer": src})


def q_stream_clean(spark, sf):
    """The row-local steps on a Structured Streaming file source over the customer
    table: C1, C2, C5, C6, C8b, C9, C16 per micro-batch into a Parquet sink."""
    from ..session import scratch_path
    from ..streaming.narrow import clean_stream, run_to_table
    stream = clean_stream(_customer_stream(spark, sf), scoped(**STREAM_OPTS))
    return run_to_table(stream, scratch_path(spark, "stream_clean"))


def q_stream_profile(spark, sf):
    """P1/P6 counts kept as streaming state over a file source of the customer table."""
    from ..streaming.narrow import run_profile, running_profile
    return run_profile(running_profile(_customer_stream(spark, sf)))


def q_dedupe_text(spark, sf):
    return TR.dedupe(doct(spark, sf), ["text"])


QUERIES = {
    "replace_placeholders": q_replace_placeholders,
    "normalize_columns": q_normalize_columns,
    "rename_columns": q_rename_columns,
    "trim_whitespace": q_trim_whitespace,
    "auto_numeric": q_auto_numeric,
    "drop_columns": q_drop_columns,
    "drop_empty_columns": q_drop_empty_columns,
    "drop_constant_columns": q_drop_constant_columns,
    "fill_numeric_mean": _fill("mean"),
    "fill_numeric_median": _fill("median"),
    "fill_numeric_zero": _fill("zero"),
    "fill_numeric_constant": _fill("123.5"),
    "label_encode": q_label_encode,
    "profile_summary": q_profile_summary,
    "profile_columns": q_profile_columns,
    "missing_by_column": q_missing_by_column,
    "missing_rows": q_missing_rows,
    "unnamed_columns": q_unnamed_columns,
    "missing_remaining": q_missing_remaining,
    "placeholder_cells": q_placeholder_cells,
    "numeric_candidates": q_numeric_candidates,
    "dq_components": q_dq_components,
    "data_quality_score": q_data_quality_score,
    "dq_improvement": q_dq_improvement,
    "cell_updates": q_cell_updates,
    "missing_cell_updates": q_missing_cell_updates,
    "cell_search": q_cell_search,
    "cell_diff": q_cell_diff,
    "changed_cells": q_changed_cells,
    "changed_cells_all": q_changed_cells_all,
    "cell_updates_table": q_cell_updates_table,
    "operation_log": q_operation_log,
    "cleaning_completeness": q_cleaning_completeness,
    "clean_minimal": q_clean_minimal,
    "clean_recipe": q_clean_recipe,
    "duplicate_count": q_duplicate_count,
    "dedupe_full": q_dedupe_full,
    "dedupe_subset": q_dedupe_subset,
    "removed_rows": q_removed_rows,
    "drop_missing_rows": q_drop_missing_rows,
    "fill_categorical_drop": q_fill_categorical_drop,
    "convert_numeric": _convert("convert_numeric"),
    "convert_datetime": _convert("convert_datetime"),
    "convert_string": _convert("convert_string"),
    "convert_category": _convert("convert_category"),
    "convert_bool": _convert("convert_bool"),
    "convert_auto": _convert("convert_auto"),
    "convert_report": q_convert_report,
    "coerce_numeric_like": q_coerce_numeric_like,
    "numeric_issues": q_numeric_issues,
    "iqr_bounds": q_iqr_bounds,
    "detect_outliers": q_detect_outliers,
    "outlier_review": q_outlier_review,
    "remove_rows": q_remove_rows,
    "outlier_remove": q_outlier_remove,
    "outlier_clip": q_outlier_clip,
    "fill_categorical_mode": q_fill_categorical_mode,
    "fill_categorical_constant": q_fill_categorical_constant,
    "preview": q_preview,
    "clean_default": q_clean_default,
    "clean_summary": q_clean_summary,
    "detect_outliers_after_clean": q_detect_outliers_after_clean,
    "dedupe_text": q_dedupe_text,
    "read_csv_roundtrip": q_read_csv_roundtrip,
    "lineitem_quality": q_lineitem_quality,
    "auto_bigint": q_auto_bigint,
    "clean_bigint_ids": q_clean_bigint_ids,
    "cell_update_bigint": q_cell_update_bigint,
    "convert_datetime_mixed": q_convert_datetime_mixed,
    "read_header_order": q_read_header_order,
    "read_quoted_newlines": q_read_quoted_newlines,
    "read_mixed_charset": q_read_mixed_charset,
    "read_json_array": q_read_json_array,
    "read_tsv": q_read_tsv,
    "read_rejects": q_read_rejects,
    "read_header_repair": q_read_header_repair,
    "write_report": q_write_report,
    "json_safe": q_json_safe,
    "missing_rows_data": q_missing_rows_data,
    "outlier_totals": q_outlier_totals,
    "completeness_with_failure": q_completeness_with_failure,
    "cell_diff_versions": q_cell_diff_versions,
    "missing_remaining_after_fill": q_missing_remaining_after_fill,
    "detect_outliers_after_fill": q_detect_outliers_after_fill,
    "stream_clean": q_stream_clean,
    "stream_profile": q_stream_profile,
}
