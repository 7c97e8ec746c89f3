"""Profiling P1-P10.  Everything but the dtypes is computed after the profiling
placeholder set has been replaced on text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions import exprs as X
from ..functions.exprs import col
from ..functions.frames import agg_chunked, side_by_side
from .transforms import KEY, data_columns, replace_placeholders, row_digest


def analyzed(df: DataFrame, key: str = KEY) -> DataFrame:
    return replace_placeholders(df, key, vocab="analyze")


def _null_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: _rows, then one null count per data column (m0, m1, ...)."""
    cs = data_columns(df, key)
    return agg_chunked(df, [F.count(F.lit(1)).alias("_rows"),
                            *[F.count(F.when(col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cs)]])


def _long(df: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Null counts in long form: (position, column, missing, rows)."""
    cs = data_columns(df, key)
    if not cs:
        return counts.select(F.lit(0).alias("position"), F.lit("").alias("column"),
                             F.lit(0).cast("bigint").alias("missing"), F.col("_rows").alias("rows")).limit(0)
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                             F.col(f"m{i}").alias("missing")) for i, c in enumerate(cs)])
    return counts.select(F.col("_rows").alias("rows"), F.inline(arr)).select(
        "position", "column", "missing", "rows")


def duplicate_count(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row (rows, distinct_rows, duplicate_count); null equals null.
    Rows meet by a 128-bit digest, combined map-side: no data column is shuffled."""
    cs = data_columns(df, key)
    groups = df.select(*row_digest(df, cs)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
                      F.count(F.lit(1)).cast("bigint").alias("distinct_rows")).select(
        "rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_count"))


def profile_summary(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows, cols, missing_count, missing_percent, duplicate_count."""
    a = analyzed(df, key)
    cs = data_columns(a, key)
    n = len(cs)
    counts = _null_counts(a, key)
    tot = X.sum_all([F.col(f"m{i}") for i in range(n)])
    dup = duplicate_count(a, key).select("duplicate_count")
    cells = F.col("_rows") * F.lit(n) if n > 0 else F.lit(1)
    return side_by_side(counts, dup).select(
        F.col("_rows").cast("bigint").alias("rows"), F.lit(n).cast("bigint").alias("cols"),
        tot.cast("bigint").alias("missing_count"),
        F.when(cells == 0, F.lit(0.0)).otherwise(F.round(tot * 100.0 / cells, 2)).alias("missing_percent"),
        F.col("duplicate_count"))


def profile_columns(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row per column with raw dtype, missing / non-missing and emptiness."""
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    a = analyzed(df, key)
    lg = _long(a, key, _null_counts(a, key))
    m = F.create_map(*[x for c in data_columns(a, key) for x in (F.lit(c), F.lit(dtypes[c]))]) \
        if data_columns(a, key) else None
    return lg.select(
        "position", "column", (m[F.col("column")] if m is not None else F.lit(None)).alias("dtype"),
        F.col("missing").cast("bigint").alias("missing"),
        (F.col("rows") - F.col("missing")).cast("bigint").alias("non_missing"),
        (F.col("missing") == F.col("rows")).alias("is_empty"))


def missing_by_column(df: DataFrame, key: str = KEY, analyze: bool = True) -> DataFrame:
    """P6 (and P10 with ``analyze=False``): columns with missing cells:
    (position, column, missing, percent)."""
    a = analyzed(df, key) if analyze else df
    lg = _long(a, key, _null_counts(a, key))
    return lg.where(F.col("missing") > 0).select(
        "position", "column", F.col("missing").cast("bigint").alias("missing"),
        F.when(F.col("rows") == 0, F.lit(0.0))
         .otherwise(F.round(F.col("missing") * 100.0 / F.col("rows"), 2)).alias("percent"))


def missing_rows(df: DataFrame, key: str = KEY, analyze: bool = True, include_row_data: bool = False) -> DataFrame:
    """Rows with a missing cell: (row_id, missing_columns, missing_count[, row_data]), ``row_data``
    being a map from column to text, empty for missing cells."""
    from .transforms import missing_any, missing_list, row_data
    a = analyzed(df, key) if analyze else df
    cs = data_columns(a, key)
    if not cs:
        return a.select(col(key).cast("bigint").alias(key), F.lit("").alias("missing_columns"),
                        F.lit(0).alias("missing_count")).limit(0)
    n = X.sum_all([F.when(col(c).isNull(), 1).otherwise(0) for c in cs])
    return a.where(missing_any(a, key)).select(
        col(key).cast("bigint").alias(key), missing_list(a, key).alias("missing_columns"),
        n.cast("bigint").alias("missing_count"),
        *([row_data(a, key).alias("row_data")] if include_row_data else []))


def unnamed_columns(df: DataFrame, key: str = KEY) -> DataFrame:
    """Columns named ``unnamed…``: non-missing, missing, percent, safe_to_drop."""
    a = analyzed(df, key)
    lg = _long(a, key, _null_counts(a, key))
    return lg.where(F.lower(X.strip_ws(F.col("column"))).startswith("unnamed")).select(
        "position", "column",
        (F.col("rows") - F.col("missing")).cast("bigint").alias("non_missing"),
        F.col("missing").cast("bigint").alias("missing"),
        F.when(F.col("rows") == 0, F.lit(0.0))
         .otherwise(F.round(F.col("missing") * 100.0 / F.col("rows"), 2)).alias("percent_missing"),
        (F.col("rows") == F.col("missing")).alias("safe_to_drop"))


def preview(df: DataFrame, key: str = KEY, n: int = tokens.PREVIEW_ROWS, analyze: bool = True) -> DataFrame:
    """First ``n`` rows in key order (a top-k: TakeOrderedAndProject),
    timestamps as ``yyyy-MM-dd HH:mm:ss`` text."""
    a = analyzed(df, key) if analyze else df
    sel = []
    for f in a.schema.fields:
        if X.is_temporal(f.dataType):
            sel.append(F.date_format(col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            sel.append(col(f.name))
    return a.orderBy(col(key)).limit(n).select(*sel)


def missing_remaining(df: DataFrame, key: str = KEY) -> DataFrame:
    """P10 on a cleaned table: per column (missing, percent) plus the table's
    missing_total and rows_with_missing, repeated on each row.  One aggregate
    computes all of it; the totals ride along when the row is unpivoted."""
    from .transforms import missing_any
    cs = data_columns(df, key)
    tot = X.sum_all([F.when(col(c).isNull(), 1).otherwise(0) for c in cs])
    counts = agg_chunked(df, [F.count(F.lit(1)).alias("_rows"),
                              *[F.count(F.when(col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cs)],
                              F.coalesce(F.sum(tot), F.lit(0)).cast("bigint").alias("missing_total"),
                              F.count(F.when(missing_any(df, key), 1)).cast("bigint").alias("rows_with_missing")])
    if not cs:
        return counts.select(F.lit(0).alias("position"), F.lit("").alias("column"),
                             F.lit(0).cast("bigint").alias("missing"), F.lit(0.0).alias("percent"),
                             "missing_total", "rows_with_missing").limit(0)
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                             F.col(f"m{i}").alias("missing")) for i, c in enumerate(cs)])
    lg = counts.select(F.col("_rows").alias("rows"), "missing_total", "rows_with_missing", F.inline(arr))
    return lg.where(F.col("missing") > 0).select(
        "position", "column", F.col("missing").cast("bigint").alias("missing"),
        F.when(F.col("rows") == 0, F.lit(0.0))
         .otherwise(F.round(F.col("missing") * 100.0 / F.col("rows"), 2)).alias("percent"),
        "missing_total", "rows_with_missing")


def profile(df: DataFrame, key: str = KEY, preview_rows: int = tokens.PREVIEW_ROWS) -> dict:
    """Everything the analysis step reports, as lazy DataFrames: summary (P1-P3),
    columns (P4/P5), missing_by_column (P6), missing_rows (P7), unnamed_columns
    (P8) and preview (P9)."""
    return {
        "summary": profile_summary(df, key),
        "columns": profile_columns(df, key),
        "missing_by_column": missing_by_column(df, key),
        "missing_rows": missing_rows(df, key),
        "unnamed_columns": unnamed_columns(df, key),
        "preview": preview(df, key, preview_rows),
    }
