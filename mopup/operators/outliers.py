"""Outlier review and handling: O1-O3, C14, C15 (IQR rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import col
from . import stats
from .transforms import KEY, _select_replacing, change, numeric_columns, replace_placeholders, row_data, with_changes


def iqr_bounds(df: DataFrame, cols: list[str] | None = None, multiplier: float = 1.5,
               method: str = "exact", key: str = KEY) -> dict:
    """O1: {col: {n, min, max, q1, q3, lower, upper}} (None bounds for columns without values)."""
    cols = numeric_columns(df, key) if cols is None else cols
    q = stats.quantiles(df, cols, probs=(0.25, 0.75), method=method)
    out = {}
    for c in cols:
        q1, q3 = q[c][0.25], q[c][0.75]
        if q1 is None:
            out[c] = {"n": q[c]["n"], "min": None, "max": None, "q1": None, "q3": None, "lower": None, "upper": None}
            continue
        iqr = q3 - q1
        out[c] = {"n": q[c]["n"], "min": q[c]["min"], "max": q[c]["max"], "q1": q1, "q3": q3,
                  "lower": q1 - multiplier * iqr, "upper": q3 + multiplier * iqr}
    return out


def outlier_flag(c: str, b: dict) -> Column:
    """True when the value lies outside the bounds; nulls and NaN are never outliers."""
    if b.get("lower") is None:
        return F.lit(False)
    x = col(c)
    outside = (x < F.lit(b["lower"])) | ((x > F.lit(b["upper"])) & ~F.isnan(x.cast("double")))
    return F.coalesce(outside, F.lit(False))


def has_outliers(b: dict) -> bool:
    return b.get("lower") is not None and (b["min"] < b["lower"] or b["max"] > b["upper"])


def bounds_frame(df: DataFrame, bounds: dict, with_counts: bool = True) -> DataFrame:
    """Bounds as a DataFrame, one row per column, plus the number of flagged cells
    (one lazy aggregate over ``df``)."""
    spark = df.sparkSession
    rows = [(i, c, b["n"], b["q1"], b["q3"], b["lower"], b["upper"]) for i, (c, b) in enumerate(bounds.items())]
    bf = spark.createDataFrame(rows, "position int, column string, n_values bigint, q1 double, q3 double, "
                                     "lower double, upper double")
    if not with_counts or not bounds:
        return bf
    counts = df.agg(*[F.count(F.when(outlier_flag(c, b), 1)).alias(f"o{i}")
                      for i, (c, b) in enumerate(bounds.items())])
    stack = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"o{i}").alias("n_outliers"))
                      for i in range(len(bounds))])
    counts = counts.select(F.inline(stack))
    return bf.join(F.broadcast(counts), "position").orderBy("position")


def detect_outliers(df: DataFrame, multiplier: float = 1.5, method: str = "exact", key: str = KEY,
                    include_row_data: bool = False, bounds: dict | None = None) -> DataFrame:
    """O2: every row flagged by some numeric column, reported once with the first
    flagging column (in column order): (row_id, column, value[, row_data]), ``row_data`` being a map
    from column to text, empty for missing cells.  ``bounds`` are computed where not given.
    No cap: the listing cap belongs to the presentation layer."""
    df = replace_placeholders(df, key, vocab="outlier")
    cols = numeric_columns(df, key)
    b = bounds or iqr_bounds(df, cols, multiplier, method, key)
    if not cols:
        return df.sparkSession.createDataFrame([], f"{key} bigint, column string, value double")
    hits = F.array_compact(F.array(*[
        F.when(outlier_flag(c, b[c]), F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")))
        for c in cols]))
    extra = [row_data(df, key).alias("row_data")] if include_row_data else []
    out = (df.select(col(key).cast("bigint").alias(key), F.get(hits, 0).alias("_h"), *extra)
           .where(F.col("_h").isNotNull()))
    return out.select(key, "_h.column", "_h.value", *(["row_data"] if include_row_data else []))


def outlier_listing(df: DataFrame, multiplier: float = 1.5, method: str = "exact", key: str = KEY,
                    max_rows: int | None = None):
    """O2 for review screens: (rows, summary).  ``rows`` lists flagged rows in the
    order a reviewer walks them (column by column, then by row id), capped at
    ``max_rows`` when given (a top-k, not a sample); ``summary`` is one row with
    columns_checked, total_rows and total_cells over the whole table.  Both use one set of bounds."""
    clean_df = replace_placeholders(df, key, vocab="outlier")
    cols = numeric_columns(df, key)
    b = iqr_bounds(clean_df, cols, multiplier, method, key)
    rows = detect_outliers(df, multiplier, method, key, bounds=b)
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))]) if cols else None
    if max_rows is not None and cols:
        rows = rows.orderBy(pos[F.col("column")], F.col(key)).limit(int(max_rows))
    cells = X.sum_all([F.when(outlier_flag(c, b[c]), 1).otherwise(0) for c in cols])
    summary = clean_df.agg(F.count(F.when(cells > 0, 1)).cast("bigint").alias("total_rows"),
                           F.coalesce(F.sum(cells), F.lit(0)).cast("bigint").alias("total_cells")).select(
        F.lit(",".join(cols)).alias("columns_checked"), "total_rows", "total_cells")
    return rows, summary


def any_outlier(bounds: dict) -> Column:
    return X.any_of([outlier_flag(c, b) for c, b in bounds.items()])


def remove_outliers(df: DataFrame, multiplier: float = 1.5, method: str = "exact", key: str = KEY):
    """C14: drop rows flagged by any numeric column (bounds from the table before
    removal).  Returns (kept, removed, bounds)."""
    b = iqr_bounds(df, None, multiplier, method, key)
    flag = any_outlier(b)
    return df.where(~flag), df.where(flag), b


def clip_outliers(df: DataFrame, multiplier: float = 1.5, method: str = "exact", key: str = KEY,
                  trail: str | None = None):
    """Clamp each numeric column with outliers into its bounds; nulls and NaN stay, and so do the
    columns without outliers, type included (a clamped integer column turns DOUBLE).  The clamped cells are
    added to the array column ``trail``, where named."""
    b = iqr_bounds(df, None, multiplier, method, key)
    new = {}
    for c, bb in b.items():
        if not has_outliers(bb):
            continue
        x = col(c).cast("double")
        new[c] = F.when(x.isNull() | F.isnan(x), x).otherwise(
            F.greatest(F.least(x, F.lit(bb["upper"])), F.lit(bb["lower"])))
    if trail is not None:
        df = with_changes(df, trail, [change(c, "outlier_clip", outlier_flag(c, b[c]), col(c), x) for c, x in new.items()])
    return _select_replacing(df, new), b
