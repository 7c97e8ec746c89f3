"""Cleaning on Structured Streaming sources.

Only the row-local steps run unchanged on an unbounded input: placeholder
replacement (C1), name normalisation (C2), manual renames (C5), trimming (C6),
dropping chosen columns (C9), explicit conversions whose target type is given
(C8b-C8f; only the listed columns — the batch rule that unlisted columns are
``auto`` needs statistics of the whole table), and dropping rows with gaps (C16).  Steps that need statistics of
the whole table (auto type decisions, empty/constant columns, dedupe, fills,
outliers, encoding) are refused rather than silently approximated.

``running_profile`` keeps the profiling counts (rows, missing cells per
column) as streaming state, so a dashboard can read them at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import col
from ..operators import transforms as TR
from ..plans.options import CleanOptions

ROW_LOCAL_TARGETS = ("numeric", "datetime", "string", "category", "bool")


def clean_stream(df: DataFrame, options: CleanOptions | dict | None = None, key: str = TR.KEY) -> DataFrame:
    opts = options if isinstance(options, CleanOptions) else CleanOptions.from_dict(options or {})
    needs_table = [n for n, on in (
        ("convert_dtypes", opts.convert_dtypes), ("drop_empty_columns", opts.drop_empty_columns),
        ("drop_constant_columns", opts.drop_constant_columns), ("remove_duplicates", opts.remove_duplicates),
        ("handle_outliers", bool(opts.handle_outliers)), ("encode_categoricals", opts.encode_categoricals == "label"),
        ("missing_strategy=fill", opts.missing_strategy == "fill")) if on]
    if needs_table:
        raise ValueError(f"not row-local, cannot run on a stream: {needs_table}")
    if opts.dtype_map and any(v not in ROW_LOCAL_TARGETS for v in opts.dtype_map.values()):
        raise ValueError("stream conversions need an explicit target type (no 'auto')")
    w = TR.replace_placeholders(df, key, "clean")
    if opts.rename_columns:
        w, _ = TR.normalize_columns(w, key)
    manual = {}
    if opts.column_renames:
        w, manual = TR.rename_columns(w, dict(opts.column_renames), key)
    if opts.trim_whitespace:
        w, _ = TR.trim_whitespace(w, key)
    if opts.dtype_map:
        types = dict((f.name, f.dataType) for f in w.schema.fields)
        dm = {manual.get(c, c): v for c, v in opts.dtype_map.items()}
        w = w.select(*[(TR.converted(col(c), types[c], dm[c]).alias(c) if c in dm else col(c))
                       for c in w.columns])
    if opts.drop_selected_columns:
        w, _ = TR.drop_columns(w, [manual.get(c, c) for c in opts.drop_selected_columns], key)
    if opts.missing_strategy == "drop":
        w = TR.drop_missing_rows(w, key)
    return w


def run_to_table(stream_df: DataFrame, path: str) -> DataFrame:
    """Run an append-mode stream over everything available now into a Parquet table
    at ``path`` (checkpoint next to it, on shared storage), then read the table."""
    q = (stream_df.writeStream.format("parquet").option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/_checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream_df.sparkSession.read.parquet(f"{path}/data")


def run_profile(agg_stream: DataFrame) -> DataFrame:
    """Run a one-row streaming aggregate (``running_profile``) over everything
    available now in complete mode.  The result table is one row by construction,
    so the in-memory sink is bounded; it is returned as a batch DataFrame."""
    import uuid
    name = f"mopup_profile_{uuid.uuid4().hex}"
    q = (agg_stream.writeStream.format("memory").queryName(name).outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return agg_stream.sparkSession.table(name)


def running_profile(df: DataFrame, key: str = TR.KEY, analyze: bool = True) -> DataFrame:
    """Stateful global aggregate: rows seen and missing cells per column (after the
    profiling placeholder set), for ``outputMode("complete")`` or ``"update"``."""
    a = TR.replace_placeholders(df, key, "analyze") if analyze else df
    cs = TR.data_columns(a, key)
    return a.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(F.when(col(c).isNull(), 1)).alias(f"missing__{X.normalize_name(c)}") for c in cs])
