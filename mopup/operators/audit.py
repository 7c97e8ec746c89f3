"""Audit and review operators A3, A4 (A1, A2, A5 come with a clean run, see
``mopup.plans.clean.CleanResult``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions.exprs import col
from ..functions.frames import BROADCAST_IDS_MAX
from .transforms import KEY, data_columns, row_sha


def cell_search(df: DataFrame, query: str = "", column: str | None = None, row_id=None,
                key: str = KEY) -> DataFrame:
    """A4: cells whose text contains ``query`` (case-insensitive), optionally in one
    column and/or one row.  An empty query matches every cell (missing shown as '').

    Each row tests its own cells and only the matching ones are exploded, so the
    intermediate result is the answer, not rows × columns."""
    q = (query or "").strip().lower()
    cs = [c for c in data_columns(df, key) if column is None or c == column]
    src = df if row_id is None else df.where(col(key) == int(row_id))
    if not cs:
        return src.select(col(key).cast("bigint").alias(key), F.lit(None).cast("string").alias("column"),
                          F.lit(None).cast("string").alias("value")).limit(0)
    hits = []
    for c in cs:
        v = F.coalesce(col(c).cast("string"), F.lit(""))
        hit = F.lower(v).contains(q) if q else F.lit(True)
        hits.append(F.when(hit, F.struct(F.lit(c).alias("column"), v.alias("value"))))
    return (src.select(col(key).cast("bigint").alias(key), F.explode(F.array_compact(F.array(*hits))).alias("_h"))
            .select(key, "_h.column", "_h.value"))


def cell_diff(before: DataFrame, after: DataFrame, key: str = KEY) -> DataFrame:
    """A3: cell-level differences of two versions of a table matched by row id and
    column name: (row_id, column, old_value, new_value, change) with change one of
    ``changed``, ``removed`` (cell gone: row or column dropped), ``added``.

    First the rows are compared by a digest of the columns that both versions have (SHA-256; key and digest are
    shuffled).  Only the keys of rows that differ, or that one version lacks, go on: with up to
    ``BROADCAST_IDS_MAX`` of them (broadcast), the cells of equal rows never cross a shuffle.  The differing rows are
    joined on the unique key and compared column by column; only differing cells are exploded.  Where one version has a
    column that the other lacks, every row differs, and the first step is left out."""
    bcols, acols = data_columns(before, key), data_columns(after, key)
    allcols = bcols + [c for c in acols if c not in bcols]
    if set(bcols) == set(acols) and bcols:
        changed = session.stage(_differing_keys(before, after, bcols, key))
        few = F.broadcast if changed.count() <= BROADCAST_IDS_MAX else (lambda x: x)
        before, after = (t.join(few(changed), col(key).cast("bigint") == F.col("_differs"), "left_semi") for t in (before, after))
    return _joined_diff(before, after, bcols, acols, allcols, key)


def _differing_keys(before: DataFrame, after: DataFrame, cols: list[str], key: str) -> DataFrame:
    def digests(t: DataFrame, name: str) -> DataFrame:
        text = t.select(col(key).cast("bigint").alias(f"_k{name}"), *[col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cols)])
        return text.select(f"_k{name}", row_sha(text, [f"_c{i}" for i in range(len(cols))]).alias(f"_d{name}"))

    both = digests(before, "b").join(digests(after, "a"), F.col("_kb") == F.col("_ka"), "full_outer")
    return both.where(~F.col("_db").eqNullSafe(F.col("_da"))).select(F.coalesce("_kb", "_ka").alias("_differs"))


def _joined_diff(before: DataFrame, after: DataFrame, bcols: list[str], acols: list[str], allcols: list[str],
                 key: str) -> DataFrame:
    b = before.select(col(key).cast("bigint").alias("_rb"),
                      *[col(c).cast("string").alias(f"_b{i}") for i, c in enumerate(allcols) if c in bcols])
    a = after.select(col(key).cast("bigint").alias("_ra"),
                     *[col(c).cast("string").alias(f"_a{i}") for i, c in enumerate(allcols) if c in acols])
    j = b.join(a, F.col("_rb") == F.col("_ra"), "full_outer")
    in_b, in_a = F.col("_rb").isNotNull(), F.col("_ra").isNotNull()
    labels, cells = [], []
    for i, c in enumerate(allcols):
        old = F.col(f"_b{i}") if c in bcols else F.lit(None).cast("string")
        new = F.col(f"_a{i}") if c in acols else F.lit(None).cast("string")
        has_old = in_b & F.lit(c in bcols)
        has_new = in_a & F.lit(c in acols)
        labels.append((F.when(has_old & ~has_new, F.lit("removed"))
                       .when(has_new & ~has_old, F.lit("added"))
                       .when(has_old & has_new & ~old.eqNullSafe(new), F.lit("changed"))).alias(f"_x{i}"))
        cells.append(F.when(F.col(f"_x{i}").isNotNull(), F.struct(
            F.lit(c).alias("column"), old.alias("old_value"), new.alias("new_value"),
            F.col(f"_x{i}").alias("change"))))
    # the change label of each cell is projected once, then the differing cells are
    # gathered with array_compact (no lambda) and exploded
    labelled = j.select("*", *labels)
    return (labelled.select(F.coalesce("_rb", "_ra").alias(key), F.explode(F.array_compact(F.array(*cells))).alias("_d"))
            .select(key, "_d.column", "_d.old_value", "_d.new_value", "_d.change"))
