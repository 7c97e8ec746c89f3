"""Row identity for tables read without a key.

Dense, 0-based ids in read order without a global sort or a single-partition
window: ``monotonically_increasing_id()`` encodes (partition, offset); the
table is staged once so that partitions are stable, per-partition row counts
(one row per partition) give each partition its start, and a broadcast join on
the partition number turns (partition, offset) into a dense id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session


def add_row_id(df: DataFrame, name: str = "row_id", key: str | None = None,
               how: str = "checkpoint", place: tuple[str, str] | None = None) -> DataFrame:
    """Return ``df`` with ``name`` first.  With ``key`` the id is a copy of that
    (unique) column; otherwise dense ids 0..n-1 in read order.  ``place`` names the columns with
    each row's file and split offset: ids then follow these, whatever order the splits were
    read in, and the two columns are dropped."""
    keep = [c for c in df.columns if c not in (place or ())]
    cells = [F.col(f"`{c}`") for c in keep]
    if key is not None:
        return df.select(F.col(f"`{key}`").cast("bigint").alias(name), *[c for c, n in zip(cells, keep) if n != name])
    staged = session.stage(df.withColumn("_mid", F.monotonically_increasing_id()), how)
    by = [F.shiftright("_mid", 33).alias("_p"), *([F.col(c) for c in place] if place else [])]
    parts = staged.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # one row per input split: bounded by the number of splits, not the data
    acc, rows = 0, []
    for r in sorted(parts.collect(), key=lambda r: tuple(r[c] for c in place) if place else r["_p"]):
        rows.append((*[r[c] for c in ("_p", *(place or ()))], r["_first"], acc))
        acc += r["_n"]
    columns = ["_p bigint", *([f"{place[0]} string", f"{place[1]} bigint"] if place else []), "_first bigint", "_start bigint"]
    starts = df.sparkSession.createDataFrame(rows, ", ".join(columns))
    out = staged.withColumn("_p", F.shiftright("_mid", 33)).join(F.broadcast(starts), ["_p", *(place or ())])
    rid = (F.col("_start") + F.col("_mid") - F.col("_first")).cast("bigint").alias(name)
    return out.select(rid, *cells)
