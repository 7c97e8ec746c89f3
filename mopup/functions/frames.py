"""Small DataFrame combinators used by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exprs import col

# id lists longer than this are matched by a join instead of an IN-list
IN_LIST_MAX = 10_000
# id tables up to this many rows are broadcast (their size is known on the driver)
BROADCAST_IDS_MAX = 2_000_000


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Place several one-row aggregates next to each other without a join: stack
    them with null padding, then keep the single non-null value of each column."""
    types = {}
    for f in frames:
        for name, dt in f.dtypes:
            types[name] = dt
    names = list(types)
    parts = [f.select(*[(col(c) if c in f.columns else F.lit(None).cast(types[c])).alias(c) for c in names])
             for f in frames]
    return reduce(DataFrame.unionByName, parts).agg(*[F.max(col(c)).alias(c) for c in names])


def id_frame(spark, ids: list, name: str = "_id") -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], f"{name} bigint")


def flag_ids(df: DataFrame, ids: list, key: str, name: str = "_chosen"):
    """(``df`` with a flag for the rows whose key is in a long list, the flag as a Column)."""
    t = id_frame(df.sparkSession, ids, name)
    if len(ids) <= BROADCAST_IDS_MAX:
        t = F.broadcast(t)
    return df.join(t, col(key) == F.col(name), "left"), F.col(name).isNotNull()


def _id_join(df: DataFrame, ids: list, key: str, how: str) -> DataFrame:
    t = id_frame(df.sparkSession, ids)
    if len(ids) <= BROADCAST_IDS_MAX:
        t = F.broadcast(t)
    return df.join(t, col(key) == F.col("_id"), how)


def with_ids(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows whose key is in ``ids`` (a caller-given list): IN-list filter pushed to
    the scan when short, semi join when long."""
    ids = sorted({int(x) for x in ids})
    if len(ids) <= IN_LIST_MAX:
        return df.where(col(key).isin(ids))
    return _id_join(df, ids, key, "left_semi")


def without_ids(df: DataFrame, ids: list, key: str) -> DataFrame:
    ids = sorted({int(x) for x in ids})
    if not ids:
        return df
    if len(ids) <= IN_LIST_MAX:
        return df.where(~col(key).isin(ids))
    return _id_join(df, ids, key, "left_anti")


# aggregate expressions per generated aggregate; very wide tables are split so that
# no single generated class grows without bound (each chunk is one more pass)
AGG_CHUNK = 480


def agg_chunked(df: DataFrame, aggs: list, chunk: int | None = None) -> DataFrame:
    """``df.agg(*aggs)`` for any number of expressions: up to ``chunk`` in one
    aggregate, beyond that several aggregates placed side by side (no join)."""
    chunk = chunk or AGG_CHUNK
    if len(aggs) <= chunk:
        return df.agg(*aggs)
    return side_by_side(*[df.agg(*aggs[i:i + chunk]) for i in range(0, len(aggs), chunk)])
