"""Sinks S8-S10: cleaned table as CSV / Parquet, report frames as JSON with
non-finite numbers written as null."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and ±infinity → null in every floating column."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(f.dataType))
                       .otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, key: str | None = "row_id", mode: str = "overwrite",
              sep: str = ",", encoding: str = "UTF-8") -> None:
    """Header line, one file per partition, cell text written as it is (no
    trimming); the key column is bookkeeping and is not written unless ``key=None``."""
    out = df.drop(key) if key and key in df.columns else df
    (out.write.mode(mode).option("header", True).option("escape", '"').option("sep", sep)
     .option("encoding", encoding).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_report(frames: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each report frame (summary, log, changed cells, removed rows ...) as JSON
    lines under ``path/<name>``."""
    for name, d in frames.items():
        json_safe(d).write.mode(mode).json(os.path.join(path, name))
