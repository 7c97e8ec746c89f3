"""Distributed exact quantiles (linear interpolation, as pandas/numpy compute them).

Spark's exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer, which does not survive a very large table.  Here the value of
a rank is found by radix selection instead:

* The first pass counts the values by sign and size, in 256 buckets for each power of two (any
  function that never falls as the value rises will do), with the least and greatest value of each bucket.
  The bucket that holds a wanted rank follows from running totals, which Spark sums.
* Where a bucket's least and greatest value are one, that is the value.  Otherwise the next pass
  counts the values between the two in 65,536 equal buckets, and so on.

The ends of a range fall into different buckets, so every pass leaves less of it.  A bucket of the first pass has at
most 2^45 different doubles and a pass keeps about a 65,536th of these, so four passes suffice (five where rounding
is at its worst) and most columns need two.  Every pass is one hash aggregate with map-side combination over all
columns and quantiles together, later passes only count values inside the wanted buckets, and the
driver gets one row for each wanted rank: no values are collected, and nothing depends on a sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.frames import agg_chunked

DEFAULT_ACCURACY = 10000  # of ``approx``
BUCKETS = 1 << 16


def _lerp(a: float, b: float, t: float) -> float:
    if a == b:
        return a
    d = b - a
    if t >= 0.5:
        return b - d * (1 - t)
    return a + d * t


def _number(c: str):
    """The column as DOUBLE; NaN is a missing value."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _cells(df: DataFrame, made: list[Column]) -> DataFrame:
    """(b, x) rows: the value that each bracket has of a row, if any."""
    return df.select(F.posexplode(F.array(*made)).alias("b", "x")).filter("x is not null and not isnan(x)")


#: Sign and size of a value: its logarithm to base 2 in steps of 1/256, moved above 0, which is zero's own place.
_SIZE = ("CASE WHEN x = 0D THEN 0L ELSE CAST(signum(x) AS BIGINT) * "
         "(CAST(floor(least(log2(abs(x)), 2000D) * 256D) AS BIGINT) + 300000L) END")


def _buckets(cells: DataFrame) -> DataFrame:
    counts = cells.groupBy("b", "d").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    order = Window.partitionBy("b").orderBy("d")
    everything = Window.partitionBy("b")
    return counts.select(
        "b", "n", "lo", "hi", (F.sum("n").over(order) - F.col("n")).alias("below"),
        F.sum("n").over(everything).alias("total"), F.min("lo").over(everything).alias("least"),
        F.max("hi").over(everything).alias("most"))


def quantiles(df: DataFrame, cols: list[str], probs=(0.25, 0.75), method: str = "exact",
              accuracy: int = DEFAULT_ACCURACY, cap: int = BUCKETS) -> dict:
    """Return ``{col: {"n": count, "min": value, "max": value, p: value-or-None, ...}}``.

    NaN counts as missing.  ``method="exact"`` matches linear interpolation exactly; ``cap`` is the
    number of buckets that a pass after the first divides a range into.  ``"approx"``
    uses a single ``percentile_approx`` pass (rank error ≤ n/accuracy).
    """
    if not cols:
        return {}
    if method == "approx":
        return _approximate(df, cols, probs, accuracy)
    df = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    out = {c: {"n": 0, "min": None, "max": None, **{p: None for p in probs}} for c in cols}
    x = [F.col(f"x{i}") for i in range(len(cols))]
    first = _buckets(_cells(df, x).select("b", F.expr(_SIZE).alias("d"), "x"))
    # ranks around each quantile's place; the place itself is computed once more on the driver
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(h), F.least(F.floor(h) + 1, F.col("total") - 1)) for h in place])))
    wanted = first.select("*", F.explode(ranks).alias("rank")).filter("below <= rank and rank < below + n")
    found: dict[tuple[int, int], float] = {}
    pending: dict[tuple[int, float, float], list[tuple[int, int]]] = {}

    def settle(i: int, rank: int, r) -> None:
        if r["lo"] == r["hi"]:
            found[i, rank] = r["lo"]
        else:
            pending.setdefault((i, r["lo"], r["hi"]), []).append((rank, r["rank"] - r["below"]))

    for r in wanted.collect():
        c = out[cols[r["b"]]]
        c["n"], c["min"], c["max"] = int(r["total"]), r["least"], r["most"]
        settle(r["b"], int(r["rank"]), r)
    steps = max(1, cap)
    while pending:
        brackets, asked = list(pending), pending

        def of(values: list) -> Column:
            return F.get(F.array(*map(F.lit, values)), F.col("b"))

        share = (F.col("x") - of([lo for _, lo, _ in brackets])) / of([hi - lo for _, lo, hi in brackets])
        cells = _cells(df, [F.when(x[i].between(lo, hi), x[i]) for i, lo, hi in brackets])
        inside = cells.select("b", F.floor(share * F.lit(float(steps))).alias("d"), "x")
        # the wanted ranks, counted within each bracket
        inner = F.get(F.array(*[F.array(*[F.lit(r).cast("bigint") for _, r in asked[k]]) for k in brackets]), F.col("b"))
        rows = _buckets(inside).select("*", F.explode(inner).alias("rank")).filter(
            "below <= rank and rank < below + n").collect()
        pending = {}
        for r in rows:
            bracket = brackets[r["b"]]
            for rank, at in asked[bracket]:
                if at == r["rank"]:
                    settle(bracket[0], rank, r)
    for i, c in enumerate(cols):
        n = out[c]["n"]
        for p in probs:
            if n:
                h = p * (n - 1)
                at = int(math.floor(h))
                out[c][p] = _lerp(found[i, at], found[i, min(at + 1, n - 1)], h - at)
    return out


def _approximate(df: DataFrame, cols: list[str], probs, accuracy: int) -> dict:
    aggs = []
    for i, c in enumerate(cols):
        x = _number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.percentile_approx(x, list(probs), accuracy).alias(f"q{i}")]
    row = agg_chunked(df, aggs).first()
    out = {}
    for i, c in enumerate(cols):
        qs = row[f"q{i}"]
        out[c] = {"n": int(row[f"n{i}"]), "min": row[f"mn{i}"], "max": row[f"mx{i}"],
                  **{p: float(qs[j]) if qs else None for j, p in enumerate(probs)}}
    return out
