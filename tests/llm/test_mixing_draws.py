"""Draws of the mix: expectations over seeds, equal rows, reruns."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mopup.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def test_every_document_keeps_its_expected_copies(spark):
    """Targets not at a whole multiple: over many seeds the mean copies are target / size for each document."""
    rows = [(i, "a", "w " * (1 + i % 7)) for i in range(12)] + [(100 + i, "b", "w " * 30) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    seeds, copies, share = 30, Counter(), {}
    for seed in range(seeds):
        for r in mixing.mix(df, seed=seed, weights=(1, 7)).collect():
            copies[r["doc_id"]] += r["copies"]
            share[r["doc_id"]] = r["target"] / r["source_size"]
    assert any(abs(s - round(s)) > 0.1 for s in share.values())
    for i, n in copies.items():  # 4.5 standard deviations of a sum of draws
        p = share[i] % 1
        assert abs(n - seeds * share[i]) <= 4.5 * (seeds * max(p * (1 - p), 0.01)) ** 0.5, (i, n, share[i])
    for source in ("a", "b"):
        mine = [r[0] for r in rows if r[1] == source]
        n = sum(copies[i] for i in mine)
        assert abs(n - seeds * len(mine) * share[mine[0]]) <= 4.5 * (seeds * len(mine)) ** 0.5


def test_targets_by_hand_over_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    import re
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in table.collect()}
    of = {r["doc_id"]: r["source"] for r in table.select("doc_id", "source").collect()}
    whole = defaultdict(int)
    for i, n in size.items():
        whole[of[i]] += n
    names = sorted(s for s in whole if s is not None) + ([None] if None in whole else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, target, left = set(), {}, 1.5 * sum(whole.values())
    while True:
        free = [s for s in names if s not in full]
        level = (left - sum(2 * whole[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if level * weight[s] > 2 * whole[s]}
        if not new:
            break
        full |= new
    target = {s: 2 * whole[s] if s in full else level * weight[s] for s in names}
    taken, biggest = defaultdict(int), defaultdict(int)
    rows = mixing.mix(table).collect()
    assert len(rows) == len(size)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[of[r["doc_id"]]]
        assert abs(r["target"] - target[of[r["doc_id"]]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
        biggest[of[r["doc_id"]]] = max(biggest[of[r["doc_id"]]], r["size"])
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in names)


def test_equal_rows_are_dealt_like_others(spark):
    def seconds(df):
        start = time.monotonic()
        out = mixing.mix(df).agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.first("target").alias("g")).first()
        assert out["n"] == 60_000 and abs(out["t"] - out["g"]) <= 40
        return time.monotonic() - start

    text = F.lit("w " * 40)
    other = spark.createDataFrame([(10 ** 9 + i, "b", "v " * 9) for i in range(3)], SCHEMA)
    distinct = spark.range(59_997).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), text.alias("text"))
    nulls = distinct.withColumn("doc_id", F.lit(None).cast("long"))
    seconds(distinct.withColumn("source", F.lit("b")).unionByName(other.withColumn("text", F.lit(""))))
    a = seconds(distinct.withColumn("source", F.lit("b")).unionByName(other.withColumn("text", F.lit(""))))
    b = seconds(nulls.withColumn("source", F.lit("b")).unionByName(other.withColumn("text", F.lit(""))))
    assert b < 3 * a + 2


def test_applied_mix_agrees_with_reruns(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i % 50, "ab"[i % 5 == 0], f"{rng.choice('xyz')} " * rng.randint(0, 4)) for i in range(600)]
    rows += [(7, "b", "same row here")] * 5000
    df = spark.createDataFrame(rows, SCHEMA)
    runs = [Counter(tuple(r) for r in mixing.apply_mix(df.repartition(n), weights=(5, 1)).collect()) for n in (3, 11)]
    assert runs[0] == runs[1]
    given = Counter(rows)
    taken = Counter((r["doc_id"], r["source"], r["copies"]) for r in mixing.mix(df, weights=(5, 1)).collect())
    for (i, s, t, copy), n in runs[0].items():
        assert n <= given[i, s, t] and 1 <= copy <= 2
    whole = sum(runs[0].values())
    assert abs(whole - sum(c * n for (_, _, c), n in taken.items())) <= 40
    with pytest.raises(ValueError):
        mixing.apply_mix(df, copy_col="text")
    assert mixing.apply_mix(df.limit(0)).collect() == []
