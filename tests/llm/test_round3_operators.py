"""Periodic runs, shard packing and whitening against plain definitions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mopup.llm import periodic_runs, sharding, whitening
from mopup.llm.queries import op12_shard_packing, op13_embedding_whitening
from mopup.llm.words import word_hashes

SF = "/root/testdata/sf0.01"


def runs_by_hand(w, least, k):
    best = {}
    for p in range(1, len(w) // k + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, k * p):
                best.setdefault((s, i + p - s), p)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_plain_search():
    rng = random.Random(11)
    for _ in range(400):
        least, k = rng.choice([(24, 3), (4, 2), (6, 3), (1, 2)])
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.choice([0, 1, 5, 30, 60]))]
            while rng.random() < .6:
                unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
                w += (unit * rng.randint(1, 12))[:rng.randint(1, 80)]
            docs.append(w)
        got = periodic_runs.runs_of([word_hashes(" ".join(w).encode()) for w in docs], least, k)
        assert got == [runs_by_hand(w, least, k) for w in docs]


def test_collapse_runs(spark):
    long = "x " * 40_000
    texts = [None, "", " \n\t", "a", "a " * 23, "a " * 24, "p " + "a b c " * 8 + "a q", "é\x0bü " * 30 + "nul\x00 \x85", long, long]
    rows = [(i if i else None, t, "n", "r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words string")
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(df).collect()}
    assert len(got) == len(texts)
    assert got[None]["n_words"] == 0 and got[None]["collapsed_text"] == "" and got[2]["runs"] == []
    assert got[4]["runs"] == [] and got[4]["collapsed_text"] == " ".join("a" * 23)
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 24, 1)] and got[5]["collapsed_text"] == "a"
    assert [tuple(r) for r in got[6]["runs"]] == [(1, 25, 3)] and got[6]["collapsed_text"] == "p a b c q"
    assert [tuple(r) for r in got[7]["runs"]] == [(0, 60, 2)]
    assert [tuple(r) for r in got[8]["runs"]] == [(0, 40_000, 1)] and got[8]["collapsed_text"] == "x"
    assert periodic_runs.collapse_runs(df.limit(0)).collect() == []
    ties = spark.createDataFrame([([(5, 30, 10), (0, 24, 8), (40, 33, 11)],)], "runs array<struct<start:long,length:long,period:long>>")
    assert tuple(ties.select(periodic_runs.longest_exponent(F.col("runs"))).first()[0]) == (5, 30, 10)
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(df, min_exponent=1)


def best_fit_by_hand(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(rooms)
            rooms.append(max(capacity, s))
        rooms[b] -= s
        out.append(b)
    return out


def test_best_fit_against_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 120))), reverse=True)
        capacity = rng.randint(10, 60)
        assert sharding.best_fit(sizes, capacity) == best_fit_by_hand(sizes, capacity)
        bins = rng.randint(1, 12)
        packed = sharding.pack_evenly(sizes, bins)
        assert len(packed) == len(sizes) and all(0 <= b < bins for b in packed)
    tree, keys = sharding.Rooms(), set()
    for i in range(3000):
        key = (rng.randint(0, 500), i)
        tree.insert(*key)
        keys.add(key)
        if i % 3 == 0:
            want = rng.randint(0, 550)
            fits = [k for k in keys if k[0] >= want]
            assert tree.take(want) == (min(fits) if fits else None)
            keys.discard(min(fits) if fits else None)
    assert sharding._height(tree.root) <= 1.45 * np.log2(len(keys) + 2)


def checked(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(by, default=0) < shards
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    return sizes


def test_sharding(spark):
    import zlib
    rng = random.Random(2)
    texts = [None, "", "é" * 50, "x" * 30_000] + ["copy " * 20] * 300 + [f"t{i} " * rng.randint(1, 60) for i in range(1500)]
    rows = [(None if i % 5 == 0 else i // 2, t, "s", "d") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, digest string").repartition(6)
    out = sharding.shard_documents(df, shards=7, with_text=True).collect()
    assert len(out) == len(rows)
    sizes = checked(out, 7)
    assert max(sizes.values()) <= 1.01 * sum(sizes.values()) / 7 and min(sizes.values()) >= 0.97 * sum(sizes.values()) / 7
    homes = defaultdict(set)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        homes[r["text"] or ""].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    again = sharding.shard_documents(df, shards=7, with_text=True).collect()
    assert sorted(map(str, ((r["text"], r["shard"]) for r in out))) == sorted(map(str, ((r["text"], r["shard"]) for r in again)))
    assert sharding.shard_documents(df.limit(0), shards=3).collect() == []


def test_group_larger_than_a_shard_is_cut(spark):
    df = spark.createDataFrame([(None, "same text")] * 5000 + [(i, f"other {i}") for i in range(500)], "doc_id long, text string").repartition(9)
    out = sharding.shard_documents(df, shards=8).collect()
    sizes = checked(out, 8)
    assert len(out) == 5500 and max(sizes.values()) <= 1.01 * sum(sizes.values()) / 8
    fixed = sharding.shard_documents(df, capacity=20_000).collect()
    sizes = checked(fixed, 100)
    total = sum(sizes.values())
    assert max(sizes.values()) <= 20_000 and len(sizes) <= 1.1 * total / 20_000 + 1
    with pytest.raises(ValueError):
        sharding.shard_documents(df)


def test_write_shards(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.shard_documents(df, shards=4, with_text=True), tmpdir_path + "/out")
    back = spark.read.parquet(tmpdir_path + "/out")
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def test_packing_query(spark):
    out = op12_shard_packing(spark, SF).collect()
    sizes = checked(out, 24)
    assert len(sizes) == 24 and {r["law"] for r in out} == {"bytes"}
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 24


@pytest.mark.parametrize("dim", [1, 2, 9, 40])
def test_spectra_follow_rank_one_updates(dim):
    rng = np.random.default_rng(dim)
    plain = rng.normal(size=(120, dim)) * 50
    flat = plain.copy()
    flat[:, dim // 2:] = 7
    for data in (plain, np.round(plain / 50), flat, np.repeat(plain[:6], 20, axis=0), plain * np.logspace(0, -6, dim) + 1e5,
                 np.ones((10, dim)), np.eye(dim)[np.arange(30) % dim] * 3):
        one = whitening.Spectrum.empty(dim)
        for block in np.array_split(data, 7):
            one = whitening.absorbed(one, block)
        parts = [whitening.absorbed(whitening.Spectrum.empty(dim), b) for b in np.array_split(data, 4)]
        both = parts[0]
        for p in parts[1:]:
            both = whitening.merged(both, p)
        y = data - data.mean(axis=0)
        want = y.T @ y
        scale = max(np.abs(want).max(), 1e-300)
        for s in (one, both):
            assert s.n == len(data) and np.abs(s.mean - data.mean(axis=0)).max() <= 1e-9 * np.abs(data).max()
            assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - want).max() <= 1e-11 * scale + 1e-9 * (scale < 1e-15)
            assert np.abs(s.vectors.T @ s.vectors - np.eye(dim)).max() < 1e-11


def test_whitening_query(spark):
    out = op13_embedding_whitening(spark, SF).toPandas()
    table = pq.read_table(SF + "/embeddings.parquet").to_pandas()
    x = np.floor(1024 * np.stack(table.embedding.to_list()).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = y @ vectors / np.sqrt(values)
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-9 and out.identity_error.max() < 1e-9
    explained = out.drop_duplicates("component").set_index("component").explained.sort_index().to_numpy()
    assert np.abs(explained - values / np.trace(cov)).max() < 1e-12
    deviation = out.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[table.vec_id].to_numpy()
    assert (deviation == ((n * x - sums) ** 2).sum(axis=1)).all() and (out.n == n).all()


def test_whitening_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<double>, component string, n string, x string"
    rng = np.random.default_rng(0)
    sound = [(i if i % 3 else None, rng.normal(size=3).tolist(), "c", "n", "x") for i in range(40)]
    odd = [(90, None, "", "", ""), (91, [], "", "", ""), (92, [1.0, None, 2.0], "", "", ""), (93, [1.0, float("nan"), 2.0], "", "", ""),
           (94, [float("inf"), 1.0, 2.0], "", "", ""), (95, [1e300, 1.0, 2.0], "", "", ""), (96, [1.0, 2.0], "", "", "")]
    out = whitening.whiten(spark.createDataFrame(sound + odd, schema)).collect()
    assert len(out) == 40 * 3 and {r["n"] for r in out} == {40} and {r["component"] for r in out} == {1, 2, 3}
    assert {r["vec_id"] for r in out}.isdisjoint(range(90, 97)) and max(r["identity_error"] for r in out) < 1e-9
    for rows in ([], odd[:3], sound[:1], [sound[0]] * 5):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    line = [(i, [float(i), 2.0 * i, 5.0], "", "", "") for i in range(20)]
    flat = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
