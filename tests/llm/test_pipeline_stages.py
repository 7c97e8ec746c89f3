"""Each stage of the pipeline against a plain version of its rule, on rows that hold every awkward case."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline as P
from mopup.llm import decontaminate, mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in "ka lo mi nu pe ra si to vu wa".split() for b in "bar den fil gos hul jom kin".split()]


def made_rows():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    bench = [prose(30), prose(45), prose(20), "", None, "tiny"]
    texts = [prose(rng.randint(5, 120)) for _ in range(120)]
    for i in range(0, 30, 3):  # near copies: one word of many changed
        words = texts[i].split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1], texts[2].upper()]
    for i, item in enumerate(bench[:3] * 3):
        words = item.split()
        if i > 2:
            words[rng.randrange(len(words))] = "x" * (i % 3)
        texts.append(prose(15) + " " + " ".join(words) + " " + prose(9))
    texts += [None, "", " \n", "one", "mail jane@site.org on 2020-01-02 or +1 555-123-4567 " + prose(12), "vile scum " * 3 + prose(30)]
    labels = [(i, 1, 0) for i, t in enumerate(texts) if t and "vile" in t] + [(0, 1, 0), (1, None, 0), (5, 0, None)]
    rows = [(i if i % 17 else (i or 0), t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows, bench, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, bench, labels = made_rows()
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(folder + "/labels.parquet")
    return folder, rows, bench


def kept(spark, stage, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    out = stage(spark, docs, folder)
    assert out.columns[:5] == docs.columns
    return out


def test_near_duplicates(spark, tables):
    folder, rows, _ = tables
    sets = {}
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    near = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    for s in sorted(sets):
        todo = [s]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if least[y] > least[s]:
                    least[y] = least[s]
                    todo.append(y)
    got = sorted(r["doc_id"] for r in kept(spark, P.near_duplicates, folder).collect())
    assert got == sorted(i for i in sets if least[i] == i) and len(got) < len(rows)


def substring_distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        nxt = [0]
        for i, q in enumerate(p):
            nxt.append(min(row[i] + (q != c), row[i + 1] + 1, nxt[i] + 1))
        row = nxt
        best = min(best, row[-1])
    return best


def test_decontamination(spark, tables):
    folder, rows, bench = tables
    plain = lambda t: " ".join(re.findall("[^\x20\x09-\x0D]+", t or "")).lower()
    items = [plain(b) for b in bench if len(plain(b)) >= decontaminate.MIN_CHARS]
    clean = [i for i, t, *_ in rows if not any(
        any(w in plain(t) for w in (x[k:k + 5] for k in range(0, len(x) - 5, 5))) and substring_distance(x, plain(t)) <= int(0.08 * len(x)) for x in items)]
    got = sorted(r["doc_id"] for r in kept(spark, P.decontamination, folder).collect())
    assert got == sorted(clean) and len(rows) - 12 <= len(got) < len(rows)


def test_pseudonyms_and_mixing(spark, tables):
    folder, rows, _ = tables
    out = {r["doc_id"]: r for r in kept(spark, P.pseudonyms, folder).collect()}
    assert len(out) == len(rows)
    for i, t, lang, source, n in rows:
        assert (out[i]["lang"], out[i]["source"], out[i]["n_chars"]) == (lang, source, n)
        assert (out[i]["text"] != t) == bool(t and "jane@" in t)
    docs = spark.read.parquet(folder + "/documents.parquet")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    copies = collections.Counter(r["doc_id"] for r in kept(spark, P.mixing, folder).collect())
    sizes = {i: len(re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert all(copies[i] == 0 for i in sizes if not sizes[i]) and set(taken) == set(sizes)
    assert abs(sum(copies[i] * sizes[i] for i in sizes) - sum(taken[i] * sizes[i] for i in sizes)) <= 4 * max(sizes.values())


def test_toxicity(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(folder + "/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(folder + "/labels.parquet"))
    got = sorted(r["doc_id"] for r in kept(spark, P.toxicity, folder).collect())
    marks = {r["doc_id"]: r["toxic"] for r in toxicity.score_texts(docs, model).collect()}
    assert got == sorted(i for i, toxic in marks.items() if not toxic)


def test_whole_run_and_empty_tables(spark, tables, tmp_path):
    folder, rows, _ = tables
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and 0 < out.count() <= 2 * len(rows)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    empty = P.run(spark, str(tmp_path))
    assert empty.collect() == [] and empty.columns == out.columns


def objective(rows, rank, model, used, l1):
    w = np.array([model[0].get(int(f), 0.0) for f in used])
    x = np.array([sum(model[0].get(int(f), 0.0) for f in r) for r in rows])
    edges = np.concatenate([[-40.0], model[1], [40.0]])
    sig = lambda z: 1 / (1 + np.exp(-z))
    p = sig(edges[rank + 1] - x) - sig(edges[rank] - x)
    return -np.log(np.maximum(p, 1e-12)).mean() + l1 * np.abs(w).sum()


def test_fit_is_at_the_likelihoods_maximum():
    """No small step of a weight or threshold lowers the penalised likelihood's loss, written out plainly."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 6))).astype(np.int32) for _ in range(400)]
    truth = rng.normal(size=12) * 1.5
    score = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=400)
    rank = np.digitize(score, [0.0, 1.5, 3.0])
    l1 = 2e-3
    model = toxicity.fit(rows, rank, l1=l1, steps=20_000)
    at = (dict(model.weights), np.array(model.thresholds))
    base = objective(rows, rank, at, range(12), l1)
    assert list(at[1]) == sorted(at[1])
    for f in range(12):
        for step in (-0.05, 0.05):
            moved = {**at[0], f: at[0].get(f, 0.0) + step}
            if f in at[0]:
                assert objective(rows, rank, (moved, at[1]), range(12), l1) > base - 1e-5, f
    for k in range(3):
        for step in (-0.05, 0.05):
            t = at[1].copy()
            t[k] += step
            assert objective(rows, rank, (at[0], t), range(12), l1) > base - 1e-5, k


def test_scores_are_the_sum_of_the_cumulative_links(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        words = {w.strip(b".,;:!?\"'()[]{}<>-_*") for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (texts[r["doc_id"]] or "").encode()).split()} - {b""}
        hashed = {__import__("zlib").crc32(x) % (1 << toxicity.BITS) for w in words
                  for x in [b"w" + w] + [b"%d" % n + w[:n] for n in (4, 5) if len(w) >= n]}
        x = sum(model.weights.get(f, 0.0) for f in hashed)
        p = [1 / (1 + np.exp(-(x - t))) for t in model.thresholds] if texts[r["doc_id"]] and texts[r["doc_id"]].split() else [0.0]
        assert abs(r["severity"] - sum(p)) < 1e-9 and abs(r["p_toxic"] - p[0]) < 1e-9
        assert r["toxic"] == (any(model.weights.get(f, 0.0) > 0 for f in hashed) and p[0] >= model.cut)
