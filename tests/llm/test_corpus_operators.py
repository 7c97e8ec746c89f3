"""Operators over whole tables against brute force, and the pipeline's stages."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from mopup.llm import components, ngram_join, substring_dedup
from mopup.llm import words as W

DOCS = "doc_id long, text string, g string, n string, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def corpus(seed, n=260, passage=70):
    """Near copies, exact copies, shared passages, frequent lines, empty and long texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "É"]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared, line = text(passage), "Licensed under some public license, version 3 of the terms.".split()
    rows, base = [], text(120)
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:  # near copies of one text, a chain of edits
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                base = w
        elif kind < 0.5:
            w = text(rng.randint(0, 40)) + shared[rng.randint(0, 20):] + text(rng.randint(0, 40))
        elif kind < 0.6:
            w = line * rng.randint(1, 3) + text(rng.randint(0, 3))
        elif kind < 0.7:
            w = text(rng.randint(0, 7))
        elif kind < 0.75 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
        else:
            w = text(rng.randint(10, 200))
        rows.append((i * 3 % n + 1000, rng.choice([" ", " ", "\t\n"]).join(w)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "de " * 300), (5, " ".join(text(30_000)))]
    return rows


def brute_components(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sample,hot", [(16000, 4096), (60, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, sample, hot):
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCS", sample)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    rows = corpus(seed)
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


@pytest.mark.parametrize("sample,hot,part", [(16000, 4096, 1024), (60, 2, 4)])
def test_links_between_classes_equal_brute_force(spark, monkeypatch, sample, hot, part):
    """Every link of different sets, also of those that other links connect; long lists are split."""
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCS", sample)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    monkeypatch.setattr(ngram_join, "LIST_PART", part)
    monkeypatch.setattr(ngram_join, "MANY_CLASSES", 1_000_000 if part > 4 else 1)
    rows = corpus(3)
    rows += [(5000 + i, rows[0][1]) for i in range(300)] + [(None, rows[1][1]), (None, None)]
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        if i is not None and w:
            sets.setdefault(frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]), []).append(i)
    reps = [(min(ids), s) for s, ids in sets.items()]
    want = {(min(a, b), max(a, b)) for a, x in reps for b, y in reps if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    got = [(min(r), max(r)) for r in ngram_join.similar_classes(docs(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    classes = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(docs(spark, rows)).collect() if r["doc_id"] is not None}
    assert all(classes[i] == min(ids) for ids in sets.values() for i in ids)
    assert ngram_join.similar_classes(docs(spark, [])).count() == 0


def test_near_duplicates_edges(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c D e f"), (None, "a b c d e f"), (11, "q"), (12, "Q"), (13, None)]
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()))
    assert got == [(0, 2, 0), (7, 2, 7), (7, 2, 7), (9, 2, 7), (11, 1, 11), (12, 1, 11), (13, 0, 13)]
    kept = ngram_join.deduplicate(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [7, 11, 13]
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0 and ngram_join.deduplicate(docs(spark, [])).count() == 0
    assert ngram_join.near_duplicates(docs(spark, [(1, None), (2, " ")])).count() == 2


def test_near_duplicates_where_the_split_limit_falls_inside_a_level(spark, monkeypatch):
    # x and y = x + 20 rare words (J = 0.8) share one prefix shingle, the first of x: it is found in
    # 10 documents and has a split list, the others of its level are found in 8 and have none
    monkeypatch.setattr(ngram_join, "HOT", 10)
    rng = random.Random(4)
    common = [f"h{j}" for j in range(63)]
    rows, pairs = [], []
    for f in range(8):
        core = sorted((f"f{f}c{j}" for j in range(17)), key=lambda w: int(W.shingle_set(w.encode(), 1)[0]))
        x = core + common
        pairs.append((100 * f, 100 * f + 1))
        family = [x, x + [f"f{f}r{j}" for j in range(20)]]
        family += [core + rng.sample(common, 20) for _ in range(6)] + [core[:1] + rng.sample(common, 30) for _ in range(2)]
        rows += [(100 * f + k, " ".join(w)) for k, w in enumerate(family)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs(spark, rows), words=1).collect()}
    assert [(a, b) for a, b in pairs if got[a] != got[b]] == []


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            if k in seen:
                gone[a:a + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("count,words", [(6, 100_000), (2, 100_000), (2, 120), (10**9, 100_000)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, count, words):
    monkeypatch.setattr(substring_dedup, "SAMPLE_COUNT", count)
    monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", words)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50 if words == 120 else 300)
    rows = corpus(3 + count % 5)
    got = substring_dedup.remove_repeats(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_repeats(rows)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_windows_of_a_frequent_anchor_are_dealt_by_their_hash(spark, monkeypatch):
    # a line of 8 words, the anchor of all windows around it, each time in other surroundings
    limit, later = 4, substring_dedup._later
    monkeypatch.setattr(substring_dedup, "WIDE", limit, raising=False)
    rng = random.Random(6)
    text = lambda k: [f"v{rng.randrange(100_000)}" for _ in range(k)]
    gram = lambda w: int(W.ngram_hashes(W.word_hashes(" ".join(w).encode()), 8)[0])
    line = min((text(8) for _ in range(3000)), key=gram)
    rows = [(i, " ".join(text(30) + line + text(30))) for i in range(40)]
    again = rows[7][1].split()
    rows += [(40 + j, " ".join(text(3) + again[15:15 + k] + text(4))) for j, k in enumerate([19, 20, 25, 40])]
    rows.append((50, " ".join(again + again)))

    def watched(batches):
        held = {}

        def seen():
            for batch in batches:
                for k, w in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                    held.setdefault(k, set()).update(memoryview(w).cast("Q").tolist())
                yield batch

        yield from later(seen())
        assert max(map(len, held.values()), default=0) <= 13 * limit

    monkeypatch.setattr(substring_dedup, "_later", watched)
    got = substring_dedup.remove_repeats(docs(spark, rows).repartition(5)).collect()
    assert sum(r["n_removed"] for r in got) > 100
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


def test_substring_dedup_edges(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text), (3, None)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30), (3, 0, 0)]
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_automaton_windows():
    rng = random.Random(6)
    passages = [np.array([rng.randrange(4) for _ in range(rng.randint(5, 40))], dtype=np.uint64) for _ in range(6)]
    known = {tuple(p[a:a + 5].tolist()) for p in passages for a in range(len(p) - 4)}
    automaton, state_of = substring_dedup.SuffixAutomaton(passages), {}
    text = [rng.randrange(4) for _ in range(3000)]
    found = dict(automaton.windows(text, 5))
    for a in range(len(text) - 4):
        w = tuple(text[a:a + 5])
        assert (a in found) == (w in known)
        if a in found:
            assert state_of.setdefault(w, found[a]) == found[a]
    assert len(set(state_of.values())) == len(state_of)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 90)] + [(500, x) for x in range(501, 600)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for s in sorted(near):
        if s not in seen:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    want[x] = s
                    todo += near[x]
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_long_words_and_blocks(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 8192)
    data = (b"x" * 20_000 + b" a\tb\n\xc3\xa9 " + b"y " * 9000 + b"z" * 100)
    ws = data.split()
    h = W.word_hashes(data)
    assert len(h) == len(ws) and len(set(h.tolist())) == len(set(ws))
    assert W.word_hashes(b"") .size == 0 and W.ngram_hashes(h[:3], 5).size == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pseudonyms", "mixing"]
    out = P.run(spark, sf)
    assert set(out.columns) == {*all_docs.columns, "copy"}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert len(kept & toxic) <= len(toxic) // 10 and len(kept) > 0.4 * all_docs.count()
