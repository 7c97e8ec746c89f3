"""Rules and training rows against what the contracts say."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from mopup.llm import ngram_join, tallies, toxicity, url_filter


def test_url_rules_are_those_of_the_contract(spark):
    assert set(url_filter.RULES) == {("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
                                     ("com/fr/", "allow"), ("com/de/", "block")}
    want = [("http://example.org/en/1", "example.org/en/1", "block"), ("https://a.EXAMPLE.org/en/12?q#t", "example.org/en/1", "block"),
            ("http://example.org/en/2", "org/", "allow"), ("http://example.org/es/1", "example.org/es/", "block"),
            ("http://badexample.org/en/1", "org/", "allow"), ("http://x.com/fr/9", "com/fr/", "allow"),
            ("http://x.com/de/9", "com/de/", "block")]
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(want)], "page_id long, url string")
    got = url_filter.filter_urls(pages).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [w[1:] for w in want]


def grades_by_hand(rows, toxic):
    """Thirds of the toxic rows by their number of features that are eight times as frequent in toxic rows."""
    has = {True: collections.Counter(), False: collections.Counter()}
    for r, t in zip(rows, toxic):
        has[bool(t)].update(r.tolist())
    n = int(toxic.sum())
    marks = {f for f, k in has[True].items() if k >= 5 and (k + 0.5) / n >= 8 * (has[False][f] + 0.5) / (len(rows) - n)}
    hits = np.array([sum(f in marks for f in r.tolist()) for r in rows])
    cuts = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0)


def test_toxicity_model_is_fitted_to_every_labelled_row(spark):
    """More rows than the 3,000 toxic and 6,000 clean ones that training once took."""
    rng = random.Random(6)
    plain, bad = [f"word{i}" for i in range(150)], [f"vile{i}" for i in range(12)]
    texts = [" ".join(rng.choices(plain, k=rng.randint(3, 9)) + rng.choices(bad, k=rng.randint(1, 3) if i % 5 < 2 else int(rng.random() < 0.05)))
             for i in range(10_500)]
    texts += texts[:400] + [None, "", "..."]
    toxic = [int(i % 5 < 2) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, 0), (1, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    got = toxicity.train(docs, labels, steps=40)
    rows = [toxicity.text_features((t or "").encode()) for t in texts]
    kept = [i for i, r in enumerate(rows) if len(r)]
    rows, marks = [rows[i] for i in kept], np.array([toxic[i] > 0 for i in kept])
    assert marks.sum() > 3000 and (~marks).sum() > 6000
    want = toxicity.fit(rows, grades_by_hand(rows, marks), steps=40)
    assert got.weights.keys() == want.weights.keys() and len(got.thresholds) == 3
    assert max(abs(got.weights[f] - v) for f, v in want.weights.items()) < 1e-9
    assert np.allclose(got.thresholds, want.thresholds, atol=1e-9) and abs(got.cut - want.cut) < 1e-9
    assert toxicity.train(docs, labels, steps=40) == got
    assert toxicity.train(docs, labels.filter("toxic = 1")).weights == {}


def test_steps_run_a_task_for_each_part_only(spark, monkeypatch):
    """However many partitions a repartition makes (here 64 at least), a step over few rows is one task."""
    rng = random.Random(9)
    toxic = [i % 3 == 0 for i in range(300)]
    texts = [" ".join(rng.choices([f"word{i}" for i in range(40)], k=5) + ["vile"] * t) for t in toxic]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    want = toxicity.train(docs, labels, steps=3)
    frame, climb, sc = type(docs), toxicity._climb, spark.sparkContext
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: deal(self, max(n, 64) if by and isinstance(n, int) else n, *by))

    def watched(gradient, *rest):
        def step(w, t):
            sc.setJobGroup("toxicity-steps", "")
            try:
                return gradient(w, t)
            finally:
                sc.setLocalProperty("spark.jobGroup.id", None)
        return climb(step, *rest)

    monkeypatch.setattr(toxicity, "_climb", watched)
    assert toxicity.train(docs, labels, steps=3) == want
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("toxicity-steps") for s in told.getJobInfo(j).stageIds]
    assert sum(s.numCompletedTasks for s in stages if s) == 3


def test_grades_that_labels_carry(spark):
    rng = random.Random(7)
    grade = [rng.choice([0, 0, 1, 3]) for _ in range(300)]
    texts = [" ".join(rng.choices(["a1", "b2", "c3", "d4"], k=3) + ["bad"] * (g > 0) + ["worse"] * (g > 2)) for g in grade]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = toxicity.train(docs, spark.createDataFrame(list(enumerate(grade)), "doc_id long, severity int"), grade_col="severity", steps=30)
    want = toxicity.fit([toxicity.text_features(t.encode()) for t in texts], np.array(grade), steps=30)
    assert got.weights.keys() == want.weights.keys() and np.allclose(got.thresholds, want.thresholds) and abs(got.cut - want.cut) < 1e-9


def test_cut_over_ranges_of_scores(spark):
    rng = random.Random(8)
    for n in (1, 7, 400):
        rows = [(rng.randint(0, n) / n, rng.random() < 0.4) for _ in range(n)] + [(0.9, True)]
        frame = spark.createDataFrame([(s, 1, int(t)) for s, t in rows], "score double, n long, hits long")
        assert toxicity.best_cut_of(frame) == toxicity.best_cut(np.array([s for s, _ in rows]), np.array([t for _, t in rows]))


def test_shingles_are_counted_over_all_documents(spark, monkeypatch):
    """More documents than the 16,000 once counted: a shingle's level comes from all of them."""
    monkeypatch.setattr(ngram_join, "MOST_BITS", 18)
    texts = [f"u{i} v{i} w{i} x{i} y{i}" if i % 100 else "five words found quite often" for i in range(40_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    levels = ngram_join._frequent(docs, 5)
    buckets = ngram_join._bucket(np.array([ngram_join.shingle_set(t.encode())[0] for t in texts]), len(levels))
    counts = np.bincount(buckets, minlength=len(levels))
    assert counts.max() >= 400 and (levels > 0).sum() == 1
    assert levels[counts.argmax()] == 1 + int(np.floor(2 * np.log2(counts.max())))
    assert not ngram_join._frequent(docs.limit(0), 5).any()


def test_tally_counts_every_row(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 200_000, 30_000)
    rows = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(7)
    got = tallies.tally(rows, 200_000, lambda batch: iter([batch.column(0).to_numpy()]))
    assert (got == np.bincount(values, minlength=200_000)).all()


def test_a_list_join_reads_one_shuffle_of_the_bitmaps(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 700).astype(np.uint64)) for _ in range(4)]
    sets.append(np.concatenate([sets[0][:-5], sets[1][:3]]))  # like the first one
    assert all(len(s) <= 64 * len(ngram_join.parity_bits(s)) <= 2 * len(s) for s in sets[:4])
    rows = spark.createDataFrame([(7, 0, len(s), i, i, ngram_join.parity_bits(s).tolist()) for i, s in enumerate(sets)],
                                 "shingle long, pos int, n long, rep long, component long, bits array<long>")
    rows = ngram_join.saved(rows)
    head = rows.groupBy("shingle").agg(F.max(F.struct(F.lit(1).alias("k"), "component")).alias("head"), F.count("rep").alias("rows"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join._met(rows, head, ["shingle"], 80, False)
        assert [tuple(r) for r in found.collect()] == [(0, 4)]
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert final.count("ReusedExchange") == 1
