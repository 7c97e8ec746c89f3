"""Memory of the Python steps: no task of the toxicity fit runs two at once, each of which has workers of its own, and
what a step holds beside its batch is bounded."""

import random
import tracemalloc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from mopup.llm import tallies, toxicity


def test_fit_chains_no_python_steps(spark, monkeypatch):
    rng = random.Random(11)
    toxic = [i % 3 == 0 for i in range(200)]
    texts = [" ".join(rng.choices([f"word{i}" for i in range(40)], k=5) + ["vile"] * t) for t in toxic]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    scores, gradient, plans, lineages = toxicity.best_cut_of, toxicity._gradient, [], []

    def judged(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return scores(frame)

    def stepped(held, *rest):
        lineages.append(held.toDebugString().decode())
        return gradient(held, *rest)

    monkeypatch.setattr(toxicity, "best_cut_of", judged)
    monkeypatch.setattr(toxicity, "_gradient", stepped)
    assert toxicity.train(docs, labels, steps=2).weights
    assert [p.count("MapInArrow") for p in plans] == [1]
    assert len(lineages) == 2 and all("CheckpointRDD" in x and "ShuffledRowRDD" not in x for x in lineages)


class Steps:
    """A table without rows that keeps the Python steps it is given."""

    def __init__(self):
        self.steps = []

    def mapInArrow(self, step, _):
        self.steps.append(step)
        return self

    def repartition(self, *_):
        return self

    def collect(self):
        return []


def most_mb(run: Callable[[], object]) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def counted(parts: Iterator[pa.RecordBatch], size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for part in parts:
        for k, counts in zip(*(c.to_pylist() for c in part.columns)):
            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), dtype=np.int64)
            out[k * tallies.SLICE:k * tallies.SLICE + len(counts)] += counts
    return out


def counting(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = Steps()
    tallies.tally(table, size, lambda batch: iter([batch.column(0).to_numpy()]))
    return table.steps[0]


def test_tally_holds_little_beside_its_table():
    size, rng = 1 << 21, np.random.default_rng(5)
    step = counting(size)
    batches = [pa.RecordBatch.from_arrays([pa.array(rng.integers(0, size, 50_000))], names=["k"]) for _ in range(30)]
    table_mb = size * 4 / 1e6
    assert most_mb(lambda: [None for _ in step(iter(batches))]) < table_mb + 12
    want = np.bincount(np.concatenate([b.column(0).to_numpy() for b in batches]), minlength=size)
    assert (counted(step(iter(batches)), size) == want).all()


def test_tally_empties_a_table_before_its_counts_are_too_large(monkeypatch):
    monkeypatch.setattr(tallies, "GATHERED", 100)
    monkeypatch.setattr(tallies, "TABLE_NUMBERS", 500)
    step = counting(100_000)
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * 60 + [99_999])], names=["k"]) for _ in range(40)]
    parts = list(step(iter(batches)))
    assert sum(p.num_rows for p in parts) > 2
    got = counted(iter(parts), 100_000)
    assert (got[7], got[99_999], got.sum()) == (2400, 40, 2440)


def test_features_of_many_words_are_not_all_kept():
    texts = [" ".join(f"word{i}x{k}" for k in range(400)) for i in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array([1] * 40, pa.int32()), pa.array(texts[i:i + 40])], names=["mark", "text"])
               for i in range(0, 400, 40)]
    assert most_mb(lambda: [None for _ in toxicity._extract(iter(batches))]) < 16
    scorer = toxicity._Scorer(toxicity.OrdinalModel({toxicity.word_features(b"vile")[0]: 2.0}, (1.0,)))
    assert most_mb(lambda: [scorer(t.encode()) for t in texts]) < 8
    # words that are not kept count as those that are
    assert scorer(b"a vile word") == toxicity._Scorer(scorer.model)(b"a vile word") and scorer(b"a vile word")[0]
    cache = {b"w%d" % i: () for i in range(toxicity._CACHE)}
    assert (toxicity.text_features(b"some new words", cache) == toxicity.text_features(b"some new words")).all()
