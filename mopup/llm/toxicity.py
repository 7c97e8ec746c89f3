"""Toxicity by cumulative-link ordinal regression over sparse text features.

One weight vector is shared by ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k).
Features are the distinct words of a text and their first four and five bytes, hashed.
The output is the expected severity, the sum of P(grade >= k) over k.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .components import saved
from .tallies import tally
from .words import binaries, lower_ascii, nulls_to_empty, split_words

BITS = 20
#: Penalty, steps and number of features of the fit.
L1, STEPS, MOST_FEATURES = 2e-3, 300, 4096
#: Labels that are broadcast at most; beyond that the texts are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Bytes of picked features (4 each) that one task sums in a step.
PART_BYTES = 1 << 24
GRADES = 4  # 0 clean, 1 to 3 toxic
_EDGE = b".,;:!?\"'()[]{}<>-_*"
#: Words whose features are kept.  Frequent words are among the first that a task meets; others are worked out again.
_CACHE = 1 << 15


def _hash(feature: bytes) -> int:
    return zlib.crc32(feature) & ((1 << BITS) - 1)


def word_features(word: bytes) -> tuple[int, ...]:
    word = word.strip(_EDGE)
    if not word:
        return ()
    return (_hash(b"w" + word), *(_hash(b"%d" % n + word[:n]) for n in (4, 5) if len(word) >= n))


def text_features(data: bytes, cache: dict[bytes, tuple[int, ...]] | None = None) -> np.ndarray:
    """The features of a text, sorted.  ``cache`` has those of the first words met."""
    out: set[int] = set()
    cache = {} if cache is None else cache
    for w in set(split_words(lower_ascii(data))):
        if (hit := cache.get(w)) is None:
            hit = word_features(w)
            if len(cache) < _CACHE:
                cache[w] = hit
        out.update(hit)
    return np.sort(np.fromiter(out, dtype=np.int32, count=len(out)))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the hashed features (those that are not 0), the ordered thresholds, and the
    P(grade >= 1) from which a text counts as toxic."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    cut: float = 0.5

    def at_least(self, x: float) -> list[float]:
        return [float(_sigmoid(x - t)) for t in self.thresholds]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def markers(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features mark severity, from the numbers of toxic and of clean rows that have each: those at least eight
    times as frequent in toxic rows as in clean ones."""
    return (in_toxic >= 5) & ((in_toxic + 0.5) / max(n_toxic, 1) >= 8 * (in_clean + 0.5) / max(n_clean, 1))


def telling_features(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int, most: int) -> np.ndarray:
    """The features of at least three rows that tell toxic rows best by chi square, up to ``most``."""
    both, n = in_toxic + in_clean, n_toxic + n_clean
    share = n_toxic / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (in_toxic - both * share) ** 2 / (both * share * (1 - share)) / (1 - both / n)
    chi = np.where(both >= 3, np.nan_to_num(chi, posinf=0.0), 0.0)
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] > 0])


def quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """The quantile of sorted ``values``, each ``counts`` times, linear between neighbours."""
    ends = np.cumsum(counts)
    at = (ends[-1] - 1) * q
    low, high = (values[np.searchsorted(ends, i, side="right")] for i in (int(at), min(int(at) + 1, ends[-1] - 1)))
    return float(low + (high - low) * (at - int(at)))


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The highest cut whose F1 over the given scores is within 0.002 of the best, half way to the
    next lower score: in doubt a document is clean."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = 0.0
    k = int(np.flatnonzero(f1 >= f1.max() - 0.002)[0])
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def best_cut_of(scores: DataFrame) -> float:
    """``best_cut`` over all rows of (score, n, hits): a score, and the numbers of rows and of toxic rows that have it.
    The scores are dealt over tasks by ranges; each range adds to the sums of those above it."""
    by_score = scores.groupBy("score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    dealt = stage(by_score.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row a range
    above = dealt.groupBy("part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(
        "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("hits").over(order), F.lit(0)).alias("hits_above"))
    toxic = dealt.agg(F.sum("hits")).first()[0]
    so_far = W.partitionBy("part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    f1 = stage(dealt.join(F.broadcast(above), "part").select("score", (
        2 * (F.col("hits_above") + F.sum("hits").over(so_far)) / (F.col("n_above") + F.sum("n").over(so_far) + toxic)).alias("f1")))
    best = f1.agg(F.max("f1")).first()[0]
    at = f1.filter(F.col("f1") >= best - 0.002).agg(F.max("score")).first()[0]
    lower = f1.filter(F.col("score") < at).agg(F.max("score")).first()[0]
    return float((at + (lower or 0.0)) / 2)


@dataclass(frozen=True)
class _Rows:
    """Rows with their rank among the grades, how many documents each stands for, and their features, row by row."""

    rank: np.ndarray
    n: np.ndarray
    row: np.ndarray
    index: np.ndarray

    def linear(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=len(self.rank))

    def gradient(self, w: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The sums over the rows of the loss's derivatives, by the weights and then by the thresholds."""
        rank, k, x = self.rank, len(t), self.linear(w)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        below = np.where(rank > 0, _sigmoid(edges[rank] - x), 0.0)
        above = np.where(rank < k, _sigmoid(edges[rank + 1] - x), 1.0)
        p = np.maximum(above - below, 1e-9)
        g = np.bincount(self.index, weights=(self.n * (1.0 - below - above))[self.row], minlength=len(w))
        gt = (np.bincount(rank, weights=self.n * below * (1 - below) / p, minlength=k + 1)[1:]
              - np.bincount(rank, weights=self.n * above * (1 - above) / p, minlength=k + 1)[:k])
        return np.concatenate([g, gt])


def _climb(gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], of_rank: np.ndarray, features: int, l1: float,
           steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by proximal AdaGrad steps.  ``of_rank`` counts the rows of each rank."""
    n, k = of_rank.sum(), len(of_rank) - 1
    under = np.cumsum(of_rank)[:-1]
    w, t = np.zeros(features), np.log((under / n) / ((n - under) / n))
    sum_w, sum_t = np.full(features, 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        both = gradient(w, t) / n
        g, gt = both[:features], both[features:]
        sum_w += g * g
        rate = 0.3 / np.sqrt(sum_w)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0.0)
        sum_t += gt * gt
        t = np.maximum.accumulate(t - 0.3 / np.sqrt(sum_t) * gt)
    return w, t


def _model(used: np.ndarray, w: np.ndarray, thresholds: np.ndarray, cut: float) -> OrdinalModel:
    return OrdinalModel({int(used[i]): float(w[i]) for i in np.flatnonzero(w)}, tuple(float(v) for v in thresholds), cut)


def _thresholds(present: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A threshold for each grade: one without rows lies between its neighbours' ones."""
    return np.interp(np.arange(1, int(present[-1]) + 1), present[1:], t)


def fit(rows: list[np.ndarray], grades: np.ndarray, l1: float = L1, steps: int = STEPS,
        most_features: int = MOST_FEATURES) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty by proximal AdaGrad steps over all given rows and their
    ``most_features`` most telling features.  With rows of one grade only, no model.

    For rows at hand; ``train`` does the same over tables."""
    present = np.unique(grades)
    if len(present) < 2:
        return OrdinalModel()
    rank = np.searchsorted(present, grades)  # grades without rows have no threshold
    n = [np.bincount(np.concatenate([r for r, high in zip(rows, rank > 0) if high == which]), minlength=1 << BITS)
         for which in (True, False)]
    used = telling_features(*n, int((rank > 0).sum()), int((rank == 0).sum()), most_features)
    column = _columns(used)
    picked = [c[c >= 0] for c in (column[r] for r in rows)]
    all_rows = _Rows(rank, np.ones(len(rows)), np.repeat(np.arange(len(rows)), [len(p) for p in picked]), np.concatenate(picked))
    w, t = _climb(all_rows.gradient, np.bincount(rank), len(used), l1, steps)
    thresholds = _thresholds(present, t)
    return _model(used, w, thresholds, best_cut(_sigmoid(all_rows.linear(w) - thresholds[0]), rank > 0))


def _columns(used: np.ndarray) -> np.ndarray:
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    return column


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          toxic_col: str = "toxic", grade_col: str | None = None, l1: float = L1, steps: int = STEPS,
          most_features: int = MOST_FEATURES) -> OrdinalModel:
    """A model from every labelled row.  Rows without a label or document, and texts without features, do not count; of
    several labels of one id the most severe holds.  ``grade_col`` has the grades where labels carry them; where they tell
    only toxic or not, toxic rows are split in three equal parts by the number of their ``markers``.

    The steps of ``fit`` over tables: features are counted, telling ones picked, and each step's gradient summed by tasks
    over all rows, one for about ``PART_BYTES`` whatever the number of shuffle partitions.  The driver holds counts by feature, weights and thresholds, never rows.  Rows equal in grade and picked
    features are one, with their number.  Up to ``BROADCAST_LABELS`` labels are broadcast, more are joined by a shuffle."""
    mark = grade_col or toxic_col
    known = labels.select(F.col(id_col).alias("id"), F.col(mark).cast("int").alias("mark")).dropna()
    known = known.groupBy("id").agg(F.greatest(F.max("mark"), F.lit(0)).alias("mark"))
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")
    rows = stage(texts.select("mark", "text").mapInArrow(_extract, _FEATURES))
    marks = {r["mark"]: r["n"] for r in rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    # without rows of two grades there is nothing to tell apart; toxic rows alone have no markers
    least = min(marks, default=0) if grade_col else 0
    n_toxic = sum(n for m, n in marks.items() if m > least)
    n_clean = sum(marks.values()) - n_toxic
    if not n_toxic or not n_clean:
        return OrdinalModel()

    def numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for m, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(x.as_py(), dtype=np.int32) + (int(m > least) << BITS)

    in_clean, in_toxic = tally(rows, 2 << BITS, numbers).reshape(2, -1)
    used = telling_features(in_toxic, in_clean, n_toxic, n_clean, most_features)
    marker = np.zeros(1 << BITS, dtype=bool) if grade_col else markers(in_toxic, in_clean, n_toxic, n_clean)
    picked = stage(_picked(rows, used, marker).groupBy("mark", "hits", "picked").agg(F.count(F.lit(1)).alias("n")))
    found = picked.groupBy("mark", "hits").agg(F.sum("n").alias("n"), F.sum(F.length("picked")).alias("bytes"))
    found = sorted(found.collect(), key=lambda r: (r["hits"], r["mark"]))
    if grade_col:
        grade = F.col("mark")
        grades = np.array([r["mark"] for r in found])
    else:
        hits, n = (np.array([r[c] for r in found if r["mark"] > 0]) for c in ("hits", "n"))
        cuts = [quantile(hits, n, q) for q in (1 / 3, 2 / 3)]
        grade = F.when(F.col("mark") > 0, sum(((F.col("hits") > c).cast("int") for c in cuts), F.lit(1))).otherwise(0)
        grades = np.array([1 + sum(r["hits"] > c for c in cuts) if r["mark"] > 0 else 0 for r in found])
    present, rank = np.unique(grades, return_inverse=True)
    of_rank = np.bincount(rank, weights=[r["n"] for r in found])
    place = F.element_at(F.create_map(*[F.lit(int(v)) for i, g in enumerate(present) for v in (g, i)]), grade)
    ranked = picked.select(place.alias("rank"), "n", "picked").groupBy("rank", "picked").agg(F.sum("n").alias("n"))
    parts = int(1 + sum(r["bytes"] for r in found) // PART_BYTES)
    # many small slices make even parts.  A row tells its slice, and equal rows are one: this order is the same in each
    # run, and so are the sums
    slices = 1 if parts == 1 else 16 * parts
    dealt = ranked.withColumn("part", F.pmod(F.xxhash64("rank", "picked"), F.lit(slices)))
    # saved, so that no task runs this and the next Python step at once: each has workers of its own, whose memory adds up
    chunks = saved(dealt.repartition(parts, "part").sortWithinPartitions("rank", "picked").select("rank", "picked", "n")
                   .mapInArrow(_chunked, _CHUNK))
    held = chunks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # however many partitions the session makes, only those of parts get tasks
        full = held.mapPartitionsWithIndex(lambda i, rows: [i] * any(True for _ in rows)).collect()
        w, t = _climb(lambda w, t: _gradient(held, full, w, t), of_rank, len(used), l1, steps)
        thresholds = _thresholds(present, t)
        return _model(used, w, thresholds, best_cut_of(_scores(chunks, w, float(thresholds[0]))))
    finally:
        held.unpersist()


_FEATURES = T.StructType([T.StructField("mark", T.IntegerType()), T.StructField("features", T.BinaryType())])
_PICKED = T.StructType([T.StructField("mark", T.IntegerType()), T.StructField("hits", T.IntegerType()),
                        T.StructField("picked", T.BinaryType())])
_CHUNK = T.StructType([T.StructField(c, T.BinaryType()) for c in ("rank", "n", "length", "index")])
_SCORES = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType()),
                        T.StructField("hits", T.LongType())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted features of each text that has any."""
    cache: dict[bytes, tuple[int, ...]] = {}
    for batch in batches:
        found = [text_features(nulls_to_empty(x.as_py()), cache) for x in binaries(batch.column(1))]
        some = pa.array([len(f) > 0 for f in found], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f.tobytes() for f in found], pa.binary())], names=_FEATURES.names).filter(some)


def _picked(rows: DataFrame, used: np.ndarray, marker: np.ndarray) -> DataFrame:
    """The columns of each row's used features, and the number of its markers."""
    spread = rows.sparkSession.sparkContext.broadcast((used, np.packbits(marker)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, packed = spread.value
        column, marker = _columns(used), np.unpackbits(packed).astype(bool)
        for batch in batches:
            hits, picked = [], []
            for x in batch.column(1):
                features = np.frombuffer(x.as_py(), dtype=np.int32)
                c = column[features]
                hits.append(int(marker[features].sum()))
                picked.append(c[c >= 0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hits, pa.int32()), pa.array(picked, pa.binary())], names=_PICKED.names)

    return rows.mapInArrow(pick, _PICKED)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of (rank, picked, n) as one row of arrays."""
    for batch in batches:
        picked = batch.column(1).to_pylist()
        arrays = (batch.column(0).to_numpy().astype(np.int32), batch.column(2).to_numpy().astype(np.int64),
                  np.array([len(p) // 4 for p in picked], dtype=np.int32), b"".join(picked))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a if isinstance(a, bytes) else a.tobytes()], pa.binary()) for a in arrays], names=_CHUNK.names)


def _rows_of(rank, n, length, index) -> _Rows:
    rank = np.frombuffer(rank, dtype=np.int32)
    return _Rows(rank, np.frombuffer(n, dtype=np.int64),
                 np.repeat(np.arange(len(rank)), np.frombuffer(length, dtype=np.int32)), np.frombuffer(index, dtype=np.int32))


def _gradient(held: RDD, full: list[int], w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The sum over the chunks in the partitions ``full``.  A job of the RDD, as it is planned hundreds of times."""
    def add(chunks: Iterator[tuple]) -> list[np.ndarray]:
        total = np.zeros(len(w) + len(t))
        for chunk in chunks:
            total += _rows_of(*chunk).gradient(w, t)
        return [total]

    # an array a partition, in their order
    return sum(held.context.runJob(held, add, full))


def _scores(chunks: DataFrame, w: np.ndarray, t: float) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in zip(*batch.columns):
                some = _rows_of(*(x.as_buffer() for x in chunk))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_sigmoid(some.linear(w) - t)), pa.array(some.n),
                     pa.array(np.where(some.rank > 0, some.n, 0))], names=_SCORES.names)

    return chunks.mapInArrow(judge, _SCORES)


def score_texts(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
                threshold: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, severity, p_toxic, toxic) for each row of ``docs``, with the columns ``keep`` passed on.

    ``severity`` is the expected grade, ``p_toxic`` is P(grade >= 1), and ``toxic`` tells whether
    that reaches ``threshold`` (the model's own cut where not given) and some feature speaks for it,
    so that a text without any telling feature is clean.  Null, empty and separator-only texts have severity 0 and are not
    toxic.  Repeated rows are judged alike, other columns are not read, and an empty table gives an
    empty table.  One narrow pass; the model that travels with it has at most 2**20 weights."""
    schema = T.StructType([docs.schema[c] for c in (id_col, *keep)] + [
        T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()),
        T.StructField("toxic", T.BooleanType())])
    cut = model.cut if threshold is None else threshold

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            found = [scorer(nulls_to_empty(x.as_py())) for x in binaries(batch.column(batch.num_columns - 1))]
            p_toxic = [p[0] if p else 0.0 for _, p in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([float(sum(p)) for _, p in found], pa.float64()),
                 pa.array(p_toxic, pa.float64()),
                 pa.array([told and v >= cut for (told, _), v in zip(found, p_toxic)], pa.bool_())], names=schema.names)

    return docs.select(id_col, *keep, text_col).mapInArrow(judge, schema)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text",
               threshold: float | None = None) -> DataFrame:
    """``docs`` without the rows that ``score_texts`` calls toxic; all columns pass on and nothing is
    shuffled.  Null and empty texts stay."""
    at, cut = docs.columns.index(text_col), model.cut if threshold is None else threshold

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            found = [scorer(nulls_to_empty(x.as_py())) for x in binaries(batch.column(at))]
            yield batch.filter(pa.array([not told or p[0] < cut for told, p in found], pa.bool_()))

    return docs.mapInArrow(drop, docs.schema)


class _Scorer:
    """Whether any feature of a text speaks for toxicity, and its P(grade >= k): (False, []) without
    words or model.  The first words met are looked up when they come again."""

    def __init__(self, model: OrdinalModel):
        self.model, self.cache = model, {}

    def __call__(self, data: bytes) -> tuple[bool, list[float]]:
        weights, cache = self.model.weights, self.cache
        words = set(split_words(lower_ascii(data)))
        if not words or not weights:
            return False, []
        features: set[int] = set()
        for w in words:
            if (hit := cache.get(w)) is None:
                hit = tuple(f for f in word_features(w) if f in weights)
                if len(cache) < _CACHE:
                    cache[w] = hit
            if hit:
                features.update(hit)
        found = [weights[f] for f in sorted(features)]
        return any(w > 0 for w in found), self.model.at_least(sum(found))
