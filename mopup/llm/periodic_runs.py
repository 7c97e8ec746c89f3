"""Periodic runs of words (op11): stretches that repeat a period several times, and their removal.

A run is a stretch of words with smallest period q and length at least ``max(min_words, k * q)`` that
no neighbouring word extends.  It shows as a *maximal pair*: two equal word sequences, as long as can
be on both sides, that begin q words apart.  A pair at distance p with common length l lies in a
stretch of l + p words with period p, so the pairs with ``l >= (k - 1) * p`` and ``l + p >= min_words``
are the runs, and none needs to be extended.

The pairs come from the LCP-interval tree of a text's suffixes, walked bottom up.  An interval of depth
l holds the places where one sequence of l words begins; where two children meet, places of different
children agree in exactly l words, and they form a maximal pair if the words to their left differ.  Each
interval keeps its places in order with the class of their left word; the smaller child is merged into
the larger.  Only neighbours in the merged order are paired: occurrences less than l/2 apart that have
another one between them have a smaller period, whose pair is met as well.  So there is no list of all
pairs within an interval, however often a sequence occurs.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import binaries, mix, ngram_hashes, nulls_to_empty, split_words, word_hashes

MIN_WORDS = 24
MIN_EXPONENT = 3
GROUP_WORDS = 1 << 18  # texts are handled together up to so many words; a longer text is alone

_U = np.uint64
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _suffix_levels(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ.  ``first`` holds the ranks
    by one word; the last word of each text occurs nowhere else."""
    size = len(first)
    order = np.argsort(first, kind="stable")
    ranks = _ranks(first[order], np.zeros(size, dtype=np.int64), order, size)
    levels, step = [ranks], 1
    while True:
        count = np.bincount(levels[-1], minlength=size)
        open_ = np.flatnonzero(count[levels[-1]] > 1)
        if not len(open_):
            return levels
        now = levels[-1]
        head, tail = now[open_], now[open_ + step]
        order = np.lexsort((tail, head))
        nxt = now.copy()
        nxt[open_[order]] = head[order] + _within(head[order], tail[order])
        levels.append(nxt)
        step *= 2


def _ranks(values: np.ndarray, base: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """The place of each group's first member in sorted order, for every member."""
    out = np.empty(size, dtype=np.int64)
    out[order] = _within(base, values)
    return out


def _within(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For pairs in order: how many members of the same head come before the pair's first equal."""
    n = len(head)
    at = np.arange(n)
    new_head = np.r_[True, head[1:] != head[:-1]]
    new_pair = new_head | np.r_[True, tail[1:] != tail[:-1]]
    return np.maximum.accumulate(np.where(new_pair, at, 0)) - np.maximum.accumulate(np.where(new_head, at, 0))


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of words that the suffixes at ``a`` and ``b`` share at their beginning."""
    far = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        far += (levels[k][a + far] == levels[k][b + far]).astype(np.int64) << k
    return far


def _maximal_pairs(places: list, depths: list, left: list, least: int, min_words: int,
                   ratio: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, common length) of the maximal pairs that are runs, from suffixes in order and the
    depth that each shares with the one after it.  ``left`` is the class of the word before a place."""
    open_depths: list[int] = []
    open_places: list[list[int]] = []

    def merge(a: list, b: list, depth: int):
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        reach = depth // ratio
        for x in small:
            at = bisect_left(large, x)
            for y in large[max(at - 1, 0):at + 1]:
                p = abs(x - y)
                if p <= reach and depth + p >= min_words and left[x] != left[y]:
                    yield min(x, y), p, depth
        if len(small) == 1:
            insort(large, small[0])
        else:
            large += small
            large.sort()
        return large

    for place, depth in zip(places, depths):
        node = [place]
        while open_depths and open_depths[-1] > depth:
            node = yield from merge(open_places.pop(), node, open_depths.pop())
        if depth < least:
            continue
        if open_depths and open_depths[-1] == depth:
            open_places[-1] = yield from merge(open_places[-1], node, depth)
        else:
            open_depths.append(depth)
            open_places.append(node)


def runs_of(texts: list[np.ndarray], min_words: int = MIN_WORDS,
            min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, given as word hashes, by start and period."""
    ratio = min_exponent - 1
    least = max(1, -(-min_words * ratio // min_exponent))  # a run's two copies share so many words at least
    found: list[list] = [[] for _ in texts]
    # texts without a sequence of that length that occurs twice have no interval deep enough
    sizes = [len(t) for t in texts]
    whole, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    grams = ngram_hashes(whole, least)
    if not len(grams):
        return found
    inside = np.flatnonzero(owner[:len(grams)] == owner[least - 1:])
    keys = mix(grams[inside] + owner[inside].astype(_U) * _U(0x9E3779B97F4A7C15))
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = np.unique(owner[inside[count[which] > 1]])
    if not len(repeated):
        return found

    # these texts side by side, each closed by an end mark of its own that comes after all words
    parts, starts, at = [], [], 0
    for d in repeated.tolist():
        starts.append(at)
        parts += [mix(texts[d] ^ mix(_U([d + 1]))), np.zeros(1, dtype=_U)]
        at += sizes[d] + 1
    stream = np.concatenate(parts)
    ends = np.array([*starts[1:], at]) - 1
    body = np.ones(len(stream), dtype=bool)
    body[ends] = False
    first = np.empty(len(stream), dtype=np.int64)
    words, first[body] = np.unique(stream[body], return_inverse=True)
    first[ends] = len(words) + np.arange(len(ends))
    left = np.r_[-1, first[:-1]]
    left[starts] = -1

    levels = _suffix_levels(first)
    suffixes = np.empty(len(stream), dtype=np.int64)
    suffixes[levels[-1]] = np.arange(len(stream))
    depth = np.r_[_common(levels, suffixes[:-1], suffixes[1:]), 0]
    keep = np.flatnonzero((depth >= least) | (np.r_[0, depth[:-1]] >= least))
    best: dict[tuple[int, int], int] = {}
    for i, p, l in _maximal_pairs(suffixes[keep].tolist(), depth[keep].tolist(), left.tolist(), least, min_words, ratio):
        best[i, l + p] = min(p, best.get((i, l + p), p))
    for (i, length), p in best.items():
        k = int(np.searchsorted(starts, i, side="right")) - 1
        found[int(repeated[k])].append((i - starts[k], length, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  min_exponent: int = MIN_EXPONENT, with_text: bool = True) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_words``, ``runs`` (array of start, length, period in words,
    by start and period) and ``collapsed_text`` (left out without ``with_text``).

    A null or empty text has no words, no runs and an empty text.  Runs that overlap, or begin at the
    same word with other periods, are all listed; one with several periods has the smallest.  Repeated rows
    are judged each for itself, ids may be null, other columns (clashing names included) are not read, and
    an empty table gives an empty table.  One narrow pass: nothing is shuffled, and a task holds
    one Arrow batch and the index of about 260,000 words, or of one text where that is longer."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN))]
                          + ([T.StructField("collapsed_text", T.StringType())] if with_text else []))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))
        for batch in batches:
            counts, runs, texts = [], [], []
            for group in _groups(binaries(batch.column(1))):
                for words, its in zip(group, runs_of([word_hashes(b" ".join(w)) for w in group], min_words, min_exponent)):
                    counts.append(len(words))
                    runs.append([dict(zip(RUN.names, r)) for r in its])
                    if with_text:
                        texts.append(collapsed(words, its))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind)]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(judge, schema)


def _groups(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in groups of about ``GROUP_WORDS``."""
    group, size = [], 0
    for value in column:
        words = split_words(nulls_to_empty(value.as_py()))
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def longest_exponent(runs):
    """Column: the run with the greatest length/period, compared exactly; the first of equal ones."""
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
