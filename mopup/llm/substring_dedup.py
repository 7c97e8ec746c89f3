"""Substring dedup: words covered by a window that also starts earlier are removed.

Frequent passages are taken from a sample of the documents as reference shards.  A suffix
automaton of each shard travels to all tasks; documents stream through it, and the matching
statistics tell which of their windows lie in the reference.  These windows, the ones that
would make hot keys, never cross the network one by one: each task sends the first place of
each automaton state at most.

The automata can't hold a corpus, so the windows outside the reference meet by content.
Each window has an anchor, its least n-gram by hash; equal windows have equal anchors.  Only
the anchors are shuffled for all documents, and only the windows whose anchor is found twice
go on, as hashes packed by anchor.  Those of anchors found at many places go on one by one, dealt
by their own hash.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import saved
from .words import binaries, mix, ngram_hashes, nulls_to_empty, split_words, word_hashes

WINDOW = 20
GRAM = 8
#: Documents that reference passages are looked for in, and how often a window must be found there.
SAMPLE_DOCS, SAMPLE_COUNT = 4000, 6
#: Words of one automaton (about 1 kB each) and words of all reference shards.
SHARD_WORDS, REFERENCE_WORDS = 50_000, 100_000
#: Places of an anchor up to which its windows meet in one task's memory.
WIDE = 1024
#: Wide anchors that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


class SuffixAutomaton:
    """The suffix automaton of some passages (arrays of word hashes), kept apart by separators."""

    def __init__(self, passages: list[np.ndarray]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for i, passage in enumerate(passages):
            for w in [*passage.tolist(), -1 - i]:
                last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def windows(self, words: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(start, state) of each window of ``size`` words that lies in a passage, by the matching
        statistics of ``words``.  A state stands for one window of this size."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= size:
                while length[link[state]] >= size:
                    state = link[state]
                matched = size
                yield i + 1 - size, state


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its least n-gram hash and the first place of that n-gram in it."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    grams = ngram_hashes(words, gram)
    span = window - gram + 1
    least, size = grams, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[span - size:span - size + n]) if size < span else least[:n]
    place = np.empty(n, dtype=np.int64)
    for j in range(span - 1, -1, -1):
        place[grams[j:j + n] == least] = j
    return least, place + np.arange(n)


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())


class Reference:
    """The reference shards in a task: their automata, and the anchors that their windows have."""

    _built: tuple[str, "Reference"] | None = None

    def __init__(self, shards: list[list[np.ndarray]], window: int, gram: int):
        self.window = window
        self.automata = [SuffixAutomaton(s) for s in shards]
        found = [anchors(p, window, gram)[0] for s in shards for p in s]
        self.anchors = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)

    @classmethod
    def of(cls, broadcast, window: int, gram: int) -> "Reference":
        """Built once for each Python worker."""
        name, shards = broadcast.value
        if cls._built is None or cls._built[0] != name:
            cls._built = None
            cls._built = (name, cls(shards, window, gram))
        return cls._built[1]

    def states(self, words: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each window its number in the reference, or -1.  Only stretches that hold an anchor of
        the reference stream through the automata."""
        out = np.full(len(least), -1, dtype=np.int64)
        if not len(self.anchors) or not len(least):
            return out
        at = np.minimum(np.searchsorted(self.anchors, least), len(self.anchors) - 1)
        for a, b in _runs(self.anchors[at] == least):
            stretch = words[a:b + self.window - 1].tolist()
            for k, automaton in enumerate(self.automata):
                for s, state in automaton.windows(stretch, self.window):
                    if out[a + s] < 0:
                        out[a + s] = state * len(self.automata) + k
        return out


def _reference(docs: DataFrame, window: int) -> list[list[np.ndarray]]:
    """Shards of the passages that are frequent in a sample of the documents."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    key = T.StructType([T.StructField("w", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in binaries(batch.column(1)):
                grams = ngram_hashes(word_hashes(nulls_to_empty(x.as_py())), window)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["w"])

    often = (sample.mapInArrow(hashed, key).groupBy("w").count().filter(F.col("count") >= SAMPLE_COUNT)
             .orderBy(F.desc("count"), "w").limit(REFERENCE_WORDS).toArrow())
    windows = often.column("w").to_numpy().astype(np.int64).view(np.uint64)
    if not len(windows):
        return []
    hot = np.unique(windows)
    count = dict(zip(windows.tolist(), often.column("count").to_pylist()))
    passage = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()),
                            T.StructField("words", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # windows this task has reported
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                words = word_hashes(nulls_to_empty(x.as_py()))
                grams = ngram_hashes(words, window)
                for a, b in _runs(np.isin(grams, hot)):
                    fresh = np.array([w not in seen for w in grams[a:b].tolist()])
                    seen.update(grams[a:b].tolist())
                    rows += [(i, a + c, words[a + c:a + d + window - 1].tobytes()) for c, d in _runs(fresh)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=passage.names)

    def frequency(raw: bytes) -> int:
        return max(count.get(g, 0) for g in ngram_hashes(np.frombuffer(raw, dtype=np.uint64), window).tolist())

    # the passages with the most frequent windows first: where room ends, the rarest are left out
    found = sorted((-frequency(r["words"]), r["id"] is None, r["id"] or 0, r["start"], r["words"])
                   for r in sample.mapInArrow(cut, passage).collect())
    shards: list[list[np.ndarray]] = [[]]
    seen: set[int] = set()
    room, total = SHARD_WORDS, 0
    for *_, raw in found:
        words = np.frombuffer(raw, dtype=np.uint64)
        grams = ngram_hashes(words, window).tolist()
        for a, b in _runs(np.array([g not in seen for g in grams])):
            size = b - a + window - 1
            if total + size > REFERENCE_WORDS:
                continue  # the windows left out meet by their anchors, like all others
            if size > room and shards[-1]:
                shards.append([])
                room = SHARD_WORDS
            shards[-1].append(words[a:b + window - 1])
            seen.update(grams[a:b])
            room, total = room - size, total + size
    return shards


_PLACE = T.StructType([T.StructField("state", T.LongType()), T.StructField("key", T.LongType()),
                       T.StructField("id", T.LongType()), T.StructField("start", T.LongType())])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (state, key, id, start): all rows of the anchors found twice or more, and the
    first row of each state.  Holds one batch and the last row, which waits for its next."""
    held, linked = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        state, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (state[1:] != state[:-1])
        new[0] = not linked
        keep = np.where(state[:-1] < 0, ~new[:-1] | ~new[1:], new[:-1])
        held, linked = batch.slice(len(key) - 1), not new[-1]
        yield batch.slice(0, len(key) - 1).filter(pa.array(keep, pa.bool_()))
    if held is not None and linked == (held.column(0)[0].as_py() < 0):
        yield held


_PACKED = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()),
                        T.StructField("start", T.LongType()), T.StructField("windows", T.BinaryType()),
                        T.StructField("told", T.LongType())])
_LATER = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()),
                       T.StructField("later", T.LongType())])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed windows sorted by (key, id, start): bits of the windows that are found at an earlier
    place, or that were told before.  Holds the distinct windows of one key: of an anchor that isn't
    wide, or one window."""
    key, seen = None, {}
    for batch in batches:
        out = []
        for k, i, s, windows, mask in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                key, seen = k, {}
            for j, x in enumerate(memoryview(windows).cast("Q").tolist()):
                if seen.setdefault(x, (i, s + j)) != (i, s + j):
                    mask |= 1 << j
            if mask:
                out.append((i, s, mask))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=_LATER.names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs``: its words without
    those covered by a ``window`` of consecutive words that also starts earlier (smaller id, or same
    id and earlier start), joined by one blank.  Windows are judged on the texts as given.

    Null, empty and shorter texts have no window and lose nothing.  Rows that repeat an id are one
    document: what is removed at a place of one is removed at that place of all.  Rows with a null id
    have no order, so they neither lose words nor make others lose any.  Whole texts count, however long.  Other columns are not
    read; an empty table gives an empty one.  ``kept_text`` is left out without ``with_text``.

    Shuffled are one number for each anchor (about a seventh of the words), the packed window hashes
    around repeated anchors, and the texts, by id.  The reference (at most ``REFERENCE_WORDS`` words)
    is broadcast."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = _reference(rows, window)
    name = hashlib.sha256(b"|".join(p.tobytes() for s in shards for p in s)).hexdigest()
    spread = spark.sparkContext.broadcast((f"{name}-{window}-{gram}", shards))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = Reference.of(spread, window, gram)
        for batch in batches:
            first: dict[int, tuple[int, int]] = {}
            out = []
            for i, x in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                words = word_hashes(nulls_to_empty(x.as_py()))
                least, place = anchors(words, window, gram)
                if not len(least):
                    continue
                states = reference.states(words, least)
                for s in np.flatnonzero(states >= 0).tolist():
                    if (t := int(states[s])) not in first or (i, s) < first[t]:
                        first[t] = (i, s)
                open_ = states < 0
                least, place = least[open_], place[open_]
                new = np.ones(len(place), dtype=bool)
                new[1:] = place[1:] != place[:-1]
                out.append((i, least[new].view(np.int64)))
            keys = [k for _, k in out]
            n = sum(map(len, keys))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, -1)), pa.array(np.concatenate(keys)),
                     pa.array(np.repeat([i for i, _ in out], [len(k) for k in keys]).astype(np.int64)),
                     pa.array(np.zeros(n, dtype=np.int64))], names=_PLACE.names)
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(first), pa.int64()), pa.array([0] * len(first), pa.int64()),
                     pa.array([p[0] for p in first.values()], pa.int64()),
                     pa.array([p[1] for p in first.values()], pa.int64())], names=_PLACE.names)

    told = saved(rows.filter("id is not null").mapInArrow(places, _PLACE).repartition("state", "key")
                 .sortWithinPartitions("state", "key", "id", "start").mapInArrow(_repeated, _PLACE))
    # at most one row for each window of the reference
    firsts = spark.sparkContext.broadcast(
        {r["state"]: (r["id"], r["start"]) for r in told.filter("state >= 0").collect()})
    places_of = told.filter("state < 0")
    wide = saved(places_of.groupBy("key").count().filter(F.col("count") > WIDE).select(
        "key", F.col("key").alias("wide")))
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_KEYS else wide
    repeated = places_of.join(wide, "key", "left").groupBy("id").agg(
        F.collect_set("key").alias("keys"), F.collect_set("wide").alias("wide"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference, where = Reference.of(spread, window, gram), firsts.value
        for batch in batches:
            out: list[tuple] = []
            # first place of each window of a wide anchor in this batch; the later ones are told at once
            first: dict[tuple[int, int], tuple[int, int]] = {}
            known: list[tuple[int, int]] = []
            for i, x, keys, wide in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), *batch.columns[2:]):
                words = word_hashes(nulls_to_empty(x.as_py()))
                least, place = anchors(words, window, gram)
                if not len(least):
                    continue
                states = reference.states(words, least)
                # windows of the reference are told at once, dealt by document
                for a, b in _runs(states >= 0):
                    late = np.array([where[t] != (i, a + j) for j, t in enumerate(states[a:b].tolist())])
                    for c, d in _runs(late):
                        out += [(i, i, a + e, b"", (1 << min(d - e, 62)) - 1) for e in range(c, d, 62)]
                if keys.as_py() is None:
                    continue
                mine = np.isin(least, keys.values.to_numpy().view(np.uint64)) & (states < 0)
                if not mine.any():
                    continue
                grams = ngram_hashes(words, window)
                if len(wide.values):
                    apart = mine & np.isin(least, wide.values.to_numpy().view(np.uint64))
                    mine &= ~apart
                    at = np.flatnonzero(apart)
                    dealt = mix(least[at] ^ mix(grams[at])).view(np.int64)
                    for s, w in zip(at.tolist(), zip(dealt.tolist(), grams[at].tolist())):
                        low = first.setdefault(w, (i, s))
                        if low != (i, s):
                            known.append(max(low, (i, s)))
                            first[w] = min(low, (i, s))
                tag = np.where(mine, place, -1)
                cuts = np.flatnonzero(np.diff(tag, prepend=-2, append=-2))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if tag[a] >= 0:
                        out.append((int(least[a].view(np.int64)), i, a, grams[a:b].tobytes(), 0))
            out += [(k, i, s, w.to_bytes(8, sys.byteorder), 0) for (k, w), (i, s) in first.items()]
            at, mask = None, 0
            for i, s in sorted(set(known)):
                if at is None or at[0] != i or s - at[1] >= 62:
                    if at:
                        out.append((at[0], *at, b"", mask))
                    at, mask = (i, s), 0
                mask |= 1 << (s - at[1])
            if at:
                out.append((at[0], *at, b"", mask))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=_PACKED.names)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    # rows without an id take part in nothing, and are not gathered by it
    known_rows, no_id = rows.filter("id is not null"), rows.filter("id is null")
    later = (known_rows.join(repeated, "id", "left").select("id", "text", "keys", "wide").mapInArrow(pack, _PACKED)
             .repartition("key").sortWithinPartitions("key", "id", "start").mapInArrow(_later, _LATER))
    runs = later.groupBy("id").agg(F.collect_list(F.struct("start", "later")).alias("runs"))
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType())] + ([T.StructField("kept_text", T.StringType())] if with_text else []))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = []
            for x, marks in zip(binaries(batch.column(1)), batch.column(2)):
                words = split_words(nulls_to_empty(x.as_py()))
                n = len(words)
                if marks.as_py() is not None and n:
                    delta = np.zeros(n + window + 1, dtype=np.int64)
                    starts = marks.values.field(0).to_pylist(), marks.values.field(1).to_pylist()
                    for s, mask in zip(*starts):
                        while mask:
                            low = mask & -mask
                            at = s + low.bit_length() - 1
                            if at + window <= n:
                                delta[at] += 1
                                delta[at + window] -= 1
                            mask ^= low
                    covered = np.cumsum(delta[:n]) > 0
                    words = [w for w, gone in zip(words, covered.tolist()) if not gone]
                kept = b" ".join(words)
                facts.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
            n, gone, digest, kept = zip(*facts) if facts else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    with_runs = known_rows.join(runs, "id", "left").select("id", "text", "runs").unionByName(
        no_id.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)))
    return with_runs.mapInArrow(remove, schema)
