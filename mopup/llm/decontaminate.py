"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to k = floor(rate * m) edits.  It is split
into k + 1 pieces: with at most k edits, at least one piece is left whole.  An Aho-Corasick
automaton over all pieces finds these in one pass over a document, and Myers' bit-parallel
edit distance verifies the neighbourhood of each hit.  Texts are compared lower-cased, with
each run of white space as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import binaries, nulls_to_empty, split_words

RATE = 0.08
#: Characters of a normalised item from which it is searched for: a shorter one is found in texts that have
#: nothing to do with it.
MIN_CHARS = 25
#: Characters of items in one automaton (about 100 bytes of memory each).
BLOCK_CHARS = 1_000_000


def normalize(data: bytes) -> str:
    return b" ".join(split_words(data)).decode("utf-8", "replace").lower()


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """The edit budget k and the k + 1 pieces (offset, text) of an item."""
    m = len(item)
    k = min(int(rate * m), m - 1)
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern to any substring of ``text``, and the first end
    (exclusive) where it is reached; Myers' bit vectors held in one integer."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The items of one block: their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_chars: int = 1):
        self.items, found = [], {}
        for item_id, text in items:
            if len(text) < max(1, min_chars):
                continue
            k, parts = pieces(text, rate)
            number = len(self.items)
            self.items.append((item_id, text, k, pattern_masks(text), pattern_masks(text[::-1])))
            for offset, part in parts:
                found.setdefault(part, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in found.items():
            self.automaton.add_word(part, (len(part), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) of the nearest occurrence of each item that is within
        its budget; of equally near ones the first end.

        Hits of one item whose windows overlap are verified together, once."""
        if not self.items or not text:
            return []
        starts: dict[int, list[int]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                starts.setdefault(number, []).append(last + 1 - length - offset)
        out = []
        for number, at in starts.items():
            item_id, item, k, masks, backward = self.items[number]
            m, best = len(item), None
            for a, b in _windows(sorted(set(at)), m, k, len(text)):
                distance, end = myers(masks, m, text[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, a + end)
            if best:
                distance, end = best
                _, back = myers(backward, m, text[max(0, end - m - k):end][::-1])
                out.append((item_id, end - back, end, distance))
        return out


def _windows(at: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold every occurrence whose shift is near one of ``at``."""
    a = b = None
    for s in at:
        lo, hi = max(0, s - k), min(n, s + m + k)
        if b is not None and lo <= b:
            b = max(b, hi)
        else:
            if b is not None:
                yield a, b
            a, b = lo, hi
    if b is not None:
        yield a, b


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
               block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, item id, start, end, distance): the nearest occurrence of each item in each row of
    ``docs`` that has it within the edit budget.  Offsets count characters of the normalised
    text (lower-cased, words joined by one blank).

    Null and empty texts have no items; null and empty items, and those of fewer than ``min_chars`` characters once
    normalised, are found nowhere.  Repeated
    documents or items give a row for each; of equally near occurrences the first end counts.  Whole texts are searched, however
    long.  Other columns, clashing names included, are not read; an empty table of
    either kind gives an empty result.  The items are dealt into as many blocks as their total
    length asks for, each block is one automaton of bounded size and one narrow pass over the
    documents; the documents are never shuffled."""
    schema = T.StructType([docs.schema[id_col], T.StructField(item_col, items.schema[item_col].dataType),
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("distance", T.LongType())])
    source = docs.select(id_col, text_col)
    passes = [source.mapInArrow(_searcher(mine, rate, schema, min_chars), schema)
              for mine in _blocks_of(items, item_col, item_text_col, block_chars)]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found


def _searcher(items: list[tuple], rate: float, schema: T.StructType, min_chars: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        matcher = Matcher([(i, normalize(t.encode())) for i, t in items], rate, min_chars)
        shape = to_arrow_schema(schema)
        for batch in batches:
            rows: list[tuple] = []
            for doc, x in zip(batch.column(0), binaries(batch.column(1))):
                if found := matcher.search(normalize(nulls_to_empty(x.as_py()))):
                    doc = doc.as_py()
                    rows += [(doc, *f) for f in found]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    return search


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS,
                  min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the rows whose text has an item within its edit budget; all columns pass on.

    Each row is judged where it is read, so nothing is shuffled.  Nulls and empty texts as in
    ``find_items``: they stay."""
    out = docs
    at = docs.columns.index(text_col)
    for mine in _blocks_of(items, item_col, item_text_col, block_chars):
        out = out.mapInArrow(_dropper(mine, rate, at, min_chars), docs.schema)
    return out


def _blocks_of(items: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """(item, text) lists, each of about ``block_chars`` characters; one empty list where there are no items."""
    rows = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(
        F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    for block in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        yield [(r["item"], r["text"]) for r in mine]


def _dropper(items: list[tuple], rate: float, at: int, min_chars: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([(i, normalize(t.encode())) for i, t in items], rate, min_chars)
        for batch in batches:
            clean = [not matcher.search(normalize(nulls_to_empty(x.as_py()))) for x in binaries(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return drop
