"""Words, word hashes and n-gram hashes of UTF-8 texts, vectorised over one text.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Texts are handled as
UTF-8 bytes: the separators are ASCII, so no multi-byte character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes hashed at once; bounds the temporaries of a very long text

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 64), _U(0xD6E8FEB86659FD93), dtype=np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def split_words(data: bytes) -> list[bytes]:
    return data.split()


def _blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK bytes, cut between words."""
    at, n = 0, len(data)
    while n - at > BLOCK:
        end = at + BLOCK
        window = np.frombuffer(data, dtype=np.uint8, count=BLOCK, offset=at)
        cuts = np.flatnonzero(_SPACE[window[-4096:]])
        if len(cuts):
            end = at + BLOCK - 4096 + int(cuts[-1])
        else:  # a very long word: go on to its end
            while end < n and not _SPACE[data[end]]:
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _hash_block(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    table = _power_table(int(lengths.max()))
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    terms = _BYTE[b[inside]] * table[within]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _STEP)


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, in order."""
    parts = [_hash_block(x) for x in _blocks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words, built by doubling: empty for shorter texts."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    have, span, level = None, 0, words
    size, rest = 1, n
    while rest:
        if rest & 1:
            if have is None:
                have, span = level, size
            else:
                m = len(words) - span - size + 1
                have = mix(have[:m] * _M1 + level[span:span + m] + _U(span))
                span += size
        rest >>= 1
        if rest:
            m = len(level) - size
            level = mix(level[:m] * _M2 + level[size:size + m] + _U(size))
            size *= 2
    return have[:len(words) - n + 1]


def shingle_set(data: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a lower-cased text; the whole
    sequence is one shingle when it has fewer words, and no words give no shingle."""
    if not data:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(lower_ascii(data))
    if not len(w):
        return w
    return np.unique(ngram_hashes(w, min(n, len(w))) if len(w) >= n else mix(ngram_hashes(w, len(w)) + _U(len(w))))


def binaries(column: pa.Array) -> pa.Array:
    """A string column as raw UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def nulls_to_empty(value: bytes | None) -> bytes:
    return value if value is not None else b""
