"""Secret scans with a recursive decoding worklist.

Each layer of a text is scanned for secrets.  Its URL escapes, Unicode escapes, base64
tokens and compressed payloads are unwrapped to further layers until nothing new comes
out; layers seen before are left alone, so cycles end.  Layers carry bytes: those that aren't
UTF-8 stay in the text as lone surrogates.  Every finding is mapped back to the code points of
the text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import binaries, lower_ascii, nulls_to_empty

KINDS = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of [0-9a-f]+ that are long enough
_HEX_MAP = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u(?P<high>[Dd][89ABab][0-9A-Fa-f]{2})\\u(?P<low>[Dd][C-Fc-f][0-9A-Fa-f]{2})"  # a surrogate pair
    r"|\\u\{(?P<braces>[0-9A-Fa-f]{1,6})\}|\\u(?P<four>[0-9A-Fa-f]{4})|\\U(?P<eight>[0-9A-Fa-f]{8})"
    r"|\\x(?P<two>[0-9A-Fa-f]{2})|&#x(?P<markup>[0-9A-Fa-f]{1,6});|&#(?P<decimal>[0-9]{1,7});|\\(?P<octal>[0-3][0-7]{2})")
_BASES = {"decimal": 10, "octal": 8}
_B64_MIN = 19  # of the shortest secret, 14 bytes, without padding
_B64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % _B64_MIN)
_B64_MAP = bytes(0x78 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 0x20
                 for c in range(256))
_PACKED = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00")  # gzip, zlib, bzip2, xz
#: Lines of base64, as mail wraps it: long runs that follow each other with nothing but a line break between.
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{40,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
_BREAKS = re.compile(r"[\r\n \t]+")
_PIECE = 1 << 16
OVERLAP = 1 << 16  # bytes that neighbouring pieces of a large payload share
_ODD = re.compile("[\udc80-\udcff]")  # bytes that aren't UTF-8


def base_spans(text: str, data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain secrets of one layer, in code points, end exclusive."""
    found = []
    low = lower_ascii(data)
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in data.translate(_HEX_MAP):
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


def may_be_encoded(data: bytes) -> bool:
    return b"%" in data or b"\\" in data or b"&#" in data or b"x" * _B64_MIN in data.translate(_B64_MAP)


def _url_run(run: str) -> list[tuple[str, int]]:
    """(character, escapes used) of a run of %XX."""
    out = binascii.unhexlify(run.replace("%", "")).decode("utf-8", "surrogateescape")
    return [(c, 3 * len(c.encode("utf-8", "surrogateescape"))) for c in out]


def _replacements(text: str, kind: str) -> list[tuple[int, int, str]]:
    """(start, end, character) of the escapes of one kind."""
    out = []
    if kind == "url" and "%" in text:
        for m in _URL.finditer(text):
            at = m.start()
            for c, n in _url_run(m[0]):
                out.append((at, at + n, c))
                at += n
    elif kind == "unicode" and ("\\" in text or "&#" in text):
        for m in _ESCAPE.finditer(text):
            if m["high"]:
                code = 0x10000 + ((int(m["high"], 16) - 0xD800) << 10) + int(m["low"], 16) - 0xDC00
            else:
                code = int(m[m.lastgroup], _BASES.get(m.lastgroup, 16))
            if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
                out.append((m.start(), m.end(), chr(code)))
    return out


def _inflate(raw: bytes, at: int, limit: int) -> tuple[bytes | None, int, bool]:
    """The content of the compressed stream at a place, its end, and whether it was left unread for its size."""
    if raw.startswith(b"BZh", at):
        unzip = bz2.BZ2Decompressor()
    elif raw.startswith(b"\xfd7zXZ\x00", at):
        unzip = lzma.LZMADecompressor()
    else:
        unzip = zlib.decompressobj(47)
    parts, room = [], limit
    try:
        while at < len(raw) and not unzip.eof:
            piece = raw[at:at + _PIECE]
            parts.append(unzip.decompress(piece, room + 1))
            at, room = at + len(piece), room - len(parts[-1])
            if room < 0:
                return None, at, True
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return None, at, False
    return b"".join(parts), at - len(unzip.unused_data), False


def _streams(raw: bytes, limit: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, content) of the compressed streams; content None where it was left unread."""
    end = 0
    for m in _PACKED.finditer(raw):
        if m.start() >= end:
            out, to, unread = _inflate(raw, m.start(), limit)
            if out or unread:
                end = to
                yield m.start(), to, out


def _unpacked(raw: bytes, limit: int) -> bytes | None:
    """The bytes, inflated until they don't begin with a stream; None where one was left unread."""
    seen = set()
    while _PACKED.match(raw) and (key := hashlib.sha256(raw).digest()) not in seen:
        seen.add(key)
        parts, at, room = [], 0, limit
        while _PACKED.match(raw, at):
            out, to, unread = _inflate(raw, at, room)
            if unread:
                return None
            if out is None:
                break
            parts.append(out)
            at, room = to, room - len(out)
        if not at:
            break
        raw = b"".join(parts) + raw[at:]
    return raw


def _of_use(text: str, raw: bytes, limit: int) -> bool:
    """Whether a layer holds a secret or something to unwrap."""
    data = text.encode("utf-8", "replace")
    return bool(base_spans(text, data) or may_be_encoded(data) and any(p.search(text) for p in (_URL, _ESCAPE, _B64))
                or next(_streams(raw, limit), None))


def _texts(raw: bytes, limit: int) -> Iterator[str]:
    """The bytes as UTF-8 and as UTF-16.  Bytes that are no clean text count where something is found in them."""
    text = raw.decode("utf-8", "surrogateescape")
    odd = sum(c < 32 and c not in (9, 10, 13) for c in raw)
    clean = odd * 10 <= len(raw) and not _ODD.search(text)
    if text and (clean or _of_use(text, raw, limit)):
        yield text
    if b"\0" in raw:
        for code in ("utf-16-le", "utf-16-be"):
            if _of_use(text := raw.decode(code, "replace"), b"", limit):
                yield text


def _chained(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of the compressed streams that ``chunks`` begin with, one after the other, then the rest as it is."""
    held, unzip = b"", None
    for chunk in chunks:
        held += chunk
        while held:
            if unzip is None:
                if not _PACKED.match(held):
                    yield held
                    held = b""
                    break
                unzip = (bz2.BZ2Decompressor() if held.startswith(b"BZh") else lzma.LZMADecompressor()
                         if held.startswith(b"\xfd7zXZ\x00") else zlib.decompressobj(47))
            try:
                out = unzip.decompress(held, _PIECE)
                held = unzip.unconsumed_tail if hasattr(unzip, "unconsumed_tail") else b""
                yield out
                while not unzip.eof and hasattr(unzip, "needs_input") and not unzip.needs_input:
                    yield unzip.decompress(b"", _PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            if unzip.eof:
                held, unzip = unzip.unused_data, None
            elif not held:
                break


def _large_pieces(raw: bytes, limit: int) -> Iterator[bytes]:
    """The content of a payload of any size, streams within streams unwrapped, in pieces of up to ``limit`` bytes (and
    four times the overlap at least) that share ``OVERLAP`` bytes with the next."""
    chunks, seen = iter([raw]), set()
    while True:
        first = b""
        for x in chunks:
            first += x
            if len(first) >= 64:
                break
        if not _PACKED.match(first) or hashlib.sha256(first[:_PIECE]).digest() in seen:
            break
        seen.add(hashlib.sha256(first[:_PIECE]).digest())
        chunks = _chained(_before(first, chunks))
    most, held = max(limit, 4 * OVERLAP), bytearray()
    for x in _before(first, chunks):
        held += x
        while len(held) >= most:
            yield bytes(held[:most])
            del held[:most - OVERLAP]
    yield bytes(held)


def _before(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _decoded(token: str) -> bytes:
    token = token[:len(token) - (len(token) % 4 == 1)]
    try:
        return base64.b64decode(token + "=" * (-len(token) % 4))
    except (binascii.Error, ValueError):
        return b""


def _payloads(text: str, decoded: bool, limit: int) -> Iterator[tuple[int, int, str | bytes]]:
    """(start, end, content) of base64 tokens and, in decoded layers, of compressed streams; content is bytes, packed
    as they are, where it is larger than the limit.

    A run of base64 characters may hold more than the token (a path or a name before it, which shifts its groups of
    four), so it is decoded from each of its first four places; from the later three it counts
    only where something is found in it.  Wrapped lines are joined as well."""
    runs = [(m.start(), m.end(), m[0]) for m in _B64.finditer(text)]
    if "\n" in text:
        runs += [(m.start(), m.end(), _BREAKS.sub("", m[0])) for m in _WRAPPED.finditer(text)]
    for start, end, run in runs:
        token = run.rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):
            if not (raw := _decoded(token[shift:])):
                continue
            packed = raw
            if (raw := _unpacked(raw, limit)) is None:
                yield start, end, packed
                continue
            for out in _texts(raw, limit):
                if not shift or _of_use(out, out.encode("utf-8", "surrogateescape"), limit):
                    yield start, end, out
    if decoded and _PACKED.search(raw := text.encode("utf-8", "surrogateescape")):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000)
        ends = np.cumsum(np.where((code >= 0xDC80) & (code <= 0xDCFF), 1, size))
        for at, to, inside in _streams(raw, limit):
            a, b = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, to - 1, "right")) + 1
            if inside is None or (inside := _unpacked(inside, limit)) is None:
                yield a, len(text), raw[at:]
            else:
                for out in _texts(inside, limit):
                    yield a, b, out


def scan(data: bytes, max_layer_bytes: int = 1 << 26) -> tuple[list, list, int, int]:
    """Base spans, all spans, number of decoded layers and of payloads scanned in pieces for their size.

    A layer's ``first``/``last`` give, for each of its characters, the code points of the
    original text that it came from; ``made`` tells which characters a decoding made.  A
    finding in a decoded layer counts if it holds such a character."""
    if not data:
        return [], [], 0, 0
    text = data.decode("utf-8", "replace")
    base = base_spans(text, data)
    if not may_be_encoded(data):
        return base, base, 0, 0
    spans, seen, work, layers, large = set(base), {(text, 0, len(text))}, deque([(text, None, None, None)]), 0, 0
    while work:
        now, first, last, made = work.popleft()
        n, children = len(now), []
        if first is None:
            first, last, made = np.arange(n), np.arange(1, n + 1), np.zeros(n, dtype=bool)
        for kind in ("url", "unicode"):
            if put := _replacements(now, kind):
                out, at = [], 0
                for a, b, c in put:
                    out += (now[at:a], c)
                    at = b
                starts, ends = (np.array([x[i] for x in put]) for i in (0, 1))
                # of each escape one character stays, with the end of the whole escape
                gone = np.zeros(n + 1, dtype=np.int32)
                np.add.at(gone, starts + 1, 1)
                np.add.at(gone, ends, -1)
                stay = np.cumsum(gone[:n]) == 0
                e, new = last.copy(), made.copy()
                e[starts], new[starts] = last[ends - 1], True
                children.append(("".join(out) + now[at:], first[stay], e[stay], new[stay]))
        for a, b, inside in _payloads(now, made.any(), max_layer_bytes):
            if isinstance(inside, bytes):
                # every finding in it has the span of the payload, so its pieces are scanned one by one and let go
                key = (inside, int(first[a]), int(last[b - 1]))
                if key not in seen:
                    seen.add(key)
                    large, layers = large + 1, layers + 1
                    for piece in _large_pieces(inside, max_layer_bytes):
                        _, found, n, more = scan(piece, max_layer_bytes)
                        layers, large = layers + n, large + more
                        spans.update((int(first[a]), int(last[b - 1]), kind) for _, _, kind in found)
                continue
            m = len(inside)
            children.append((inside, np.full(m, first[a]), np.full(m, last[b - 1]), np.ones(m, dtype=bool)))
        for child in children:
            inside, f, e, new = child
            if not inside or (key := (inside, int(f[0]), int(e[-1]))) in seen:
                continue
            seen.add(key)
            layers += 1
            work.append(child)
            for a, b, kind in base_spans(inside, inside.encode("utf-8", "replace")):
                if new[a:b].any():
                    spans.add((int(f[a:b].min()), int(e[a:b].max()), kind))
    return base, sorted(spans, key=lambda x: (x[0], _ORDER[x[2]], x[1])), layers, large


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_layer_bytes: int = 1 << 26) -> DataFrame:
    """One row for each row of ``docs``: counts of its plain secrets by kind, their spans and all
    spans (``kind:start:end``, code points of the given text, end exclusive).

    ``n_layers`` counts the decoded layers.  A payload that unpacks to more than ``max_layer_bytes`` is scanned
    whole, in pieces of that size that overlap by 64 KB, so that memory stays bounded; ``n_streamed`` counts these.
    Only an encoded token of more than 64 KB inside such a payload may be cut by a piece's end.  Whole texts are scanned,
    however long.  Findings that tie in place and kind are one.  A null text counts as empty: no secrets.  Repeated rows are scanned each for
    itself, other columns are not read, and an empty table gives an empty table.  One narrow
    pass: nothing is shuffled."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
        + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()),
           T.StructField("n_layers", T.LongType()), T.StructField("n_streamed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(nulls_to_empty(x.as_py()), max_layer_bytes) for x in binaries(batch.column(1))]
            counts = [pa.array([sum(s[2] == k for s in f[0]) for f in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([joined(f[0]) for f in found], pa.string()),
                 pa.array([joined(f[1]) for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64()),
                 pa.array([f[3] for f in found], pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
