"""Encodings that once hid a secret, payloads of any size, and the base columns of a whole table by plain search."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib

from mopup.llm import secrets
from mopup.llm.queries import op2_secret_scan

SECRET = "token=abcdefgh12"


def b64(x):
    return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()


def spans(text, **more):
    return secrets.scan(text.encode(), **more)[1]


def test_tokens_behind_names_and_paths():
    rng = random.Random(1)
    for text in (SECRET, "x" * 7 + " " + SECRET, "password: hunter2hunter2 and more of it"):
        for packed in (b64(text), b64(text).rstrip("="), b64(gzip.compress(text.encode())), b64(text).replace("+", "-").replace("/", "_")):
            for head in ("https://x.org/cb/", "p/", "a-", "id_", "ab/cd/e+f-", "x_", "xy_", "xyz_", "".join(rng.choice("abcXYZ019/_-") for _ in range(40)) + "/"):
                for tail in ("", "/view", " end"):
                    got = spans(f"see {head}{packed}{tail}")
                    assert got and all(k == "assign" and a >= 4 for a, _, k in got), (head, packed, tail)
    assert spans("path/to/some/very/long/name_without-anything/hidden/in/it/at/all") == []


def test_wrapped_lines():
    text = "nothing to see in this long beginning of a message " * 3
    for pad in range(60):
        for sep in ("\n", "\r\n", "\n  "):
            whole = b64(text + "y" * pad + SECRET + " end")
            lines = sep.join(whole[i:i + 76] for i in range(0, len(whole), 76))
            assert spans("mail:\n" + lines + "\nbye"), (pad, sep)


def test_escapes():
    hidden = [r"\164oken=abcdefgh12", r"\U00000074oken=abcdefgh12", "".join(f"\\{ord(c):03o}" for c in SECRET),
              "".join(f"\\U{ord(c):08x}" for c in SECRET), "".join(f"&#{ord(c)};" for c in SECRET), "".join(f"\\x{ord(c):02x}" for c in SECRET)]
    for text in hidden:
        assert spans("é " + text) == [(2, 2 + len(text), "assign")], text
    u = "\\u"
    pair = f"{u}d83d{u}de00 {u}0074oken=abcdefgh12"
    assert spans(pair) == [(13, len(pair), "assign")]
    assert spans(r"\ud83d alone \U99999999 \400") == []


def test_payloads_of_any_size_are_scanned_whole():
    filler = b"just words " * 40_000
    secret = SECRET.encode()
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: zlib.compress(gzip.compress(x)),
                 lambda x: gzip.compress(x[:100_000]) + gzip.compress(x[100_000:])):
        for body in (filler + secret + b" " + filler, secret + b" " + filler, filler + b" " + secret,
                     filler + b" " + b64(secret + b" here").encode() + b" " + filler):
            text = b64(pack(body))
            base, found, layers, large = secrets.scan(f"a {text} z".encode(), 300_000)
            assert found == [(2, 2 + len(text), "assign")] and large >= 1 and base == []
        assert secrets.scan(b64(pack(filler)).encode(), 300_000)[1] == []
    # a secret at every place around the end of a piece
    most = 4 * secrets.OVERLAP
    for at in range(most - 40, most + 20, 3):
        text = b64(zlib.compress(b" " * at + secret + b" " * 300_000))
        assert spans(text, max_layer_bytes=1000) == [(0, len(text), "assign")]
    broken = b64(gzip.compress(filler + secret)[:-20])
    assert secrets.scan(broken.encode(), 1000)[0] == []


def test_base_columns_of_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assign = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    rank = {"assign": 0, "access": 1, "hex": 2}
    want = {}
    for r in table:
        t = r["text"] or ""
        found = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        found.sort(key=lambda x: (x[0], rank[x[1]]))
        line = ",".join(f"{k}:{a}:{b}" for a, k, b in found)
        want[r["doc_id"]] = ([sum(k == kind for _, k, _ in found) for kind in rank], hashlib.sha256(line.encode()).hexdigest(),
                             set(line.split(",")) - {""})
    got = op2_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    for r in got:
        counts, digest, listed = want[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == digest
        assert listed <= set(r["spans"].split(","))
