"""Readers and sinks (M18): charsets, separators, header repair, blank lines,
rejected rows, dense row ids, CSV / report round trips."""

import json
import os

from mopup.rowid import add_row_id
from mopup.sources.readers import _json_keys, read_table, repair_header, sniff_separator
from mopup.sources.sinks import json_safe, write_csv, write_report


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_header_repair_and_sniff():
    assert repair_header(["a", "a", "", "b"]) == ["a", "a.1", "Unnamed: 2", "b"]
    assert repair_header(["a", "a", "a.1"]) == ["a", "a.1", "a.1.1"]
    assert sniff_separator("x;y;z") == ";" and sniff_separator("x\ty") == "\t" and sniff_separator("x") == ","


def test_same_table_in_three_charsets(spark, tmpdir_path):
    text = "name,city\ncafé,Zürich\nthé,Genève\n"
    paths = [_write(tmpdir_path, "u8.csv", text.encode("utf-8")),
             _write(tmpdir_path, "bom.csv", b"\xef\xbb\xbf" + text.encode("utf-8")),
             _write(tmpdir_path, "l1.csv", text.encode("latin-1"))]
    got = []
    for p in paths:
        r = read_table(spark, p)
        got.append(([c for c in r.df.columns], sorted(tuple(x) for x in r.df.collect())))
    assert got[0] == got[1] == got[2]
    assert got[0][0] == ["row_id", "name", "city"]


def test_separators_blank_line_and_rejects(spark, tmpdir_path):
    for sep, name in ((",", "c.csv"), (";", "s.txt"), ("\t", "t.tsv")):
        body = sep.join(["a", "a", "", "b"]) + "\n" + sep.join("1234") + "\n\n" + sep.join("567") + "\n" \
            + sep.join(["8", "9", "10", "11", "12"]) + "\n"
        r = read_table(spark, _write(tmpdir_path, name, body.encode()))
        assert r.sep == sep
        assert r.df.columns == ["row_id", "a", "a.1", "Unnamed: 2", "b"]
        data = sorted(tuple(x) for x in r.df.collect())
        assert [d[0] for d in data] == [0, 1]          # blank line skipped, long row rejected
        assert data[1][4] is None                      # short row kept, padded
        assert [x["line"] for x in r.rejects.collect()] == [sep.join(["8", "9", "10", "11", "12"])]


def test_na_tokens_and_types(spark, tmpdir_path):
    body = "i,f,b,s\n1,1.5,True,x\n2,N/A,False,-\n3,2,true,NULL\n"
    r = read_table(spark, _write(tmpdir_path, "t.csv", body.encode()))
    assert dict(r.df.dtypes) == {"row_id": "bigint", "i": "bigint", "f": "double", "b": "boolean", "s": "string"}
    got = sorted(tuple(x) for x in r.df.collect())
    assert got[1] == (1, 2, None, False, "-")          # '-' is not a read-time NA token
    assert got[2][4] is None


def test_json_array(spark, tmpdir_path):
    p = _write(tmpdir_path, "t.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]).encode())
    r = read_table(spark, p)
    assert sorted(tuple(x) for x in r.df.collect()) == [(0, 1, "x"), (1, 2, None)]


def test_dense_row_ids_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id * 3 as v")
    out = add_row_id(df)
    ids = sorted(r["row_id"] for r in out.collect())
    assert ids == list(range(1000))
    assert sorted((r["row_id"], r["v"]) for r in out.collect())[10] == (10, 30)


def test_csv_and_report_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([(0, "a", 1.0), (1, None, float("inf"))], "row_id bigint, t string, x double")
    write_csv(df, os.path.join(tmpdir_path, "out"))
    back = spark.read.csv(os.path.join(tmpdir_path, "out"), header=True)
    assert back.columns == ["t", "x"] and back.count() == 2
    assert json_safe(df).where("x is null").count() == 1
    write_report({"summary": df}, os.path.join(tmpdir_path, "rep"))
    assert spark.read.json(os.path.join(tmpdir_path, "rep", "summary")).count() == 2


def test_json_column_order_of_a_long_first_record(spark, tmpdir_path):
    long = {"z": "é\\" * 50_000, "m": [{"q": i} for i in range(300)], "b": 1, "a": "x"}
    wide = {f"k{i * 7919 % 500}": i for i in range(500)}
    for name, record, indent in [("one_line", long, None), ("many_lines", long, 1), ("many_keys", wide, 1)]:
        p = _write(tmpdir_path, name + ".json", json.dumps([record, {"a": "y"}], indent=indent, ensure_ascii=False).encode())
        df = read_table(spark, p).df
        assert [c for c in df.columns if c != "row_id"][:len(record)] == list(record), name
    p = _write(tmpdir_path, "long.jsonl", (json.dumps(long) + "\n" + '{"a": "y"}\n' * 400).encode())
    assert [c for c in read_table(spark, p).df.columns if c != "row_id"] == list(long)
    bad = _write(tmpdir_path, "bad.json", b'{"b": 1, oops ' + b"x" * 200_000)
    assert _json_keys(spark, bad, "UTF-8") == []


def test_json_lines_and_key(spark, tmpdir_path):
    p = _write(tmpdir_path, "t.jsonl", b'{"id": 7, "b": "x"}\n{"id": 9, "b": null}\n')
    r = read_table(spark, p, key="id")
    assert r.df.columns[0] == "row_id"
    assert sorted((x["row_id"], x["b"]) for x in r.df.collect()) == [(7, "x"), (9, None)]


def test_rejects_same_for_any_column_selection(spark, tmpdir_path):
    p = _write(tmpdir_path, "r.csv", b"a,b\n1,2\n3,4,5\n6,7\n8\n")
    r = read_table(spark, p, infer=False)
    assert r.rejects.count() == 1 and len(r.rejects.collect()) == 1
    assert r.df.count() == 3 and r.df.select("a").count() == 3


def test_headers_are_matched_by_name(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "folder")
    os.mkdir(d)
    _write(d, "1.csv", b"id,name,v\n1,x,10\n2,y,20\n")
    _write(d, "2.csv", b"name,id,v\nz,3,30\n")
    _write(d, "3.csv", "v;id;größe\n40;4;1\n".encode("latin-1"))
    _write(d, "4.csv", b'id,"na\nme",v\n5,"w\r\nw",50\n')
    _write(d, "5.csv", b"id,name\n")
    r = read_table(spark, d, fmt="csv")
    assert r.df.columns == ["row_id", "id", "name", "v", "größe", "na\nme"]
    assert [tuple(x) for x in r.df.orderBy("row_id").collect()] == [
        (0, 1, "x", 10, None, None), (1, 2, "y", 20, None, None), (2, 3, "z", 30, None, None), (3, 4, None, 40, 1.0, None),
        (4, 5, None, 50, None, "w\r\nw")]


def test_quoted_line_breaks_over_many_splits(spark, tmpdir_path):
    """A file whose records go on over lines and splits is read by many tasks, in order."""
    import csv
    import io
    import random
    rng = random.Random(3)
    rows = [[str(i), "".join(rng.choice(['a', 'é', ' ', '"', ',', '\n', 'bb', '\n\n']) for _ in range(rng.randint(0, 60))) + "x", f"t{i}"]
            for i in range(3000)]
    rows[1500][1] = "long\n" * 30_000 + "end"   # one record over several splits
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["n", "text", "tag"], *rows])
    p = _write(tmpdir_path, "q.csv", out.getvalue().encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        from mopup.sources import readers
        assert readers._records(spark, [p], "UTF-8").select(readers._FILE, "record").count() == 3000
        assert readers._lines(spark, p).rdd.getNumPartitions() > 4
        r = read_table(spark, p)
        got = [tuple(x)[1:] for x in r.df.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(int(a), b, c) for a, b, c in rows]
    assert r.rejects.count() == 0


def test_large_json_array_is_cut_by_many_tasks(spark, tmpdir_path, monkeypatch):
    """Braces, quotes and escapes in strings, nested values, pretty print; the same rows as one task reads."""
    import random
    from mopup.sources import readers
    rng = random.Random(9)
    texts = ['{"a": 1}', '}', '{', '"', '\\', '\\"}', 'é{', '[', ']', '', 'line\nbreak', '\\\\', '"}{"']
    rows = [{"n": i, "t": "".join(rng.choice(texts) for _ in range(rng.randint(0, 30))), "o": {"x": rng.choice(texts), "l": [{"y": "}"}] * (i % 3)}}
            for i in range(3000)]
    one = _write(tmpdir_path, "one.json", json.dumps(rows, ensure_ascii=False).encode())
    pretty = _write(tmpdir_path, "pretty.json", ("\n " + json.dumps(rows, indent=2) + "\n").encode())
    latin = _write(tmpdir_path, "latin.json", json.dumps(rows, ensure_ascii=False).encode("latin-1"))
    plain = [tuple(r) for r in read_table(spark, one).df.orderBy("row_id").collect()]
    assert [r[1] for r in plain] == list(range(3000)) and [r[2] for r in plain] == [r["t"] for r in rows]
    monkeypatch.setattr(readers, "SPREAD_ABOVE", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for p in (one, pretty, latin):
            r = read_table(spark, p)
            assert r.df.columns == ["row_id", "n", "t", "o"]
            assert [tuple(x) for x in r.df.orderBy("row_id").collect()] == plain, p
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
