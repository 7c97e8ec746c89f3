"""Sources S1-S7: delimited text (separator sniffed), TSV, JSON, Parquet, with
charset choice, header repair, NA tokens, type inference and a rejects frame.

Every step is a Spark read or one aggregate over the files; nothing is parsed
on the driver except the header line.
"""

from __future__ import annotations

import csv
import json
import os
import re
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..functions import exprs as X
from ..functions import tokens
from ..functions.frames import agg_chunked
from ..rowid import add_row_id

#: Bytes of a JSON array file from which it is cut into records by many tasks.
SPREAD_ABOVE = 64 << 20
BOM = "﻿"
CORRUPT = "_corrupt_record"


@dataclass
class ReadResult:
    df: DataFrame                 # row_id first, then the columns
    rejects: DataFrame | None     # malformed lines (too many fields), raw text
    encoding: str | None = None
    sep: str | None = None
    header: list | None = None


@dataclass(frozen=True)
class FileTraits:
    """What decides how a file is read."""
    encoding: str
    multi_line: bool      # some quoted cell goes on over a line break
    bare_returns: bool = False  # lines may end in a carriage return alone
    large: bool = False         # more than SPREAD_ABOVE bytes


def _lines(spark: SparkSession, files) -> DataFrame:
    """(file, block, at, value): the raw lines, in the order of ``at`` within each split of a file."""
    return spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_size").alias("size"))


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _surveyed(spark: SparkSession, path) -> list:
    """One row a file, from one pass over the raw lines: counts, and where its first line is."""
    lines = _lines(spark, path)
    first = F.when((F.col("block") == 0) & (F.length(F.rtrim("value")) > 0), F.col("at"))
    return lines.groupBy("file").agg(
        F.count(F.when(~F.is_valid_utf8("value"), 1)).alias("bad"),
        F.count(F.when(_quotes(F.col("value")) % 2 == 1, 1)).alias("odd"),
        F.count(F.when(F.col("value").rlike(r"\r(?!$)"), 1)).alias("returns"),
        F.count(F.when(F.contains("value", F.lit('"')), 1)).alias("quoted"), F.min(first).alias("first"),
        F.max("size").alias("size")).orderBy("file").collect()


def file_traits(spark: SparkSession, path) -> dict[str, FileTraits]:
    """S4 and S1, for each file: UTF-8 when every line is valid UTF-8, else ISO-8859-1 (which decodes
    any byte); and whether some line has an odd number of quotes.  One distributed pass over the raw
    lines; one row a file comes back."""
    return {unquote(r["file"]): _traits(r) for r in _surveyed(spark, path)}


def _traits(r) -> FileTraits:
    returns = r["returns"] > 0
    return FileTraits("UTF-8" if r["bad"] == 0 else "ISO-8859-1", r["odd"] > 0 or (returns and r["quoted"] > 0), returns,
                      r["size"] > SPREAD_ABOVE)


def _decoded(line: Column, encoding: str) -> Column:
    return line if encoding == "UTF-8" else F.decode(line.cast("binary"), encoding)


def _first_lines(spark: SparkSession, path, rows: list) -> dict[str, str]:
    """The first line with text of each file, found by its place."""
    places = [r["first"] for r in rows if r["first"] is not None]
    places = spark.createDataFrame([(p,) for p in places], "at bigint")
    found = _lines(spark, path).join(F.broadcast(places), "at").select("file", "value", F.decode(
        F.col("value").cast("binary"), "ISO-8859-1").alias("latin")).collect()
    by = {unquote(r["file"]): r for r in rows}
    return {unquote(r["file"]): (r["value"] if by[unquote(r["file"])]["bad"] == 0 else r["latin"]).rstrip("\r") for r in found}


def detect_encoding(spark: SparkSession, path: str) -> str:
    """S4 for a path as a whole: UTF-8 when every file is."""
    return "UTF-8" if all(t.encoding == "UTF-8" for t in file_traits(spark, path).values()) else "ISO-8859-1"


def sniff_separator(first_line: str) -> str:
    """The candidate separator that occurs most often in the header line outside quotes."""
    bare = re.sub(r'"(?:[^"]|"")*"?', "", first_line)
    counts = [(bare.count(s), -i, s) for i, s in enumerate(tokens.SEPARATOR_CANDIDATES)]
    best = max(counts)
    return best[2] if best[0] > 0 else ","


def repair_header(names: list) -> list[str]:
    """Blank names become ``Unnamed: i``; repeats get ``.1``, ``.2`` ..."""
    out, used, seen = [], set(), {}
    for i, n in enumerate(names):
        n = "" if n is None else str(n)
        if i == 0:
            n = n.lstrip(BOM)
        if n.strip() == "":
            n = f"Unnamed: {i}"
        if n in seen or n in used:
            k = seen.get(n, 1)
            while f"{n}.{k}" in used:
                k += 1
            seen[n] = k + 1
            n2 = f"{n}.{k}"
        else:
            seen[n] = 1
            n2 = n
        used.add(n2)
        out.append(n2)
    return out


def _na_to_null(c: Column) -> Column:
    return F.when(c.isin(*X.lits(tokens.READ_NA_TOKENS)), F.lit(None).cast("string")).otherwise(c)


def infer_types(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Strict per-column inference from one aggregate: BIGINT (integers, no gaps),
    DOUBLE (numbers; integers with gaps), BOOLEAN (True/False words), else STRING.  Columns ``keep``
    pass on as they are."""
    if not cols:
        return df
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = X.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count(X.parse_int(x)).alias(f"i{i}"),
                 F.count(X.parse_number(x)).alias(f"d{i}"),
                 F.count(F.when(F.lower(X.strip_ws(x)).isin("true", "false"), 1)).alias(f"b{i}")]
    r = agg_chunked(df, aggs).collect()[0]
    new = {}
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        x = X.col(c)
        if n == 0:
            new[c] = F.lit(None).cast("double")   # an all-empty column reads as floating point
            continue
        if r[f"i{i}"] == n and n == r["_rows"]:
            new[c] = X.parse_int(x)
        elif r[f"d{i}"] == n:
            new[c] = X.parse_number(x)
        elif r[f"b{i}"] == n:
            new[c] = F.lower(X.strip_ws(x)) == "true"
        else:
            continue
    return df.select(*[(new[c].alias(c) if c in new else X.col(c)) for c in [*cols, *keep]])


_FILE, _BLOCK = "__mopup_file", "__mopup_block"


def _placed(df: DataFrame) -> DataFrame:
    """With the file and the offset of the split that each row was read from."""
    return df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))


def _by_traits(traits: dict[str, FileTraits]) -> list[tuple[FileTraits, list[str]]]:
    kinds = dict.fromkeys(traits.values())
    return [(k, [f for f, t in traits.items() if t == k]) for k in kinds]


@dataclass(frozen=True)
class _Layout:
    """Files that are read alike."""
    traits: FileTraits
    sep: str
    names: tuple


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   key: str | None = None, infer: bool = True, multi_line: bool | None = None,
                   row_id: str = "row_id") -> ReadResult:
    """S1/S2/S4-S7.  ``sep=None`` sniffs it from each file's header line (``.tsv`` → tab).

    Each file is read with its own charset, separator and header.  Columns of several files are matched by name: those of
    the first file (by path) come first, in its order, others follow as they appear, and cells of a column that a
    file lacks are missing.  Files are split over tasks, those with quoted line breaks too (see ``_records``);
    only files that have both quotes and lines ended by a carriage return alone are read whole.
    ``encoding`` and ``multi_line`` set these for all files.  Without
    ``key``, row ids follow the files by name and the lines within them."""
    rows = _surveyed(spark, path)
    traits = {unquote(r["file"]): _traits(r) for r in rows}
    forced = multi_line is not None
    if encoding is not None or forced:
        traits = {f: FileTraits(encoding or t.encoding, multi_line if forced else t.multi_line, t.bare_returns)
                  for f, t in traits.items()}
    encodings = sorted({t.encoding for t in traits.values()}, key=lambda e: e != "UTF-8")
    enc = encodings[0] if len(encodings) == 1 else ",".join(encodings) or "UTF-8"
    if sep is None and path.lower().endswith(".tsv"):
        sep = "\t"
    heads = _first_lines(spark, path, rows)
    if not heads:
        return ReadResult(spark.createDataFrame([], f"{row_id} bigint"), None, enc, sep or ",", [])
    layouts: dict[_Layout, list[str]] = {}
    for f in sorted(heads):
        line, t = heads[f].lstrip(BOM), replace(traits[f], large=False)
        s = sep or sniff_separator(line.split("\r")[0])
        if encoding is not None or t.bare_returns or _quotes_in(line) % 2:  # the header may be more than this line
            top = list(spark.read.csv(f, sep=s, header=False, encoding=t.encoding, escape='"', multiLine=t.multi_line).first())
        else:
            top = [v or None for v in next(csv.reader([line], delimiter=s))]
        layouts.setdefault(_Layout(t, s, tuple(repair_header(top))), []).append(f)
    names = list(dict.fromkeys(n for layout in layouts for n in layout.names))
    good, rejects = None, None
    for layout, files in layouts.items():
        kept, bad = _read_layout(spark, layout, files, spread=not forced and not layout.traits.bare_returns)
        missing = [n for n in names if n not in layout.names]
        kept = kept.select(*[X.col(n) if n not in missing else F.lit(None).cast("string").alias(n) for n in names], _FILE, _BLOCK)
        bad = bad.select("line", *[X.col(n) if n not in missing else F.lit(None).cast("string").alias(n) for n in names])
        good = kept if good is None else good.unionByName(kept)
        rejects = bad if rejects is None else rejects.unionByName(bad)
    if infer:
        good = infer_types(good, names, keep=[_FILE, _BLOCK])
    first = next(iter(layouts))
    return ReadResult(add_row_id(good, row_id, key, place=(_FILE, _BLOCK)), rejects, enc, sep or first.sep, names)


def _quotes_in(line: str) -> int:
    return line.count('"')


def _read_layout(spark: SparkSession, layout: _Layout, files: list[str], spread: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of files of one layout, with the place of each row."""
    names, sep, kind = layout.names, layout.sep, layout.traits
    fields = [T.StructField(f"_f{i}", T.StringType(), True) for i in range(len(names))]
    schema = T.StructType(fields + [T.StructField(CORRUPT, T.StringType(), True)])
    if kind.multi_line and spread:
        options = {"sep": sep, "escape": '"', "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
                   "multiLine": "true"}
        parsed = F.from_csv("record", schema.simpleString(), options)
        raw = _records(spark, files, kind.encoding).select(parsed.alias("_r"), _FILE, _BLOCK).select("_r.*", _FILE, _BLOCK)
    else:
        raw = _placed(spark.read.csv(files, sep=sep, header=True, encoding=kind.encoding, escape='"', schema=schema,
                                     mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
                                     multiLine=kind.multi_line, nullValue=None, emptyValue=""))
    # a flagged line is rejected only when it has more fields than the header;
    # shorter lines are kept with the missing cells null
    wide = T.StructType(fields + [T.StructField("_extra", T.StringType(), True)])
    extra = F.from_csv(F.col(CORRUPT), wide.simpleString(), {"sep": sep, "escape": '"'})["_extra"]
    # the predicate reads every parsed field (in a form the optimizer cannot fold
    # away): with CSV column pruning, whether a line counts as malformed depends on
    # the columns a query needs, and a scan of the corrupt-record column alone is
    # refused; reading all fields makes both frames the same for any later query
    touch = F.length(F.concat_ws("", *[F.col(f"_f{i}") for i in range(len(names))])) >= 0
    too_long = F.col(CORRUPT).isNotNull() & extra.isNotNull() & touch
    good = raw.where(~too_long).select(
        *[_na_to_null(F.col(f"_f{i}")).alias(n) for i, n in enumerate(names)], _FILE, _BLOCK)
    # the parsed fields ride along: Spark refuses a query on the corrupt column alone
    rejects = raw.where(too_long).select(F.col(CORRUPT).alias("line"),
                                         *[F.col(f"_f{i}").alias(n) for i, n in enumerate(names)])
    return good, rejects


def _records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """(record, file, place): the records of files with quoted line breaks, without their headers.

    A line begins a record where the number of quotes before it in its file is even.  Within a split that is a running
    sum; the splits' own sums, one row each, are added up on the driver.  Lines of a record then meet by
    its number, so a file of any size is read by as many tasks as it has splits, and a task holds one record at a time.
    Records are put back in the order of the file by a range partitioning on their number."""
    odd = (_quotes(F.col("value")) % 2).cast("int")
    split = W.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("odd").over(split.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = _lines(spark, files).withColumn("odd", odd).withColumn("inside", before)
    # records begun in the split up to each line, if it starts outside a quoted cell and if it starts inside one
    upto = split.rowsBetween(W.unboundedPreceding, 0)
    lines = session.stage(lines.select(
        "file", "block", "at", "value", "odd", F.sum(1 - F.col("inside")).over(upto).alias("n0"),
        F.sum("inside").over(upto).alias("n1")))
    sums = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.max("n0").alias("n0"), F.max("n1").alias("n1")).collect()
    starts, state = [], {}
    for r in sorted(sums, key=lambda r: (r["file"], r["block"])):  # one row for each split of a file
        inside, seen = state.get(r["file"], (0, 0))
        starts.append((r["file"], r["block"], inside, seen))
        state[r["file"]] = ((inside + r["odd"]) % 2, seen + r["n1" if inside else "n0"])
    table = spark.createDataFrame(starts, "file string, block bigint, inside int, seen bigint")
    numbered = lines.join(F.broadcast(table), ["file", "block"]).select(
        "file", (F.col("seen") + F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1"))).alias("n"),
        F.struct("block", "at", _decoded(F.col("value"), encoding).alias("value")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]), "\n")
    records = numbered.groupBy("file", "n").agg(F.regexp_replace(text, r"\r$", "").alias("record"))
    # the header is the first record with text
    told = records.filter(F.length(F.trim("record")) > 0)
    head = told.groupBy("file").agg(F.min("n").alias("head"))
    told = told.join(F.broadcast(head), "file").filter("n > head")
    ordered = told.repartitionByRange("file", "n").sortWithinPartitions("file", "n")
    return ordered.select("record", F.col("file").alias(_FILE), F.spark_partition_id().cast("bigint").alias(_BLOCK))


#: Characters at the start of a JSON file in which the first record's keys are looked for at first;
#: a record that goes on beyond them is read on to its end.
_JSON_HEAD = 1 << 16


def _json_keys(spark: SparkSession, file: str, encoding: str) -> list[str]:
    """The keys of a file's first record, in their order; [] where it isn't valid JSON."""
    text = spark.read.option("encoding", encoding).text(file)
    lines, chars = 200, _JSON_HEAD
    while True:
        rows = [r[0] or "" for r in text.select(F.substring("value", 1, chars)).take(lines)]
        joined = "\n".join(rows)
        head = joined[:chars].lstrip(BOM).rstrip()
        try:
            record, _ = json.JSONDecoder().raw_decode(head, head.index("{"))
            return list(record)
        except json.JSONDecodeError as e:
            # at a cut, a string has no end, or the error is at the last few characters
            cut = e.msg.startswith("Unterminated string") or e.pos >= len(head) - 16
        except ValueError:
            cut = not head.strip("[ \t\r\n")
        if not cut or len(joined) < chars and len(rows) < lines:
            return []
        if len(joined) < chars:
            lines *= 4
        else:  # as many lines as the head held, so that what is fetched grows with the record only
            lines, chars = joined.count("\n", 0, chars) + 1, 4 * chars


def _array_records(spark: SparkSession, files: list[str], encoding: str) -> str:
    """A folder of JSON Lines with the records of array files, in order.

    The files are read in pieces that end with a closing brace, which any split can begin at.  A piece's quotes and
    braces, counted for both cases (it starts inside a string or not), give running sums within its split; the splits'
    sums, one row each, are added up on the driver.  A record ends where the depth comes back to 0, and its pieces
    meet by its number.  Every task holds one split's pieces or one record."""
    body = F.regexp_replace(F.col("value"), r"(?s)\\.", "")
    outside = F.regexp_replace(F.col("body"), r'"[^"]*("|$)', "")
    after = F.regexp_replace(F.regexp_replace(F.col("body"), r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")
    opens = lambda x: F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))
    split = W.partitionBy("file", "block").orderBy("at")
    upto = split.rowsBetween(W.unboundedPreceding, 0)
    read = spark.read.option("lineSep", "}").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), _decoded(F.col("value"), encoding).alias("value"))
    pieces = read.withColumn("body", body).select("file", "block", "at", "value", _quotes(F.col("body")).alias("q"),
                                                  opens(outside).alias("o0"), opens(after).alias("o1"))
    pieces = pieces.withColumn("now", F.coalesce(F.sum("q").over(split.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2)
    for s in (0, 1):  # the split starts outside of a string, or inside of one
        begun, ended = (F.col("now") + s) % 2, (F.col("now") + F.col("q") + s) % 2
        pieces = pieces.withColumn(f"c{s}", 1 - ended).withColumn(
            f"d{s}", F.sum(F.when(begun == 0, F.col("o0")).otherwise(F.col("o1")) - (1 - ended)).over(upto))
    pieces = session.stage(pieces.select("file", "block", "at", "value", "q", "c0", "c1", "d0", "d1"))
    last = F.max(F.struct("at", "d0", "d1"))
    sums = pieces.groupBy("file", "block").agg(F.sum("q").alias("q"), last.alias("last")).collect()
    starts, state = [], {}
    for r in sorted(sums, key=lambda r: (r["file"], r["block"])):
        inside, depth = state.get(r["file"], (0, 0))
        starts.append((r["file"], r["block"], inside, depth))
        state[r["file"]] = ((inside + r["q"]) % 2, depth + r["last"][f"d{inside}"])
    table = spark.createDataFrame(starts, "file string, block bigint, inside int, depth bigint")
    of = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    ends = ((of("c") == 1) & (F.col("depth") + of("d") == 0)).cast("int")
    marked = pieces.join(F.broadcast(table), ["file", "block"]).select("file", "block", "at", "value", ends.alias("end"))
    counts = marked.groupBy("file", "block").agg(F.sum("end").alias("n")).collect()
    bases, seen = [], {}
    for r in sorted(counts, key=lambda r: (r["file"], r["block"])):
        bases.append((r["file"], r["block"], seen.get(r["file"], 0)))
        seen[r["file"]] = seen.get(r["file"], 0) + r["n"]
    base = spark.createDataFrame(bases, "file string, block bigint, base bigint")
    numbered = marked.withColumn("done", F.sum("end").over(upto) - F.col("end")).join(F.broadcast(base), ["file", "block"]).select(
        "file", (F.col("base") + F.col("done")).alias("n"), F.struct("block", "at", "value").alias("piece"))
    whole = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["value"]), "}"), F.lit("}"))
    records = numbered.groupBy("file", "n").agg(whole.alias("text")).select(
        "file", "n", F.regexp_replace(F.regexp_replace("text", r"^[^{]*", ""), r"[\r\n]+", " ").alias("value"))
    path = session.scratch_path(spark, "json-records")
    records.where("value like '{%'").repartitionByRange("file", "n").sortWithinPartitions("file", "n").select("value").write.text(path)
    return path


def read_json(spark: SparkSession, path: str, lines: bool = False, key: str | None = None,
              row_id: str = "row_id") -> ReadResult:
    """S3: a JSON array of records (``lines=False``) or JSON Lines, each file with its own charset.
    Columns keep the order of the first record; those that it lacks follow by name.  An array file of more than
    ``SPREAD_ABOVE`` bytes is cut into its records by many tasks (see ``_array_records``)."""
    traits = file_traits(spark, path)
    df, order = None, []
    for encoding, large in sorted({(t.encoding, t.large and not lines) for t in traits.values()}, key=lambda e: (e[0] != "UTF-8", e[1])):
        files = [f for f, t in traits.items() if (t.encoding, t.large and not lines) == (encoding, large)]
        if large:
            part = _placed(spark.read.json(_array_records(spark, files, encoding)))
        else:
            part = _placed(spark.read.json(files, multiLine=not lines, encoding=encoding))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if df is None:
        return ReadResult(spark.createDataFrame([], f"{row_id} bigint"), None)
    for f, t in traits.items():
        if order := _json_keys(spark, f, t.encoding):
            break
    names = [c for c in df.columns if c not in (_FILE, _BLOCK, CORRUPT)]
    names = [c for c in order if c in names] + [c for c in names if c not in order]
    rejects = None
    if CORRUPT in df.columns:
        rejects = df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), *[X.col(c) for c in names])
        df = df.where(F.col(CORRUPT).isNull())
    df = df.select(*[X.col(c) for c in names], _FILE, _BLOCK)
    return ReadResult(add_row_id(df, row_id, key, place=(_FILE, _BLOCK)), rejects,
                      ",".join(dict.fromkeys(t.encoding for t in traits.values())))


def read_table(spark: SparkSession, path: str, fmt: str | None = None, key: str | None = None,
               **kw) -> ReadResult:
    """Dispatch on the suffix: .csv/.txt (sniffed), .tsv, .json, .jsonl, .parquet."""
    ext = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if ext in ("csv", "txt"):
        return read_delimited(spark, path, key=key, **kw)
    if ext == "tsv":
        return read_delimited(spark, path, sep="\t", key=key, **kw)
    if ext == "json":
        return read_json(spark, path, key=key, **kw)
    if ext in ("jsonl", "ndjson"):
        return read_json(spark, path, lines=True, key=key, **kw)
    if ext == "parquet":
        return ReadResult(add_row_id(spark.read.parquet(path), kw.get("row_id", "row_id"), key), None)
    raise ValueError(f"unsupported table format {ext!r} (spreadsheets: convert to CSV or Parquet first)")
