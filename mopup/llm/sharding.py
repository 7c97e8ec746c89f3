"""Best-fit-decreasing packing of documents into shards (op12).

Documents with equal text form a group, which stays together.  Groups enter shards in order of falling
size, each into the open shard with the least room that still holds it, found in a balanced tree of
rooms; a shard is opened only where none has room.  Given a number of shards instead of a capacity, the
least capacity (in fine steps) that needs no more shards than that is taken, so sizes come out near equal.

Packing is a sequential rule, so it runs on two levels.  Groups are dealt into slices by their digest, and
each slice packs its groups into *crates*, small bins of a fixed capacity, in a task of its own; then
the crates, whose number depends on the number of shards and slices and not on that of the documents, are
packed into shards by the same rule.  The smallest groups of each slice go into finer crates (a
sixteenth of the bytes into crates of a sixteenth, and once more), which fill what the coarse ones leave;
groups larger than a crate are packed on their own.

A group larger than a shard can't stay whole: it is cut into equal parts of at most a shard.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

MAX_ITEMS = 8192       # crates of the coarsest grade, over all shards
GRADES = (1, 16, 256)  # crate capacities, as fractions of the coarsest
SLICE_GROUPS = 4096
MAX_SLICES = 20_000
MAX_HOT = 10_000       # groups joined by broadcast: each holds at least that fraction of the rows


class Rooms:
    """A balanced search tree (AVL) of (room, bin): insertion, and removal of the tightest room that holds a
    size, in logarithmic time."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    # a node is [key, left, right, height]
    def insert(self, room: int, which: int) -> None:
        self.root = _insert(self.root, (room, which))

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (room, bin) with room >= size; None where there is none."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = _remove(self.root, best)
        return best


def _height(node) -> int:
    return 0 if node is None else node[3]


def _fixed(node):
    """``node`` with its height set, rotated where one side is deeper by two."""
    tilt = _height(node[1]) - _height(node[2])
    if tilt > 1:
        if _height(node[1][1]) < _height(node[1][2]):
            node[1] = _turned(node[1], 2)
        return _turned(node, 1)
    if tilt < -1:
        if _height(node[2][2]) < _height(node[2][1]):
            node[2] = _turned(node[2], 1)
        return _turned(node, 2)
    node[3] = 1 + max(_height(node[1]), _height(node[2]))
    return node


def _turned(node, side: int):
    """The child on ``side`` becomes the parent."""
    child, other = node[side], 3 - side
    node[side], child[other] = child[other], node
    node[3] = 1 + max(_height(node[1]), _height(node[2]))
    child[3] = 1 + max(_height(child[1]), _height(child[2]))
    return child


def _insert(node, key):
    if node is None:
        return [key, None, None, 1]
    side = 1 if key < node[0] else 2
    node[side] = _insert(node[side], key)
    return _fixed(node)


def _remove(node, key):
    if key == node[0]:
        if node[1] is None or node[2] is None:
            return node[1] if node[2] is None else node[2]
        least = node[2]
        while least[1] is not None:
            least = least[1]
        node[0] = least[0]
        node[2] = _remove(node[2], least[0])
    else:
        side = 1 if key < node[0] else 2
        node[side] = _remove(node[side], key)
    return _fixed(node)


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size, for sizes in falling order; a size beyond the capacity gets a bin of its own.
    None as soon as more than ``most`` bins are needed."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            if bins == most:
                return None
            found = (max(capacity, size), bins)
            bins += 1
        if found[0] > size:
            rooms.insert(found[0] - size, found[1])
        out.append(found[1])
    return out


def pack_evenly(sizes: list[int], bins: int) -> list[int]:
    """``best_fit`` with the least capacity, in steps that grow from a 50,000th of the mean, that needs at
    most ``bins`` bins."""
    if not sizes:
        return []
    mean = -(-sum(sizes) // bins)
    extra = max(1, mean // 50_000)
    capacity = max(mean, sizes[0])
    while (out := best_fit(sizes, capacity, bins)) is None:
        capacity, extra = capacity + extra, extra * 2
    return out


def _crated(coarse: int):
    """A function that packs one slice's groups into crates."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "digest"], ascending=[False, True], kind="stable")
        sizes = frame["bytes"].tolist()
        total, seen = sum(sizes), 0
        grades: list[list[int]] = [[] for _ in GRADES]
        for i, size in enumerate(sizes):
            rest = total - seen  # the smallest groups, this one included, hold so many bytes
            grade = max(g for g, part in enumerate(GRADES) if rest * part <= total)
            grades[grade].append(i)
            seen += size
        crates = [0] * len(sizes)
        first = 0
        for part, members in zip(GRADES, grades):
            bins = best_fit([sizes[i] for i in members], max(1, coarse // part))
            for i, b in zip(members, bins):
                crates[i] = first + b
            first += max(bins, default=-1) + 1
        return frame.assign(crate=crates)

    return pack


def _numbered(rows: DataFrame, name: str, by: str) -> DataFrame:
    """``rows`` of a written table whose files are sorted by ``by``, with the place of each row among those
    of its ``by`` value, gapless from 0.

    A row's place is that of its file among the files plus its own within the file, so only counts
    of each file are added up: no value's rows are gathered, however many it has."""
    spot = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = spot.groupBy("_file", by).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(by).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_file", F.col(by).alias("_by"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return spot.join(starts, (spot["_file"] == starts["_file"]) & spot[by].eqNullSafe(starts["_by"])).select(
        *rows.columns, (F.col("_start") + F.col("_row") - F.col("_first")).alias(name))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text", overhead: int = 8, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id, ``size`` (UTF-8 bytes of the text plus ``overhead``),
    ``text_crc32``, ``shard`` (from 0), ``slot`` (place within the shard, gapless from 0) and, on request, the text.

    ``shards`` gives that many shards of near equal size; ``capacity`` gives shards of at most
    so many bytes, as few as best fit decreasing finds.  A null text has no bytes and counts as equal to an
    empty one.  Rows with equal text share a shard unless they are together larger than one; repeated ids and rows
    are placed each for itself.  One text larger than a shard fills a shard alone.  An empty table
    gives an empty table; other columns, clashing names included, are not read.  Reruns give the same shards.

    Cost: the documents' texts are read once (and written once more with ``with_text``); sizes and digests are written,
    grouped with partial aggregation, and joined with their crates.  Groups with many rows are joined by
    broadcast (at most 10,000 groups).  The driver and its broadcast see crates only: about three
    times 8,192, or 12 a shard beyond 2,048 shards, and three for each slice of 4,096 or more groups (20,000 slices at most)."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either the number of shards or their capacity")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = _written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"),
        *([F.col(text_col).cast("string").alias("text")] if with_text else [])), "shard-sizes")
    spark = docs.sparkSession
    groups = _written(light.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")), "shard-groups")
    whole = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("copies").alias("rows"), F.sum("bytes").alias("bytes")).first()
    total = whole["bytes"] or 0
    limit = max(1, capacity if capacity is not None else -(-total // shards))
    many = shards if shards is not None else max(1, -(-total // limit))
    coarse = max(1, limit * many // max(MAX_ITEMS, 4 * many))

    # groups beyond a shard, of which there are fewer than shards, are cut into parts of equal numbers of rows
    parts, pieces = [], []
    for i, r in enumerate(groups.filter(F.col("bytes") > limit).orderBy("digest").collect()):
        one = r["bytes"] // r["copies"]
        each = max(1, min(limit // one, math.ceil(r["copies"] / math.ceil(r["bytes"] / limit))))
        pieces.append((bytes(r["digest"]), each, i))
        parts += [(-1 - i, k, one * min(each, r["copies"] - k * each)) for k in range(-(-r["copies"] // each))]

    # slices pack their groups into crates
    slices = max(1, min(MAX_SLICES, -(-(whole["groups"] or 0) // SLICE_GROUPS)))
    crates = _written(
        groups.filter(F.col("bytes") <= limit)
        .select("*", F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int").alias("slice"))
        .repartition(slices, "slice").groupBy("slice")
        .applyInPandas(_crated(coarse), "digest binary, copies bigint, bytes bigint, slice int, crate int"), "shard-crates")
    loads = crates.groupBy("slice", "crate").agg(F.sum("bytes").alias("bytes")).collect()
    items = sorted(parts + [(r["slice"], r["crate"], r["bytes"]) for r in loads], key=lambda x: (-x[2], x[0], x[1]))
    sizes = [x[2] for x in items]
    bins = pack_evenly(sizes, shards) if shards is not None else best_fit(sizes, limit)
    placed = spark.createDataFrame([(s, c, b) for (s, c, _), b in zip(items, bins)], "slice int, crate int, shard int")

    counted = crates.join(F.broadcast(placed), ["slice", "crate"]).select("digest", "copies", "shard")
    hot = max(256, (whole["rows"] or 0) // MAX_HOT)
    frequent = counted.filter(F.col("copies") >= hot).select("digest", "shard", F.lit(None).cast("int").alias("each"))
    cut = spark.createDataFrame([(d, -1 - i, e) for d, e, i in pieces], "digest binary, shard int, each int")
    known = light.join(F.broadcast(frequent.unionByName(cut)), "digest", "left")
    rest = counted.filter(F.col("copies") < hot).select("digest", "shard")
    out = known.filter("shard is not null").unionByName(
        known.filter("shard is null").drop("shard").join(rest, "digest").select(*known.columns[:-2], "shard", "each"))
    if pieces:
        # rows of a cut group are numbered, and the number says which part they go to
        numbered = _numbered(_written(out.filter("shard < 0").sortWithinPartitions("shard"), "shard-cut"), "_k", "shard")
        part = numbered.withColumn("crate", F.floor(F.col("_k") / F.col("each")).cast("int")).withColumnRenamed("shard", "slice")
        out = out.filter("shard >= 0").unionByName(
            part.join(F.broadcast(placed.filter("slice < 0")), ["slice", "crate"]).select(*out.columns))
    kept = [c for c in out.columns if c not in ("digest", "each")]
    placed_rows = _written(out.select(*kept).sortWithinPartitions("shard"), "shard-rows")
    slots = _numbered(placed_rows, "slot", "shard")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                        F.col("slot").cast("bigint").alias("slot"), *(["text"] if with_text else []))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows of ``shard_documents`` as Parquet, a folder for each shard, in the order of the slots.

    A shard's rows are split over files by ranges of slots, so that a large shard has many writers."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
