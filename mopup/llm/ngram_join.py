"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles.  Under one order of all shingles, two sets whose
Jaccard similarity reaches t share a shingle among the first n - ceil(t n) + 1 of each (the
prefix).  Documents with the same prefix and size form one group; groups that share a prefix
shingle are filtered by size; the members of the remaining pairs are verified exactly.

Components need not see every pair.  First each group is paired with one leader of every
shingle it shares: the group with the fewest shingles of its own, as the original of many
edited copies has.  Pairs inside one shingle's list that the links found so far do not
connect are verified after that, so no link between components is missed.

Verification first bounds the overlap from above by folded parity bitmaps of the sets, and
then compares the shingle sets of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, saved
from .tallies import tally
from .words import binaries, mix, nulls_to_empty, shingle_set

#: Buckets that shingles are counted in, by document, and the least and greatest power of two of them.  Frequent shingles
#: go last in the order.  Any order gives the same result; this one keeps the lists short.
BUCKETS, LEAST_BITS, MOST_BITS = 32, 16, 22
#: A shingle is frequent from three in this many documents.  No sample is taken: all documents are counted.
SAMPLE_DOCS = 16000
#: Number of documents from which a shingle's list is split, lowered to the limit of a level
#: of the order, and into how many parts.
HOT, SALTS = 4096, 64
#: Rows of a list that one task pairs with the others of it; a longer list's pairs are dealt over more tasks.
LIST_PART, LIST_PARTS = 8192, 256
#: Classes that are broadcast at most: those with at least this fraction of all rows.
MANY_CLASSES = 10_000
#: Ids that are broadcast at most (8 bytes each); beyond that the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000

Levels = np.ndarray


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered(shingles: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles, rare ones first, which of them have a split list, and which are not frequent."""
    mine = levels[_bucket(shingles, len(levels))]
    order = np.lexsort((shingles, mine))
    mine = mine[order]
    # split lists are whole levels, so that they are the end of a prefix and positions keep its order
    return shingles[order], mine >= _level(HOT), mine == 0


def _bucket(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return (shingles & np.uint64(buckets - 1)).astype(np.int64)


def _frequent(docs: DataFrame, words: int) -> Levels:
    """The level of each bucket of shingles, 0 for those that are not frequent, from counts over all documents.

    A shingle's bucket counts the documents that have it or another one of the bucket.  Frequent are buckets that exceed
    the common one, the median, by three in ``SAMPLE_DOCS`` documents, and by three."""
    n = docs.count()
    buckets = 1 << min(MOST_BITS, max(LEAST_BITS, (BUCKETS * n).bit_length()))

    def numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x in binaries(batch.column(1)):
            yield _bucket(shingle_set(nulls_to_empty(x.as_py()), words), buckets)

    levels = tally(docs.select("id", "text"), buckets, numbers, _level)
    common = 2 ** (float(np.median(levels)) / 2)  # the next level after the median's starts here
    return np.where(levels >= _level(common + max(3, 3 * n / SAMPLE_DOCS)), levels, 0).astype(np.int8)


def _level(count: np.ndarray | float) -> np.ndarray:
    return (1 + np.floor(2 * np.log2(np.maximum(count, 1)))).astype(np.int8)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """A bitmap, as 64-bit numbers, in which each shingle flips one of n to 2n bits.  Two sets that
    differ in d shingles have bitmaps that differ in at most d bits; sets with nothing in common differ
    in about half of n bits, where links differ in less than a quarter."""
    bits = max(256, 1 << (max(len(shingles), 1) - 1).bit_length())
    flips = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _differing_bits(x: Column, y: Column) -> Column:
    """Differing bits of two bitmaps, the longer one folded once where their sizes differ."""
    def folded(z: Column) -> Column:
        half = F.floor(F.size(z) / 2).cast("int")
        return F.zip_with(F.slice(z, F.lit(1), half), F.slice(z, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def apart(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)

    return (F.when(F.size(x) == F.size(y), apart(x, y)).when(F.size(x) == 2 * F.size(y), apart(folded(x), y))
            .when(2 * F.size(x) == F.size(y), apart(x, folded(y))))


def _may_link(n: Column, m: Column, x: Column, y: Column, percent: int) -> Column:
    """False where the bitmaps rule a link out: similar sets differ in at most
    (100 - percent) / (100 + percent) of their total size.  Sets of bitmaps that can't be compared may."""
    return F.coalesce((100 + percent) * _differing_bits(x, y) <= (100 - percent) * (n + m), F.lit(True))


_SETS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("g", T.LongType()),
    T.StructField("set", T.BinaryType()), T.StructField("bits", T.ArrayType(T.LongType())),
    T.StructField("rank", T.IntegerType()), T.StructField("rare", T.ArrayType(T.LongType())),
    T.StructField("hot", T.ArrayType(T.LongType()))])


def _sets(docs: DataFrame, words: int, percent: int, frequent: Levels) -> DataFrame:
    """(id, set size, group, digest and bitmap of the set, rank as a leader, prefix shingles with
    whole and with split lists).  The rank counts infrequent shingles per thousand of the prefix."""
    spread = docs.sparkSession.sparkContext.broadcast(frequent)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            sizes, groups, digests, bits, ranks, rare, hot = [], [], [], [], [], [], []
            for x in binaries(batch.column(1)):
                s = shingle_set(nulls_to_empty(x.as_py()), words)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bits.append(parity_bits(s))
                o, split, own = ordered(s, known)
                p = prefix_length(len(s), percent) if len(s) else 0
                o, split = o[:p], split[:p]
                ranks.append(1000 * int(own[:p].sum()) // max(p, 1))
                sizes.append(len(s))
                groups.append(int.from_bytes(hashlib.blake2b(o.tobytes() + b"%d" % len(s), digest_size=8).digest(),
                                             "little", signed=True))
                rare.append(o[~split].view(np.int64))
                hot.append(o[split].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(groups, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(ranks, pa.int32()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int64()))], names=_SETS.names)

    return docs.select("id", "text").mapInArrow(build, _SETS)


_SHARED = T.StructType([
    T.StructField("shingle", T.LongType()), T.StructField("turn", T.IntegerType()), T.StructField("g", T.LongType()),
    T.StructField("pos", T.IntegerType()), T.StructField("lead", T.LongType()), T.StructField("lead_pos", T.IntegerType())])
#: ``turn`` holds a posting's part of the list (0: the list is whole) and, below, its rank.
_RANKS = 1 << 10


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (shingle, turn, g): each group of a list but the first, with the
    first one, the leader.  Repeated postings count once.  Split lists also report their leader, as
    its own follower.  Holds one batch and the state of the list that it ends in."""
    state = None  # shingle, part, leader, its position, last group
    for batch in batches:
        s, turn, g, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(s):
            continue
        part = turn // _RANKS
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (part[1:] != part[:-1])
        again = np.zeros(len(s), dtype=bool)
        again[1:] = ~new[1:] & (g[1:] == g[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        lead, lead_pos = g[first], pos[first]
        if state is not None and (s[0], part[0]) == state[:2]:
            lead, lead_pos = np.where(first == 0, state[2], lead), np.where(first == 0, state[3], lead_pos)
            again[0], new[0] = g[0] == state[4], False
        keep = ~again & ((lead != g) | (new & (part > 0)))
        state = (s[-1], part[-1], lead[-1], lead_pos[-1], g[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[keep]) for c in (s, turn, g, pos, lead, lead_pos)], names=_SHARED.names)


def _shared(sets: DataFrame) -> DataFrame:
    """The lists of the prefix shingles that several groups share: (shingle, turn, g, pos, lead,
    lead_pos) for each group but the list's leader, with the positions in their prefixes."""
    part = F.when(F.col("pos") >= F.size("rare"), 1 + F.pmod("g", F.lit(SALTS))).otherwise(0)
    postings = sets.select("rare", "rank", "g", F.posexplode(F.concat("rare", "hot")).alias("pos", "shingle")).select(
        "shingle", (part * _RANKS + F.col("rank")).cast("int").alias("turn"), "g", "pos")
    return (postings.repartition("shingle", F.floor(F.col("turn") / _RANKS)).sortWithinPartitions("shingle", "turn", "g")
            .mapInArrow(_followers, _SHARED))


def _size_fits(a, b, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, packed) of the given ids; their texts compressed."""
    n = ids.count()
    wanted = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [tool.compress(nulls_to_empty(x.as_py())) for x in binaries(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=schema.names)

    return wanted.select("id", "text").mapInArrow(pack, schema).dropDuplicates(["id"])


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't rule out."""
    facts = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    both = pairs.join(facts, "a").join(facts.toDF("b", "n_b", "bits_b"), "b")
    return both.filter(_may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent)).select(
        "a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: 100 * intersection >= percent * union."""
    pairs = saved(pairs)
    texts = saved(_texts(docs, pairs.select(F.col("a").alias("id")).unionByName(
        pairs.select(F.col("b").alias("id"))).distinct()))
    left = texts.select(F.col("id").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("packed").alias("text_b"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last, hub = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            good = []
            for b, x, y in zip(batch.column(1), batch.column(2), batch.column(3)):
                if b != last:
                    last, hub = b, shingle_set(tool.decompress(y.as_py()), words)
                mine = shingle_set(tool.decompress(x.as_py()), words)
                both = len(np.intersect1d(mine, hub, assume_unique=True))
                good.append(100 * both >= percent * (len(mine) + len(hub) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # the leaders, b, come sorted out of the last join, so that a leader's set is built once
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, schema)


def _members(shared: DataFrame, leaders: DataFrame) -> DataFrame:
    """(shingle, g, pos) of all groups of each list but its leader, and of those leaders that ``leaders`` (lead) names."""
    own = shared.filter("g <> lead").select("shingle", "lead", "lead_pos").distinct().join(leaders, "lead")
    return shared.select("shingle", "g", "pos").unionByName(
        own.select("shingle", F.col("lead").alias("g"), F.col("lead_pos").alias("pos")))


def _list_pairs(rows: DataFrame, head: DataFrame, percent: int, all_pairs: bool = False) -> DataFrame:
    """The pairs (a, b) of a list's classes that are of different components and that neither sizes, positions nor
    bitmaps rule out.  ``head`` has each list's largest component, which only the others meet, and its number of rows.

    A list of more than ``LIST_PART`` rows is dealt over parts: its rows on one side by their id, those on the other
    side to every part.  Such lists are few, at most one for each ``LIST_PART`` rows; up to ``BROADCAST_IDS`` of them are
    told by a broadcast, so that the others, the bulk, are shuffled as if there were none."""
    parts = F.least(F.lit(LIST_PARTS), 1 + F.floor(F.col("rows") / LIST_PART)).cast("int")
    long = saved(head.filter(F.col("rows") > LIST_PART).select("shingle", "head", parts.alias("parts")))
    n = long.count()
    if not n:
        return _met(rows, head, ["shingle"], percent, all_pairs).distinct()
    long = F.broadcast(long) if n <= BROADCAST_IDS else long
    short = _met(rows.join(long.select("shingle"), "shingle", "left_anti"), head, ["shingle"], percent, all_pairs)
    dealt = rows.join(long.select("shingle", "parts"), "shingle")
    mine = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    every = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return short.unionByName(_met(mine, long, ["shingle", "part"], percent, all_pairs, every)).distinct()


def _met(rows: DataFrame, head: DataFrame, on: list[str], percent: int, all_pairs: bool,
         others: DataFrame | None = None) -> DataFrame:
    """The pairs of ``_list_pairs`` where rows and others agree in ``on``.  Without others, both sides read one shuffle of
    the rows with their bitmaps: no condition on one side may be of a kind that Spark moves below it."""
    if others is None:
        rows = others = rows.repartition(*on)
    rest = rows.join(head.select("shingle", "head"), "shingle").filter(
        F.lit(all_pairs) | ~F.col("component").eqNullSafe(F.col("head.component"))).select(
        *on, F.col("pos").alias("p1"), F.col("n").alias("n1"), F.col("rep").alias("a"),
        F.col("component").alias("c1"), F.col("head.component").alias("main"), F.col("bits").alias("x"))
    other = others.select(
        *on, F.col("pos").alias("p2"), F.col("n").alias("n2"), F.col("rep").alias("b"),
        F.col("component").alias("c2"), F.col("bits").alias("y"))
    # similar sets share a shingle that has fewer than n - overlap + 1 before it in either
    overlap = F.expr(f"((n1 + n2) * {percent} + {99 + percent}) div {100 + percent}")
    near = (F.col("p1") <= F.col("n1") - overlap) & (F.col("p2") <= F.col("n2") - overlap)
    # one condition of the join, so that it makes no other rows; the bitmaps are compared last
    apart = (F.col("c1") != F.col("c2")) & (F.coalesce(F.col("c2") == F.col("main"), F.lit(False)) | (F.col("a") < F.col("b")))
    may = F.when(apart & near, _may_link(F.col("n1"), F.col("n2"), F.col("x"), F.col("y"), percent)).otherwise(False)
    return rest.join(other, on).filter(may).select("a", "b")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """(a, b): every link between different shingle sets, a < b being the smallest ids of documents with these sets (the
    ``class_id`` of ``near_duplicates``, which gives the members).

    Unlike ``near_duplicates``, this verifies the pairs that other links connect already: it costs more where many
    different documents are alike.  Copies are never expanded.  Nulls, empty tables and repeated ids as there."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = saved(_sets(docs, words, percent, _frequent(docs, words)).filter("n > 0 and id is not null"))
    classes = saved(sets.groupBy("g", "n", "set").agg(F.min("id").alias("rep")))
    shared = saved(_shared(sets))
    every = shared.select("lead").distinct()
    bits = sets.select(F.col("id").alias("rep"), "n", "bits").dropDuplicates(["rep", "n"])
    mine = classes.select("g", "n", "rep").join(bits, ["rep", "n"])
    groups = classes.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g")
    rows = saved(_members(shared, every).distinct().join(mine, "g").select("shingle", "pos", "n", "rep", "bits").unionByName(
        mine.join(groups, "g").select(F.col("g").alias("shingle"), F.lit(0).alias("pos"), "n", "rep", "bits")).withColumn(
        "component", F.col("rep")))
    # each class is a component of its own, and none is the largest
    head = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).withColumn("head", F.struct(
        F.lit(0).cast("long").alias("k"), F.lit(None).cast("long").alias("component")))
    return _verified(_list_pairs(rows, head, percent, all_pairs=True), docs, words, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, class_id) for each row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word
    shingles (lower-cased A-Z); a shorter text's whole sequence is its one shingle.
    ``component_id`` is the smallest id that a document reaches by links, ``class_id`` the smallest
    id of a document with the same set.  Null, empty and wordless texts have an empty set and link
    with nothing.  Rows that repeat an id count as one document, each keeps its row.  A null id can't
    be linked: its component is null.  Other columns are not read; an empty table gives an empty one.

    The prefix shingles (a fifth of all) are shuffled once, as numbers; texts of candidates only
    are fetched, compressed.  Lists of frequent shingles are split over ``SALTS`` tasks."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = saved(_sets(docs, words, percent, _frequent(docs, words)))
    facts = sets.select("id", "n", "g", "set")
    classes = saved(facts.filter("n > 0 and id is not null").groupBy("g", "n", "set").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    shared = saved(_shared(sets.filter("n > 0 and id is not null")))
    leads = classes.groupBy("g").agg(F.min("rep").alias("lead_rep"), F.min("n").alias("n"))

    # first pairs: every class with the leader of its group and of each list of its group
    heads = shared.filter("g = lead").select("shingle", F.pmod("turn", F.lit(_RANKS)).alias("rank"), "g")
    top = heads.groupBy("shingle").agg(F.min(F.struct("rank", "g")).alias("top"))
    over = heads.join(top, "shingle").select("g", F.col("top.g").alias("lead"))
    group_pairs = shared.select("g", "lead").unionByName(over).filter("g <> lead").distinct()
    outer = (group_pairs.join(classes.select("g", "n", "rep"), "g")
             .join(leads.select(F.col("g").alias("lead"), F.col("n").alias("lead_n"), "lead_rep"), "lead")
             .filter(_size_fits(F.col("n"), F.col("lead_n"), percent)).select("rep", "lead_rep"))
    inner = classes.join(leads.select("g", "lead_rep"), "g").select("rep", "lead_rep")
    first = saved(outer.unionByName(inner).filter("rep <> lead_rep").distinct()
                  .select(F.col("rep").alias("a"), F.col("lead_rep").alias("b")))
    links = saved(_verified(_possible(first, sets, percent), docs, words, percent))
    label = saved(components(links))

    # second pairs: within a list, those not connected yet
    bits = sets.filter("n > 0").select(F.col("id").alias("rep"), F.col("n"), "bits").dropDuplicates(["rep", "n"])
    named = (classes.select("g", "n", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left")
             .select("g", "n", "rep", F.coalesce("component", "rep").alias("component")))
    spread = named.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                    F.count(F.lit(1)).alias("classes"))
    # the leader of a whole list has met all others, but for further classes of its group
    several = spread.filter("classes > 1").select(F.col("g").alias("lead"))
    members = _members(shared, several)
    # a group of several components is mixed by itself, whatever it shares
    mixed_lists = (members.join(spread, "g").groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                   .filter("low <> high").select("shingle"))
    lists = members.distinct().join(mixed_lists, "shingle").join(named.join(bits, ["rep", "n"]), "g")
    alone = spread.filter("low <> high").select("g").join(named, "g").join(bits, ["rep", "n"]).select(
        F.col("g").alias("shingle"), F.lit(0).alias("pos"), "n", "rep", "component", "bits")
    rows = saved(lists.select("shingle", "pos", "n", "rep", "component", "bits").unionByName(alone))
    # the largest component of a list is only met by the others
    counts = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"))
    head = counts.groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("head"), F.sum("k").alias("rows"))
    second = _met(rows, head, ["shingle"], percent, False).distinct()
    second = saved(second.join(first, ["a", "b"], "left_anti"))
    more = _verified(second, docs, words, percent)
    final = components(links.unionByName(more)).withColumnRenamed("id", "rep")

    # documents without words or id have no class; the classes of many copies are few, and broadcast
    linked = F.coalesce((F.col("n") > 0) & F.col("id").isNotNull(), F.lit(False))
    many = max(256, facts.count() // MANY_CLASSES)
    named_sets = classes.select("set", F.col("rep").alias("class_id"), "copies")
    hot = facts.filter(linked).join(F.broadcast(named_sets.filter(F.col("copies") >= many).select("set", "class_id")), "set", "left")
    own = (hot.filter("class_id is not null").unionByName(
        hot.filter("class_id is null").drop("class_id").join(named_sets.filter(F.col("copies") < many).select("set", "class_id"), "set"))
        .unionByName(facts.filter(~linked).select("set", "id", "n", "g", F.col("id").alias("class_id"))))
    out = own.join(final, own["class_id"] == final["rep"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "class_id").alias("component_id"), "class_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns pass on.
    Of rows that repeat an id one stays; rows with a null id and documents without words all stay."""
    found = saved(near_duplicates(docs, id_col, text_col, words, percent))
    by_id = found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__mopup_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("component"), F.max("n_shingles").alias("size"))
    copies = by_id.filter("component <> __mopup_id").select("__mopup_id")
    kept = docs.join(copies, F.col(id_col) == F.col("__mopup_id"), "left_anti")
    repeated = by_id.filter("rows > 1 and component = __mopup_id and size > 0").select("__mopup_id")
    if repeated.isEmpty():
        return kept
    same = F.col(id_col) == F.col("__mopup_id")
    return kept.join(repeated, same, "left_anti").unionByName(
        kept.join(repeated, same, "left_semi").dropDuplicates([id_col]))
