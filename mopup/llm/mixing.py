"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target gives all its documents the same expected number of copies.  The
whole part is certain.  The fractional parts are rounded together: two documents meet,
probability mass (counted in words) moves from one to the other at random until one of
them is 0 or 1, and the other goes on.  Documents meet within blocks of bounded size; the
one left over of each block meets those of other blocks on the next level, and so on up a
tree.  The moves keep every expectation and the words of the source; the one document left at the root is
taken with the probability it holds, so every document has its expected number of copies, and the words
taken differ from the target by less than that one document's.  The largest documents of a block meet
first, which leaves small ones for the end.

Rows that agree in all that the mix looks at are told by a number, given out by counting them, so any number of
equal rows is dealt over blocks like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 256  # documents that meet in one block
CHUNK = 4096  # equal rows that are numbered in one step


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST, count: str | None = None) -> DataFrame:
    """(source, source_size, target) by water-filling: sources in code point order, null last,
    take the weights in turn, and a target stops at ``most`` times its source's size.

    With sources ordered by size over weight, the first k are full exactly while the level
    that the others would get is not below the k-th one's limit.  One row a source: the
    windows run over that small aggregate.  ``count`` names a column that says how many rows a row stands for."""
    m = F.col(count) if count else F.lit(1)
    by_source = sizes.groupBy(source).agg(F.sum(F.col(size) * m).alias("source_size"), F.sum(m).alias("source_rows"))
    order = W.orderBy(F.col(source).isNull(), F.col(source))
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    limit = F.col("source_size") * most
    t = by_source.withColumn("__w", weight).withColumn("__limit", limit)
    filling = W.orderBy(F.col("__limit") / F.col("__w"), F.col(source).isNull(), F.col(source))
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(whole) * share
    level = (total - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("__w").over(rest)
    t = t.withColumn("__level", level).withColumn("__open", F.col("__limit") > F.col("__level") * F.col("__w"))
    # the level of the first source that is not full holds for all after it
    final = F.first(F.when(F.col("__open"), F.col("__level")), ignorenulls=True).over(
        filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(final.isNull(), F.col("__limit")).otherwise(F.least(F.col("__limit"), final * F.col("__w")))
    return t.withColumn("target", target).select(source, "source_size", "source_rows", "target")


def _random(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1), the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _decided(item: Column, value: Column) -> Column:
    return F.array(F.struct(item["who"].alias("who"), item["size"].alias("size"), item["row"].alias("row"),
                            value.cast("int").alias("extra")))


def _meet(state: Column, item: Column, seed: int) -> Column:
    """One meeting of the one carried along (state.held) with the next document."""
    a, done = state["held"], state["done"]
    mass_a, mass_b = a["p"] * a["size"], item["p"] * item["size"]
    to_b = F.least(mass_a, item["size"] - mass_b)
    to_a = F.least(a["size"] - mass_a, mass_b)
    toward_b = _random(seed, a["row"], item["row"]) * (to_a + to_b) < to_a

    def go(held: Column, p: Column, out: Column, value: Column) -> Column:
        one = F.struct(held["who"].alias("who"), held["size"].alias("size"), held["row"].alias("row"), p.alias("p"))
        return F.struct(one.alias("held"), F.concat(done, _decided(out, value)).alias("done"))

    half = F.lit(0.5)
    return (
        F.when(a["row"].isNull(), F.struct(item.alias("held"), done.alias("done")))
        # one that rounding errors left at 0 or 1 is decided as it is
        .when((to_a + to_b) <= 1e-9, go(item, item["p"], a, a["p"] >= half))
        .when(toward_b & (mass_a <= item["size"] - mass_b),
              go(item, (mass_b + mass_a) / item["size"], a, F.lit(0)))
        .when(toward_b, go(a, (mass_a - to_b) / a["size"], item, F.lit(1)))
        .when(a["size"] - mass_a <= mass_b, go(item, (mass_b - to_a) / item["size"], a, F.lit(1)))
        .otherwise(go(a, (mass_a + mass_b) / a["size"], item, F.lit(0))))


def _round(open_: DataFrame, keys: list[str], seed: int, last: Column) -> DataFrame:
    """All documents of each block, decided but for one (``extra`` null) where not ``last``."""
    item = F.struct((-F.col("size")).alias("order"), F.col("row").alias("row"), F.col("who").alias("who"),
                    F.col("size").alias("size"), F.col("p").alias("p"))
    blocks = open_.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    shape = f"who:{dict(open_.dtypes)['who']},size:double,row:bigint"
    none = F.lit(None).cast(f"struct<{shape},p:double>")
    empty = F.array().cast(f"array<struct<{shape},extra:int>>")
    plain = F.transform("items", lambda x: F.struct(x["who"].alias("who"), x["size"].alias("size"),
                                                     x["row"].alias("row"), x["p"].alias("p")))
    folded = blocks.withColumn("fold", F.aggregate(
        plain, F.struct(none.alias("held"), empty.alias("done")), lambda s, x: _meet(s, x, seed)))
    held = F.col("fold.held")
    # the root of the tree is decided by what it holds
    end = F.when(last, (_random(seed + 5, held["row"]) < held["p"]).cast("int"))
    left = F.array(F.struct(held["who"].alias("who"), held["size"].alias("size"), held["row"].alias("row"),
                            end.alias("extra"), held["p"].alias("p")))
    done = F.transform("fold.done", lambda x: F.struct(
        x["who"].alias("who"), x["size"].alias("size"), x["row"].alias("row"), x["extra"].alias("extra"),
        F.lit(None).cast("double").alias("p")))
    return folded.select(*keys, F.explode(F.concat(done, left)).alias("x")).select(*keys, "x.*")


def _numbered(classes: DataFrame) -> DataFrame:
    """A row ``k`` = 0, 1, ... for each of the ``m`` equal rows of each class.  Those of a large class are
    numbered by many tasks."""
    first = classes.filter("m = 1").withColumn("k", F.lit(0).cast("long"))
    some = classes.filter((F.col("m") > 1) & (F.col("m") <= CHUNK)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return first.unionByName(some).unionByName(_chunks(classes.filter(F.col("m") > CHUNK), F.col("m")))


def _chunks(rows: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times, ``k`` counting from 0: first in chunks, which are spread, then within each."""
    wide = rows.withColumn("__n", n.cast("long")).filter("__n > 0").withColumn("__c", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(__n - 1) div {CHUNK}")))).repartition("__c")
    within = F.sequence(F.col("__c") * CHUNK, F.least(F.col("__n"), (F.col("__c") + 1) * CHUNK) - 1)
    return wide.withColumn("k", F.explode(within)).drop("__n", "__c")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of ``docs``.

    A null text has size 0 and is taken 0 times, a null source is a source of its own, and an
    empty table gives an empty table.  Repeated rows, and rows without an id that agree in source and size, are
    documents of their own, each with its own draw; which of them
    is taken is not told apart.  Other columns are not read.  Copies depend on ids, sizes and
    the seed alone, so reruns agree.  The texts are read once: ids, sources and word counts are written to the
    shared folder.  A hot source is dealt over as many blocks as it needs, and so are equal rows; no
    block, and no task, holds more than a bounded number of documents by expectation."""
    decided = _decide(docs, id_col, source_col, text_col, F.lit(0), weights, share, most, seed, block)
    return decided.select(F.col("who.id").alias(id_col), "source", "size", "source_size", "target", "copies",
                          (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _decide(docs: DataFrame, id_col: str, source_col: str, text_col: str, digest: Column, weights=WEIGHTS,
            share: float = SHARE, most: float = MOST, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(who, source, size, source_size, target, base, copies) for each row; ``who`` is the id and ``digest``."""
    who = F.struct(F.col(id_col).alias("id"), digest.alias("digest"))
    classes = stage(docs.select(who.alias("who"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("words"))
                    .groupBy("who", "source", "words").agg(F.count(F.lit(1)).alias("m")))
    targets = stage(source_targets(classes, "source", "words", weights, share, most, "m")).withColumnRenamed("source", "__s")
    spread = classes.join(F.broadcast(targets) if _few(targets) else targets,
                          F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(expected + 1e-12)
    part = F.greatest(expected - whole, F.lit(0.0))
    spread = spread.withColumns({"base": whole.cast("int"), "p": F.when(part > 1e-9, part).otherwise(F.lit(0.0))})
    sized = _numbered(spread).withColumn("size", F.col("words").cast("double"))
    carry = ["source", "source_size", "target", "base"]

    def out(x: DataFrame, extra: Column) -> DataFrame:
        size = F.col("size").cast("long")
        copies = F.when(size > 0, F.col("base") + extra).otherwise(F.lit(0))
        return x.select("who", *carry, size.alias("size"), copies.cast("int").alias("copies"))

    settled = out(sized.filter((F.col("words") == 0) | (F.col("p") == 0.0)), F.lit(0))
    blocks = F.ceil(F.col("source_rows") / F.lit(float(block))).cast("long")
    row = F.xxhash64(F.lit(seed), F.col("who"), F.col("words"), F.col("k"))
    now = (sized.filter((F.col("words") > 0) & (F.col("p") > 0.0)).withColumn("row", row)
           .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.col("row")), F.col("blocks"))))
    levels = _levels(targets, block)
    results = [settled]
    for k in range(levels):
        met = _round(now, [*carry, "blocks", "block"], seed + 10 * k, F.col("blocks") == 1)
        results.append(out(met.filter(F.col("extra").isNotNull()), F.col("extra")))
        if k + 1 < levels:
            fewer = F.ceil(F.col("blocks") / F.lit(float(block))).cast("long")
            now = (met.filter(F.col("extra").isNull()).drop("extra").withColumn("blocks", fewer)
                   .withColumn("block", F.pmod(F.col("block"), F.col("blocks"))))
    everything = results[0]
    for x in results[1:]:
        everything = everything.unionByName(x)
    return everything


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
              copy_col: str = "copy", **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it: all columns, and ``copy_col`` counted from 1 (an error if
    ``docs`` has a column of that name).  Rows taken 0 times go.

    Each row is told by a 128-bit digest of all its columns, so reruns take the same rows; rows equal in every column
    share their decisions out.  A large class of equal rows (over 4,096) is made anew from one of them by many tasks."""
    if copy_col in docs.columns:
        raise ValueError(f"there is a column {copy_col!r} already: name another one for the copies")
    key, turn = "__mopup_key", "__mopup_turn"
    plain = [c for c, t in docs.dtypes if "map<" not in t]
    digest = F.struct(F.xxhash64(F.lit(1), *plain).alias("a"), F.xxhash64(F.lit(2), *plain).alias("b"))
    decided = stage(_decide(docs, id_col, source_col, text_col, digest, **options))
    # of m equal rows, all are taken base times and some once more
    taken = decided.groupBy("who").agg(F.count(F.lit(1)).alias("__m"), F.max("base").alias("__base"),
                                       F.sum("copies").alias("__all"), F.min("copies").alias("__least"))
    taken = taken.filter("__all > 0").withColumn("__more", F.col("__all") - F.col("__m") * F.col("__least"))
    named = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), digest.alias("digest")))
    large = F.broadcast(taken.filter(F.col("__m") > CHUNK))  # at most rows / 4,096 of them, and only classes of equal rows
    joined = named.join(taken.filter(F.col("__m") <= CHUNK), F.col(key).eqNullSafe(F.col("who")))
    turned = joined.withColumn(turn, F.when(F.col("__m") > 1, F.row_number().over(
        W.partitionBy(key).orderBy(key))).otherwise(F.lit(1)))
    copies = F.col("__least") + F.when(F.col(turn) <= F.col("__more"), 1).otherwise(0)
    one = turned.withColumn("__n", copies).filter("__n > 0").withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    out = one.select(*docs.columns, copy_col)
    if large.limit(1).count():
        again = _chunks(named.join(large, F.col(key).eqNullSafe(F.col("who"))).dropDuplicates([key]), F.col("__all"))
        # the first copies of the rows, then the second ones ...
        full = F.col("__m") * F.col("__least")
        number = F.when(F.col("k") < full, F.expr("k div __m") + 1).otherwise(F.col("__least") + 1)
        out = out.unionByName(again.select(*docs.columns, number.cast("int").alias(copy_col)))
    return out


def _levels(targets: DataFrame, block: int) -> int:
    """Levels of the tree over the largest source."""
    most = targets.agg(F.max("source_rows")).first()[0] or 1
    n, levels = -(-most // block), 1
    while n > 1:
        n, levels = -(-n // block), levels + 1
    return levels


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the source table is small enough to broadcast (about 100 bytes a row)."""
    return targets.count() <= most
