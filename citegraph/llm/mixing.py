"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Every source is cut into blocks of documents.  Its quota, a number of words, is
met by whole rounds over all its blocks plus one partial round over blocks in
a permuted order; the block where the quota ends is cut into smaller ones until
it has few rows.  A block in a round is a draw.  The draws of all sources are split
in two again and again until there is one part for each output shard: a node's
draws are permuted by a hash and cut at exactly half, so the number that each
source has in either half follows the multivariate hypergeometric law, and no draw
is in two parts.  Rounds are draws of their own, so the copies of a document lie in
parts and places of their own.  Documents of a part are then put in a pseudo-random
order within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.shared import BLANKS, broadcast_if_small, discard, written

WEIGHTS, MOST, BLOCKS, LEVELS = (5, 2, 1), 3, 256, 4
#: Rows on either side of a quota's end among which single documents are chosen, and the most rows that a block there may have.
ZONE, MOST_ZONE = 200, 4000
CELL = ["b0", "b1", "b2"]


def word_count(text: Column) -> Column:
    """Words of a text, none for a null: what is left if each word, with the blanks after it, becomes one letter."""
    bare = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.length(F.regexp_replace(bare, f"[^{BLANKS}]++[{BLANKS}]*+", "x")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in the order of code points, null last, weigh `weights` in turn and
    share the total.  A target above `most` times its source's size stops there and
    the excess goes to the others by weight, until none is above: with sources
    in the order of most * size / weight, a prefix of them stops, the shortest one
    such that the rest shares what is left at no more than the next one's bound.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", pick).withColumn("bound", F.col("source_size") * most)
    ratio = F.col("bound") / F.col("weight")
    rank = Window.orderBy(ratio, F.col("source").cast("binary").asc_nulls_last())
    whole = Window.partitionBy()
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    steps = weighed.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    steps = steps.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    steps = steps.withColumn("level", F.when(ratio * F.col("rest") >= F.col("left"), F.struct(F.col("left").alias("a"), F.col("rest").alias("b"))))
    steps = steps.withColumn("level", F.first("level", ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.col("level.a") * F.col("weight") / F.col("level.b")
    return steps.select("source", "source_size", F.least(F.col("bound").cast("double"), share.cast("double")).alias("target"))


def _keyed(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """row (all columns of `docs` as one), doc_id, source, text_hash, spot, and b0, b1, b2, the numbers of the row's block at each of three levels."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"))
    out = out.withColumn("spot", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    part = lambda bits: F.pmod(F.shiftright("spot", bits), F.lit(blocks)).cast("int")
    return out.withColumn("b0", part(0)).withColumn("b1", part(20)).withColumn("b2", part(40))


def _in_cell(rows: str, cells: str):
    """Rows (b0, b1, b2) of a cell, whose b1 or b2 is -1 where it was not cut further."""
    same = lambda c: (F.col(f"{cells}.{c}") == -1) | (F.col(f"{rows}.{c}") == F.col(f"{cells}.{c}"))
    return F.col(f"{rows}.source").eqNullSafe(F.col(f"{cells}.source")) & (F.col(f"{rows}.b0") == F.col(f"{cells}.b0")) & same("b1") & same("b2")


def _cumulated(cells: DataFrame, seed: int) -> DataFrame:
    """Cells with the words and rows up to their end in the permuted order of their source's blocks, and whether the quota ends within."""
    order = []
    for i in range(len(CELL)):
        order += [F.xxhash64("source", *CELL[: i + 1], F.lit(seed + 1)), F.col(CELL[i])]
    upto = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cells.withColumn("upto", F.sum("words").over(upto)).withColumn("row_end", F.sum("n").over(upto))
    return out.withColumn("cut", (F.col("upto") - F.col("words") < F.col("quota")) & (F.col("upto") > F.col("quota")))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int, levels: int, seed: int) -> DataFrame:
    """The cells of `rows` (source, size, b0, b1, b2): source, b0, b1, b2, source_size, target, rounds, quota, upto, zone, ahead, parts (one for each round, and for the partial one)."""
    counted = [F.sum("size").alias("words"), F.count("*").alias("n")]
    table = rows.groupBy("source", "b0").agg(*counted)
    goal = targets(table.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    # Rounds over everything, then one partial round over the blocks in a permuted order.
    goal = goal.withColumn("rounds", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    goal = goal.withColumn("quota", F.col("target") - F.col("rounds") * F.col("source_size"))
    table = table.alias("t").join(goal.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))).select("t.*", "source_size", "target", "rounds", "quota")
    cells = written(_cumulated(table.withColumn("b1", F.lit(-1)).withColumn("b2", F.lit(-1)), seed), "cells")
    for level in (1, 2):  # a block where a quota ends and that has too many rows is replaced by smaller ones
        large = F.col("cut") & (F.col("n") > MOST_ZONE)
        if cells.filter(large).limit(1).count() == 0:
            break
        finer = rows.alias("r").join(F.broadcast(cells.filter(large).alias("c")), _in_cell("r", "c"))
        keys = [F.col(f"r.{c}").alias(c) if i <= level else F.lit(-1).alias(c) for i, c in enumerate(CELL)]
        finer = finer.select(F.col("r.source").alias("source"), *keys, "size", "source_size", "target", "rounds", "quota")
        finer = finer.groupBy("source", *CELL, "source_size", "target", "rounds", "quota").agg(*counted)
        table = cells.filter(~large).select(finer.columns).unionByName(finer)
        before, cells = cells, written(_cumulated(table, seed), "cells")
        discard(before)
    # Documents decide in the cell where the quota ends, and in those beside it until there are some hundreds of them.
    whole = Window.partitionBy("source")
    at = F.max(F.when(F.col("cut"), F.col("row_end"))).over(whole)
    near = (F.col("row_end") > at - ZONE) & (F.col("row_end") - F.col("n") < at + ZONE) & (F.col("cut") | (F.col("n") <= MOST_ZONE))
    table = cells.withColumn("zone", F.coalesce(near, F.lit(False)))
    table = table.withColumn("ahead", F.coalesce(F.max(F.when(~F.col("zone") & (F.col("upto") <= F.col("quota")), F.col("upto"))).over(whole), F.lit(0)))
    partial = F.col("zone") | (F.col("upto") <= F.col("quota"))
    times = F.least(F.col("rounds") + partial.cast("int"), F.lit(most)).cast("int")
    draws = table.filter(times > 0).select("source", *CELL, F.explode(F.sequence(F.lit(1), times)).alias("draw"))
    # The splitting tree: each level cuts every node's draws at half in a permuted order.
    draws = draws.withColumn("part", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("part")
        rank = F.row_number().over(node.orderBy(F.xxhash64("source", *CELL, "draw", F.lit(seed + 2 + level)), F.col("source").asc_nulls_last(), *CELL, "draw"))
        draws = draws.withColumn("rank", rank).withColumn("half", (F.count("*").over(node) + 1) / 2)
        draws = draws.withColumn("part", F.col("part") * 2 + (F.col("rank") > F.floor("half")).cast("int"))
    dealt = draws.groupBy("source", *CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "part"))), lambda d: d["part"]).alias("parts"))
    same = F.col("t.source").eqNullSafe(F.col("d.source"))
    for c in CELL:
        same = same & (F.col(f"t.{c}") == F.col(f"d.{c}"))
    out = table.alias("t").join(dealt.alias("d"), same, "left").select("t.source", *[f"t.{c}" for c in CELL], "source_size", "target", "rounds", "quota", "upto", "zone", "ahead", F.coalesce("parts", F.array().cast("array<int>")).alias("parts"))
    out = written(out, "blocks")
    discard(cells)
    return out


def _chosen(placed: DataFrame, most: int) -> DataFrame:
    """The rows of zones with extra: 1 for those that fill their source's quota. A source has at most some thousand rows there, however large it is."""
    split = placed.withColumn("left", F.col("quota") - F.col("ahead")).withColumn("extra", F.lit(0))
    slack = F.max("size").over(Window.partitionBy("source"))  # room for the largest document, which the later turns may need
    for turn in range(5):  # first in a permuted order, then the largest that still fit
        first = Window.partitionBy("source").orderBy("spot" if turn == 0 else F.col("size").desc(), "spot", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fits = (F.col("extra") == 0) & (F.col("size") <= F.col("left"))
        split = split.withColumn("fits", fits if turn else F.lit(True)).withColumn("sum", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(first))
        split = split.withColumn("now", (F.col("fits") & (F.col("sum") <= F.col("left") - (F.lit(0) if turn else slack))).cast("int"))
        used = F.sum(F.col("now") * F.col("size")).over(Window.partitionBy("source"))
        split = split.withColumn("left", F.col("left") - used).withColumn("extra", F.col("extra") + F.col("now"))
    return split.drop("left", "fits", "sum", "now")


def _placed(docs: DataFrame, weights: tuple[int, ...], most: int, blocks: int, levels: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every row of `docs`, narrow, with its cell and how many copies are taken; and the cells."""
    rows = _keyed(docs.select("doc_id", "source", "text"), blocks, seed).withColumn("size", word_count(F.col("row.text"))).drop("row")
    rows = written(rows, "sizes")
    cells = _plan(rows, weights, most, levels, seed)
    placed = rows.alias("r").join(cells.alias("b"), _in_cell("r", "b")).select("doc_id", "text_hash", "size", "spot", "b.*")
    whole = placed.filter("not zone").withColumn("extra", (F.col("upto") <= F.col("quota")).cast("int"))
    out = _chosen(placed.filter("zone"), most).unionByName(whole)
    return out.withColumn("copies", F.least(F.col("rounds") + F.col("extra"), F.lit(most)).cast("int")), cells


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, blocks: int = BLOCKS, levels: int = LEVELS, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, parts, positions, source, text_hash) for every row of `docs` (doc_id, text, source, ...).

    size is the number of words, taken = copies * size, copies from 0 to `most`.
    parts has the output shard (0 .. 2**levels - 1) of each copy, positions its
    pseudo-random place there; both are empty if none is taken.  A source's taken words
    come nearest to its target that documents around the end of its quota allow, and
    never differ by its longest document.  The draw depends on the rows and the seed alone.  A null text has no words; a null source is a source of
    its own; rows of a null doc_id and repeated rows are documents like any other;
    ties of the hash are broken by doc_id.  An empty table gives an empty one.
    """
    out, _ = _placed(docs, weights, most, blocks, levels, seed)
    parts = F.slice("parts", F.lit(1), F.col("copies"))
    positions = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda i: F.xxhash64("spot", i, F.lit(seed + 99)))
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", parts.alias("parts"), F.when(F.col("copies") > 0, positions).otherwise(none).alias("positions"), "source", "text_hash")


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, blocks: int = BLOCKS, levels: int = LEVELS, seed: int = 17) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them.

    What is taken of a block is joined to the rows by its number, and single
    documents decide only around the end of a quota, so the texts themselves are
    not shuffled.  Rows equal in doc_id, text and source are taken as often as they are together.
    """
    placed, cells = _placed(docs, weights, most, blocks, levels, seed)
    single = placed.filter("zone").groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").cast("int").alias("times"), F.count("*").alias("rows"))
    single = written(single, "zone")
    rows = _keyed(docs, blocks, seed).alias("r").join(broadcast_if_small(cells).alias("b"), _in_cell("r", "b"))
    taken = F.least(F.col("b.rounds") + (F.col("b.upto") <= F.col("b.quota")).cast("int"), F.lit(most)).cast("int")
    rows = rows.select("row", "doc_id", "r.source", "text_hash", F.when(~F.col("b.zone"), taken).alias("taken"))
    same = F.col("r.doc_id").eqNullSafe(F.col("z.doc_id")) & F.col("r.source").eqNullSafe(F.col("z.source")) & (F.col("r.text_hash") == F.col("z.text_hash"))
    # A row outside every zone has none in the table of single documents, as equal rows lie in one cell.
    found = rows.alias("r").join(broadcast_if_small(single).alias("z"), same, "left")
    found = found.select("row", "r.doc_id", "r.source", "r.text_hash", F.coalesce("taken", "times").alias("times"), F.coalesce(F.col("taken").isNull() & (F.col("rows") > 1), F.lit(False)).alias("many"))
    out = found
    if single.filter("rows > 1").limit(1).count():
        out = found.filter("not many").unionByName(found.filter("many").dropDuplicates(["doc_id", "source", "text_hash"]))
    out = out.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return out.select("row.*")
