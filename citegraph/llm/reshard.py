"""Resharding by minimum-cost flow: which blocks of which old shards move so that the fewest bytes do.

Rows are dealt by hash into blocks of their old shard; only the table of block
sizes, of a fixed number of rows at any corpus size, comes to the driver.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.llm.shared import written

#: Blocks of an old shard; with the old shards this bounds the driver's table.
BLOCKS = 512
OLD_SHARDS = 16


def minimum_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: int(i != j)) -> list[list[int]]:
    """How much of each supply goes to each capacity, all of it, at the least total cost.

    Successive shortest paths on the bipartite graph; capacities must suffice.
    """
    m, n = len(supply), len(capacity)
    flow, left, room = [[0] * n for _ in range(m)], list(supply), list(capacity)
    while any(left):
        far = [0 if left[i] else None for i in range(m)] + [None] * n
        came: list[int | None] = [None] * (m + n)
        changed = True
        while changed:  # Bellman-Ford on the residual graph
            changed = False
            for i in range(m):
                for j in range(n):
                    if far[i] is not None and (far[m + j] is None or far[i] + cost(i, j) < far[m + j]):
                        far[m + j], came[m + j], changed = far[i] + cost(i, j), i, True
                    if flow[i][j] and far[m + j] is not None and (far[i] is None or far[m + j] - cost(i, j) < far[i]):
                        far[i], came[i], changed = far[m + j] - cost(i, j), m + j, True
        ends = [j for j in range(n) if room[j] and far[m + j] is not None]
        if not ends:
            raise ValueError("capacities do not suffice")
        end = min(ends, key=lambda j: (far[m + j], j))
        path, v = [], m + end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        much = min(left[v], room[end], *(flow[b][a - m] for a, b in path if a >= m))
        for a, b in path:
            if a < m:
                flow[a][b - m] += much
            else:
                flow[b][a - m] -= much
        left[v] -= much
        room[end] -= much
    return flow


@dataclasses.dataclass
class Plan:
    """target: (old shard, block) -> new shard; first_slot: the slot of the block's first row; moved: bytes that change shard."""

    target: dict[tuple[int, int], int]
    first_slot: dict[tuple[int, int], int]
    moved: int
    loads: list[int]


def plan_blocks(blocks: list[tuple[int, int, int, int]], shards: int, capacity: list[int] | None = None) -> Plan:
    """A plan for blocks (old shard, block, rows, bytes) and new shards 0..shards-1 of the given capacities (equal ones if None).

    The flow says how many bytes go from each old shard to each new one; whole
    blocks fill it, largest first, and last the smallest exchange of blocks evens
    out what rounding left.
    """
    total = sum(b[3] for b in blocks)
    capacity = capacity or [total // shards + (j < total % shards) for j in range(shards)]
    olds = max([shards, *(b[0] + 1 for b in blocks)])
    supply = [0] * olds
    for old, _, _, size in blocks:
        supply[old] += size
    flow = minimum_cost_flow(supply, capacity)
    target, loads = {}, [0] * shards
    for old in range(olds):
        need = list(flow[old])
        for o, b, _, size in sorted((x for x in blocks if x[0] == old), key=lambda x: (-x[3], x[1])):
            best = max(range(shards), key=lambda j: (min(need[j], capacity[j] - loads[j]), j == old, -j))
            if old < shards and need[old] >= size and capacity[old] - loads[old] >= size:
                best = old
            need[best] -= size
            loads[best] += size
            target[o, b] = best
    held: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in range(shards)]
    for o, b, _, size in blocks:
        held[target[o, b]].append((size, (o, b)))
    for _ in range(4 * len(blocks)):
        gap = [loads[j] - capacity[j] for j in range(shards)]
        full, free = max(range(shards), key=lambda j: gap[j]), min(range(shards), key=lambda j: gap[j])
        move = min(held[full], key=lambda x: (abs(2 * x[0] - gap[full] + gap[free]), x[1]), default=None)
        if full == free or move is None or move[0] >= gap[full] - gap[free]:
            break
        held[full].remove(move)
        held[free].append(move)
        target[move[1]] = free
        loads[full] -= move[0]
        loads[free] += move[0]
    first, slots = {}, [0] * shards
    for o, b, rows, _ in sorted(blocks):
        first[o, b] = slots[target[o, b]]
        slots[target[o, b]] += rows
    return Plan(target, first, sum(x[3] for x in blocks if target[x[0], x[1]] != x[0]), loads)


def by_source(shards: int = OLD_SHARDS) -> Column:
    """The old layout of a corpus that was written source by source: all rows of a source lie in one shard; null counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def reshard(docs: DataFrame, shards: int = OLD_SHARDS, old_shard: Column | None = None, capacity: list[int] | None = None, blocks: int = BLOCKS) -> tuple[DataFrame, Plan]:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for every row of `docs` (doc_id, text, ...), and the plan.

    `old_shard` says where each row lies (by source unless given).  Size is the UTF-8
    bytes of the text, none for a null, plus 1; a null's checksum is that of no
    bytes.  Slots run from 0 without a gap in every shard.  Rows of a null doc_id
    and repeated rows are placed like any other; which of several equal rows gets
    which of their slots does not matter.
    """
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        (by_source() if old_shard is None else old_shard).alias("old_shard"),
    )
    rows = written(rows.withColumn("spot", F.xxhash64("doc_id", "text_crc32")).withColumn("block", F.pmod("spot", F.lit(blocks)).cast("int")), "rows")
    sizes = rows.groupBy("old_shard", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    plan = plan_blocks(sorted((r.old_shard, r.block, r.n, r.bytes) for r in sizes), shards, capacity)
    spark = docs.sparkSession
    table = spark.createDataFrame([(o, b, j, plan.first_slot[o, b]) for (o, b), j in plan.target.items()], "old_shard int, block int, shard int, first_slot long")
    from pyspark.sql import Window

    inside = Window.partitionBy("old_shard", "block").orderBy("spot", "doc_id", "text_crc32", "size")
    placed = rows.join(F.broadcast(table), ["old_shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first_slot") + F.row_number().over(inside) - 1).alias("slot")), plan


def rewrite_affected(docs: DataFrame, plan: Plan, out_dir: str, old_shard: Column | None = None, blocks: int = BLOCKS) -> list[int]:
    """Write the shards that gain or lose rows under `out_dir`/shard=N and return their numbers; files of other shards stay as they are.

    Rows go as `reshard` placed them, nulls and repeated rows too; a column `shard`
    of `docs` is written as shard_before; an empty table affects nothing.
    """
    docs = docs.withColumnRenamed("shard", "shard_before")
    affected = sorted({j for (o, _), j in plan.target.items() if j != o} | {o for (o, _), j in plan.target.items() if j != o})
    spark = docs.sparkSession
    table = spark.createDataFrame([(o, b, j) for (o, b), j in plan.target.items() if j in affected], "__old int, __block int, shard int")
    body = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.withColumn("__old", by_source() if old_shard is None else old_shard).withColumn("__block", F.pmod(F.xxhash64("doc_id", F.crc32(body)), F.lit(blocks)).cast("int"))
    rows = keyed.join(F.broadcast(table), ["__old", "__block"])
    # A shard is dealt over many tasks by its blocks, so no task writes a whole shard.
    rows.repartition("shard", F.pmod("__block", F.lit(64))).drop("__old", "__block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(out_dir)
    return affected
