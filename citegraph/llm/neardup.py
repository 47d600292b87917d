"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A text is the bag of its five-word shingles, so the similarity is the weighted
Jaccard similarity of two multisets.  BagMinHash: each distinct shingle carries
Poisson processes over its weight axis, one for each dyadic interval [0,1),
[1,2), [2,4), ... of the discretised weights; a process is seeded by the shingle
and the interval alone, so two texts see the same points as far as both their
weights reach.  Every point falls in one of the registers; a register keeps its
earliest point, and two registers agree with exactly the probability of the
weighted Jaccard similarity.  The processes of a text advance together and stop
once every register is sure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import words as W
from citegraph.llm.components import connected_components
from citegraph.llm.shared import broadcast_if_small, by_value, release, small_batches, written

by_value(__name__)

#: Two texts of similarity exactly 0.8 share no band with probability (1 - 0.8**5)**24 = 7e-5, of 0.85 with 1e-6, of 0.5 with 0.47.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
#: Members of one bucket, and shingles of them, that are compared at once.
BLOCK, BLOCK_ITEMS = 256, 400_000
#: Pairs of one leader that meet one copy of its bag.
SALT = 1024


def bags(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of the distinct shingles, ordered; a text of fewer than k words has one shingle, all its words."""
    starts, ends, first = W.spans(data, at)
    words = W.word_hashes(data, starts, ends)
    index, text = W.runs_within(first, k)
    shingles = W.run_hashes(words, k)[index] if len(index) else np.empty(0, np.uint64)
    counts = np.diff(first)
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            shingles = np.concatenate([shingles, W.run_hashes(words, n)[first[short]]])
            text = np.concatenate([text, short])
    order = np.lexsort((shingles, text)) if len(at) > 1 << 16 else None
    if order is None:
        # The order of the upper 48 bits within a text is enough to bring equal shingles together.
        packed = (text.astype(np.uint64) << np.uint64(48)) | (shingles >> np.uint64(16))
        packed.sort()
        text, shingles = (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1)
    else:
        text, shingles = text[order], shingles[order] >> np.uint64(16)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    where = np.flatnonzero(new)
    return text[where], shingles[where], np.diff(np.append(where, len(text)))


def signatures(text: np.ndarray, shingles: np.ndarray, weights: np.ndarray, texts: int, size: int) -> np.ndarray:
    """BagMinHash registers (texts x size) as the bits of each register's earliest time; rows of texts without shingles are infinite."""
    seed, weights = W.mix(shingles + np.uint64(0x632BE59BD9B4E019)), weights.astype(np.int64)
    parts = [(text, seed, np.ones(len(text)), np.zeros(len(text), np.int64), weights)]
    level, more = 1, np.flatnonzero(weights > 1)
    while len(more):
        low = 1 << (level - 1)
        parts.append((text[more], W.mix(seed[more] + np.uint64(level * 0x2545F4914F6CDD1D & (1 << 64) - 1)), np.full(len(more), float(low)), np.full(len(more), low), weights[more]))
        level += 1
        more = more[weights[more] > (1 << (level - 1))]
    text, seed, rate, low, limit = (np.concatenate(x) for x in zip(*parts, strict=True))
    total = np.bincount(text, np.minimum(rate, limit - low), texts)
    out = np.full((texts, size), np.inf)
    todo, reach = total > 0, size * (np.log(size) + 5)
    while todo.any():
        until = np.where(todo, reach / np.maximum(total, 1), -1.0)
        flat = np.full(texts * size, np.inf)
        mine = np.flatnonzero(todo[text])
        t_text, t_seed, t_rate, t_low, t_limit = text[mine], seed[mine], rate[mine], low[mine], limit[mine]
        time, step, ahead = np.zeros(len(mine)), 0, 1
        while len(t_text):  # the next 1, 2, 4, ... points of every process that is still early enough
            steps = np.arange(step + 1, step + ahead + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            z = W.mix(t_seed[:, None] + steps)
            times = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / t_rate[:, None]
            times[:, 0] += time
            np.cumsum(times, 1, out=times)
            who, which = np.nonzero(times <= until[t_text][:, None])
            z, at = W.mix(z[who, which] ^ np.uint64(0xD1B54A32D192ED03)), times[who, which]
            register = ((z >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            spot = t_low[who] + ((z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * t_rate[who]).astype(np.int64)
            kept = np.flatnonzero(spot < t_limit[who])
            np.minimum.at(flat, t_text[who[kept]] * size + register[kept].astype(np.int64), at[kept])
            time = times[:, -1]
            alive = np.flatnonzero(time <= until[t_text])
            t_text, t_seed, t_rate, t_low, t_limit, time = (x[alive] for x in (t_text, t_seed, t_rate, t_low, t_limit, time))
            step, ahead = step + ahead, min(2 * ahead, 64)
        flat = flat.reshape(texts, size)
        full = todo & np.isfinite(flat).all(1)
        out[full] = flat[full]
        todo &= ~full
        reach *= 2
    return out


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band, different for different bands."""
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(W.mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for r in range(rows):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))


def _sign(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.chunks(batch.column(2)):
                text, shingles, weights = bags(data, at, k)
                keys = band_keys(signatures(text, shingles, weights, hi - lo, bands * rows), bands, rows)
                some = np.bincount(text, minlength=hi - lo) > 0
                size = pa.array(np.bincount(text, weights, hi - lo).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], size, _lists(keys[some].ravel(), some * bands)], ["doc_id", "text_key", "size", "bands"])

    return run


def _bag(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.chunks(batch.column(1)):
                text, shingles, weights = bags(data, at, k)
                # The j-th copy of a shingle is an element of its own: overlap of bags becomes overlap of sets.
                nth = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
                items = (W.mix(np.repeat(shingles, weights) + (nth.astype(np.uint64) << np.uint64(48)))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], _lists(items, np.bincount(text, weights, hi - lo).astype(np.int64))], ["tid", "bag"])

    return run


def _compare(similarity: float):
    """Links between the queries and the targets of one block pair, at most one for each two components."""

    def run(table: pa.Table) -> pa.Table:
        reps, comps = table["tid"].to_numpy(), table["comp"].to_numpy()
        role, lists = table["is_query"].to_numpy(), table["bag"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes, owner = np.diff(off), np.repeat(np.arange(len(reps)), np.diff(off))
        q, t = np.flatnonzero(role), np.flatnonzero(~role)
        links = []
        if len(q) and len(t):
            _, code = np.unique(flat[off[0] : off[-1]], return_inverse=True)
            row = np.zeros(len(reps), np.int64)
            row[q], row[t] = np.arange(len(q)), np.arange(len(t))
            shared = np.zeros((len(q), len(t)), np.float32)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            for low in range(0, int(code[-1]) + 1, 4096):
                a, b = np.searchsorted(code, (low, low + 4096))
                left, right = np.zeros((len(q), 4096), np.float32), np.zeros((len(t), 4096), np.float32)
                o, c = owner[a:b], code[a:b] - low
                left[row[o[role[o]]], c[role[o]]] = 1
                right[row[o[~role[o]]], c[~role[o]]] = 1
                shared += left @ right.T
            union = sizes[q][:, None] + sizes[t][None, :] - shared
            hit = (shared >= similarity * union - 1e-6) & (comps[q][:, None] != comps[t][None, :])
            i, j = np.nonzero(hit)
            pair = np.stack([np.minimum(comps[q[i]], comps[t[j]]), np.maximum(comps[q[i]], comps[t[j]])], 1)
            links = np.unique(pair, axis=0) if len(pair) else []
        links = np.asarray(links, np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return run


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, class_id, class_key) for every row of `docs` (doc_id, text, any more columns).

    Two texts are linked if their bags of shingles have a weighted Jaccard
    similarity of at least `similarity`; classes are the connected components.
    A class is named by the least doc_id of its rows, class_id, and by the
    text_key (md5) of the text that has it, class_key; of several texts with that
    doc_id the least key counts.  Texts are compared whatever their doc_id; a class
    without any has a null class_id.  A bucket of any size is finished exactly: first
    all members against the least one, then, where a bucket still spans several
    components, those outside its largest component against all, in blocks.

    A null text counts as an empty one.  Texts without words are alike only if
    equal.  Repeated rows come out as often as they went in.  An empty table gives
    an empty one.
    """
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(source.mapInArrow(_sign(bands, rows, shingle), "doc_id long, text_key string, size long, bands array<long>"), "signed")
    texts = signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    keyed = texts.select("tid", "size", F.explode("bands").alias("key"))
    # Written, so that the join with it has an exchange of its own and Spark may split a key that many texts have.
    buckets = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("tid", "size")).alias("leader")).filter("n > 1"), "buckets")
    members = written(keyed.join(buckets, "key"), "members")
    release(buckets)

    wanted = members.select("tid").distinct().join(texts.select("tid", "text_key", "rep"), "tid")
    wanted = written(wanted, "wanted")
    bodies = source.join(broadcast_if_small(wanted), (source["text_key"] == wanted["text_key"]) & source["doc_id"].eqNullSafe(wanted["rep"])).select("tid", "text").dropDuplicates(["tid"])
    bagged = written(bodies.mapInArrow(_bag(shingle), "tid long, bag array<long>"), "bags")
    release(wanted)

    # A leader's bag goes out in as many copies as its largest bucket needs, so that no task holds all of its pairs.
    least, most = F.least("size", "leader.size"), F.greatest("size", "leader.size")
    near = members.filter((F.col("tid") != F.col("leader.tid")) & (least >= F.lit(similarity) * most - F.lit(1e-6)))
    pairs = near.groupBy("tid", F.col("leader.tid").alias("leader")).agg(F.max("n").alias("n"))
    pairs = written(pairs.select("tid", "leader", F.ceil(F.col("n") / SALT).cast("int").alias("copies")).withColumn("copy", F.pmod(F.xxhash64("tid"), "copies").cast("int")), "pairs")
    leaders = pairs.select("leader", "copies").distinct().join(bagged.select(F.col("tid").alias("leader"), F.col("bag").alias("bag2")), "leader")
    leaders = leaders.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    linked = (
        pairs.join(bagged, "tid").join(leaders, ["leader", "copies", "copy"])
        .withColumn("shared", F.size(F.array_intersect("bag", "bag2")))
        .filter(F.col("shared") >= F.lit(similarity) * (F.size("bag") + F.size("bag2") - F.col("shared")) - F.lit(1e-6))
        .select(F.col("tid").alias("a"), F.col("leader").alias("b"))
    )
    labels = connected_components(written(linked, "links"))
    release(pairs)

    members = members.join(labels.withColumnRenamed("id", "tid"), "tid", "left").select("key", "tid", "n", "size", F.coalesce("label", "tid").alias("comp"))
    split = members.groupBy("key").agg(F.first("n").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.sum(F.xxhash64("tid").cast("decimal(38,0)")).alias("set")).filter("n > 2 and least <> most")
    split = split.groupBy("n", "set").agg(F.min("key").alias("key"))  # buckets of the same members need one look
    open_members = written(members.join(split.select("key"), "key"), "open")
    groups = open_members.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("size").alias("items"))
    largest = groups.groupBy("key").agg(F.max(F.struct("m", "comp", "items")).alias("top"), F.sum("items").alias("items"))
    asked = open_members.join(largest, "key").withColumn("is_query", F.col("comp") != F.col("top.comp"))
    pieces = lambda n, items: F.ceil(F.greatest(n / BLOCK, items / BLOCK_ITEMS)).cast("int")
    blocks = asked.withColumn("q_blocks", pieces(F.col("n") - F.col("top.m"), F.col("items") - F.col("top.items"))).withColumn("t_blocks", pieces(F.col("n"), F.col("items"))).withColumn("spot", F.xxhash64("tid"))
    queries = blocks.filter("is_query").select("key", "tid", "comp", F.lit(True).alias("is_query"), F.pmod("spot", "q_blocks").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("tb"))
    targets = blocks.select("key", "tid", "comp", F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), F.pmod("spot", "t_blocks").cast("int").alias("tb"))
    rest = queries.unionByName(targets).join(bagged, "tid").groupBy("key", "qb", "tb").applyInArrow(_compare(similarity), "a long, b long")
    merged = connected_components(written(rest.distinct(), "rest"))
    release(open_members, bagged)

    labels = labels.unionByName(merged.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))).alias("l").join(merged.select(F.col("id").alias("label"), F.col("label").alias("low")), "label", "left")
    placed = texts.select("tid", "text_key", "rep").join(labels.select(F.col("id").alias("tid"), F.coalesce("low", "label").alias("label")), "tid", "left")
    placed = written(placed.select("text_key", "rep", F.coalesce("label", "tid").alias("label")), "placed")
    names = placed.groupBy("label").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "text_key")).alias("name"))
    named = placed.join(names, "label").select("text_key", F.col("name.rep").alias("class_id"), F.col("name.text_key").alias("class_key"))
    return signed.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", "class_id", "class_key")


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that name their class in `classes`, one a class, and only one of repeated rows."""
    # The caller's columns travel as one, so that none of their names can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    first = classes.filter("doc_id <=> class_id and text_key = class_key").groupBy(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")).agg(F.count("*").alias("copies"))
    found = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))).select("row", "id", "key", "copies")
    single = found.filter("copies = 1")
    repeated = found.filter("copies > 1").dropDuplicates(["id", "key"])
    return single.unionByName(repeated).select("row.*")
