"""Removal of repeated passages.

Against a reference (`strip_reference`): suffix automata of reference shards of
bounded size are broadcast, documents stream through them for matching
statistics, and every maximal span of at least `min_words` words that stands in
the reference goes.

Within a corpus (`strip_repeats`): here the reference is the corpus itself, whose
automata have no size bound and would have to meet every document, so windows
are counted instead.  Two equal windows hold the same least 10-gram at the same
place; only texts that share such an anchor with another text or place have
windows hashed, counted by a shuffle and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import words as W
from citegraph.llm.shared import broadcast_if_small, by_value, small_batches, written

by_value(__name__)

WINDOW, ANCHOR = 35, 10
SHARD_WORDS, SHARDS_AT_ONCE = 100_000, 4


def anchors(words: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window within a text: its first word, its text, the place of its least k-gram, and that k-gram's hash."""
    at, text = W.runs_within(first, window)
    if not len(at):
        return at, text, at, np.empty(0, np.uint64)
    low = np.uint64((1 << 20) - 1)
    grams = W.run_hashes(words, k)
    least = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    span, have = window - k + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    place = at + ((least[at].astype(np.int64) - at) & ((1 << 20) - 1))
    return at, text, place, grams[place]


def _hash_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.chunks(batch.column(2)):
                starts, ends, first = W.spans(data, at)
                _, text, place, gram = anchors(W.word_hashes(data, starts, ends), first, window, k)
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
                text, gram = text[new], gram[new]
                offsets = np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)
                raw = data.tobytes()
                whole = [_hash_of(raw[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(np.diff(first).astype(np.int64)), pa.array(whole), pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram.view(np.int64)))],
                    ["doc_id", "text_key", "n_words", "whole_sha256", "anchors"],
                )

    return run


def _windows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weight, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for lo, hi, data, at in W.chunks(batch.column(3)):
                starts, ends, first = W.spans(data, at)
                words = W.word_hashes(data, starts, ends)
                begin, text, _, gram = anchors(words, first, window, k)
                take = np.isin(gram.view(np.int64), shared[lo:hi].flatten().to_numpy(zero_copy_only=False))
                begin, text, gram = begin[take], text[take], gram[take]
                whole = W.run_hashes(words, window)[begin] if len(begin) else gram
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[lo + text]), pa.array((begin - first[text]).astype(np.int32)), pa.array(weight[lo + text])],
                    ["gram", "whole", "tid", "begin", "n"],
                )

    return run


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_bytes(batch.column(1))
            raw, removed, kept = data.tobytes(), [], []
            for i, begins in enumerate(batch.column(2)):
                words = raw[at[i] : at[i + 1]].split()
                edge = np.zeros(len(words) + 1, np.int64)
                b = begins.values.to_numpy()
                np.add.at(edge, b, 1)
                np.add.at(edge, b + window, -1)
                free = np.cumsum(edge[:-1]) == 0
                removed.append(len(words) - int(free.sum()))
                kept.append(b" ".join(words[j] for j in np.flatnonzero(free)))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), texts], ["tid", "n_removed", "kept_sha256", "kept"])

    return run


def strip_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept_sha256, kept) for every row of `docs` (doc_id, text, any more columns).

    A word goes if a window of `window` consecutive words covers it whose words
    also start anywhere else, in another row or the same; windows are judged on
    the input.  `kept` has the words left, joined by one space, and is null
    where the text lost nothing.

    A null or blank text has no words.  Repeated rows are documents of their own
    and so repeat each other.  doc_id is carried, never compared.  Windows are
    compared by 128 bits of hash.
    """
    source = small_batches(docs).select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    seen = written(source.mapInArrow(_scan(window, anchor), f"doc_id {kind}, text_key binary, n_words long, whole_sha256 string, anchors array<long>"), "scan")
    texts = seen.groupBy("text_key").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    placed = texts.filter(F.size("anchors") > 0).select("tid", "n", F.explode("anchors").alias("gram"))
    # What is shared is written, so that the joins with it have exchanges of their own and Spark may split a hot key.
    common = written(placed.groupBy("gram").agg(F.sum("n").alias("c")).filter("c > 1").select("gram"), "common")
    hits = written(placed.join(common, "gram").groupBy("tid", "n").agg(F.collect_set("gram").alias("grams")), "hits")
    wanted = written(hits.join(texts.select("tid", "text_key"), "tid"), "wanted")
    bodies = source.select("text_key", "text")
    bodies = bodies.join(broadcast_if_small(wanted.select("text_key")), "text_key", "left_semi").dropDuplicates(["text_key"])
    bodies = written(bodies.join(wanted, "text_key").select("tid", "n", "grams", "text"), "bodies")

    runs = bodies.mapInArrow(_windows(window, anchor), "gram long, whole long, tid long, begin int, n long")
    runs = written(runs, "windows")
    repeated = written(runs.groupBy("gram", "whole").agg(F.sum("n").alias("c")).filter("c > 1").select("gram", "whole"), "repeated")
    # A text that has a copy loses all it has; only texts of their own need their windows back.
    found = runs.filter("n = 1").join(repeated, ["gram", "whole"]).groupBy("tid").agg(F.collect_list("begin").alias("begins"))
    stripped = found.join(bodies.select("tid", "text"), "tid").select("tid", "text", "begins")
    stripped = stripped.mapInArrow(_strip(window), "tid long, n_removed long, kept_sha256 string, kept string")

    by_text = texts.select("tid", "text_key", "n").join(stripped, "tid", "left").drop("tid")
    copied = (F.col("n") > 1) & (F.col("n_words") >= window)
    empty = hashlib.sha256(b"").hexdigest()
    return seen.drop("anchors").join(by_text, "text_key").select(
        "doc_id", "text_key", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


class SuffixAutomaton:
    """The suffix automaton of word sequences; no match runs from one sequence into the next."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # a further sequence takes a path that is there
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def matching_statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest match that ends with it."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def strip_reference(docs: DataFrame, reference: DataFrame, min_words: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` with spans (array of begin, end in words) and kept (text) added: maximal spans of `min_words` words or more that stand in a text of `reference` (text) go.

    The reference is dealt by hash into shards of about `shard_words` words, whose
    automata are bounded by twice that many states; SHARDS_AT_ONCE of them are
    broadcast to a pass over the documents, and a larger reference takes more
    passes.  A null text stays null and has no spans; an empty reference removes
    nothing; repeated rows are treated each; columns `spans` and `kept` of `docs` come back as
    spans_before and kept_before.
    """
    docs = small_batches(docs).withColumnsRenamed({"spans": "spans_before", "kept": "kept_before"})
    spark = docs.sparkSession
    parts = reference.select(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+").alias("w")).agg(F.sum(F.size("w"))).first()[0] or 0
    n = max(1, -(-parts // shard_words))
    out = docs.withColumn("spans", F.array().cast("array<struct<begin:int,end:int>>"))
    for lo in range(0, n, SHARDS_AT_ONCE):
        shards = []
        for s in range(lo, min(n, lo + SHARDS_AT_ONCE)):
            rows = reference.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == s).select("text").collect()
            shards.append(SuffixAutomaton([(r.text or "").encode().split() for r in rows]))
        sent = spark.sparkContext.broadcast(shards)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = []
                for text, had in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    words, marks = (text or "").encode().split(), list(had)
                    for automaton in sent.value:
                        stats = automaton.matching_statistics(words)
                        marks += [{"begin": i + 1 - m, "end": i + 1} for i, m in enumerate(stats) if m >= min_words and (i + 1 == len(stats) or stats[i + 1] <= m)]
                    merged: list[dict] = []
                    for m in sorted(marks, key=lambda m: m["begin"]):
                        if merged and m["begin"] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(m["end"], merged[-1]["end"])
                        else:
                            merged.append(dict(m))
                    spans.append(merged)
                columns = [pa.array(spans, batch.schema.field("spans").type) if f.name == "spans" else batch.column(i) for i, f in enumerate(batch.schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        out = written(out.mapInArrow(match, out.schema), "matched")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["begin"] <= i) & (i < s["end"])))
    return out.withColumn("kept", F.array_join(kept, " "))
