"""The index of one repository: chunks, lexical and dense index, graph; searches over a batch of queries."""

from __future__ import annotations

import dataclasses
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions import text as T
from citegraph.operators import chunks as C
from citegraph.operators import fusion, graph, lexical, lookup, vectors
from citegraph.sources.files import read_chunks, source_files, write_chunks

MODES = ("bm25", "dense", "hybrid", "hybrid+graph")


def _one(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id long, text string")


@dataclasses.dataclass
class Index:
    chunks: DataFrame
    lexical: lexical.LexicalIndex
    encoder: vectors.TfidfSvdEncoder
    vectors: DataFrame
    graph: graph.CodeGraph
    manifest: dict

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    # Vectors are keyed by a number; chunks carry theirs.
    @property
    def numbered(self) -> DataFrame:
        return self.chunks.select("chunk_id", F.xxhash64("chunk_id").alias("doc_no"))

    @classmethod
    def build(cls, spark: SparkSession, root: str, encoder: str = "auto", dimension: int = 256, min_lines: int = 1) -> Index:
        began = time.time()
        found = C.chunk_files(source_files(spark, root), min_lines).persist()
        if found.limit(1).count() == 0:
            raise ValueError(f"no chunks under {root}")
        docs = C.retrieval_docs(found)
        lex = lexical.build(docs)
        for name in ("postings", "doc_stats", "term_stats", "corpus_stats"):
            getattr(lex, name).persist()
        enc = vectors.build_encoder(encoder, dimension).fit(docs)
        vecs = enc.encode(docs).persist()
        code = graph.build(found)
        code.edges.persist()
        row = C.manifest(found).first()
        built = {"chunks": row.chunks, "files": row.files, "kinds": dict(row.kinds), "encoder": enc.describe(), "chunker": "stdlib-ast", "vectors": "exact", "graph": graph.summary(code), "build_seconds": round(time.time() - began, 2), "root": root}
        return cls(found, lex, enc, vecs, code, built)

    def save(self, path: str) -> None:
        write_chunks(self.chunks, f"{path}/chunks")
        self.lexical.save(f"{path}/lexical")
        self.encoder.save(f"{path}/encoder")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
        self.graph.module_edges.write.mode("overwrite").parquet(f"{path}/module_edges")
        self.graph.call_sites.write.mode("overwrite").parquet(f"{path}/call_sites")
        self.spark.createDataFrame([(json.dumps(self.manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        found = read_chunks(spark, f"{path}/chunks")
        code = graph.CodeGraph(found, read("edges").select("src", "dst", "type", "call", "resolver"), read("module_edges"), read("call_sites"))
        return cls(found, lexical.LexicalIndex.load(spark, f"{path}/lexical"), vectors.TfidfSvdEncoder.load(spark, f"{path}/encoder"), read("vectors"), code, json.loads(spark.read.text(f"{path}/manifest").first()[0]))

    # Lists of chunk ids for a batch of queries (query_id, text).
    def bm25(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return lexical.search(self.lexical, queries, k)

    def dense(self, queries: DataFrame, k: int = 20) -> DataFrame:
        asked = self.encoder.encode(queries.select(F.col("query_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "query_id")
        mine = self.vectors.select(F.xxhash64("doc_id").alias("doc_id"), "embedding")
        top = vectors.exact_top_k(mine, asked, k).withColumnRenamed("doc_id", "doc_no")
        return top.join(self.numbered, "doc_no").select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")

    def hybrid(self, queries: DataFrame, k: int | None = 10, candidates: int = 30, weights: dict[str, float] | None = None) -> DataFrame:
        return fusion.fuse({"bm25": self.bm25(queries, candidates), "dense": self.dense(queries, candidates)}, weights=weights, top_k=k)

    def expanded(self, queries: DataFrame, k: int = 10, seed_k: int = 8, token_budget: int = 6000, max_hops: int = 2, candidates: int = 30, include_siblings: bool = False) -> tuple[DataFrame, DataFrame]:
        """Fused seeds widened along the graph: (query_id, doc_id, score, hops, reached_via, sources, ranks, rank), and the trace."""
        fused = self.hybrid(queries, None, candidates).persist()
        seeds = fused.filter(F.col("rank") <= seed_k).select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank")
        costs = self.chunks.select("chunk_id", T.estimate_tokens(F.col("source")).alias("cost"))
        found = graph.expand(seeds, self.graph.edges, costs, token_budget, max_hops, include_siblings=include_siblings)
        ranks = fused.select("query_id", F.col("doc_id").alias("chunk_id"), "ranks")
        rows = found.filter("admitted").join(ranks, ["query_id", "chunk_id"], "left")
        rows = rows.withColumn("sources", F.coalesce(fusion.sources(F.col("ranks")), F.array(F.lit("graph"))))
        order = F.row_number().over(lexical.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hops", "chunk_id"))
        top = rows.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "hops", "reached_via", "sources", "ranks", "rank")
        return top, graph.expansion_trace(found, token_budget)

    def retrieve(self, queries: DataFrame, mode: str, k: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank) in one of MODES."""
        if mode == "bm25":
            return self.bm25(queries, k)
        if mode == "dense":
            return self.dense(queries, k)
        if mode == "hybrid":
            return self.hybrid(queries, k).select("query_id", "doc_id", "score", "rank")
        if mode == "hybrid+graph":
            return self.expanded(queries, k, seed_k=max(3, k // 2), token_budget=6000)[0].select("query_id", "doc_id", "score", "rank")
        raise ValueError(f"unknown mode: {mode}")

    def results(self, ranked: DataFrame) -> list[dict]:
        """Ranked rows of one query with what a reader needs of each chunk; scores at 6 digits."""
        extra = [c for c in ("sources", "ranks", "hops", "reached_via") if c in ranked.columns]
        rows = ranked.join(self.chunks.withColumnRenamed("chunk_id", "doc_id"), "doc_id").orderBy("rank")
        rows = rows.select(F.col("doc_id").alias("chunk_id"), "path", "kind", "name", "qualified_name", "start_line", "end_line", T.header(F.col("signature"), F.col("name")).alias("signature"), T.citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation"), F.round("score", 6).alias("score"), *extra)
        return [r.asDict(recursive=True) for r in rows.collect()]

    def search(self, query: str, mode: str = "hybrid", k: int = 10) -> list[dict]:
        return self.results(self.retrieve(_one(self.spark, query), mode, k))

    def search_with_expansion(self, query: str, k: int = 10, **options) -> tuple[list[dict], dict]:
        top, trace = self.expanded(_one(self.spark, query), k, **options)
        row = trace.first()
        return self.results(top), row.asDict(recursive=True) if row else {}

    def get(self, chunk_id: str) -> dict | None:
        row = lookup.by_id(self.chunks, chunk_id).first()
        return row.asDict() if row else None

    def files(self) -> list[str]:
        return [r.path for r in lookup.files(self.chunks).collect()]


def build_indexes(spark: SparkSession, repos: dict[str, str], base: str = ".") -> dict[str, Index]:
    """An index for each repository whose root exists."""
    return {name: Index.build(spark, str(Path(base, root))) for name, root in repos.items() if Path(base, root).is_dir()}
