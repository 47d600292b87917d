"""Dense retrieval: TF-IDF with truncated SVD, vector tables, exact inner-product top k."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.functions.text import tokenize
from citegraph.operators.lexical import ranked_top, small
from citegraph.sources.scratch import written

#: Numbers in the queries that go to every task at once; more of them take more passes.
QUERY_CELLS = 4_000_000
#: Terms up to which a vocabulary goes to every task.
VOCABULARY_ROWS = 1_000_000
#: Queries and vectors that a task multiplies at once, so that its memory does not grow with either.
TILE_QUERIES, TILE_VECTORS = 512, 2048


class Encoder(ABC):
    """Texts to unit vectors of one length."""

    dimension: int

    @abstractmethod
    def fit(self, corpus: DataFrame) -> Encoder: ...

    @abstractmethod
    def encode(self, texts: DataFrame) -> DataFrame:
        """(doc_id, embedding) of `texts` (doc_id, text)."""

    @abstractmethod
    def describe(self) -> str: ...


class TfidfSvdEncoder(Encoder):
    """Sublinear TF-IDF, projected on the leading right singular vectors of the corpus."""

    def __init__(self, dimension: int = 256):
        self.requested, self.dimension = dimension, 0
        self.idf: DataFrame | None = None
        self.components: DataFrame | None = None

    def fit(self, corpus: DataFrame) -> TfidfSvdEncoder:
        """The term weights, and components from the eigenvectors of the documents' Gram matrix (small corpora) or of Spark's distributed SVD."""
        n = corpus.count()
        self.idf = self.term_weights(corpus)
        width = self.idf.count()
        self.dimension = max(2, min(self.requested, min(n, width) - 1))
        rows = self.weights(corpus)
        if n <= 4000:
            cells = rows.select("doc_id", "idx", "weight").toPandas()
            _, doc = np.unique(cells.doc_id.to_numpy(), return_inverse=True)
            dense = np.zeros((n, width))
            dense[doc, cells.idx.to_numpy()] = cells.weight.to_numpy()
            value, left = np.linalg.eigh(dense @ dense.T)
            keep = np.argsort(-value)[: self.dimension]
            right = (dense.T @ left[:, keep]) / np.sqrt(np.maximum(value[keep], 1e-12))
        else:
            right = self._distributed(rows, n, width)
        spark = corpus.sparkSession
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(right).ravel()), right.shape[1]).cast(pa.list_(pa.float64()))
        self.components = spark.createDataFrame(pa.table({"idx": pa.array(np.arange(len(right)), pa.int32()), "component": flat}), "idx int, component array<double>").persist()
        return self

    def _distributed(self, rows: DataFrame, n: int, width: int) -> np.ndarray:
        """Right singular vectors by Spark's Lanczos iterations, of which each reads all rows; so they are kept as JVM vectors instead of being made anew by Python each time."""
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("v"))
        matrix = RowMatrix(grouped.select("v.idx", "v.weight").rdd.map(lambda r: Vectors.sparse(width, r.idx, r.weight)), n, width)
        kept = matrix._java_matrix_wrapper._java_model.rows()
        kept.persist(rows.sparkSession._jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())
        try:
            return matrix.computeSVD(self.dimension, computeU=False).V.toArray()
        finally:
            kept.unpersist(False)

    def term_weights(self, corpus: DataFrame) -> DataFrame:
        """(term, idx, idf) of the terms of `corpus`."""
        terms = corpus.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return written(numbered(terms, "term").select("term", "idx", (F.log((1 + F.lit(corpus.count())) / (1 + F.col("df"))) + 1).alias("idf")), "idf")

    def weights(self, texts: DataFrame) -> DataFrame:
        """(doc_id, term, idx, weight): (1 + ln tf) * idf, rows of length 1; unknown terms are left out."""
        if self.idf is None:
            raise RuntimeError("the encoder is not fitted")
        # Whole texts are dealt once, by document: terms are counted and lengths taken where they are, as a text is smaller than its counted terms.
        tf = texts.select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        raw = tf.join(small(self.idf, VOCABULARY_ROWS), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
        return raw.select("doc_id", "term", F.col("idx").cast("int").alias("idx"), (F.col("w") / norm).alias("weight"))

    def encode(self, texts: DataFrame) -> DataFrame:
        """Unit vectors; a text without known terms has the zero vector."""
        placed = self.weights(texts).join(self.components, "idx")
        sums = placed.groupBy("doc_id").agg(*[F.sum(F.col("weight") * F.col("component")[i]).alias(f"c{i}") for i in range(self.dimension)])
        raw = F.array(*[F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in range(self.dimension)])
        length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
        out = texts.select("doc_id").join(sums, "doc_id", "left").select("doc_id", raw.alias("raw")).withColumn("n", length)
        return out.select("doc_id", F.transform("raw", lambda x: x / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n"))).cast("array<float>").alias("embedding"))

    def describe(self) -> str:
        return f"tfidf-svd({self.dimension})"

    def save(self, path: str) -> None:
        if self.idf is None or self.components is None:
            raise RuntimeError("the encoder is not fitted")
        self.idf.write.mode("overwrite").parquet(f"{path}/idf")
        self.components.write.mode("overwrite").parquet(f"{path}/components")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfSvdEncoder:
        out = cls()
        out.idf, out.components = spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/components")
        out.dimension = out.requested = len(out.components.first().component)
        return out


def build_encoder(prefer: str = "auto", dimension: int = 256) -> Encoder:
    """The local encoder; a neural one is never replaced silently."""
    if prefer in ("auto", "local", "tfidf"):
        return TfidfSvdEncoder(dimension)
    if prefer in ("jina", "neural"):
        raise RuntimeError("no neural encoder is available here")
    raise ValueError(f"unknown encoder: {prefer}")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """`rows` with idx, 0, 1, ... in the order of `key`: sorted ranges are numbered in their tasks, and only the ranges' sizes come to the driver."""
    placed = written(rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    start, sizes = {}, {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    for part in sorted(sizes):
        start[part] = sum(sizes[p] for p in start)
    table = rows.sparkSession.createDataFrame([*start.items()], "__part int, __start long")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return placed.join(F.broadcast(table), "__part").withColumn("idx", (F.col("__start") + inside - 1).cast("int")).drop("__part", "__start")


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """`vectors` as it is; reading a row of another dimension is an error."""
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"dimension is not {dimension}"))))


def _scorer(ids: np.ndarray, matrix: np.ndarray, k: int, id_type: pa.DataType):
    def exact(block: np.ndarray, own: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Inner products of pairs, added in the order of the dimensions as SQL does, so that equal vectors tie wherever they stand."""
        out = np.zeros(len(q))
        for j in range(block.shape[1]):
            out += block[q, j] * own[d, j]
        return out

    def first(q: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best of each q, best first, and their places from 0."""
        order = np.lexsort((d, -s, ~np.isnan(s), q))
        q, s, d = q[order], s[order], d[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        return tuple(x[at < k] for x in (q, s, d, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        starts = range(0, len(ids), TILE_QUERIES)
        best, least = {b: none for b in starts}, np.full(len(ids), -np.inf)
        length = np.sqrt((matrix * matrix).sum(1))
        for batch in batches:
            for at in range(0, len(batch), TILE_VECTORS):
                part = batch.slice(at, TILE_VECTORS)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                doc, far = part.column(0).to_numpy(zero_copy_only=False), np.sqrt((own * own).sum(1))
                wild = ~np.isfinite(far)
                # Twice what a product may be off in its last bits, whatever the order of addition.
                slack = 4 * np.finfo(float).eps * own.shape[1] * far[~wild].max(initial=0)
                for b in starts:
                    block, bound = matrix[b : b + TILE_QUERIES], least[b : b + TILE_QUERIES] - slack * length[b : b + TILE_QUERIES]
                    near = block @ own.T
                    asked = ~(near < bound[:, None]) | wild
                    if asked.sum() > 4 * k * len(block) and k < len(doc):
                        kth = np.partition(near, len(doc) - k, axis=1)[:, len(doc) - k] - slack * length[b : b + TILE_QUERIES]
                        asked &= ~(near < kth[:, None]) | wild
                    q, d = np.nonzero(asked)
                    if not len(q):
                        continue
                    found = (q, exact(block, own, q, d), doc[d])
                    *best[b], place = first(*[np.concatenate(x) for x in zip(best[b], found, strict=True)])
                    full = place == k - 1
                    least[b + best[b][0][full]] = np.nan_to_num(best[b][1][full], nan=np.inf, posinf=np.inf, neginf=-np.inf)
        for b in starts:
            q, s, d = best[b]
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[b + q], id_type), pa.array(d, pa.int64()), pa.array(s)], ["query_id", "doc_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, doc_id, score, rank): the k greatest inner products of `vectors` (doc_id long, embedding) for each of `queries` (query_id long, embedding); ties by doc_id.

    Each task multiplies its vectors by a block of queries, a tile at a time, and passes
    on its best k a query, so what is shuffled does not grow with the vectors.  Queries come to the
    driver a block of QUERY_CELLS numbers at a time; with several blocks, each one's result is
    written before the next comes.  Without vectors or queries there are no rows.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-size[0] * max(1, size[1] or 1) // QUERY_CELLS))
    mine = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        ids, matrix = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block])
        found = ranked_top(mine.mapInArrow(_scorer(ids, matrix, k, pa.int64()), "query_id long, doc_id long, score double"), k)
        found = written(found, "nearest") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return ranked_top(vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double"), k) if out is None else out
