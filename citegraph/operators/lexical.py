"""BM25 over bags of identifier parts: an inverted index as tables, and top k of a batch of queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.functions.text import tokenize, tokenize_query
from citegraph.sources.scratch import written

K1, B = 1.2, 0.75
#: Sums of the same terms in another order differ in their last bits; rounded, copies of a document tie.
SCORE_DIGITS = 9
#: Query terms beyond which they are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked_top(scored: DataFrame, k: int | None, score: str = "score", tie: str = "doc_id", by: str = "query_id") -> DataFrame:
    """`scored` with its 1-based rank within `by`, best first, ties by `tie`; only ranks up to k (all if k is 0 or None)."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))))
    return out.filter(F.col("rank") <= k) if k else out


@dataclasses.dataclass
class LexicalIndex:
    """postings (term, doc_id, tf), doc_stats (doc_id, dl), term_stats (term, df), corpus_stats (n, avgdl)."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    k1: float = K1
    b: float = B

    def __len__(self) -> int:
        return self.doc_stats.count()

    def save(self, path: str) -> None:
        # Sorted by term, so that a search reads only the row groups of its terms; by hash, as a range exchange would count all postings twice.
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        stored = self.postings.sparkSession.read.parquet(f"{path}/postings")
        stored.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/term_stats")
        for name in ("doc_stats", "corpus_stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, k1: float = K1, b: float = B) -> LexicalIndex:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "doc_stats", "term_stats", "corpus_stats")], k1, b)


def build(docs: DataFrame, k1: float = K1, b: float = B) -> LexicalIndex:
    """The index of `docs` (doc_id, text); a document without tokens still counts among them and in the mean length.

    Texts are cut into tokens once; postings are counted within each row.
    """
    bags = written(docs.select("doc_id", tokenize(F.col("text")).alias("tokens")), "bags")
    doc_stats = bags.select("doc_id", F.size("tokens").cast("long").alias("dl"))
    term_stats = bags.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return LexicalIndex(term_counts(bags), doc_stats, term_stats, doc_stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), k1, b)


def term_counts(bags: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of `bags` (doc_id, tokens): counted within each row without a shuffle if no two rows have one doc_id."""
    if bags.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return bags.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    # In sorted tokens a term's run ends where the next begins.
    sorted_ = bags.select("doc_id", F.sort_array("tokens").alias("tokens"))
    ends = F.filter(F.transform("tokens", lambda t, i: F.when((i + 1 == F.size("tokens")) | (t != F.get("tokens", i + 1)), F.struct(t.alias("term"), i.alias("at")))), lambda x: x.isNotNull())
    runs = sorted_.select("doc_id", ends.alias("ends"))
    tf = F.transform("ends", lambda x, i: F.struct(x["term"].alias("term"), (x["at"] - F.coalesce(F.get("ends", i - 1)["at"], F.lit(-1))).cast("long").alias("tf")))
    return runs.select("doc_id", F.inline(tf)).select("term", "doc_id", "tf")


def idf(n, df):
    return F.when(df > 0, F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def search(index: LexicalIndex, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents for each of `queries` (query_id, text); a repeated query term counts as often."""
    terms = queries.select("query_id", F.explode(tokenize_query(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighed = terms.join(index.term_stats, "term").crossJoin(F.broadcast(index.corpus_stats)).select("query_id", "term", "avgdl", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w"))
    weighed = small(weighed)
    # Postings of the queries' terms go to their documents once; there each meets its queries, and a document's parts are added where they are.
    hits = index.postings.join(small(terms.select("term").distinct()), "term", "left_semi").join(index.doc_stats, "doc_id")
    tf, dl = F.col("tf"), F.greatest(F.col("dl"), F.lit(1))
    parts = hits.join(weighed, "term").select("query_id", "doc_id", (F.col("w") * tf * (index.k1 + 1) / (tf + index.k1 * (1 - index.b + index.b * dl / F.col("avgdl")))).alias("part"))
    return ranked_top(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score")), k)


def scan_search(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """`search` without an index, in one pass over `docs`: only occurrences of query terms leave a row, so no inverted index is shuffled."""
    terms = queries.select("query_id", F.explode(tokenize_query(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    # Texts are cut into tokens once; the rest reads the written tokens.
    bags = written(docs.select("doc_id", tokenize(F.col("text")).alias("tokens")), "bags")
    corpus = bags.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    wanted = small(terms.select("term").distinct())
    hits = bags.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    found = written(hits.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "hits")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(corpus)).select("query_id", "term", "avgdl", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w"))
    tf, dl = F.col("tf"), F.greatest(F.col("dl"), F.lit(1))
    parts = found.join(weighed, "term").select("query_id", "doc_id", (F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))).alias("part"))
    return ranked_top(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score")), k)
