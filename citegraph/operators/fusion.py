"""Reciprocal rank fusion of any number of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators.lexical import ranked_top

RRF_K = 60


def fuse(arms: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None, top_k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, ranks, raw_scores, rank) from `arms`: name -> (query_id, doc_id, score, rank).

    score is the sum of weight / (k + rank) over the lists that have the document;
    ranks and raw_scores are maps by the list's name.  Ties go to the lesser doc_id;
    top_k 0 or None keeps all.
    """
    weights = weights or {}
    rows = [df.select("query_id", "doc_id", F.lit(name).alias("arm"), "rank", F.col("score").cast("double").alias("raw"), (F.lit(float(weights.get(name, 1.0))) / (k + F.col("rank"))).alias("part")) for name, df in arms.items()]
    both = reduce(DataFrame.unionByName, rows)
    fused = both.groupBy("query_id", "doc_id").agg(
        F.sum("part").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", "rank")))).alias("ranks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", "raw")))).alias("raw_scores")
    )
    return ranked_top(fused, top_k)


def sources(ranks):
    return F.array_sort(F.map_keys(ranks))


def found_by_both(ranks):
    return F.size(ranks) > 1
