"""Retrieval metrics from ranked lists and gold, citation statistics, gold validation, localisation of diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.functions.text import spans_overlap

KS = (1, 3, 5, 10)


def deduplicated(ranked: DataFrame, item: str = "item") -> DataFrame:
    """(query_id, item, rank): each item at its first place, ranks without gaps."""
    first = ranked.groupBy("query_id", F.col(item).alias("item")).agg(F.min("rank").alias("at"))
    return first.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "item")).alias("rank"))


def per_query(queries: DataFrame, ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """A row for each of `queries` (query_id, ...): recall, hit and precision at each k, rr and ap, from `ranked` (query_id, item, rank) and `gold` (query_id, item).

    Precision divides by how many items there are up to k; without gold, or without
    items, everything is 0.
    """
    truth = gold.select("query_id", "item").distinct()
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    marked = ranked.join(truth.withColumn("good", F.lit(1)), ["query_id", "item"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    running = F.sum("good").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("so_far", running)
    cells = [F.count("*").alias("n_items"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("good") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum")]
    cells += [F.count_distinct(F.when((F.col("good") == 1) & (F.col("rank") <= k), F.col("item"))).alias(f"in{k}") for k in ks]
    rows = queries.join(marked.groupBy("query_id").agg(*cells), "query_id", "left").join(sizes, "query_id", "left").na.fill(0, ["n_items", "n_gold", "ap_sum", *[f"in{k}" for k in ks]])
    out = [c for c in queries.columns]
    for k in ks:
        hits = F.col(f"in{k}")
        rows = rows.withColumn(f"recall_at_{k}", F.when(F.col("n_gold") > 0, hits / F.col("n_gold")).otherwise(0.0)).withColumn(f"hit_at_{k}", (hits > 0).cast("double"))
        rows = rows.withColumn(f"precision_at_{k}", F.when(F.col("n_items") > 0, hits / F.least(F.lit(k), F.col("n_items"))).otherwise(0.0))
        out += [f"recall_at_{k}", f"hit_at_{k}", f"precision_at_{k}"]
    rows = rows.withColumn("rr", F.coalesce(1.0 / F.col("first"), F.lit(0.0))).withColumn("ap", F.when(F.col("n_gold") > 0, F.col("ap_sum") / F.col("n_gold")).otherwise(0.0))
    return rows.select(*out, "rr", "ap")


def means(rows: DataFrame, by: str | None = None, digits: int | None = 4) -> DataFrame:
    """Means of all metrics of per_query over all queries (`by` null) and for each value of the column `by`, in one pass."""
    names = [c for c in rows.columns if c.startswith(("recall_", "hit_", "precision_")) or c in ("rr", "ap")]
    cells = [F.count("*").alias("questions"), *[(F.round(F.avg(c), digits) if digits is not None else F.avg(c)).alias(c) for c in names]]
    return rows.rollup(by).agg(*cells) if by else rows.agg(*cells)


def citation_stats(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """One row from `answers` (answer_id) and verified `citations` (answer_id, valid, reason): totals, rates and a map of reasons."""
    each = answers.join(citations.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("good")), "answer_id", "left").na.fill(0, ["n", "good"])
    row = each.agg(
        F.count("*").alias("answers"), F.sum("n").alias("citations"), F.sum("good").alias("valid_citations"), F.avg((F.col("good") > 0).cast("double")).alias("supported_rate"),
        F.avg(((F.col("n") > 0) & (F.col("good") == F.col("n"))).cast("double")).alias("all_valid_rate"),
    )
    reasons = citations.filter(~F.col("valid")).groupBy("reason").agg(F.count("*").alias("k")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "k")))).alias("failure_reasons"))
    return row.withColumn("validity_rate", F.when(F.col("citations") > 0, F.col("valid_citations") / F.col("citations")).otherwise(0.0)).crossJoin(reasons)


def invalid_gold(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, problem, value): gold files and symbols that no chunk of the question's repository has, and repositories without chunks. `chunks` has repo, path, qualified_name."""
    repos = chunks.select("repo").distinct()
    none = questions.join(repos, "repo", "left_anti").select("id", F.lit("missing_index").alias("problem"), F.col("repo").alias("value"))
    there = questions.join(repos, "repo", "left_semi")
    files = there.select("id", "repo", F.explode("gold_files").alias("value")).join(chunks.select("repo", F.col("path").alias("value")), ["repo", "value"], "left_anti")
    symbols = there.select("id", "repo", F.explode("gold_symbols").alias("value")).join(chunks.select("repo", F.col("qualified_name").alias("value")), ["repo", "value"], "left_anti")
    return none.unionByName(files.select("id", F.lit("missing_file").alias("problem"), "value")).unionByName(symbols.select("id", F.lit("missing_symbol").alias("problem"), "value"))


def gold_files(hunks: DataFrame) -> DataFrame:
    """(query_id, files): the sorted paths that the hunks of each instance change."""
    return hunks.groupBy(F.col("instance_id").alias("query_id")).agg(F.array_sort(F.collect_set("path")).alias("files"))


def overlapping(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """The rows of `spans` (query_id, path, start_line, end_line, ...) that some hunk (query_id, path, lo, hi) of their query and file overlaps."""
    s, h = spans.alias("s"), hunks.alias("h")
    same = (F.col("s.query_id") == F.col("h.query_id")) & (F.col("s.path") == F.col("h.path"))
    return s.join(h, same & spans_overlap(F.col("s.start_line"), F.col("s.end_line"), F.col("h.lo"), F.col("h.hi")), "left_semi")


def localisation(ranked: DataFrame, hunks: DataFrame, all_chunks: DataFrame | None = None, ks: tuple[int, ...] = KS) -> tuple[DataFrame, DataFrame]:
    """Metrics by file and by symbol for `ranked` (query_id, chunk_id, path, start_line, end_line, rank) against diff hunks.

    Gold symbols are the retrieved chunks that overlap a hunk or, with `all_chunks`
    (query_id, chunk_id, path, ...), all chunks that do, which also counts what was missed.
    """
    queries = hunks.select("query_id").distinct()
    files = per_query(queries, deduplicated(ranked, "path"), hunks.select("query_id", F.col("path").alias("item")), ks)
    gold = overlapping(ranked if all_chunks is None else all_chunks, hunks).select("query_id", F.col("chunk_id").alias("item"))
    return files, per_query(queries, deduplicated(ranked, "chunk_id"), gold, ks)
