"""Evaluations over a question set: retrieval by mode, the agent, and diffs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.operators import metrics
from citegraph.plans.agent import Model, Answerer
from citegraph.plans.index import MODES, Index, build_indexes
from citegraph.sources.files import patch_hunks, read_instances, read_questions, read_repositories, union_all
from citegraph.sources.scratch import written


def by_question(questions: DataFrame, index: Index, modes: tuple[str, ...] = MODES, k: int = 10) -> DataFrame:
    """(mode, level, query_id, type, metrics...): every question, by file and by symbol."""
    asked = questions.select(F.col("id").alias("query_id"), F.col("question").alias("text")).withColumn("no", F.xxhash64("query_id"))
    base = questions.select(F.col("id").alias("query_id"), "type")
    files = questions.select(F.col("id").alias("query_id"), F.explode("gold_files").alias("item"))
    symbols = questions.select(F.col("id").alias("query_id"), F.explode("gold_symbols").alias("item"))
    out = []
    for mode in modes:
        top = index.retrieve(asked.select(F.col("no").alias("query_id"), "text"), mode, k).withColumnRenamed("query_id", "no").join(asked.select("no", "query_id"), "no")
        ranked = written(top.join(index.chunks.select(F.col("chunk_id").alias("doc_id"), "path", "qualified_name"), "doc_id"), "ranked")
        for level, item, gold in (("file", "path", files), ("symbol", "qualified_name", symbols)):
            rows = metrics.per_query(base, metrics.deduplicated(ranked, item), gold)
            out.append(rows.select(F.lit(mode).alias("mode"), F.lit(level).alias("level"), "*"))
    return union_all(out)


def retrieval(questions: DataFrame, index: Index, modes: tuple[str, ...] = MODES, k: int = 10) -> DataFrame:
    """(mode, level, type, questions, metrics...): means by file and by symbol, over all questions (type null) and by type."""
    rows = written(by_question(questions, index, modes, k), "questions")
    each = [metrics.means(rows.filter((F.col("mode") == m) & (F.col("level") == v)), "type").select(F.lit(m).alias("mode"), F.lit(v).alias("level"), "*") for m in modes for v in ("file", "symbol")]
    return union_all(each)


def diffs(instances: DataFrame, indexes: dict[str, Index], mode: str = "hybrid+graph", k: int = 10) -> dict:
    """Localisation of diffs: each instance asks its index (by instance_id) for its problem statement; instances without an index are skipped and counted."""
    hunks = patch_hunks(instances).withColumnRenamed("instance_id", "query_id")
    rows = instances.select("instance_id", "problem_statement").collect()
    found, skipped = [], sorted(r.instance_id for r in rows if r.instance_id not in indexes)
    for r in rows:
        if r.instance_id in indexes:
            index = indexes[r.instance_id]
            asked = index.spark.createDataFrame([(0, r.problem_statement or "")], "query_id long, text string")
            top = index.retrieve(asked, mode, k).drop("query_id").withColumnRenamed("doc_id", "chunk_id")
            found.append(top.join(index.chunks.select("chunk_id", "path", "start_line", "end_line"), "chunk_id").withColumn("query_id", F.lit(r.instance_id)))
    out = {"mode": mode, "top_k": k, "instances_available": len(rows), "instances_scored": len(found), "instances_skipped": len(skipped), "skipped_ids": skipped[:20]}
    if found:
        scored = hunks.filter(F.col("query_id").isin([r.instance_id for r in rows if r.instance_id in indexes]))
        by_file, by_symbol = (written(x, "localised") for x in metrics.localisation(written(union_all(found), "ranked"), scored))
        out |= {"file_level": metrics.means(by_file).first().asDict(), "function_level": metrics.means(by_symbol).first().asDict(), "per_instance": [r.asDict() for r in by_file.orderBy("query_id").collect()]}
    return out


def agent(questions: list[dict], index: Index, model: Model | None = None, max_steps: int = 6) -> dict:
    """Citation statistics, the share of answers that cite a gold file, mean steps and a histogram of tools."""
    spark, answers = index.spark, []
    for q in questions:
        answers.append((q, Answerer(index, model, max_steps).answer(q["question"])))
    ids = spark.createDataFrame([(q["id"],) for q, _ in answers], "answer_id string")
    cited = spark.createDataFrame([(q["id"], c["valid"], c["reason"]) for q, a in answers for c in a.citations], "answer_id string, valid boolean, reason string")
    row = metrics.citation_stats(ids, cited).first().asDict()
    n = max(1, len(answers))
    asked = spark.createDataFrame([(q["id"],) for q, _ in answers], "query_id string")
    listed = spark.createDataFrame([(q["id"], p, i + 1) for q, a in answers for i, p in enumerate(a.cited_files)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([(q["id"], f) for q, _ in answers for f in q.get("gold_files") or []], "query_id string, item string")
    localised = metrics.means(metrics.per_query(asked, listed, gold)).first().asDict()
    return row | {
        "gold_file_rate": sum(bool(set(a.cited_files) & set(q.get("gold_files") or [])) for q, a in answers) / n, "mean_steps": sum(len(a.steps) for _, a in answers) / n,
        "answer_file_localisation": localised,
        "per_question": [{"id": q["id"], "steps": len(a.steps), "tools_used": a.tools_used, "citations": len(a.citations), "valid_citations": len(a.valid), "supported": a.supported, "stopped": a.stopped} for q, a in answers],
        "tool_usage": dict(Counter(t for _, a in answers for t in a.tools_used)),
    }


def report(spark: SparkSession, questions: str, base: str = ".", k: int = 10, with_agent: bool = True, instances: str | None = None, checkouts: str | None = None) -> dict:
    """All evaluations of a question set: gold that no chunk has, retrieval by mode and question, the agent, and diffs if there are any."""
    asked, roots = read_questions(spark, questions), read_repositories(questions)
    indexes = build_indexes(spark, roots, base)
    chunks = [i.chunks.select(F.lit(name).alias("repo"), "path", "qualified_name") for name, i in indexes.items()]
    chunks = union_all(chunks) if chunks else spark.createDataFrame([], "repo string, path string, qualified_name string")
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    out = {"questions": asked.count(), "indexes": {n: i.manifest for n, i in indexes.items()}, "invalid_gold": rows(metrics.invalid_gold(asked, chunks)), "retrieval": {}, "per_question": {}, "agent": {}}
    for name, index in indexes.items():
        own = asked.filter(F.col("repo") == name)
        out["retrieval"][name] = rows(retrieval(own, index, k=k))
        out["per_question"][name] = rows(by_question(own, index, k=k))
        if with_agent:
            out["agent"][name] = agent(rows(own), index)
    if instances:
        table, provenance = read_instances(spark, instances)
        ids = [r.instance_id for r in table.select("instance_id").collect()]
        ready = build_indexes(spark, {i: i for i in ids}, checkouts or ".")
        out["diffs"] = {"provenance": provenance, "results": diffs(table, ready, k=k) if ready else None}
    return out
