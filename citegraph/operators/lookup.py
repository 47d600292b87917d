"""Lookups over chunks, text search by line, and the check of citations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CITATION = r"^([^\s:]+):(\d+)(?:-(\d+))?$"


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def by_name(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks of that name, or whose qualified name ends with it, whatever the case."""
    low = name.lower()
    return chunks.filter((F.lower("name") == low) | F.endswith(F.lower(F.col("qualified_name")), F.lit(low)))


def in_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("path") == path).orderBy("start_line", "chunk_id")


def files(chunks: DataFrame) -> DataFrame:
    return chunks.select("path").distinct().orderBy("path")


def grep(chunks: DataFrame, pattern: str, max_results: int = 20) -> DataFrame:
    """(path, line, text, chunk_id) of the first lines that match, in the order of chunks; an invalid expression is searched for as it stands."""
    try:
        re.compile(pattern)
        hit = F.regexp_like("text", F.lit(pattern))
    except re.error:
        hit = F.contains("text", F.lit(pattern))
    lines = chunks.select("path", "chunk_id", "start_line", F.posexplode(F.split("source", "\n")).alias("pos", "text")).filter(hit)
    return lines.select("path", (F.col("start_line") + F.col("pos")).alias("line"), F.substring(F.trim("text"), 1, 200).alias("text"), "chunk_id", "start_line", "pos").orderBy("path", "start_line", "chunk_id", "pos").limit(max_results).select("path", "line", "text", "chunk_id")


def verify_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """`citations` (raw, ...) with path, start, end, valid and reason.

    Valid is a span within one chunk of its file.  The spans of a file are joined
    by path, once for each distinct citation.
    """
    text = F.regexp_replace(F.trim(F.coalesce("raw", F.lit(""))), "^`+|`+$", "")
    number = lambda i: F.try_to_number(F.nullif(F.regexp_extract("__text", CITATION, i), F.lit("")), F.lit("9" * 18)).cast("long")
    asked = citations.withColumn("__text", text)
    parsed = asked.select("__text").distinct().select("__text", F.regexp_extract("__text", CITATION, 1).alias("path"), number(2).alias("start"), number(3).alias("__end"))
    parsed = parsed.select("__text", "path", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("__end", "start", F.lit(0)).alias("end"))
    spans = chunks.select("path", "start_line", "end_line")
    held = parsed.filter("path <> ''").join(spans, "path").groupBy("__text").agg(F.bool_or((F.col("start_line") <= F.col("start")) & (F.col("end") <= F.col("end_line"))).alias("__in"), F.max("end_line").alias("__last"))
    judged = parsed.join(held, "__text", "left").select(
        "__text", "path", "start", "end", F.coalesce("__in", F.lit(False)).alias("valid"),
        F.when(F.col("path") == "", "malformed, expected path:start-end").when(F.col("__last").isNull(), "path not in index").when(F.col("__in"), "")
        .when(F.col("start") > F.col("__last"), F.concat(F.lit("line "), F.col("start").cast("string"), F.lit(" beyond indexed extent ("), F.col("__last").cast("string"), F.lit(")"))).otherwise("span does not fall inside one chunk").alias("reason"),
    )
    return asked.join(judged, "__text").drop("__text")
