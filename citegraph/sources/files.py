"""Source trees, question sets, diff benchmarks and index tables as DataFrames."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Directories of vendored, generated or tool files.
SKIPPED = (".git", "__pycache__", ".venv", "venv", "node_modules", ".mypy_cache", ".pytest_cache", "build", "dist", ".eggs", ".tox", ".idea", ".ruff_cache")

CHUNK = (
    "chunk_id string, path string, kind string, name string, qualified_name string, start_line int, end_line int, source string, module string, signature string, "
    "docstring string, parent string, imports array<string>, calls array<string>, decorators array<string>, language string"
)
INSTANCE = "instance_id string, repo string, base_commit string, problem_statement string, patch string"
QUESTION = "id string, repo string, type string, question string, gold_files array<string>, gold_symbols array<string>"


def module_name(path: Column) -> Column:
    """The dotted module of a path: without the suffix, `__init__` and a leading `src`."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: p != "__init__")
    parts = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, 2, 1_000_000)).otherwise(parts)
    return F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise(F.regexp_extract(bare, r"[^/]*$", 0))


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".py",)) -> DataFrame:
    """(path, text) of the files below `root`, without those in skipped directories. Bytes that are not UTF-8 become U+FFFD, line ends one "\\n", unreadable files are left out."""
    globs = extensions[0] if len(extensions) == 1 else "{" + ",".join(extensions) + "}"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{globs}").option("ignoreCorruptFiles", "true").text(root, wholetext=True)
    base = raw.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(raw.sparkSession._jsparkSession.sessionState().newHadoopConf()).makeQualified(base).toUri().getPath().rstrip("/")
    place = F.url_decode(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"), r"^[a-z0-9]+:(?://[^/]*)?", ""))
    rel = F.substr(place, F.lit(len(full) + 2))
    listed = raw.select(rel.alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return listed.filter(~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED]))) if SKIPPED else listed


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from Parquet, or from JSON lines, where unknown fields are ignored."""
    return spark.read.schema(CHUNK).json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    writer = chunks.write.mode("overwrite")
    writer.json(path) if path.endswith((".json", ".jsonl")) else writer.parquet(path)


def read_questions(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """Questions of a YAML file; a field that questions do not have is an error."""
    import yaml

    known = {x.split()[0] for x in QUESTION.split(", ")}
    rows = (yaml.safe_load(Path(path).read_text()) or {}).get("questions") or []
    for row in rows:
        if unknown := set(row) - known:
            raise TypeError(f"unknown fields: {sorted(unknown)}")
    out = spark.createDataFrame([tuple(r.get(k) for k in ("id", "repo", "type", "question", "gold_files", "gold_symbols")) for r in rows], QUESTION)
    return out.filter(F.col("repo") == repo) if repo else out


def read_repositories(path: str) -> dict[str, str]:
    """The roots of a question set's repositories by name."""
    import yaml

    return {name: r["root"] for name, r in ((yaml.safe_load(Path(path).read_text()) or {}).get("repos") or {}).items()}


def read_instances(spark: SparkSession, path: str | None, limit: int | None = None) -> tuple[DataFrame, str]:
    """Rows of a diff benchmark in JSON lines and where they come from; if there are none, an empty table and the reason."""
    empty = spark.createDataFrame([], INSTANCE)
    if not path:
        return empty, "no path given; the hub needs a network"
    try:
        rows = spark.read.schema(INSTANCE).json(path).filter("instance_id is not null")
        rows = rows.orderBy("instance_id").limit(limit) if limit else rows
        return rows, f"read from {path}"
    except Exception as reason:  # noqa: BLE001  a missing benchmark is reported, not raised
        return empty, f"cannot read {path}: {str(reason).splitlines()[0]}"


def patch_hunks(instances: DataFrame) -> DataFrame:
    """(instance_id, path, lo, hi): lines that each hunk of a unified diff covers in the new file; hunks of deleted files are none."""
    lines = instances.select("instance_id", F.posexplode(F.split("patch", "\n")).alias("pos", "line"))
    head, hunk = r"^\+\+\+ b/(.+?)\s*$", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    opened = F.when(F.regexp_like("line", F.lit(head)), F.regexp_extract("line", head, 1)).when(F.startswith("line", F.lit("+++ /dev/null")), F.lit(""))
    marks = lines.filter(F.regexp_like("line", F.lit(r"^(\+\+\+ |@@ )"))).withColumn("opened", opened)
    marks = marks.withColumn("path", F.last("opened", ignorenulls=True).over(Window.partitionBy("instance_id").orderBy("pos")))
    lo = F.regexp_extract("line", hunk, 1).cast("int")
    size = F.coalesce(F.nullif(F.regexp_extract("line", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    hunks = marks.filter(F.regexp_like("line", F.lit(hunk)) & (F.col("path") != ""))
    return hunks.select("instance_id", "path", lo.alias("lo"), (lo + F.greatest(F.lit(0), size - 1)).alias("hi"))


def readiness(instances: DataFrame, checkouts: DataFrame) -> DataFrame:
    """One row: ready, missing, first_missing (20 ids) of `instances` against `checkouts` (instance_id)."""
    both = instances.select("instance_id").join(checkouts.select("instance_id", F.lit(True).alias("there")).distinct(), "instance_id", "left")
    first = both.filter("there is null").orderBy("instance_id").limit(20).agg(F.array_sort(F.collect_list("instance_id")).alias("first_missing"))
    return both.agg(F.count_if(F.col("there").isNotNull()).alias("ready"), F.count_if(F.col("there").isNull()).alias("missing")).crossJoin(first)


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, default=str))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
