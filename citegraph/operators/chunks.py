"""Definitions of Python files as chunks with real line spans.

Parsing is the one step that needs Python: files stream through a parser in
Arrow batches; everything after it is DataFrame operations.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions import text as T
from citegraph.sources.files import CHUNK, module_name

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _offsets(source: str) -> list[int]:
    out = [0]
    for line in source.split("\n"):
        out.append(out[-1] + len(line.encode()) + 1)
    return out


class _File:
    def __init__(self, source: str):
        self.text, self.raw, self.lines, self.at = source, source.encode(), source.split("\n"), _offsets(source)

    def between(self, l0: int, c0: int, l1: int, c1: int) -> str:
        return self.raw[self.at[l0 - 1] + c0 : self.at[l1 - 1] + c1].decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.between(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)


def _calls(node: ast.AST, file: _File) -> list[str]:
    """Callee texts within a definition, without those of definitions nested in it; a nested one's decorators count."""
    found: list[tuple[int, int, str]] = []
    todo = list(ast.iter_child_nodes(node)) if not isinstance(node, _DEFINITIONS) else [c for c in ast.iter_child_nodes(node) if c not in node.decorator_list]
    while todo:
        n = todo.pop()
        if isinstance(n, _DEFINITIONS):
            todo += n.decorator_list
            continue
        if isinstance(n, ast.Call):
            found.append((n.lineno, n.col_offset, -n.end_lineno, -n.end_col_offset, file.of(n.func).strip()))
        todo += ast.iter_child_nodes(n)
    return list(dict.fromkeys(f[-1] for f in sorted(found)))


def _docstring(node: ast.AST, file: _File) -> str:
    first = node.body[0] if node.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return file.of(first.value).strip("\"'").strip()
    return ""


def definitions(source: str, module: str) -> list[dict]:
    """One dict for each definition, outer ones first; none if the source does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    file, out = _File(source), []
    imports = [" ".join(file.of(n).split()) for n in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)), key=lambda n: (n.lineno, n.col_offset))]

    def visit(node: ast.AST, scope: list[str], parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, _DEFINITIONS):
                visit(child, scope, parent)
                continue
            qualified = ".".join([module, *scope, child.name])
            start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
            body = child.body[0]
            begin = min([(body.lineno, body.col_offset), *((d.lineno, d.col_offset - 1) for d in getattr(body, "decorator_list", []))])
            signature = " ".join(file.between(child.lineno, child.col_offset, *begin).rstrip().rstrip(":").split())
            out.append({
                "kind": "class" if isinstance(child, ast.ClassDef) else "method" if scope else "function", "name": child.name, "qualified_name": qualified, "start_line": start, "end_line": child.end_lineno,
                "source": "\n".join(file.lines[start - 1 : child.end_lineno]), "signature": signature, "docstring": _docstring(child, file), "parent": parent, "imports": imports,
                "calls": _calls(child, file), "decorators": ["@" + file.of(d).strip() for d in child.decorator_list],
            })
            visit(child, [*scope, child.name], qualified)

    visit(tree, [], None)
    return out


_PARSED = "path string, module string, kind string, name string, qualified_name string, start_line int, end_line int, source string, signature string, docstring string, parent string, imports array<string>, calls array<string>, decorators array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, many = pa.string(), pa.list_(pa.string())
    kinds = {"string": text, "int": pa.int32(), "array<string>": many}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _PARSED.split(", ")])
    for batch in batches:
        for path, module, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows = [{"path": path, "module": module, **d} for d in definitions(source or "", module)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def chunk_files(files: DataFrame, min_lines: int = 1) -> DataFrame:
    """The chunks of `files` (path, text): every class and function, nested ones too, with its decorators; files that do not parse have none."""
    parsed = files.select("path", module_name(F.col("path")).alias("module"), "text").mapInArrow(_parse, _PARSED)
    out = parsed.withColumn("chunk_id", T.chunk_id(F.col("path"), F.col("qualified_name"), F.col("start_line"))).withColumn("language", F.lit("python"))
    return out.filter(T.line_count(F.col("start_line"), F.col("end_line")) >= min_lines).select([f.split()[0] for f in CHUNK.split(", ")])


def retrieval_docs(chunks: DataFrame) -> DataFrame:
    """(doc_id, text) to index."""
    return chunks.select(F.col("chunk_id").alias("doc_id"), T.retrieval_text(F.col("qualified_name"), F.col("signature"), F.col("docstring"), F.col("source")).alias("text"))


def manifest(chunks: DataFrame) -> DataFrame:
    """One row: chunks, files, kinds (map)."""
    kinds = chunks.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files")).crossJoin(kinds)
