"""The library on source code and on an index, with DuckDB SQL that gives the same rows.

The tables hold no code, so it is written from them: a module for each nation with a
class of its suppliers, imports, decorators and calls that resolve in every way
there is.  What the parser, the graph and the tools should find follows from
the tables alone, which is what the SQL says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions import text as T
from citegraph.operators import chunks as C
from citegraph.operators import graph, lexical, lookup, metrics, vectors
from citegraph.plans import agent, driver_queries, evaluate
from citegraph.plans.index import MODES, Index
from citegraph.sources import files
from citegraph.sources.scratch import fresh, write_text, written


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, text) of one module a nation."""
    ring = F.coalesce(F.lead("s_suppkey").over(lexical.Window.partitionBy("s_nationkey").orderBy("s_suppkey")), F.first("s_suppkey").over(lexical.Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    method = F.format_string("    @staticmethod\n    def supply_%d(self):\n        return self.supply_%d() + total() + len('x')\n", "s_suppkey", "next")
    body = _t(spark, d, "supplier").withColumn("next", ring).withColumn("m", method).groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "m"))), lambda x: x["m"]), "").alias("body"))
    n = _t(spark, d, "nation").join(body, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    key, odd = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 2 == 1
    following = ((F.col("n_nationkey") + 1) % 25).cast("string")
    text = F.concat(
        F.lit("import os\nfrom .n"), following, F.lit(" import total as total\n\nclass Store"), key, F.lit(':\n    """Suppliers of nation '), key, F.lit('."""\n'), F.coalesce("body", F.lit("")),
        F.lit("\ndef total():\n    return Store"), key, F.lit("() + shop.n0.total()"), F.when(odd, " + shared()\n").otherwise("\n\ndef shared():\n    return 1\n"),
    )
    return n.select(F.concat(F.lit("src/shop/n"), key, F.lit(".py")).alias("path"), text.alias("text"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_files(code_files(spark, d))


def _flat(chunks: DataFrame) -> DataFrame:
    """Chunks with their lists as texts and what is derived of them."""
    joined = [F.array_join(c, "|").alias(c) for c in ("imports", "calls", "decorators")]
    derived = [
        T.citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation"), T.header(F.col("signature"), F.col("name")).alias("header"), T.line_count(F.col("start_line"), F.col("end_line")).alias("lines"),
        F.md5(T.retrieval_text(F.col("qualified_name"), F.col("signature"), F.col("docstring"), F.col("source"))).alias("retrieval_md5"), T.estimate_tokens(F.col("source")).alias("tokens"),
    ]
    return chunks.select("chunk_id", "path", "kind", "name", "qualified_name", "start_line", "end_line", "module", "signature", "docstring", "parent", *joined, *derived)


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All definitions of all modules."""
    return _flat(_chunks(spark, d))


def _checkout(spark: SparkSession, d: str) -> str:
    """The modules as files below a root, beside files that no scan takes."""
    root = fresh(spark, "checkout")
    rows = code_files(spark, d).collect()
    for r in rows:
        write_text(spark, f"{root}/{r.path}", r.text.replace("\n", "\r\n") if r.path.endswith("0.py") else r.text)
    for skipped in ("src/build/gen.py", "src/shop/notes.txt", ".venv/lib.py", "src/shop/__pycache__/n0.py"):
        write_text(spark, f"{root}/{skipped}", "def skipped():\n    return 0\n")
    write_text(spark, f"{root}/src/shop/broken.py", "def broken(:\n")
    return root


def source_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files found below a root, with their modules and texts (line ends as one character)."""
    found = files.source_files(spark, _checkout(spark, d))
    return found.select("path", files.module_name(F.col("path")).alias("module"), F.md5("text").alias("text_md5"))


def chunk_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a scanned tree, written as Parquet and as JSON lines and read again."""
    found = C.chunk_files(files.source_files(spark, _checkout(spark, d)))
    out = []
    for form in ("parquet", "jsonl"):
        path = fresh(spark, "chunks") + f".{form}"
        files.write_chunks(found, path)
        out.append(_flat(files.read_chunks(spark, path)).withColumn("form", F.lit(form)))
    return out[0].unionByName(out[1])


def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    row = C.manifest(_chunks(spark, d))
    return row.select("chunks", "files", F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("kinds"))


def import_aliases(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_table(_chunks(spark, d)).select("path", "alias", "target")


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Call and containment edges by name resolution."""
    return graph.build(written(_chunks(spark, d), "chunks")).edges.select("src", "dst", "type", F.coalesce("call", F.lit("")).alias("call"))


def module_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.build(_chunks(spark, d)).module_edges.select("src", "dst", "via")


def call_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How every call site was resolved."""
    return graph.build(written(_chunks(spark, d), "chunks")).call_sites.groupBy("base", "outcome").agg(F.count("*").alias("n"))


def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    row = graph.resolution_stats(graph.build(written(_chunks(spark, d), "chunks")).call_sites)
    return row.withColumn("resolution_rate", F.round("resolution_rate", 6))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    found = graph.summary(graph.build(written(_chunks(spark, d), "chunks")))
    names = ["nodes", "call_edges", "contains_edges", "modules", "module_edges", "total_call_sites", "resolved", "external"]
    return spark.createDataFrame([tuple(int(found[k]) for k in names)], ", ".join(f"{k} long" for k in names))


def chunk_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Files, the symbols of one of them, and a chunk by its id."""
    found = written(_chunks(spark, d), "chunks")
    one = found.filter("name = 'Store3'").first().chunk_id
    rows = [lookup.files(found).select(F.lit("files").alias("how"), F.col("path").alias("what")), lookup.in_file(found, "src/shop/n1.py").select(F.lit("in_file").alias("how"), F.col("qualified_name").alias("what")), lookup.by_id(found, one).select(F.lit("by_id").alias("how"), F.col("qualified_name").alias("what"))]
    return files.union_all(rows)


def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of identifiers in camel case, in snake case and with acronyms, made from the types of parts."""
    words = F.initcap(F.lower("p_type"))
    forms = F.array(F.replace(words, F.lit(" "), F.lit("")), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.concat(F.lit("HTTP"), F.replace(words, F.lit(" "), F.lit(""))), F.concat(F.lit("_"), F.replace(words, F.lit(" "), F.lit("_"))))
    names = _t(spark, d, "part").select("p_partkey", F.posexplode(forms).alias("form", "name"))
    return names.select("p_partkey", "form", "name", F.array_join(T.split_identifier(F.col("name")), " ").alias("parts"))


def request_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of a request about every nation, the first JSON object of an answer, and what is left of a long payload."""
    rows = []
    for r in _t(spark, d, "nation").select("n_nationkey", "n_name").collect():
        found = T.extract_json(f"thinking {{not json}} ... ```json\n{{\"k\": {r.n_nationkey}}}\n```" if r.n_nationkey % 2 else f"say {{\"k\": {r.n_nationkey}, \"in\": {{\"a\": 1}}}} now {{\"k\": -1}}")
        short = T.condense({"rows": list(range(r.n_nationkey)), "text": "x" * 100 * r.n_nationkey})
        rows.append((r.n_nationkey, T.prompt_hash("m", [{"role": "user", "content": r.n_name}], temperature=0.0), found["k"], len(short["rows"]), short.get("rows_truncated", 0), len(short["text"])))
    return spark.createDataFrame(rows, "n_nationkey int, prompt_hash string, k int, kept int, left_out int, letters int")


def _instances(spark: SparkSession, d: str) -> DataFrame:
    """An edit of two files for every order, one of them deleted for some, as a diff benchmark in JSON lines."""
    at, n = (F.col("o_custkey") % 280 + 1).cast("string"), F.col("o_orderkey") % 4
    first = F.concat(F.lit("diff --git a/x b/x\n--- a/orders/"), F.col("o_orderkey").cast("string"), F.lit(".py\n+++ b/orders/"), F.col("o_orderkey").cast("string"), F.lit(".py\n@@ -1,2 +"), at, F.when(n == 0, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@ def f():\n+a\n@@ -90 +400,3 @@\n+b\n"))
    second = F.when(F.col("o_orderkey") % 3 == 0, "--- a/gone.py\n+++ /dev/null\n@@ -1,4 +0,0 @@\n-x\n").otherwise("--- a/y.py\n+++ b/y.py\n@@ -5,1 +5,2 @@\n+y\n")
    rows = _t(spark, d, "orders").select(F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("instance_id"), F.lit("r").alias("repo"), F.lit("c").alias("base_commit"), F.lit("p").alias("problem_statement"), F.concat(first, second).alias("patch"))
    path = fresh(spark, "instances")
    rows.write.json(path)
    return files.read_instances(spark, path)[0]


def patch_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines that each hunk covers, of a benchmark read from JSON lines."""
    return files.patch_hunks(_instances(spark, d))


def patched_files(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gold_files(files.patch_hunks(_instances(spark, d))).select("query_id", F.array_join("files", "|").alias("files"))


def checkout_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Instances with a checkout: those whose order has a line of return flag R."""
    there = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("i"), F.col("l_orderkey").cast("string")).alias("instance_id"))
    row = files.readiness(_instances(spark, d), there)
    return row.select("ready", "missing", F.array_join("first_missing", ",").alias("first_missing"))


def diff_localisation(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by file and by symbol of the lines of an order, dearest first, against a hunk of its file."""
    li, at = _t(spark, d, "lineitem"), (F.col("o_custkey") % 280).cast("int")
    key = lambda c: F.concat(F.lit("orders/"), F.col(c).cast("string"))
    ranked = lexical.ranked_top(li.select(key("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("doc_id"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_linenumber") % 2 == 0, key("l_orderkey")).otherwise(F.lit("other")).alias("path"), (F.col("l_linenumber") * 40).cast("int").alias("start_line"), (F.col("l_linenumber") * 40 + F.col("l_quantity")).cast("int").alias("end_line")), 10).withColumnRenamed("doc_id", "chunk_id")
    hunks = _t(spark, d, "orders").select(key("o_orderkey").alias("query_id"), key("o_orderkey").alias("path"), at.alias("lo"), (at + 60).alias("hi"))
    by_file, by_symbol = metrics.localisation(ranked, hunks, ks=(1, 5))
    cells = [F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_5", "recall_at_5", "rr")]
    return by_file.select("query_id", F.lit("file").alias("level"), *cells).unionByName(by_symbol.select("query_id", F.lit("symbol").alias("level"), *cells))


# An index over the benchmark's passages, of which each calls the next.  One has no tokens, so the rest span fewer dimensions than there are rows.
def passage_index(spark: SparkSession, d: str) -> Index:
    b = _passages(spark, d).withColumnRenamed("query_id", "item_id").unionByName(spark.createDataFrame([(-1, "")], "item_id long, text string"))
    name = F.format_string("p%05d", F.col("item_id") + 1)
    no, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    found = b.select(
        name.alias("chunk_id"), F.concat(F.lit("f"), (F.col("item_id") % 7).cast("string")).alias("path"), F.lit("function").alias("kind"), name.alias("name"), name.alias("qualified_name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.col("text").alias("source"),
        F.lit("m").alias("module"), F.lit("").alias("signature"), F.lit("").alias("docstring"), no.alias("parent"), none.alias("imports"), none.alias("calls"), none.alias("decorators"), F.lit("text").alias("language"),
    )
    found = written(found, "passages")
    docs = found.select(F.col("chunk_id").alias("doc_id"), F.col("source").alias("text"))
    edges = found.filter("source <> ''").select(F.col("chunk_id").alias("src"), F.format_string("p%05d", F.substring("chunk_id", 2, 5).cast("int") + 1).alias("dst"), F.lit("calls").alias("type"), no.alias("call"), no.alias("resolver"))
    edges = edges.join(found.select(F.col("chunk_id").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "call", "resolver")
    encoder = vectors.build_encoder("auto", 256).fit(docs)
    code = graph.CodeGraph(found, edges, edges.limit(0), edges.limit(0))
    lex = lexical.build(docs)
    out = Index(found, lex, encoder, vectors.check_dimension(encoder.encode(docs), encoder.dimension), code, {"encoder": encoder.describe(), "vectors": "exact"})
    path = fresh(spark, "index")
    out.save(path)
    return Index.load(spark, path)


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages with a word that all share, so that no two are wholly unlike and none tie."""
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("passage "), "text").alias("text"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 from an index that was stored and loaded."""
    index = lexical.build(_t(spark, d, "documents").select("doc_id", "text"))
    path = fresh(spark, "lexical")
    index.save(path)
    found = lexical.search(lexical.LexicalIndex.load(spark, path), _asked(spark, d), 20)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Term weights of documents, rows of length 1."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    encoder = vectors.TfidfSvdEncoder()
    encoder.idf = encoder.term_weights(docs)
    return encoder.weights(docs).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of encoded passages: as many components as the passages span keep them as they are."""
    index = passage_index(spark, d)
    found = index.dense(_passages(spark, d), 5)
    return found.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank", F.lit(index.manifest["encoder"]).alias("encoder"), F.lit(index.manifest["vectors"]).alias("store"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    found = passage_index(spark, d).hybrid(_passages(spark, d), 8, candidates=5)
    return found.select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank", F.array_join(F.array_sort(F.map_keys("ranks")), ",").alias("sources"))


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """Fused passages widened along the graph within a budget."""
    found, _ = passage_index(spark, d).expanded(_passages(spark, d), 10, seed_k=4, token_budget=400, candidates=5)
    return found.select("query_id", "doc_id", F.round("score", 8).alias("score"), "hops", "reached_via", F.array_join("sources", ",").alias("sources"), "rank")


def graph_trace(spark: SparkSession, d: str) -> DataFrame:
    _, trace = passage_index(spark, d).expanded(_passages(spark, d), 10, seed_k=4, token_budget=400, candidates=5)
    return trace.select("query_id", "seeds", "admitted", "expanded", "max_hops_reached", "tokens_used", "token_budget", "stopped_on_budget", "frontier_exhausted")


def search_modes(spark: SparkSession, d: str) -> DataFrame:
    """The best passage for every passage in each mode that can be asked for: itself."""
    index = passage_index(spark, d)
    return files.union_all([index.retrieve(_passages(spark, d), mode, 6).filter("rank = 1").select(F.lit(mode).alias("mode"), "query_id", "doc_id") for mode in MODES])


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Each passage asks for itself; what it should find is its file and name."""
    name = F.format_string("p%05d", F.col("item_id") + 1)
    return _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("r").alias("repo"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("type"), F.concat(F.lit("passage "), "text").alias("question"), F.array(F.concat(F.lit("f"), (F.col("item_id") % 7).cast("string"))).alias("gold_files"), F.array(name, F.lit("p00003")).alias("gold_symbols"))


def retrieval_evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.retrieval(_questions(spark, d), passage_index(spark, d), ("bm25",), 6)
    return rows.select("mode", "level", F.coalesce("type", F.lit("all")).alias("type"), "questions", *[F.round(c, 3).alias(c) for c in ("recall_at_1", "recall_at_5", "hit_at_1", "precision_at_5", "rr", "ap")])


def retrieval_by_question(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.by_question(_questions(spark, d), passage_index(spark, d), ("bm25",), 6)
    return rows.select("mode", "level", "query_id", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "hit_at_1", "rr")])


def tool_results(spark: SparkSession, d: str) -> DataFrame:
    """What the tools say of a tree that was scanned, chunked and indexed as a whole."""
    tools = agent.ToolBox(_code_index(spark, d))
    rows = [("tools", ",".join(tools.names()))]
    rows += [("list_symbols", s["qualified_name"]) for s in tools.call("list_symbols", {"path": "n2.py"}).payload["symbols"]]
    rows += [("find_callers", r["qualified_name"]) for r in tools.call("find_callers", {"chunk_id": "shop.n0.total"}).payload["callers"]]
    rows += [("find_callees", r["qualified_name"]) for r in tools.call("find_callees", {"chunk_id": "shop.n1.total"}).payload["callees"]]
    rows.append(("read_chunk", tools.call("read_chunk", {"chunk_id": "Store5"}).payload["citation"]))
    rows += [("grep_repo", f"{m['path']}:{m['line']}") for m in tools.call("grep_repo", {"pattern": "def shared", "max_results": 5}).payload["matches"]]
    rows += [("failed", t) for t, a in (("no_such_tool", {}), ("read_chunk", {"chunk_id": "nothing"}), ("list_symbols", {"file": "x"})) if not tools.call(t, a).ok]
    return spark.createDataFrame(rows, "tool string, item string")


_INDEXES: dict[str, Index] = {}


def _code_index(spark: SparkSession, d: str) -> Index:
    key = f"{spark.sparkContext.applicationId} {d}"
    if key not in _INDEXES:
        _INDEXES[key] = Index.build(spark, _checkout(spark, d), dimension=16)
    return _INDEXES[key]


def agent_answers(spark: SparkSession, d: str) -> DataFrame:
    """A question about relations and one that is not, answered offline behind a cache; asked again, all of it comes from there."""
    index, rows = _code_index(spark, d), []
    cache = agent.ResponseCache(":memory:")
    for question in ("what calls shared?", "Store5", "Store5"):
        model = agent.Failover([agent.Provider("none", None, needs_key="NO_SUCH_KEY"), agent.Provider("broken", None), agent.Provider("offline", agent.OfflinePolicy())], cache)
        said = agent.Answerer(index, model).answer(question)
        rows.append((len(rows), ",".join(said.tools_used), said.stopped, said.supported, said.validity, "+".join(sorted({e["model"] for e in model.failures})), model.cached))
    return spark.createDataFrame(rows, "n int, tools string, stopped string, supported boolean, validity double, failed_over string, cached int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        code_chunks, source_scan, chunk_round_trip, chunk_manifest, import_aliases, code_edges, module_edges, call_outcomes, resolution_stats, graph_summary, chunk_lookups, identifier_parts, request_hashes, patch_hunks, patched_files,
        checkout_readiness, diff_localisation, index_bm25, tfidf_weights, dense_search, hybrid_search, graph_search, graph_trace, search_modes, retrieval_evaluation, retrieval_by_question, tool_results, agent_answers,
    )
}

_SUPPLIERS = """sup as (
  select s_nationkey as k, s_suppkey as s, row_number() over (partition by s_nationkey order by s_suppkey) as r,
    coalesce(lead(s_suppkey) over (partition by s_nationkey order by s_suppkey), first_value(s_suppkey) over (partition by s_nationkey order by s_suppkey)) as nx from supplier),
methods as (select *, '    @staticmethod' || chr(10) || '    def supply_' || s || '(self):' || chr(10) || '        return self.supply_' || nx || '() + total() + len(''x'')' as src from sup),
mods as (
  select n_nationkey as k, 'src/shop/n' || n_nationkey || '.py' as path, 'shop.n' || n_nationkey as module, 'shop.n' || ((n_nationkey + 1) % 25) || '.total' as imported, n_nationkey % 2 = 1 as odd,
    'import os|from .n' || ((n_nationkey + 1) % 25) || ' import total as total' as imports, coalesce(m.n, 0) as m, coalesce(m.src, '') as methods
  from nation left join (select k, count(*) as n, string_agg(chr(10) || src, '' order by s) as src from methods group by k) m on m.k = n_nationkey)"""
_CHUNKS = f"""{_SUPPLIERS},
defs as (
  select path, 'class' as kind, 'Store' || k as name, module || '.Store' || k as qualified_name, 4 as start_line, 5 + 3 * m as end_line, module, 'class Store' || k as signature, 'Suppliers of nation ' || k || '.' as docstring,
    cast(null as varchar) as parent, imports, '' as calls, '' as decorators, 'class Store' || k || ':' || chr(10) || '    \"\"\"Suppliers of nation ' || k || '.\"\"\"' || methods as source from mods
  union all select b.path, 'method', 'supply_' || s, b.module || '.Store' || b.k || '.supply_' || s, 3 + 3 * r, 5 + 3 * r, b.module, 'def supply_' || s || '(self)', '', b.module || '.Store' || b.k, b.imports, 'self.supply_' || nx || '|total|len', '@staticmethod', d.src
    from methods d join mods b on b.k = d.k
  union all select path, 'function', 'total', module || '.total', 7 + 3 * m, 8 + 3 * m, module, 'def total()', '', null, imports, 'Store' || k || '|shop.n0.total' || case when odd then '|shared' else '' end, '',
    'def total():' || chr(10) || '    return Store' || k || '() + shop.n0.total()' || case when odd then ' + shared()' else '' end from mods
  union all select path, 'function', 'shared', module || '.shared', 10 + 3 * m, 11 + 3 * m, module, 'def shared()', '', null, imports, '', '', 'def shared():' || chr(10) || '    return 1' from mods where not odd),
chunks as (select substr(sha1(path || '::' || qualified_name || '::' || start_line), 1, 16) as chunk_id, * from defs)"""
_FLAT = """chunk_id, path, kind, name, qualified_name, start_line, end_line, module, signature, docstring, parent, imports, calls, decorators, path || ':' || start_line || '-' || end_line as citation, signature as header, end_line - start_line + 1 as lines,
  md5(concat_ws(chr(10), qualified_name, nullif(signature, ''), nullif(docstring, ''), source)) as retrieval_md5, greatest(1, length(source) // 4) as tokens from chunks"""
_CALLED = """called as (
  select m.chunk_id as src, o.chunk_id as dst, 'self.supply_' || s.nx as call, 'suffix' as outcome from sup s join chunks m on m.name = 'supply_' || s.s join chunks o on o.name = 'supply_' || s.nx
  union all select m.chunk_id, o.chunk_id, 'total', 'import' from sup s join chunks m on m.name = 'supply_' || s.s join mods b on b.k = s.k join chunks o on o.qualified_name = b.imported
  union all select m.chunk_id, o.chunk_id, o.name, 'suffix' from mods b join chunks m on m.qualified_name = b.module || '.total' join chunks o on o.name = 'Store' || b.k
  union all select m.chunk_id, o.chunk_id, 'shop.n0.total', 'exact' from mods b join chunks m on m.qualified_name = b.module || '.total' join chunks o on o.qualified_name = 'shop.n0.total'),
edges as (
  select src, dst, 'calls' as type, call from called where src <> dst
  union all select p.chunk_id, c.chunk_id, 'contains', '' from chunks c join chunks p on p.qualified_name = c.parent),
outcomes as (select call as base, outcome from called union all select 'len', 'external' from sup union all select 'shared', 'ambiguous' from mods where odd)"""
_STATS = """select count(*) as total_call_sites, count(*) filter (outcome = 'external') as external, count(*) filter (outcome = 'exact') as resolved_exact, count(*) filter (outcome = 'import') as resolved_import, count(*) filter (outcome = 'suffix') as resolved_suffix,
  count(*) filter (outcome = 'ambiguous') as ambiguous, count(*) filter (outcome = 'ambiguous') as unresolved, count(*) filter (outcome in ('exact', 'import', 'suffix')) as resolved, count(*) filter (outcome <> 'external') as in_repository from outcomes"""
_INSTANCES = "inst as (select o_orderkey as o, 'i' || o_orderkey as instance_id, o_custkey % 280 + 1 as begins, case when o_orderkey % 4 = 0 then 1 else o_orderkey % 4 end as n, o_orderkey % 3 <> 0 as has_y from orders)"
_HUNKS = f"""{_INSTANCES}, hunks as (
  select instance_id, 'orders/' || o || '.py' as path, begins as lo, begins + n - 1 as hi from inst union all select instance_id, 'orders/' || o || '.py', 400, 402 from inst union all select instance_id, 'y.py', 5, 6 from inst where has_y)"""


def _measures(ks: tuple[int, ...]) -> str:
    """per_query from asked (query_id, type), ranked (query_id, item, rank) and gold (query_id, item)."""
    sums = ", ".join(f"sum(case when rank <= {k} then good else 0 end) as in{k}" for k in ks)
    cells = ", ".join(f"case when n.n > 0 then coalesce(s.in{k}, 0) * 1.0 / n.n else 0.0 end as recall_at_{k}, case when s.in{k} > 0 then 1.0 else 0.0 end as hit_at_{k}, case when s.items > 0 then s.in{k} * 1.0 / least({k}, s.items) else 0.0 end as precision_at_{k}" for k in ks)
    return f"""truth as (select distinct query_id, item from gold), n_gold as (select query_id, count(*) as n from truth group by query_id),
marked as (select r.query_id, r.rank, case when g.item is null then 0 else 1 end as good from ranked r left join truth g on g.query_id = r.query_id and g.item = r.item),
running as (select *, sum(good) over (partition by query_id order by rank) as so_far from marked),
sums as (select query_id, count(*) as items, {sums}, min(case when good = 1 then rank end) as first, sum(case when good = 1 then so_far * 1.0 / rank else 0 end) as ap from running group by query_id),
per_query as (
  select a.query_id, a.type, {cells}, coalesce(1.0 / s.first, 0.0) as rr, case when n.n > 0 then coalesce(s.ap, 0) * 1.0 / n.n else 0.0 end as ap
  from asked a left join sums s on s.query_id = a.query_id left join n_gold n on n.query_id = a.query_id)"""


def _level(level: str) -> str:
    lines = "select 'orders/' || l_orderkey as query_id, l_linenumber as line, case when l_linenumber % 2 = 0 then 'orders/' || l_orderkey else 'other' end as path, l_linenumber * 40 as lo, cast(l_linenumber * 40 + l_quantity as int) as hi, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rank from lineitem"
    first = f"top as (select * from ({lines}) where rank <= 10), asked as (select 'orders/' || o_orderkey as query_id, '' as type, o_custkey % 280 as lo from orders)"
    if level == "file":
        items = "ranked as (select query_id, item, row_number() over (partition by query_id order by first_at, item) as rank from (select query_id, path as item, min(rank) as first_at from top group by all)), gold as (select query_id, query_id as item from asked)"
    else:
        items = "ranked as (select query_id, item, row_number() over (partition by query_id order by first_at, item) as rank from (select query_id, line as item, min(rank) as first_at from top group by all)), gold as (select t.query_id, t.line as item from top t join asked a on a.query_id = t.query_id and t.path = a.query_id where t.lo <= a.lo + 60 and a.lo <= t.hi)"
    return f"with {first}, {items}, {_measures((1, 5))} select query_id, '{level}' as level, " + ", ".join(f"round({c}, 6) as {c}" for c in ("hit_at_1", "hit_at_5", "recall_at_5", "rr")) + " from per_query"


_PASSAGES = "said as (select item_id, 'passage ' || text as text from benchmark), passages as (select 'p' || lpad(cast(item_id + 1 as varchar), 5, '0') as node, 'f' || item_id % 7 as path, text from said union all select 'p00000', 'f-1', '')"
_ARMS = f"""{_PASSAGES}, occ as ({driver_queries.tokens("passages", "node")}), qt as (select item_id as q, t, count(*) as qtf from ({driver_queries.tokens("said", "item_id")}) group by item_id, t),
dls as (select p.node, count(o.t) as dl from passages p left join occ o on o.node = p.node group by p.node), corpus as (select count(*) as n, avg(dl) as avgdl from dls), dfs as (select t, count(distinct node) as df from occ group by t), tfs as (select node, t, count(*) as tf from occ group by node, t),
lexical as (
  select q.q, f.node, round(sum(q.qtf * ln(1 + (c.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * greatest(l.dl, 1) / c.avgdl))), 9) as score
  from qt q join tfs f on f.t = q.t join dfs d on d.t = q.t join dls l on l.node = f.node cross join corpus c group by q.q, f.node),
raw as (select node, f.t, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) as w from tfs f join dfs d on d.t = f.t cross join corpus),
unit as (select node, t, w / sqrt(sum(w * w) over (partition by node)) as w from raw),
cosines as (select item_id as q, b.node, sum(a.w * b.w) as score from benchmark join unit a on a.node = 'p' || lpad(cast(item_id + 1 as varchar), 5, '0') join unit b on b.t = a.t group by item_id, b.node),
arms as (
  select 'bm25' as arm, q, node, score, row_number() over (partition by q order by score desc, node) as rank from lexical
  union all select 'dense', q, node, score, row_number() over (partition by q order by score desc, node) from cosines),
fused as (select *, row_number() over (partition by q order by score desc, node) as rank from (select q, node, sum(1.0 / (60 + rank)) as score, string_agg(arm, ',' order by arm) as sources from arms where rank <= 5 group by q, node)),
hops as (select node as src, 'p' || lpad(cast(cast(substr(node, 2) as int) + 1 as varchar), 5, '0') as dst from passages where text <> ''),
near as (select src as node, 0 as rel, dst as other from hops where dst in (select node from passages) union select dst, 1, src from hops where dst in (select node from passages)),
costs as (select node, greatest(1, length(text) // 4) as cost from passages),
seeds as (select q, node, score, rank from fused where rank <= 4)"""
_ITEMS = f"""{_ARMS}, top as (select cast(a.q as varchar) as query_id, a.node, p.path, a.rank from arms a join passages p on p.node = a.node where arm = 'bm25' and rank <= 6),
asked as (select cast(item_id as varchar) as query_id, case when item_id % 2 = 0 then 'even' else 'odd' end as type from benchmark)"""


def _items(level: str) -> str:
    if level == "file":
        chosen = "ranked as (select query_id, item, row_number() over (partition by query_id order by first_at, item) as rank from (select query_id, path as item, min(rank) as first_at from top group by all)), gold as (select cast(item_id as varchar) as query_id, 'f' || item_id % 7 as item from benchmark)"
    else:
        chosen = "ranked as (select query_id, node as item, rank from top), gold as (select cast(item_id as varchar) as query_id, unnest(['p' || lpad(cast(item_id + 1 as varchar), 5, '0'), 'p00003']) as item from benchmark)"
    return f"with {_ITEMS}, {chosen}, {_measures((1, 3, 5, 10))}"


def _both_levels(columns: str, group: str = "") -> str:
    return " union all ".join(f"select * from ({_items(level)} select 'bm25' as mode, '{level}' as level, {columns} from per_query {group})" for level in ("file", "symbol"))


_WALK = driver_queries.walk(400)
_TOP20 = driver_queries.ORACLE_SQL["bm25_topk_batch"]

ORACLE_SQL: dict[str, str] = {
    "code_chunks": f"with {_CHUNKS} select {_FLAT}",
    "source_scan": f"""with {_SUPPLIERS} select path, module, md5(concat('import os', chr(10), 'from .n', (k + 1) % 25, ' import total as total', chr(10), chr(10), 'class Store', k, ':', chr(10), '    \"\"\"Suppliers of nation ', k, '.\"\"\"', methods, chr(10),
  chr(10), 'def total():', chr(10), '    return Store', k, '() + shop.n0.total()', case when odd then ' + shared()' || chr(10) else chr(10) || chr(10) || 'def shared():' || chr(10) || '    return 1' || chr(10) end)) as text_md5 from mods
  union all select 'src/shop/broken.py', 'shop.broken', md5('def broken(:' || chr(10))""",
    "chunk_round_trip": f"with {_CHUNKS} select 'parquet' as form, {_FLAT} union all select 'jsonl', {_FLAT}",
    "chunk_manifest": f"with {_CHUNKS}, kinds as (select kind, count(*) as n from chunks group by kind) select count(*) as chunks, count(distinct path) as files, (select string_agg(kind || '=' || n, ',' order by kind) from kinds) as kinds from chunks",
    "import_aliases": f"with {_SUPPLIERS} select path, 'os' as alias, 'os' as target from mods union all select path, 'total', imported from mods",
    "code_edges": f"with {_CHUNKS}, {_CALLED} select src, dst, type, call from edges",
    "module_edges": f"with {_SUPPLIERS} select module as src, 'os' as dst, 'os' as via from mods union all select module, imported, 'shop' from mods",
    "call_outcomes": f"with {_CHUNKS}, {_CALLED} select base, outcome, count(*) as n from outcomes group by base, outcome",
    "resolution_stats": f"with {_CHUNKS}, {_CALLED} select *, round(resolved * 1.0 / in_repository, 6) as resolution_rate from ({_STATS})",
    "graph_summary": f"""with {_CHUNKS}, {_CALLED}, stats as ({_STATS}), ends as (select module as m from mods union select imported from mods union select 'os')
select (select count(*) from chunks) as nodes, (select count(*) from edges where type = 'calls') as call_edges, (select count(*) from edges where type = 'contains') as contains_edges, (select count(*) from ends) as modules, (select 2 * count(*) from mods) as module_edges, total_call_sites, resolved, external from stats""",
    "chunk_lookups": f"with {_CHUNKS} select distinct 'files' as how, path as what from chunks union all select 'in_file', qualified_name from chunks where path = 'src/shop/n1.py' union all select 'by_id', 'shop.n3.Store3'",
    "identifier_parts": r"""
with w as (select p_partkey, lower(p_type) as low, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as cap from part),
forms as (select p_partkey, 0 as form, replace(cap, ' ', '') as name from w union all select p_partkey, 1, replace(low, ' ', '_') from w union all select p_partkey, 2, 'HTTP' || replace(cap, ' ', '') from w union all select p_partkey, 3, '_' || replace(cap, ' ', '_') from w),
cut as (select *, list_concat([lower(name)], string_split(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '_')) as parts from forms)
select p_partkey, form, name, array_to_string(list_filter(parts, lambda x, i: x <> '' and list_position(parts, x) = i), ' ') as parts from cut""",
    "request_hashes": """
select n_nationkey, sha256('{"messages":[{"content":"' || n_name || '","role":"user"}],"model":"m","params":{"temperature":0.0}}') as prompt_hash, n_nationkey as k, least(n_nationkey, 5) as kept, greatest(n_nationkey - 5, 0) as left_out, case when n_nationkey > 6 then 604 else 100 * n_nationkey end as letters from nation""",
    "patch_hunks": f"with {_HUNKS} select * from hunks",
    "patched_files": f"with {_HUNKS} select instance_id as query_id, string_agg(distinct path, '|' order by path) as files from hunks group by instance_id",
    "checkout_readiness": f"""with {_INSTANCES}, both_ as (select instance_id, o in (select l_orderkey from lineitem where l_returnflag = 'R') as there from inst)
select count(*) filter (there) as ready, count(*) filter (not there) as missing, (select string_agg(instance_id, ',' order by instance_id) from (select instance_id from both_ where not there order by instance_id limit 20)) as first_missing from both_""",
    "diff_localisation": f"select * from ({_level('file')}) union all select * from ({_level('symbol')})",
    "index_bm25": _TOP20,
    "tfidf_weights": f"""with occ as ({driver_queries.tokens("documents", "doc_id")}), tfs as (select doc_id, t, count(*) as tf from occ group by doc_id, t), dfs as (select t, count(*) as df from tfs group by t),
raw as (select doc_id, f.t, (1 + ln(tf)) * (ln((1.0 + (select count(*) from documents)) / (1 + df)) + 1) as w from tfs f join dfs d on d.t = f.t)
select doc_id, t as term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from raw""",
    "dense_search": f"with {_ARMS} select q as query_id, node as doc_id, round(score, 4) as score, rank, 'tfidf-svd(' || (select count(*) from benchmark) || ')' as encoder, 'exact' as store from arms where arm = 'dense' and rank <= 5",
    "hybrid_search": f"with {_ARMS} select q as query_id, node as doc_id, round(score, 8) as score, rank, sources from fused where rank <= 8",
    "graph_search": f"""with {_ARMS}, {_WALK}, ranked as (select w.*, coalesce(f.sources, 'graph') as sources, row_number() over (partition by w.q order by w.score desc, w.hops, w.node) as rank from walk w left join fused f on f.q = w.q and f.node = w.node where w.admitted)
select q as query_id, node as doc_id, round(score, 8) as score, hops, via as reached_via, sources, rank from ranked where rank <= 10""",
    "graph_trace": f"""with {_ARMS}, {_WALK} select q as query_id, count(*) filter (admitted and hops = 0) as seeds, count(*) filter (admitted) as admitted, count(*) filter (admitted and hops > 0) as expanded, max(hops) filter (admitted) as max_hops_reached,
  cast(sum(cost) filter (admitted) as bigint) as tokens_used, 400 as token_budget, bool_or(not admitted) as stopped_on_budget, not bool_or(not admitted) as frontier_exhausted from walk group by q""",
    "search_modes": "select unnest(['bm25', 'dense', 'hybrid', 'hybrid+graph']) as mode, item_id as query_id, 'p' || lpad(cast(item_id + 1 as varchar), 5, '0') as doc_id from benchmark",
    "retrieval_evaluation": _both_levels("coalesce(type, 'all') as type, count(*) as questions, " + ", ".join(f"round(round(avg({c}), 4), 3) as {c}" for c in ("recall_at_1", "recall_at_5", "hit_at_1", "precision_at_5", "rr", "ap")), "group by rollup(type)"),
    "retrieval_by_question": _both_levels("query_id, " + ", ".join(f"round({c}, 6) as {c}" for c in ("recall_at_5", "hit_at_1", "rr"))),
    "tool_results": f"""with {_CHUNKS}, {_CALLED}
select 'tools' as tool, 'search_code,expand_context,read_chunk,find_callers,find_callees,list_symbols,grep_repo' as item
union all select 'list_symbols', qualified_name from chunks where path = 'src/shop/n2.py'
union all select distinct 'find_callers', c.qualified_name from edges e join chunks c on c.chunk_id = e.src join chunks t on t.chunk_id = e.dst where e.type = 'calls' and t.qualified_name = 'shop.n0.total'
union all select distinct 'find_callees', c.qualified_name from edges e join chunks c on c.chunk_id = e.dst join chunks t on t.chunk_id = e.src where e.type = 'calls' and t.qualified_name = 'shop.n1.total'
union all select 'read_chunk', path || ':' || start_line || '-' || end_line from chunks where name = 'Store5'
union all (select 'grep_repo', path || ':' || start_line from chunks where name = 'shared' order by path limit 5)
union all select 'failed', unnest(['no_such_tool', 'read_chunk', 'list_symbols'])""",
    "agent_answers": """
select * from (values (0, 'search_code,expand_context,read_chunk,find_callers,final_answer', 'final_answer', true, 1.0, 'broken', 0), (1, 'search_code,read_chunk,final_answer', 'final_answer', true, 1.0, 'broken', 0), (2, 'search_code,read_chunk,final_answer', 'final_answer', true, 1.0, 'broken', 3)) as t(n, tools, stopped, supported, validity, failed_over, cached)""",
}
