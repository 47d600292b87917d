"""Chunking, tokens, index, graph, expansion, lookups, metrics and the agent on small inputs."""

import random
import tracemalloc
from collections import deque
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citegraph.functions import text as T
from citegraph.operators import fusion, graph, lexical, lookup, metrics, vectors
from citegraph.plans import evaluate
from citegraph.plans.agent import Answerer, CachedModel, Failover, OfflinePolicy, Provider, ResponseCache, ToolBox
from citegraph.plans.index import Index, build_indexes
from citegraph.sources import files

CORPUS = str(Path(__file__).parent / "corpus")


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark, CORPUS, dimension=8)


def test_identifiers_and_tokens(spark):
    split = lambda s: value(spark, T.split_identifier(F.col("s")), s=s)
    assert split("parseConfigFile") == ["parseconfigfile", "parse", "config", "file"]
    assert split("parse_config_file") == ["parse_config_file", "parse", "config", "file"]
    assert split("HTTPServerHandler") == ["httpserverhandler", "http", "server", "handler"]
    assert split("__init__") == ["__init__", "init"]
    tokens = lambda s: value(spark, T.tokenize(F.col("s")), s=s)
    assert tokens("how does the parser handle a config file?") == ["parser", "handle", "config", "file"]
    assert tokens("def f(self): return 9abc + é_x") == ["abc", "_x"]
    assert tokens("") == []


def test_expressions(spark):
    resolve = lambda t, m: value(spark, T.resolve_relative(F.col("t"), F.col("m")), t=t, m=m)
    assert resolve(".models", "a.b.c") == "a.b.models"
    assert resolve("..index", "a.b.c") == "a.index"
    assert resolve("os.path", "a.b.c") == "os.path"
    assert value(spark, T.estimate_tokens(F.col("s")), s="abc") == 1
    assert value(spark, T.l2_normalise(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert value(spark, T.l2_normalise(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert T.extract_json('say {"a": {"b": 1}} now') == {"a": {"b": 1}}
    assert T.extract_json('```json\n{"tool": "x"}\n``` {"tool": "y"}') == {"tool": "x"}
    assert T.extract_json("{broken {\"k\": 2}") == {"k": 2}
    assert T.extract_json("none") is None
    hashes = {T.prompt_hash(m, [{"role": "user", "content": c}], temperature=t) for m in "ab" for c in "xy" for t in (0, 1)}
    assert len(hashes) == 8
    assert T.condense({"a": list(range(9)), "b": "x" * 700}) == {"a": [0, 1, 2, 3, 4], "a_truncated": 4, "b": "x" * 600 + " ..."}


def test_chunks(index):
    rows = {r.qualified_name: r for r in index.chunks.collect()}
    assert {p.path for p in rows.values()} == {"src/shop/store.py", "src/shop/pricing.py", "src/shop/crlf.py"}
    store, total = rows["shop.store.Store"], rows["shop.store.Store.total"]
    assert (store.kind, total.kind, rows["shop.store.load"].kind) == ("class", "method", "function")
    assert rows["shop.store.Store.reload.inner"].kind == "method"
    assert total.decorators == ["@functools.lru_cache"] and total.source.startswith("    @functools")
    assert total.docstring == "Sum of all prices." and total.signature == "def total(self)"
    assert total.parent == "shop.store.Store" and total.calls == ["sum", "cost", "self.count"]
    assert rows["shop.store.Store.reload"].calls == ["loader"]
    assert "from .pricing import price_of as cost, tax" in total.imports
    assert rows["shop.crlf.windows"].source == 'def windows():\n    return "caf�"'
    assert index.manifest["chunks"] == len(rows)


def test_graph(index):
    name = {r.chunk_id: r.qualified_name for r in index.chunks.collect()}
    calls = {(name[e.src], name[e.dst], e.type) for e in index.graph.edges.collect()}
    # An alias that no definition has is external, whatever it was imported from.
    assert ("shop.store.Store.total", "shop.pricing.price_of", "calls") not in calls
    assert ("shop.store.Store.total", "shop.store.Store.count", "calls") in calls
    assert ("shop.store.Store.reload.inner", "shop.pricing.tax", "calls") in calls
    assert ("shop.store.load", "shop.pricing.read", "calls") in calls
    assert ("shop.store.parseConfigFile", "shop.store.load", "calls") in calls
    assert ("shop.pricing.read", "shop.pricing.load", "calls") in calls
    assert ("shop.store.Store", "shop.store.Store.count", "contains") in calls
    s = graph.resolution_stats(index.graph.call_sites).first()
    assert s.total_call_sites == s.external + s.resolved + s.unresolved and s.resolution_rate > 0.8
    ids = {q: c for c, q in name.items()}
    assert {name[r.node] for r in graph.callers(index.graph.edges, ids["shop.pricing.price_of"]).collect()} == {"shop.pricing.tax"}
    assert {name[r.node] for r in graph.siblings(index.graph.edges, ids["shop.store.Store.count"]).collect()} == {"shop.store.Store.__init__", "shop.store.Store.total", "shop.store.Store.reload"}
    assert graph.callees(index.graph.edges, "nothing").collect() == []


def walk(seeds, near, cost, budget, hops, cap):
    """One query's walk with a queue."""
    out, used, queue, stopped = {}, 0, deque(), False
    for node, score in seeds:
        if node not in cost or node in out:
            continue
        if out and used + cost[node] > budget:
            stopped = True
            break
        out[node] = (score, 0)
        used += cost[node]
        queue.append(node)
    while queue and not stopped:
        node = queue.popleft()
        score, hop = out[node]
        if hop >= hops:
            continue
        for other in near.get(node, [])[:cap]:
            if other in out or other not in cost:
                continue
            if used + cost[other] > budget:
                stopped = True
                break
            out[other] = (score * 0.5 ** (hop + 1), hop + 1)
            used += cost[other]
            queue.append(other)
        if stopped:
            break
    return out


def test_expansion_equals_a_queue(spark):
    rng = random.Random(3)
    edge_rows, seed_rows, cost_rows, want = set(), [], {}, {}
    for q in range(25):
        nodes = [f"{q:02d}-{i:02d}" for i in range(14)]
        edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)}
        edges = {(a, b) for a, b in edges if a != b}
        cost = {n: rng.randint(1, 9) for n in nodes if rng.random() < 0.9}
        seeds = [(n, 1.0 / (i + 1)) for i, n in enumerate(rng.sample(nodes, 3))]
        near = {n: sorted(b for a, b in edges if a == n) + sorted(a for a, b in edges if b == n) for n in nodes}
        want |= {(q, n): s for n, s in walk(seeds, near, cost, 30, 2, 4).items()}
        edge_rows |= edges
        cost_rows |= cost
        seed_rows += [(q, n, s, i + 1) for i, (n, s) in enumerate(seeds)]
    edges = spark.createDataFrame([(a, b, "calls", None, None) for a, b in sorted(edge_rows)], graph.EDGE)
    found = graph.expand(spark.createDataFrame(seed_rows, "query_id int, chunk_id string, score double, rank int"), edges, spark.createDataFrame(list(cost_rows.items()), "chunk_id string, cost int"), 30, 2, cap=4).persist()
    got = {(r.query_id, r.chunk_id): (r.score, r.hops) for r in found.filter("admitted").collect()}
    assert got == want
    trace = {r.query_id: r for r in graph.expansion_trace(found).collect()}
    assert all(trace[q].tokens_used == sum(cost_rows[n] for p, n in want if p == q) for q in trace)


def test_fusion(spark):
    df = lambda rows: spark.createDataFrame([(0, d, s, i + 1) for i, (d, s) in enumerate(rows)], "query_id int, doc_id string, score double, rank int")
    rows = fusion.fuse({"bm25": df([("a", 99.0), ("b", 98.0)]), "dense": df([("b", 0.9), ("c", 0.8)])}).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["b", "a", "c"]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61) and rows[0].ranks == {"bm25": 2, "dense": 1} and rows[0].raw_scores == {"bm25": 98.0, "dense": 0.9}


def test_lexical_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha alpha gamma")], "doc_id long, text string")
    index = lexical.build(docs)
    assert len(index) == 3 and index.corpus_stats.first().avgdl == pytest.approx(5 / 3)
    queries = spark.createDataFrame([(0, "alpha"), (1, "nothing"), (2, "gamma gamma")], "query_id long, text string")
    got = [(r.query_id, r.doc_id) for r in lexical.search(index, queries).orderBy("query_id", "rank").collect()]
    assert got == [(0, 3), (0, 1), (2, 3)]
    scan = {(r.query_id, r.doc_id): r.score for r in lexical.scan_search(docs, queries).collect()}
    assert scan == {(r.query_id, r.doc_id): pytest.approx(r.score) for r in lexical.search(index, queries).collect()}


def test_index_cuts_texts_once(spark, tmp_path):
    cut = spark.sparkContext.accumulator(0)
    same = F.udf(lambda s: (cut.add(1), s)[1])
    texts = ["alpha beta beta", None, "", "the of", "zeta alpha alpha zeta beta", "parseFile parseFile"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = lexical.build(docs.select("doc_id", same("text").alias("text")))
    index.save(str(tmp_path))
    assert cut.value == len(texts)
    stored = lexical.LexicalIndex.load(spark, str(tmp_path))
    got = {(r.term, r.doc_id): r.tf for r in stored.postings.collect()}
    assert got == {("alpha", 0): 1, ("beta", 0): 2, ("alpha", 4): 2, ("beta", 4): 1, ("zeta", 4): 2, ("parsefile", 5): 2, ("parse", 5): 2, ("file", 5): 2}
    assert {r.term: r.df for r in stored.term_stats.collect()} == {"alpha": 2, "beta": 2, "zeta": 1, "parsefile": 1, "parse": 1, "file": 1}
    # Rows of one document are one document's terms.
    twice = lexical.build(spark.createDataFrame([(1, "alpha beta"), (1, "alpha")], "doc_id long, text string"))
    assert {(r.term, r.doc_id, r.tf) for r in twice.postings.collect()} == {("alpha", 1, 2), ("beta", 1, 1)}


def test_term_weights_shuffle_texts_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    encoder = vectors.TfidfSvdEncoder()
    encoder.idf = encoder.term_weights(docs)
    found = encoder.weights(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 1
    rows = {(r.doc_id, r.term): r.weight for r in found.collect()}
    assert sorted(rows) == [(1, "alpha"), (1, "beta"), (2, "alpha"), (2, "beta"), (2, "gamma")]
    for doc in (1, 2):
        assert sum(w * w for (d, _), w in rows.items() if d == doc) == pytest.approx(1.0)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.6])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, embedding array<float>")
    assert [r.doc_id for r in vectors.exact_top_k(v, q, 2).orderBy("rank").collect()] == [1, 3]
    assert vectors.exact_top_k(v.limit(0), q, 2).collect() == [] and vectors.exact_top_k(v, q.limit(0), 2).collect() == []
    with pytest.raises(Exception, match="dimension"):
        vectors.check_dimension(v, 3).collect()
    with pytest.raises(ValueError, match="unknown"):
        vectors.build_encoder("other")
    with pytest.raises(RuntimeError):
        vectors.TfidfSvdEncoder().encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"))


def test_citations_and_lookups(spark, index):
    good = index.chunks.filter("name = 'total'").first()
    raw = ["src/shop/nope.py:1-2", "garbage", "src/shop/store.py:99999-100000", f"`src/shop/store.py:{good.start_line}-{good.end_line}`", "src/shop/store.py:1-9999", f"src/shop/store.py:{good.start_line}"]
    rows = {r.raw: r for r in lookup.verify_citations(spark.createDataFrame([(x,) for x in raw], "raw string"), index.chunks).collect()}
    assert [rows[x].valid for x in raw] == [False, False, False, True, False, True]
    assert rows[raw[0]].reason == "path not in index" and rows[raw[1]].reason.startswith("malformed") and "beyond" in rows[raw[2]].reason and "one chunk" in rows[raw[4]].reason
    assert {r.name for r in lookup.by_name(index.chunks, "STORE.total").collect()} == {"total"}
    found = lookup.grep(index.chunks, "price_of\\(", 5).collect()
    assert found and all("price_of(" in r.text for r in found)
    assert lookup.grep(index.chunks, "len(", 5).count() > 0


def test_patches(spark, tmp_path):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -10,3 +10,4 @@ def f():\n+a\n@@ -50 +60 @@\n+b\n--- a/gone.py\n+++ /dev/null\n@@ -1,4 +0,0 @@\n--- a/y.py\n+++ b/y.py\n@@ -5,1 +5,2 @@\n"
    rows = spark.createDataFrame([("i", "r", "c", "p", patch)], files.INSTANCE)
    assert sorted((r.path, r.lo, r.hi) for r in files.patch_hunks(rows).collect()) == [("x.py", 10, 13), ("x.py", 60, 60), ("y.py", 5, 6)]
    ready = files.readiness(rows, spark.createDataFrame([("j",)], "instance_id string")).first()
    assert (ready.ready, ready.missing, ready.first_missing) == (0, 1, ["i"])
    none, why = files.read_instances(spark, str(tmp_path / "absent.jsonl"))
    assert none.count() == 0 and "absent" in why


def test_metrics(spark):
    q = spark.createDataFrame([("q", "t"), ("empty", "t")], "query_id string, type string")
    r = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "a", 3)], "query_id string, item string, rank int")
    g = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, item string")
    rows = {x.query_id: x for x in metrics.per_query(q, r, g).collect()}
    assert rows["q"].rr == pytest.approx(1 / 3) and rows["q"].recall_at_3 == 0.5 and rows["q"].ap == pytest.approx(1 / 6) and rows["q"].precision_at_5 == pytest.approx(1 / 3)
    assert rows["empty"].rr == 0 and rows["empty"].precision_at_1 == 0
    ranked = spark.createDataFrame([("i", "c1", "x.py", 1, 9, 1), ("i", "c2", "x.py", 20, 30, 2)], "query_id string, chunk_id string, path string, start_line int, end_line int, rank int")
    by_file, by_symbol = metrics.localisation(ranked, spark.createDataFrame([("i", "x.py", 25, 26)], "query_id string, path string, lo int, hi int"))
    assert by_file.first().rr == 1.0 and by_symbol.first().rr == 0.5


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert again.search("parse config file", "bm25", 3) == index.search("parse config file", "bm25", 3)
    assert again.manifest["chunks"] == index.manifest["chunks"]


def test_search_and_evaluation(spark, index):
    assert index.search("parse config file")[0]["qualified_name"] == "shop.store.parseConfigFile"
    rows, trace = index.search_with_expansion("parseConfigFile", 10)
    assert trace["admitted"] >= len(rows) > 0
    with pytest.raises(ValueError, match="mode"):
        index.search("x", "other")
    questions = files.read_questions(spark, str(Path(__file__).parent / "questions.yaml"), "shop")
    table = {(r["mode"], r.level, r.type): r for r in evaluate.retrieval(questions, index, ("bm25",)).collect()}
    assert table["bm25", "file", None].questions == 2 and table["bm25", "file", "lookup"].hit_at_1 == 1.0
    assert build_indexes(spark, {"none": "no/such/root"}) == {}


def test_report_and_diffs(spark, index, tmp_path):
    out = evaluate.report(spark, str(Path(__file__).parent / "questions.yaml"), str(Path(__file__).parent.parent), 5, with_agent=False)
    assert out["questions"] == 2 and out["invalid_gold"] == [] and len(out["per_question"]["shop"]) == 16
    hunk = index.chunks.filter("name = 'parseConfigFile'").first()
    patch = f"--- a/{hunk.path}\n+++ b/{hunk.path}\n@@ -1 +{hunk.start_line},2 @@\n"
    rows = spark.createDataFrame([("i", "r", "c", "parse config file", patch), ("j", "r", "c", "p", patch)], files.INSTANCE)
    found = evaluate.diffs(rows, {"i": index}, "bm25", 5)
    assert (found["instances_scored"], found["instances_skipped"], found["skipped_ids"]) == (1, 1, ["j"])
    assert found["function_level"]["hit_at_1"] == 1.0 and found["file_level"]["questions"] == 1
    files.write_report(out, str(tmp_path / "report.json"))
    assert "per_question" in (tmp_path / "report.json").read_text()


def test_failover(tmp_path, monkeypatch):
    monkeypatch.delenv("ABSENT_KEY", raising=False)
    cache = ResponseCache(str(tmp_path / "f.db"))
    with pytest.raises(RuntimeError, match="key"):
        Failover([Provider("a", OfflinePolicy(), "ABSENT_KEY")], cache).complete([])
    with pytest.raises(RuntimeError, match="failed"):
        Failover([Provider("b", None)], cache).complete([])
    monkeypatch.setenv("ABSENT_KEY", "1")
    model = Failover([Provider("b", None), Provider("a", OfflinePolicy(), "ABSENT_KEY")], cache)
    said = [model.complete([{"content": "{}"}]) for _ in range(2)]
    assert [s.cached for s in said] == [False, True] and model.stats()["failures"] == 2 and said[0].model == "a"


def test_dense_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "doc_id long, embedding array<double>")
    asked = rows.withColumnRenamed("doc_id", "query_id")
    whole = sorted(vectors.exact_top_k(rows, asked, 3).collect())
    monkeypatch.setattr(vectors, "QUERY_CELLS", 12)
    assert sorted(vectors.exact_top_k(rows, asked, 3).collect()) == whole and len(whole) == 120


def test_top_k_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    own, asked = rng.normal(size=(10_000, 16)), rng.normal(size=(2_000, 16))
    own[5000:5040], own[7], own[9, 0] = own[1], np.nan, np.inf
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)), pa.int64()), pa.array(list(own), pa.list_(pa.float64()))], ["doc_id", "embedding"])
    tracemalloc.start()
    out = pa.Table.from_batches(vectors._scorer(np.arange(len(asked)) * 3, asked, 5, pa.int64())(iter([batch]))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 100  # 2,000 x 10,000 scores are 160 MB
    got = list(zip(*out.values(), strict=True))
    assert len(got) == 10_000
    for q in (0, 511, 512, 1999):
        score = [sum(a * b for a, b in zip(asked[q].tolist(), v, strict=True)) for v in own.tolist()]
        order = sorted(range(len(own)), key=lambda i: (score[i] == score[i], -score[i] if score[i] == score[i] else 0, i))[:5]
        assert [d for x, d, _ in got if x == 3 * q] == order
    # Copies of one vector tie wherever a tile has them.
    monkeypatch.setattr(vectors, "TILE_VECTORS", 3)
    run = vectors._scorer(np.array([1]), own[1:2], 6, pa.int64())
    assert pa.Table.from_batches(run(iter([batch.slice(0, 7), batch.slice(4990, 60)])))["doc_id"].to_pylist() == [1, 5000, 5001, 5002, 5003, 5004]


def test_distributed_fit_keeps_its_rows(spark, monkeypatch):
    from pyspark.mllib.linalg.distributed import RowMatrix

    kept, compute = [], RowMatrix.computeSVD
    monkeypatch.setattr(RowMatrix, "computeSVD", lambda self, *a, **b: (kept.append(self._java_matrix_wrapper._java_model.rows().getStorageLevel().useMemory()), compute(self, *a, **b))[1])
    words = ["red", "green", "blue", "grey", "pink"]
    rows = [(i, " ".join(w for j, w in enumerate(words) for _ in range((i * (j + 3)) % (j + 2)))) for i in range(4100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoder = vectors.TfidfSvdEncoder(3).fit(docs)
    assert kept == [True]  # Lanczos reads them dozens of times
    dense = np.zeros((4100, 5))
    for r in encoder.weights(docs).collect():
        dense[r.doc_id, r.idx] = r.weight
    right = np.linalg.svd(dense, full_matrices=False)[2][:3]
    got = np.array([r.component for r in encoder.components.orderBy("idx").collect()])
    assert np.abs(got @ got.T - right.T @ right).max() < 1e-6


def test_agent(index, tmp_path):
    tools = ToolBox(index)
    assert len(tools.names()) == 7 and not tools.call("no_such_tool").ok and "bad arguments" in tools.call("read_chunk", {"x": 1}).error
    assert tools.call("list_symbols", {"path": "pricing"}).payload["path"] == "src/shop/pricing.py"
    assert tools.call("grep_repo", {"pattern": "lru_cache"}).payload["matches"]
    cache = ResponseCache(str(tmp_path / "c.db"))
    answer = Answerer(index, CachedModel(OfflinePolicy(), cache, "offline")).answer("what calls price_of?")
    assert answer.stopped == "final_answer" and answer.supported and answer.validity == 1.0
    assert answer.tools_used == ["search_code", "expand_context", "read_chunk", "find_callers", "final_answer"]
    assert cache.stats()["entries"] == 5
    cache.put("k", "m", {}, {"text": "t"})
    assert cache.get("k") == {"text": "t"} and cache.stats()["hits"] == 1
    cache.clear()
    assert cache.stats() == {"entries": 0, "hits": 0}
    cache.close()
