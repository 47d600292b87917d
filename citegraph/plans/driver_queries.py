"""The library's operators on the driver tables, whole, with DuckDB SQL that gives the same rows.

The tables hold no source code, so other entities take its roles: documents are
what is indexed, benchmark passages the queries; suppliers and parts are the
nodes of a graph; an order's lines are the spans of a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions import text as T
from citegraph.operators import fusion, graph, lexical, lookup, metrics, vectors


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bm25_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """BM25 top 20 of documents for every benchmark passage."""
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.scan_search(_t(spark, d, "documents").select("doc_id", "text"), queries, 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    """df and idf of every term of documents."""
    index = lexical.build(_t(spark, d, "documents").select("doc_id", "text"))
    return index.term_stats.crossJoin(F.broadcast(index.corpus_stats)).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.tokenize(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("dl"), F.size(F.array_distinct(tokens)).cast("long").alias("terms"), T.estimate_tokens(F.col("text")).cast("long").alias("token_estimate"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build(_t(spark, d, "documents").select("doc_id", "text")).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of all embeddings for each whose id is divisible by 50."""
    e = _t(spark, d, "embeddings")
    out = vectors.exact_top_k(e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return out.select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    unit = T.l2_normalise(F.col("embedding"))
    return e.select("vec_id", F.round(T.inner_product(unit, unit), 6).alias("unit"), F.round(F.get(unit, F.lit(0)), 6).alias("first"))


def _arms(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two ranked lists of customers in every market segment: by balance and by the sum of their orders."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("query_id"), F.col("c_acctbal").alias("score"))
    spent = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("score"))
    return {"balance": lexical.ranked_top(c, 30), "orders": lexical.ranked_top(c.drop("score").join(spent, "doc_id"), 30)}


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(_arms(spark, d), weights={"balance": 2.0}, top_k=25)
    return fused.select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank", F.array_join(fusion.sources(F.col("ranks")), ",").alias("sources"), fusion.found_by_both(F.col("ranks")).alias("both"))


def find_by_name(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("qualified_name"))
    return lookup.by_name(p, "steel").unionByName(lookup.by_name(p, "BRAND#11")).select("chunk_id", "name", "qualified_name")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Every line of an order as a span of the order's file."""
    start = F.col("l_linenumber") * 40
    return _t(spark, d, "lineitem").select(F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("path"), start.cast("int").alias("start_line"), (start + F.col("l_quantity")).cast("int").alias("end_line"), F.col("l_partkey").alias("part"))


def verify_citations(spark: SparkSession, d: str) -> DataFrame:
    """A citation into the file of every order, and of one that there is not."""
    o = _t(spark, d, "orders")
    start = (F.col("o_custkey") % 300).cast("string")
    raw = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("no such "), start)).when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("nowhere/"), F.col("o_orderkey").cast("string"), F.lit(":"), start)).otherwise(F.concat(F.lit("`orders/"), F.col("o_orderkey").cast("string"), F.lit(":"), start, F.lit("-"), (F.col("o_custkey") % 300 + 3).cast("string"), F.lit("`")))
    return lookup.verify_citations(o.select("o_orderkey", raw.alias("raw")), _spans(spark, d)).select("o_orderkey", "path", "start", "end", "valid", "reason")


def citation_stats(spark: SparkSession, d: str) -> DataFrame:
    checked = verify_citations(spark, d).join(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("answer_id")), "o_orderkey")
    row = metrics.citation_stats(_t(spark, d, "customer").select(F.col("c_custkey").alias("answer_id")), checked.select("answer_id", "valid", "reason"))
    return row.select("answers", "citations", "valid_citations", *[F.round(c, 6).alias(c) for c in ("supported_rate", "all_valid_rate", "validity_rate")], F.size("failure_reasons").cast("long").alias("reasons"))


def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 lines with a version or licence in documents."""
    chunks = _t(spark, d, "documents").select(F.format_string("%08d", "doc_id").alias("path"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(1).alias("start_line"), F.col("text").alias("source"))
    return lookup.grep(chunks, "[Ll]icen[sc]e|[Vv]ersion [0-9]", 20).select("path", F.col("line").cast("long").alias("line"), "text")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers call the parts they supply; nations contain suppliers."""
    li = _t(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("type"))
    s = _t(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"), F.lit("contains").alias("type"))
    return li.unionByName(s)


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d)).select("node", "n_callees", "n_callers", "degree")


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), "s1", include_siblings=True)


def graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Two hops from the three suppliers of the greatest balance in every nation, within a budget."""
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc_id"), F.col("s_acctbal").alias("score"))
    seeds = lexical.ranked_top(s, 3).withColumnRenamed("doc_id", "chunk_id")
    e = _edges(spark, d)
    nodes = e.select(F.col("src").alias("chunk_id")).union(e.select("dst")).distinct()
    costs = nodes.select("chunk_id", (F.length("chunk_id") * 10 + F.ascii(F.substring("chunk_id", -1, 1)) % 7).alias("cost"))
    found = graph.expand(seeds, e, costs, token_budget=900, max_hops=2)
    return found.filter("admitted").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "hops", "reached_via", "from_chunk", F.col("ord").cast("long").alias("ord"))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers ask; their orders by price are the list; urgent orders are gold."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), "o_orderpriority")
    gold = o.filter("o_orderpriority = '1-URGENT'").select("query_id", F.col("doc_id").alias("item"))
    queries = _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("type"))
    return queries, lexical.ranked_top(o, 10).select("query_id", F.col("doc_id").alias("item"), "rank"), gold


def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.per_query(*_ranked(spark, d), ks=(1, 5))
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "hit_at_1", "precision_at_1", "recall_at_5", "hit_at_5", "precision_at_5", "rr", "ap")])


def metric_means(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.means(metrics.per_query(*_ranked(spark, d), ks=(5,)), "type", None)
    return rows.select(F.coalesce("type", F.lit("all")).alias("type"), "questions", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "hit_at_5", "precision_at_5", "rr", "ap")])


def invalid_gold(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines whose part is not among the first half's, as gold that no chunk has."""
    gold = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("gold_files"))
    q = gold.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("r").alias("repo"), "gold_files", F.array().cast("array<string>").alias("gold_symbols"))
    c = _t(spark, d, "part").filter("p_size > 3").select(F.lit("r").alias("repo"), F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("qualified_name"))
    return metrics.invalid_gold(q, c)


def localisation_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Spans of orders that a hunk of their order's file overlaps."""
    s = _spans(spark, d).withColumn("query_id", F.col("path"))
    at = (F.col("o_custkey") % 280).cast("int")
    h = _t(spark, d, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), at.alias("lo"), (at + 9).alias("hi")).withColumn("query_id", F.col("path"))
    return metrics.overlapping(s, h).select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "part")


def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids and citations of order lines."""
    s = _spans(spark, d)
    return s.select("path", F.col("start_line").cast("long").alias("start_line"), T.chunk_id(F.col("path"), F.col("part").cast("string"), F.col("start_line")).alias("chunk_id"), T.citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_topk_batch, term_stats, document_lengths, corpus_stats, vector_topk, vector_norms, rrf_fusion, find_by_name, verify_citations, citation_stats, grep_lines, graph_degrees,
        graph_neighbours, graph_expansion, metrics_per_query, metric_means, invalid_gold, localisation_overlap, chunk_identity,
    )
}

_STOP = ", ".join(f"'{w}'" for w in sorted({*T.ENGLISH, *T.PYTHON}))


def tokens(table: str, key: str) -> str:
    """(key, t) for every token occurrence."""
    names = f"select {key}, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as i from {table}"
    cut = r"regexp_replace(regexp_replace(i, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')"
    parts = f"select {key}, unnest(list_distinct(list_concat([lower(i)], string_split(lower({cut}), '_')))) as t from ({names})"
    return f"select {key}, t from ({parts}) where length(t) >= 2 and t not in ({_STOP})"


_LENGTHS = "dls as (select d.doc_id, count(o.t) as dl from documents d left join occ o on o.doc_id = d.doc_id group by d.doc_id), corpus as (select count(*) as n, avg(dl) as avgdl from dls), dfs as (select t, count(distinct doc_id) as df from occ group by t)"
_SPANS = "spans as (select 'orders/' || l_orderkey as path, cast(l_linenumber * 40 as bigint) as start_line, cast(l_linenumber * 40 + l_quantity as bigint) as end_line, l_partkey as part from lineitem)"
_CITED = """cited as (
  select o_orderkey, o_custkey, case when o_orderkey % 11 = 0 then '' when o_orderkey % 7 = 0 then 'nowhere/' || o_orderkey else 'orders/' || o_orderkey end as path,
    case when o_orderkey % 11 = 0 then 0 else o_custkey % 300 end as s, case when o_orderkey % 11 = 0 then 0 when o_orderkey % 7 = 0 then o_custkey % 300 else o_custkey % 300 + 3 end as e
  from orders),
judged as (
  select c.o_orderkey, c.o_custkey, c.path, c.s, c.e, coalesce(bool_or(p.start_line <= c.s and c.e <= p.end_line), false) as valid, max(p.end_line) as last
  from cited c left join spans p on p.path = c.path group by all),
checked as (
  select *, case when path = '' then 'malformed, expected path:start-end' when last is null then 'path not in index' when valid then ''
    when s > last then 'line ' || s || ' beyond indexed extent (' || last || ')' else 'span does not fall inside one chunk' end as reason from judged)"""
_EDGES = "calls as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem)"
_METRICS = """ranked as (
  select query_id, item, rank from (select o_custkey as query_id, o_orderkey as item, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 10),
gold as (select o_custkey as query_id, o_orderkey as item from orders where o_orderpriority = '1-URGENT'),
n_gold as (select query_id, count(*) as n from gold group by query_id),
marked as (select r.query_id, r.rank, case when g.item is null then 0 else 1 end as good from ranked r left join gold g on g.query_id = r.query_id and g.item = r.item),
running as (select *, sum(good) over (partition by query_id order by rank) as so_far from marked),
sums as (
  select query_id, count(*) as items, sum(case when rank <= 1 then good else 0 end) as in1, sum(case when rank <= 5 then good else 0 end) as in5, min(case when good = 1 then rank end) as first, sum(case when good = 1 then so_far * 1.0 / rank else 0 end) as ap
  from running group by query_id),
per_query as (
  select c.c_custkey as query_id, c.c_mktsegment as type, case when n.n > 0 then coalesce(s.in1, 0) * 1.0 / n.n else 0.0 end as recall_at_1, case when s.in1 > 0 then 1.0 else 0.0 end as hit_at_1, case when s.items > 0 then s.in1 * 1.0 else 0.0 end as precision_at_1,
    case when n.n > 0 then coalesce(s.in5, 0) * 1.0 / n.n else 0.0 end as recall_at_5, case when s.in5 > 0 then 1.0 else 0.0 end as hit_at_5, case when s.items > 0 then s.in5 * 1.0 / least(5, s.items) else 0.0 end as precision_at_5,
    coalesce(1.0 / s.first, 0.0) as rr, case when n.n > 0 then coalesce(s.ap, 0) * 1.0 / n.n else 0.0 end as ap
  from customer c left join sums s on s.query_id = c.c_custkey left join n_gold n on n.query_id = c.c_custkey)"""

def walk(budget: int, cap: int = 12) -> str:
    """walk (q, node, score, hops, via, from_node, cost, ord, admitted): two hops from seeds (q, node, score, rank) along near (node, rel, other) with costs (node, cost)."""
    via = "case rel when 0 then 'callee' when 1 then 'caller' else 'sibling' end"

    def hop(h: int) -> str:
        known = " union all ".join(f"select q, node, ord from l{i}" for i in range(h))
        return f"""k{h} as ({known}),
w{h} as (
  select l.q, s.other as node, l.score * {0.5**h} as score, {h} as hops, {via} as via, l.node as from_node, c.cost, l.ord as pord, s.rel, row_number() over (partition by l.q, s.other order by l.ord, s.rel) as n
  from l{h - 1} l join slots s on s.node = l.node join costs c on c.node = s.other anti join k{h} k on k.q = l.q and k.node = s.other),
l{h} as (select w.q, w.node, score, hops, via, from_node, cost, (select max(k.ord) from k{h} k where k.q = w.q) + row_number() over (partition by w.q order by pord, rel, w.node) as ord from w{h} w where n = 1)"""

    return f"""slots as (select * from (select *, row_number() over (partition by node order by rel, other) as slot from near) where slot <= {cap}),
l0 as (
  select s.q, s.node, cast(s.score as double) as score, 0 as hops, 'seed' as via, cast(null as varchar) as from_node, c.cost, row_number() over (partition by s.q order by s.rank) as ord
  from (select *, row_number() over (partition by q, node order by rank) as n from seeds) s join costs c on c.node = s.node where n = 1),
{hop(1)}, {hop(2)},
walk as (select *, sum(cost) over (partition by q order by ord) <= {budget} or ord = 1 as admitted from (select * from l0 union all select * from l1 union all select * from l2))"""


ORACLE_SQL: dict[str, str] = {
    "bm25_topk_batch": f"""
with occ as ({tokens("documents", "doc_id")}), {_LENGTHS},
qt as (select item_id, t, count(*) as qtf from ({tokens("benchmark", "item_id")}) group by item_id, t),
tfs as (select doc_id, t, count(*) as tf from occ where t in (select t from qt) group by doc_id, t),
scored as (
  select q.item_id as query_id, f.doc_id, round(sum(q.qtf * ln(1 + (c.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * greatest(l.dl, 1) / c.avgdl))), 9) as score
  from qt q join tfs f on f.t = q.t join dfs d on d.t = q.t join dls l on l.doc_id = f.doc_id cross join corpus c group by q.item_id, f.doc_id),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)
select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 20""",
    "term_stats": f"with occ as ({tokens('documents', 'doc_id')}), {_LENGTHS} select t as term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from dfs cross join corpus",
    "document_lengths": f"with occ as ({tokens('documents', 'doc_id')}) select d.doc_id, count(o.t) as dl, count(distinct o.t) as terms, greatest(1, length(any_value(d.text)) // 4) as token_estimate from documents d left join occ o on o.doc_id = d.doc_id group by d.doc_id",
    "corpus_stats": f"with occ as ({tokens('documents', 'doc_id')}), {_LENGTHS} select n, round(avgdl, 6) as avgdl from corpus",
    "vector_topk": """
with s as (select q.vec_id as query_id, e.vec_id as doc_id, list_inner_product(cast(q.embedding as double[]), cast(e.embedding as double[])) as score from embeddings q cross join embeddings e where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, doc_id, round(score, 5) as score, rank from r where rank <= 10""",
    "vector_norms": "with n as (select vec_id, embedding, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as n from embeddings) select vec_id, round(case when n = 0 then 0.0 else 1.0 end, 6) as unit, round(cast(embedding[1] as double) / case when n = 0 then 1 else n end, 6) as first from n",
    "rrf_fusion": """
with c as (select c_custkey as doc_id, c_mktsegment as query_id, c_acctbal as score from customer),
spent as (select c.doc_id, c.query_id, cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) as score from c join orders o on o.o_custkey = c.doc_id group by c.doc_id, c.query_id),
arms as (
  select 'balance' as arm, 2.0 as w, query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from c
  union all select 'orders', 1.0, query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) from spent),
f as (select query_id, doc_id, sum(w / (60 + rank)) as score, string_agg(arm, ',' order by arm) as sources, count(*) > 1 as "both" from arms where rank <= 30 group by query_id, doc_id),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f)
select query_id, doc_id, round(score, 8) as score, rank, sources, "both" from r where rank <= 25""",
    "find_by_name": "select p_partkey as chunk_id, p_brand as name, p_type as qualified_name from part where lower(p_brand) = 'steel' or lower(p_type) like '%steel' union all select p_partkey, p_brand, p_type from part where lower(p_brand) = 'brand#11' or lower(p_type) like '%brand#11'",
    "verify_citations": f"with {_SPANS}, {_CITED} select o_orderkey, path, s as start, e as \"end\", valid, reason from checked",
    "citation_stats": f"""
with {_SPANS}, {_CITED}, each as (select c.c_custkey, count(k.o_orderkey) as n, count(case when k.valid then 1 end) as good from customer c left join checked k on k.o_custkey = c.c_custkey group by c.c_custkey)
select count(*) as answers, cast(sum(n) as bigint) as citations, cast(sum(good) as bigint) as valid_citations, round(avg(case when good > 0 then 1.0 else 0.0 end), 6) as supported_rate, round(avg(case when n > 0 and good = n then 1.0 else 0.0 end), 6) as all_valid_rate,
  round(sum(good) * 1.0 / sum(n), 6) as validity_rate, (select count(distinct reason) from checked where not valid) as reasons from each""",
    "grep_lines": """
with l as (select doc_id, string_split(text, chr(10)) as parts from documents), n as (select doc_id, unnest(range(1, len(parts) + 1)) as line, parts from l), m as (select doc_id, line, parts[line] as text from n)
select lpad(cast(doc_id as varchar), 8, '0') as path, line, substr(trim(text), 1, 200) as text from m where regexp_matches(text, '[Ll]icen[sc]e|[Vv]ersion [0-9]') order by doc_id, line limit 20""",
    "graph_degrees": f"with {_EDGES}, sides as (select src as node, 1 as o, 0 as i from calls union all select dst, 0, 1 from calls) select node, cast(sum(o) as bigint) as n_callees, cast(sum(i) as bigint) as n_callers, cast(sum(o + i) as bigint) as degree from sides group by node",
    "graph_neighbours": "select 'p' || l_partkey as node from lineitem where l_suppkey = 1 union select 's' || b.s_suppkey from supplier a join supplier b on b.s_nationkey = a.s_nationkey where a.s_suppkey = 1 and b.s_suppkey <> 1",
    "graph_expansion": f"""
with {_EDGES}, near as (select src as node, 0 as rel, dst as other from calls union select dst, 1, src from calls),
nodes as (select src as node from calls union select dst from calls union select 's' || s_suppkey from supplier union select 'n' || s_nationkey from supplier), costs as (select node, length(node) * 10 + ascii(right(node, 1)) % 7 as cost from nodes),
seeds as (select * from (select s_nationkey as q, 's' || s_suppkey as node, s_acctbal as score, row_number() over (partition by s_nationkey order by s_acctbal desc, 's' || s_suppkey) as rank from supplier) where rank <= 3),
{walk(900)} select q as query_id, node as chunk_id, round(score, 6) as score, hops, via as reached_via, from_node as from_chunk, ord from walk where admitted""",
    "metrics_per_query": f"with {_METRICS} select query_id, " + ", ".join(f"round({c}, 6) as {c}" for c in ("recall_at_1", "hit_at_1", "precision_at_1", "recall_at_5", "hit_at_5", "precision_at_5", "rr", "ap")) + " from per_query",
    "metric_means": f"with {_METRICS} select coalesce(type, 'all') as type, count(*) as questions, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in ("recall_at_5", "hit_at_5", "precision_at_5", "rr", "ap")) + " from per_query group by rollup(type)",
    "invalid_gold": "select distinct cast(l_orderkey as varchar) as id, 'missing_file' as problem, cast(l_partkey as varchar) as value from lineitem where l_partkey not in (select p_partkey from part where p_size > 3)",
    "localisation_overlap": f"with {_SPANS} select s.path, s.start_line, s.end_line, s.part from spans s join orders o on s.path = 'orders/' || o.o_orderkey where s.start_line <= o.o_custkey % 280 + 9 and o.o_custkey % 280 <= s.end_line",
    "chunk_identity": f"with {_SPANS} select path, start_line, substr(sha1(path || '::' || part || '::' || start_line), 1, 16) as chunk_id, path || ':' || start_line || '-' || end_line as citation from spans",
}
