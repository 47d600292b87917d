"""Call, containment and module edges from chunks by joins, and queries on them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.functions.text import resolve_relative
from citegraph.sources.scratch import written

CALLS, CONTAINS = "calls", "contains"
EDGE = "src string, dst string, type string, call string, resolver string"


def import_table(chunks: DataFrame) -> DataFrame:
    """(path, alias, target): what each file's import statements make visible; the last statement wins."""
    files = chunks.groupBy("path").agg(F.first("module").alias("module"), F.first("imports").alias("imports"))
    stmts = files.select("path", "module", F.posexplode("imports").alias("pos", "stmt"))
    words = F.split("stmt", " ")
    kind = F.get(words, F.lit(0))
    taken = F.regexp_extract("stmt", r"^from \S+ import (.*)$", 1)
    rest = F.when(kind == "from", taken).when(kind == "import", F.substr("stmt", F.lit(8))).otherwise("")
    base = F.when(kind == "from", resolve_relative(F.get(words, F.lit(1)), F.col("module")))
    pieces = stmts.select("path", "pos", kind.alias("kind"), base.alias("base"), F.posexplode(F.split(rest, ",")).alias("at", "piece"))
    clean = F.trim(F.regexp_replace(F.trim("piece"), r"^\(+|\)+$", ""))
    parts = F.split(clean, r"\s+")
    name = F.get(parts, F.lit(0))
    alias = F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == "as"), F.get(parts, F.lit(2))).otherwise(name)
    target = F.when((F.col("kind") == "from") & (F.col("base") != ""), F.concat("base", F.lit("."), name)).otherwise(name)
    return pieces.filter(clean != "").groupBy("path", alias.alias("alias")).agg(F.max_by(target, F.struct("pos", "at")).alias("target"))


@dataclasses.dataclass
class CodeGraph:
    """edges (src, dst, type, call, resolver), module_edges (src, dst, via), call_sites (src, base, outcome, ...), chunks."""

    chunks: DataFrame
    edges: DataFrame
    module_edges: DataFrame
    call_sites: DataFrame


def build(chunks: DataFrame) -> CodeGraph:
    """Edges by name resolution: the exact qualified name, then the import table, then the only definition of that name in scope.

    A call of a name that no chunk has is external; one with several candidates is
    ambiguous and stays unresolved; an edge from a chunk to itself is left out but
    counts as resolved.
    """
    ids = chunks.select("chunk_id", "path", "module", "name", "qualified_name", "parent", "start_line")
    first = ids.groupBy("qualified_name").agg(F.min_by("chunk_id", F.struct("path", "start_line")).alias("target"))
    contains = ids.filter("parent is not null").join(first.withColumnRenamed("qualified_name", "parent"), "parent").select(F.col("target").alias("src"), F.col("chunk_id").alias("dst"), F.lit(CONTAINS).alias("type"), F.lit(None).cast("string").alias("call"), F.lit(None).cast("string").alias("resolver"))

    imports = import_table(chunks)
    modules = imports.join(ids.select("path", "module").distinct(), "path").withColumn("via", F.get(F.split("target", r"\."), F.lit(0)))
    module_edges = modules.filter((F.col("module") != "") & (F.col("via") != "") & (F.col("via") != F.col("module"))).groupBy(F.col("module").alias("src"), F.col("target").alias("dst")).agg(F.first("via").alias("via"))

    sites = chunks.select(F.col("chunk_id").alias("src"), "path", "module", F.col("parent").alias("enclosing"), F.posexplode("calls").alias("pos", "raw"))
    sites = sites.withColumn("base", F.trim(F.get(F.split("raw", r"\("), F.lit(0)))).withColumn("leaf", F.element_at(F.split("base", r"\."), -1))
    sites = sites.withColumn("head", F.get(F.split("base", r"\."), F.lit(0))).withColumn("tail", F.substr("base", F.length(F.get(F.split("base", r"\."), F.lit(0))) + 1))
    names = ids.groupBy("name").agg(F.count("*").alias("same_named"))
    exact = first.select(F.col("qualified_name").alias("base"), F.col("target").alias("p1"))
    sites = sites.join(names.withColumnRenamed("name", "leaf"), "leaf", "left").join(exact, "base", "left")
    sites = sites.join(imports.select("path", F.col("alias").alias("head"), F.col("target").alias("import_target")), ["path", "head"], "left")
    by_import = first.select(F.col("qualified_name").alias("full"), F.col("target").alias("p2"))
    sites = sites.withColumn("full", F.concat("import_target", "tail")).join(by_import, "full", "left")

    # Candidates are counted before any are joined, so a name that a third of all chunks define costs one row a site.
    def only(*keys: str) -> DataFrame:
        return ids.groupBy(*keys).agg(F.count("*").alias("n"), F.min("chunk_id").alias("only"))

    def as_(df: DataFrame, mark: str, **names: str) -> DataFrame:
        return df.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("n").alias(f"n_{mark}"), F.col("only").alias(f"only_{mark}"))

    sites = sites.withColumn("owner", F.coalesce("enclosing", "module"))
    sites = sites.join(as_(only("name", "parent", "module"), "cm", name="leaf", parent="owner", module="module"), ["leaf", "owner", "module"], "left")
    sites = sites.join(as_(only("name", "parent"), "c", name="leaf", parent="owner"), ["leaf", "owner"], "left")
    sites = sites.join(as_(only("name", "module"), "m", name="leaf", module="module"), ["leaf", "module"], "left")
    sites = sites.join(as_(only("name"), "a", name="leaf"), "leaf", "left")
    own = F.startswith("base", F.lit("self.")) & F.col("n_c").isNotNull()
    pick = lambda *marks: F.coalesce(*[F.when(F.col(f"n_{m}").isNotNull(), F.struct(F.col(f"n_{m}").alias("n"), F.col(f"only_{m}").alias("id"))) for m in marks])
    pool = F.when(own, pick("cm", "c")).otherwise(pick("m", "a"))
    sites = sites.withColumn("pool", pool).withColumn("p3", F.when(F.col("pool.n") == 1, F.col("pool.id")))
    outcome = (
        F.when(F.col("base") == "", "empty").when(F.col("same_named").isNull(), "external").when(F.col("p1").isNotNull(), "exact").when(F.col("p2").isNotNull(), "import").when(F.col("p3").isNotNull(), "suffix")
        .when(F.col("same_named") > 1, "ambiguous").otherwise("unresolved")
    )
    sites = sites.withColumn("outcome", outcome).withColumn("dst", F.when(F.col("same_named").isNotNull() & (F.col("base") != ""), F.coalesce("p1", "p2", "p3"))).select("src", "path", "pos", "base", "outcome", "dst")
    called = sites.filter("dst is not null and dst <> src").select("src", "dst", F.lit(CALLS).alias("type"), F.col("base").alias("call"), F.lit(None).cast("string").alias("resolver"))
    return CodeGraph(chunks, called.unionByName(contains), module_edges, sites)


def resolution_stats(sites: DataFrame) -> DataFrame:
    """One row of counts by outcome; ambiguous sites are also unresolved; rate is resolved / (total - external)."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    row = sites.agg(
        F.count("*").alias("total_call_sites"), n("external").alias("external"), n("exact").alias("resolved_exact"), n("import").alias("resolved_import"), n("suffix").alias("resolved_suffix"),
        n("ambiguous").alias("ambiguous"), n("ambiguous", "unresolved", "empty").alias("unresolved"), n("exact", "import", "suffix").alias("resolved"),
    )
    inside = F.col("total_call_sites") - F.col("external")
    return row.withColumn("in_repository", inside).withColumn("resolution_rate", F.when(inside > 0, F.col("resolved") / inside).otherwise(0.0))


def callees(edges: DataFrame, node) -> DataFrame:
    return edges.filter((F.col("type") == CALLS) & (F.col("src") == node)).select(F.col("dst").alias("node")).distinct().orderBy("node")


def callers(edges: DataFrame, node) -> DataFrame:
    return edges.filter((F.col("type") == CALLS) & (F.col("dst") == node)).select(F.col("src").alias("node")).distinct().orderBy("node")


def siblings(edges: DataFrame, node) -> DataFrame:
    """Other children of what contains the node."""
    inside = edges.filter(F.col("type") == CONTAINS)
    parents = inside.filter(F.col("dst") == node).select("src").distinct()
    return inside.join(parents, "src", "left_semi").filter(F.col("dst") != node).select(F.col("dst").alias("node")).distinct().orderBy("node")


def neighbours(edges: DataFrame, node, include_siblings: bool = False) -> DataFrame:
    out = callees(edges, node).union(callers(edges, node))
    return (out.union(siblings(edges, node)) if include_siblings else out).distinct().orderBy("node")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_callees, n_callers, degree) of every node with a call."""
    calls = edges.filter(F.col("type") == CALLS).select("src", "dst").distinct()
    sides = calls.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(calls.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return sides.groupBy("node").agg(F.sum("o").alias("n_callees"), F.sum("i").alias("n_callers"), F.sum(F.col("o") + F.col("i")).alias("degree"))


def summary(graph: CodeGraph) -> dict:
    """Counts of nodes, edges by type and modules, with the resolution statistics."""
    by_type = {r["type"]: r["n"] for r in graph.edges.groupBy("type").agg(F.count("*").alias("n")).collect()}
    ends = graph.module_edges.select(F.col("src").alias("m")).union(graph.module_edges.select("dst")).union(graph.chunks.select("module").filter("module <> ''")).distinct()
    return {"nodes": graph.chunks.count(), "call_edges": by_type.get(CALLS, 0), "contains_edges": by_type.get(CONTAINS, 0), "modules": ends.count(), "module_edges": graph.module_edges.count(), **resolution_stats(graph.call_sites).first().asDict()}


def ordered_neighbours(edges: DataFrame, include_siblings: bool = False, cap: int | None = None) -> DataFrame:
    """(node, relation, other): callees (0), callers (1) and siblings (2), each once; of each node only the first `cap` in that order and by id.

    Of what a container holds, each child needs no more than the first cap + 1
    as siblings, so a container of any size costs that many rows a child.
    """
    calls = edges.filter(F.col("type") == CALLS).select("src", "dst").distinct()
    out = calls.select(F.col("src").alias("node"), F.lit(0).alias("relation"), F.col("dst").alias("other")).union(calls.select(F.col("dst"), F.lit(1), F.col("src")))
    if include_siblings:
        inside = edges.filter(F.col("type") == CONTAINS).select("src", "dst").distinct()
        first = inside if cap is None else _first(inside, "src", cap + 1, "dst")
        pairs = inside.select("src", F.col("dst").alias("node")).join(first.select("src", F.col("dst").alias("other")), "src").filter("node <> other")
        out = out.union(pairs.select("node", F.lit(2), "other").distinct())
    return out if cap is None else _first(out, "node", cap, "relation", "other")


def _first(rows: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each value of `by`; tasks keep n of each before any are shuffled."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__at") <= n).drop("__at")


def expand(seeds: DataFrame, edges: DataFrame, costs: DataFrame, token_budget: int = 6000, max_hops: int = 2, decay: float = 0.5, include_siblings: bool = False, cap: int = 12) -> DataFrame:
    """(query_id, chunk_id, score, hops, reached_via, from_chunk, cost, ord, admitted) of everything a walk outward from `seeds` discovers.

    `seeds` has query_id, chunk_id, score and rank; `costs` chunk_id and cost (tokens).
    Nodes are discovered level by level, in the order of their parent, then
    callees before callers before siblings, then by id; of each parent the first
    `cap` neighbours count, whether known or not.  A node at hop h scores its
    parent's score times decay ** h.  Admitted is the longest prefix in the order of
    discovery whose costs fit the budget; the first seed always is.  All queries walk
    at once: one join a hop.
    """
    around = written(ordered_neighbours(edges, include_siblings, cap), "around")
    known = costs.select("chunk_id", "cost")
    # As seeds repeat, the first mention of a chunk stands.
    level = seeds.join(known, "chunk_id").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).filter("n = 1")
    level = level.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("hops"), F.lit("seed").alias("reached_via"), F.lit(None).cast("string").alias("from_chunk"), "cost", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long").alias("ord"))
    found = level = written(level, "level")
    via = F.when(F.col("relation") == 0, "callee").when(F.col("relation") == 1, "caller").otherwise("sibling")
    for hop in range(1, max_hops + 1):
        wide = level.select("query_id", F.col("chunk_id").alias("node"), "score", F.col("ord").alias("parent_ord")).join(around, "node")
        wide = wide.join(known.withColumnRenamed("chunk_id", "other"), "other").join(found.select("query_id", F.col("chunk_id").alias("other")), ["query_id", "other"], "left_anti")
        once = Window.partitionBy("query_id", "other").orderBy("parent_ord", "relation")
        wide = wide.withColumn("n", F.row_number().over(once)).filter("n = 1")
        last = found.groupBy("query_id").agg(F.max("ord").alias("last"))
        wide = wide.join(last, "query_id")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("parent_ord", "relation", "other"))
        level = wide.select("query_id", F.col("other").alias("chunk_id"), (F.col("score") * decay**hop).alias("score"), F.lit(hop).alias("hops"), via.alias("reached_via"), F.col("node").alias("from_chunk"), "cost", (F.col("last") + order).alias("ord"))
        level = written(level, "level")  # the next hop reads it twice, and so would compute all hops before it again
        found = found.unionByName(level)
    total = F.sum("cost").over(Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.withColumn("total", total).withColumn("admitted", (F.col("total") <= token_budget) | (F.col("ord") == 1)).drop("total")


def expansion_trace(found: DataFrame, token_budget: int = 6000) -> DataFrame:
    """One row a query: seeds, admitted, expanded (admitted beyond the seeds), max_hops_reached, tokens_used, token_budget, by_hop, stopped_on_budget, frontier_exhausted."""
    good = found.filter("admitted").groupBy("query_id", "hops").agg(F.count("*").alias("n"), F.sum("cost").alias("tokens"))
    rows = good.groupBy("query_id").agg(
        F.sum("n").alias("admitted"), F.sum(F.when(F.col("hops") > 0, F.col("n")).otherwise(0)).alias("expanded"), F.max("hops").alias("max_hops_reached"),
        F.sum("tokens").alias("tokens_used"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("hops", "n")))).alias("by_hop"),
    )
    left = found.groupBy("query_id").agg(F.bool_or(~F.col("admitted")).alias("stopped_on_budget"), F.count_if((F.col("hops") == 0) & F.col("admitted")).alias("seeds"))
    return rows.join(left, "query_id").withColumn("token_budget", F.lit(token_budget)).withColumn("frontier_exhausted", ~F.col("stopped_on_budget"))
