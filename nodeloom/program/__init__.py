"""Program records beside the graph: evidence, anchors, joins, call graphs and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.traverse import closure

#: Kinds of nodes that stand for callable code.
CALLABLE = ("function", "method", "constructor", "closure")
#: Lines of a cell in which sites and ranges meet.
CELL = 64


def innermost(sites: DataFrame, ranges: DataFrame, cell: int = CELL) -> DataFrame:
    """(site_id, owner_id): the smallest range of a file that contains each site, null without one.

    ``sites(site_id, file, line)``, ``ranges(id, file, start_line, end_line)``, ends included;
    ties fall to the smaller id. A range is listed under every cell of lines it touches and a
    site under its own, so both meet by an equality and a file of any length is spread over
    its cells. Sites without a file or line, and ranges without both ends or with reversed
    ones, meet nothing.
    """
    at = lambda c: F.expr(f"{c} div {cell}")
    r = ranges.where("start_line <= end_line").select("id", "file", "start_line", "end_line", F.explode(F.sequence(at("start_line"), at("end_line"))).alias("cell"))
    hit = sites.where("line is not null").withColumn("cell", at("line")).join(r, ["file", "cell"]).where("start_line <= line and line <= end_line")
    best = hit.groupBy("site_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("id").alias("id"))).alias("m"))
    return sites.select("site_id").distinct().join(best, "site_id", "left").select("site_id", F.col("m.id").alias("owner_id"))


def join_program(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol_id, node_id, state) of ``functions(symbol_id, name, graph_node_id)`` against graph nodes.

    ``orphan`` functions name no node, ``absent`` ones a node that is not there, ``conflict``
    ones a node of another name (trailing ``()`` and leading dots aside); the rest are
    ``joined``.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\(\))+$", ""), r"^\.+", "")
    known = nodes.select(F.col("id").alias("graph_node_id"), F.col("node_label").alias("_label"), F.lit(True).alias("_known"))
    state = F.when(F.col("graph_node_id").isNull(), "orphan").when(F.col("_known").isNull(), "absent").when(bare("_label").eqNullSafe(bare("name")), "joined").otherwise("conflict")
    return functions.join(known, "graph_node_id", "left").select("symbol_id", F.when(F.col("_known"), F.col("graph_node_id")).alias("node_id"), state.alias("state"))


def merge_providers(facts: DataFrame) -> DataFrame:
    """One record per symbol of ``facts(symbol_id, provider, confidence, score)``: (symbol_id, providers, facts, provider, confidence, conflict).

    The firmest fact stands for the symbol: exact before inferred before ambiguous before
    others, then the higher score (null last), then the smaller provider. ``conflict`` tells
    whether providers differ in confidence.
    """
    rank = F.when(F.col("confidence") == "exact", 0).when(F.col("confidence") == "inferred", 1).when(F.col("confidence") == "ambiguous", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("r"), (-F.coalesce("score", F.lit(-1.0))).alias("s"), F.col("provider").alias("provider"), F.col("confidence").alias("confidence"))).alias("m")
    pairs = facts.where("symbol_id is not null").groupBy("symbol_id", "provider").agg(F.count(F.lit(1)).alias("n"), best, F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return pairs.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("providers"), F.sum("n").alias("facts"), F.min("m").alias("m"), (F.min("lo") != F.max("hi")).alias("conflict")).select("symbol_id", "providers", "facts", F.col("m.provider").alias("provider"), F.col("m.confidence").alias("confidence"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def call_edges(links: DataFrame, graph: PropertyGraph) -> DataFrame:
    """(eid, src, dst, resolution) of call links ``(eid, src, dst, is_deferred, confidence)``.

    unresolved: the target is no node; ambiguous or inferred by the link's evidence (a
    deferred call is inferred); else resolved.
    """
    known = graph.nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "unresolved").when(F.col("confidence") == "AMBIGUOUS", "ambiguous").when((F.col("confidence") == "INFERRED") | F.col("is_deferred"), "inferred").otherwise("resolved")
    return links.join(known, "dst", "left").select("eid", "src", "dst", state.alias("resolution"))


def call_graph(calls: DataFrame, roots: DataFrame, direction: str = "both", depth: int = 2, max_nodes: int = 64, max_edges: int = 128) -> tuple[DataFrame, DataFrame]:
    """Bounded call graph of each root: nodes(root, node, depth, kept) and edges(root, eid, kept).

    ``calls(eid, src, dst, resolution)``, ``direction`` is in (callers), out or both. Of the
    nodes within ``depth`` the first ``max_nodes`` by id are kept, and the root; of the edges
    among kept nodes the first ``max_edges`` by id. What is not kept is where a caller may
    continue.
    """
    way = lambda a, b: F.struct(F.col(a).alias("here"), F.col(b).alias("there"))
    ways = {"out": [way("src", "dst")], "in": [way("dst", "src")], "both": [way("src", "dst"), way("dst", "src")]}[direction]
    adjacency = calls.select(F.explode(F.array(*ways)).alias("w"), "eid", F.col("resolution").alias("type")).select("w.*", "eid", "type").distinct()
    reach = closure(adjacency, roots.select(F.col("id").alias("root"), F.col("id").alias("node")), depth).select("root", "node", "depth")
    rank = F.row_number().over(Window.partitionBy("root").orderBy("node"))
    nodes = reach.withColumn("kept", (rank <= max_nodes) | (F.col("node") == F.col("root")))
    inside = nodes.where("kept").select("root", "node")
    among = calls.join(inside.withColumnRenamed("node", "src"), "src").join(inside.withColumnRenamed("node", "dst"), ["root", "dst"]).select("root", "eid")
    return nodes, among.withColumn("kept", F.row_number().over(Window.partitionBy("root").orderBy("eid")) <= max_edges)


def universal_calls(calls: DataFrame) -> DataFrame:
    """(src, dst, layer): a caller's resolved calls where it has any, else all of its structural ones."""
    firm = calls.where("resolution = 'resolved'").select("src").distinct().withColumn("_firm", F.lit(True))
    layered = calls.where("resolution != 'unresolved'").join(firm, "src", "left")
    return layered.where("_firm is null or resolution = 'resolved'").select("src", "dst", F.when(F.col("_firm"), "program").otherwise("structural").alias("layer")).distinct()


def validate(functions: DataFrame) -> DataFrame:
    """(module, symbol_id, problem) of ``functions(module, symbol_id, source_file, start_line, end_line)``.

    A symbol stands once in a module, its path is relative and stays inside the tree, and its
    lines are ordered; every broken rule gives a row.
    """
    path = F.col("source_file")
    bad_path = path.isNotNull() & ((path == "") | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike("^[A-Za-z]:"))
    problems = {"no symbol": F.col("symbol_id").isNull() | (F.col("symbol_id") == ""), "path": bad_path, "lines": F.coalesce(F.col("start_line") > F.col("end_line"), F.lit(False)) | F.coalesce(F.col("start_line") < 1, F.lit(False))}
    each = functions.select("module", "symbol_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in problems.items()]), lambda x: x.isNotNull())).alias("problem")).distinct()
    twice = functions.where("symbol_id is not null").groupBy("module", "symbol_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("module", "symbol_id", F.lit("repeated").alias("problem"))
    return each.unionByName(twice)
