"""Structural graph queries: neighbours, breadth-first closures, trails and their witnesses."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CONFIDENCE, PropertyGraph
from ..runtime import Workspace

#: Relationship sets of the structural queries, as canonical types.
CALLER_TYPES = ("CALLS", "ROUTES_TO")
CALLEE_TYPES = ("CALLS",)
IMPACT_TYPES = ("CALLS", "ROUTES_TO", "IMPORTS", "EXPORTS", "REFERENCES", "DEPENDS_ON", "READS", "WRITES", "PUBLISHES", "SUBSCRIBES", "PRODUCES", "CONSUMES", "SCHEDULES", "TRIGGERS", "MAPS_TO")
AFFECTED_TYPES = ("CALLS", "INDIRECT_CALL", "REFERENCES", "IMPORTS", "IMPORTS_FROM", "RE_EXPORTS", "INHERITS", "EXTENDS", "IMPLEMENTS", "USES", "MIXES_IN", "EMBEDS")
LENSES = {
    "dependencies": ("IMPORTS", "IMPORTS_FROM", "RE_EXPORTS", "DEPENDS_ON", "USES", "REFERENCES"),
    "routes": ("ROUTES_TO", "HANDLES", "REGISTERS", "DECORATES"),
    "data": ("READS", "WRITES", "MAPS_TO"),
    "messaging": ("PUBLISHES", "SUBSCRIBES", "PRODUCES", "CONSUMES", "SCHEDULES", "TRIGGERS"),
    "tests": ("TESTS",),
    "provenance": ("ALIASES", "EXPORTS", "RE_EXPORTS", "OVERRIDES"),
}


def directed(graph: PropertyGraph, types: tuple[str, ...] | None = None, direction: str = "out") -> DataFrame:
    """Adjacency (here, there, eid, type) in a direction: out, in or both (self-loops once)."""
    e = graph.edges if types is None else graph.edges.where(F.col("type").isin(*types))
    way = lambda a, b: F.struct(F.col(a).alias("here"), F.col(b).alias("there"))
    if direction == "both":
        pairs = F.explode(F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src"))))
    else:
        pairs = way("src", "dst") if direction == "out" else way("dst", "src")
    return e.select(pairs.alias("p"), "eid", "type").select("p.*", "eid", "type")


def neighbours(graph: PropertyGraph, types: tuple[str, ...], direction: str) -> DataFrame:
    """(symbol, neighbour, eid, type) for every symbol at once."""
    return directed(graph, types, direction).select(F.col("here").alias("symbol"), F.col("there").alias("neighbour"), "eid", "type")


def callers(graph: PropertyGraph) -> DataFrame:
    return neighbours(graph, CALLER_TYPES, "in")


def callees(graph: PropertyGraph) -> DataFrame:
    return neighbours(graph, CALLEE_TYPES, "out")


def closure(adjacency: DataFrame, seeds: DataFrame, max_depth: int | None, *, hubs: DataFrame | None = None, worst: str | None = None) -> DataFrame:
    """Breadth-first closure from all seeds at once: (root, node, depth, parent, eid, type).

    ``seeds`` is (root, node). One staged level a step; a node keeps the least edge id that
    reaches it at its least depth, which is its witness. ``hubs`` (id) are reached but not
    expanded, unless they are seeds. ``worst`` names a number of the adjacency; its largest
    value along the witnesses comes out under that name (0 for a seed). The loop stops at the
    first empty level; a ``max_depth`` of None sets no other end.
    """
    work = Workspace(adjacency.sparkSession, "closure")
    more = [worst] if worst else []
    if max_depth is None or max_depth > 1:
        adjacency = work.stage(adjacency.select("here", "there", "eid", "type", *more))  # each step reads it again
    none = F.lit(None).cast("string")
    start = seeds.select("root", "node").where("root is not null and node is not null").distinct()
    level = work.stage(start.select("root", "node", F.lit(0).alias("depth"), none.alias("parent"), none.alias("eid"), none.alias("type"), *[F.lit(0).alias(c) for c in more]))
    seen = level
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        front = level
        if hubs is not None and depth > 1:
            front = front.join(hubs.select(F.col("id").alias("node")), "node", "left_anti")
        step = front.select("root", F.col("node").alias("here"), *[F.col(c).alias("_before") for c in more]).join(adjacency, "here")
        witness = F.min(F.struct("eid", "here", "type", *[F.greatest(c, "_before").alias(c) for c in more])).alias("m")
        found = step.groupBy("root", F.col("there").alias("node")).agg(witness)
        fresh = found.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"), F.col("m.here").alias("parent"), F.col("m.eid").alias("eid"), F.col("m.type").alias("type"), *[F.col(f"m.{c}").alias(c) for c in more])
        level, n = work.stage_counted(fresh, n=F.count(F.lit(1)))
        if not n["n"]:
            break
        seen = seen.unionByName(level)
        if depth % 16 == 0:
            seen = work.stage(seen)  # a plan must not hold a table for every level
    return seen


def impact(graph: PropertyGraph, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """What depends on each seed: reverse closure over the impact relationships."""
    return closure(directed(graph, IMPACT_TYPES, "in"), seeds, max_depth)


def weakest_links(graph: PropertyGraph, seeds: DataFrame, max_depth: int = 8, types: tuple[str, ...] = IMPACT_TYPES, direction: str = "in") -> DataFrame:
    """Closure from each seed with the weakest confidence along each node's witness path.

    (root, node, depth, weakest, resolution): ``confidence`` of an edge is EXTRACTED where it
    has no evidence; a path is exact, unresolved (something inferred) or ambiguous.
    """
    rank = F.when(F.col("confidence") == CONFIDENCE[2], 2).when(F.col("confidence") == CONFIDENCE[1], 1).otherwise(0)
    links = directed(graph, types, direction).join(graph.edges.select("eid", rank.alias("_rank")), "eid")
    reach = closure(links, seeds, max_depth, worst="_rank")
    at = F.col("_rank") + 1
    return reach.select("root", "node", "depth", F.element_at(F.array(*map(F.lit, CONFIDENCE)), at).alias("weakest"), F.element_at(F.array(F.lit("exact"), F.lit("unresolved"), F.lit("ambiguous")), at).alias("resolution"))


def affected(graph: PropertyGraph, seeds: DataFrame, max_depth: int = 8, types: tuple[str, ...] = AFFECTED_TYPES) -> DataFrame:
    """Reverse closure from each seed and the members it contains, which count as depth 0."""
    members = graph.edges.where(F.col("type").isin("METHOD", "CONTAINS")).select(F.col("src").alias("node"), F.col("dst").alias("member"))
    start = seeds.unionByName(seeds.join(members, "node").select("root", F.col("member").alias("node"))).distinct()
    return closure(directed(graph, types, "in"), start, max_depth)


def trails(graph: PropertyGraph, pairs: DataFrame, max_depth: int = 8, direction: str = "out", types: tuple[str, ...] | None = None, *, paths: bool = True) -> DataFrame:
    """Shortest path between each pair (a, b): (a, b, hops, path), path being the node ids (with ``paths``).

    Pairs without a path within ``max_depth`` have a null path. All pairs are searched at
    once and each from both ends: a step moves on the side whose frontier is smaller, and a
    pair whose frontiers have met is searched no further, so a hub is passed by few of them.
    Where several paths are shortest, the one through the least meeting node counts, and
    from there on each side the links of the least id.
    """
    work = Workspace(graph.spark, "trails")
    key = ["a", "b"]
    pairs, asked = work.stage_counted(pairs.select(*key).where("a is not null and b is not null").distinct(), n=F.count(F.lit(1)))
    forth = work.stage(directed(graph, types, direction).select("here", "there", "eid"))
    back = forth if direction == "both" else forth.select(F.col("there").alias("here"), F.col("here").alias("there"), "eid")
    none = F.lit(None).cast("string").alias("parent")
    sides = [[adjacency, pairs.select(*key, F.col(end).alias("node"), F.lit(0).alias("depth"), none), None, asked["n"], 0] for adjacency, end in ((forth, "a"), (back, "b"))]
    for side in sides:
        side[2] = side[1]
    met = pairs.where("a = b").select(*key, F.lit(0).alias("hops"), F.col("a").alias("meet"))
    for depth in range(1, max_depth + 1):
        side = min(sides, key=lambda x: x[3])
        other = sides[1] if side is sides[0] else sides[0]
        adjacency, level, seen, _, steps = side
        front = level.join(met.select(*key), key, "left_anti").select(*key, F.col("node").alias("here"))
        step = front.join(adjacency, "here").groupBy(*key, F.col("there").alias("node")).agg(F.min(F.struct("eid", "here")).alias("m"))
        fresh = step.join(seen.select(*key, "node"), [*key, "node"], "left_anti")
        # what has been met before is done, so a meeting lies on the frontiers of both sides
        ahead = other[1].select(*key, "node", F.lit(True).alias("hit"))
        fresh = fresh.join(ahead, [*key, "node"], "left").select(*key, "node", F.lit(steps + 1).alias("depth"), F.col("m.here").alias("parent"), "hit")
        level, n = work.stage_counted(fresh, n=F.count(F.lit(1)))
        if not n["n"]:
            break  # every pair has met, or nothing more can be reached from this side
        met = met.unionByName(level.where("hit").groupBy(*key).agg(F.min("node").alias("meet")).select(*key, F.lit(depth).alias("hops"), "meet"))
        level = level.drop("hit")
        side[1:] = level, seen.unionByName(level), n["n"], steps + 1
    if not paths:
        return pairs.join(met.select(*key, "hops"), key, "left")
    out = met.withColumn("path", F.array("meet"))
    for k, (_, _, seen, _, steps) in enumerate(sides):
        if not steps:
            continue
        up = seen.where("depth > 0").select(*key, F.col("node").alias("at"), "parent")
        out = out.withColumn("at", F.col("meet"))
        for _ in range(steps):
            more = F.concat(F.array("parent"), "path") if k == 0 else F.concat("path", F.array("parent"))
            out = out.join(up, [*key, "at"], "left").select(*key, "hops", "meet", F.when(F.col("parent").isNotNull(), more).otherwise(F.col("path")).alias("path"), F.col("parent").alias("at"))
        out = work.stage(out.drop("at"))
    return pairs.join(out.select(*key, "hops", "path"), key, "left")


def node_trail(graph: PropertyGraph, pairs: DataFrame, max_depth: int = 8) -> DataFrame:
    """Directed shortest paths; ``diagnostic`` tells pairs that only connect against the direction."""
    there = Workspace(graph.spark, "trail").stage(trails(graph, pairs, max_depth, "out"))
    lost = there.where("hops is null").select("a", "b")
    any_way = trails(graph, lost, max_depth, "both", paths=False).where("hops is not null").select("a", "b", F.lit("direction_mismatch").alias("diagnostic"))
    return there.join(any_way, ["a", "b"], "left")


def hub_threshold(degrees: DataFrame, floor: int = 50, share: float = 0.99) -> DataFrame:
    """Ids whose degree reaches max(``floor``, the ``share`` quantile of degrees)."""
    cut = degrees.agg(F.greatest(F.lit(floor), F.percentile("degree", F.lit(share)).cast("bigint")).alias("cut"))
    return degrees.where(F.col("degree") >= cut.scalar()).select("id")


def discover(graph: PropertyGraph, seeds: DataFrame, direction: str = "both", max_depth: int = 2, max_nodes: int = 64, max_edges: int = 128, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bounded neighbourhood of each root: its nodes by depth and id, and the edges among them."""
    from pyspark.sql import Window

    hubs = hub_threshold(graph.degrees())
    reach = closure(directed(graph, types, direction), seeds, max_depth, hubs=hubs)
    rank = F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))
    nodes = reach.withColumn("rank", rank).where(F.col("rank") <= max_nodes).select("root", "node", "depth")
    e = graph.edges if types is None else graph.edges.where(F.col("type").isin(*types))
    ends = e.select("eid", "src", "dst", "type").join(nodes.select("root", F.col("node").alias("src")), "src").join(nodes.select("root", F.col("node").alias("dst")), ["root", "dst"])
    edges = ends.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("eid"))).where(F.col("rank") <= max_edges).select("root", "eid", "src", "dst", "type")
    return nodes, edges


def bounded(rows: DataFrame, by: str, order: tuple[str, ...], most: int) -> DataFrame:
    """The first ``most`` rows of each group with ``truncated`` and how many were ``omitted``."""
    from pyspark.sql import Window

    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= most)
    return first.join(counts, by).select(*rows.columns, (F.col("_n") > most).alias("truncated"), F.greatest(F.col("_n") - most, F.lit(0)).alias("omitted"))


def find_node(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes matching a text by tier: source file, exact name, prefix, substring."""
    want, name = text.strip().lower(), F.lower("node_label")
    tier = F.when(F.lower("source_file") == want, 0).when(name == want, 1).when(name.startswith(want), 2).when(name.contains(want), 3)
    return nodes.select("id", "node_label", "source_file", tier.alias("tier")).where("tier is not null").orderBy("tier", "id").limit(limit)


def resolve_symbol(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(symbol, id, how): by id, else by a normalised name if only one node has it, else null."""
    norm = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"\(\)$", ""), r"^\.", ""))
    by_id = wanted.join(nodes.select(F.col("id").alias("symbol"), F.lit("id").alias("by_id")), "symbol", "left")
    names = nodes.groupBy(norm(F.col("node_label")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("named"))
    both = by_id.withColumn("name", norm(F.col("symbol"))).join(names, "name", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("n") == 1, "name").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return both.select("symbol", F.when(F.col("by_id").isNotNull(), F.col("symbol")).when(F.col("n") == 1, F.col("named")).alias("id"), how.alias("how"))


def resolve_seed(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id, how): by id, exact name, name in any case, source file, or part of a name, each only if unique."""
    n = nodes.select("id", "node_label", F.lower("node_label").alias("low"), "source_file")
    w = wanted.select("wanted", F.lower("wanted").alias("lw"))
    tests = {"id": F.col("id") == F.col("wanted"), "label": F.col("node_label") == F.col("wanted"), "bare": F.col("low") == F.col("lw"), "file": F.col("source_file") == F.col("wanted"), "substring": F.contains("low", "lw")}
    any_way = None
    for t in tests.values():
        any_way = t if any_way is None else any_way | t
    hits = n.join(w, any_way)  # the wanted texts are the few a caller asks for
    counts = hits.groupBy("wanted").agg(*[x for k, t in tests.items() for x in (F.count_if(t).alias(f"n_{k}"), F.min(F.when(t, F.col("id"))).alias(f"i_{k}"))])
    found, how = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(tests):
        found, how = F.when(F.col(f"n_{k}") == 1, F.col(f"i_{k}")).otherwise(found), F.when(F.col(f"n_{k}") == 1, k).otherwise(how)
    return wanted.select("wanted").join(counts, "wanted", "left").select("wanted", found.alias("id"), how.alias("how"))


def explain(graph: PropertyGraph) -> DataFrame:
    """Incident relationships of every node: (id, direction, type, n)."""
    ends = graph.edges.select("type", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction")))).alias("e"))
    return ends.groupBy("e.id", "e.direction", "type").agg(F.count(F.lit(1)).alias("n"))


def greedy_cuts(items: DataFrame, capacity: int, by: str, order: str, size: str, *, separator: int = 0, name: str = "page") -> DataFrame:
    """Numbers of greedily filled pages: an item that no longer fits opens the next page of its group.

    Sizes are summed in the order of ``order`` (ties: the smaller size first), ``separator``
    lying between two items of a page; an item larger than ``capacity`` has a page of its
    own. Where a page ends depends on all before it, so a group is one stream: its rows are
    sorted on disk by the shuffle and pass through in Arrow batches, of which a task keeps a
    running sum and no rows. Null sizes count as 0; columns but the three named are dropped.
    """
    kinds = dict(items.dtypes)

    def cut(batches):
        at, used, page = (), 0, 0
        for batch in batches:
            pages = []
            for group, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                n = n or 0
                if (group,) != at:
                    at, used, page = (group,), n, 0
                elif used + separator + n > capacity:
                    used, page = n, page + 1
                else:
                    used += separator + n
                pages.append(page)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.int64())], names=[by, order, size, name])

    streams = items.select(by, order, size).repartition(by).sortWithinPartitions(by, order, size)
    return streams.mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in (by, order, size)) + f", `{name}` bigint")


def text_pages(lines: DataFrame, budget: int, by: str, order: str, chars: str, *, overhead: int = 0) -> DataFrame:
    """Pages of a listing within a budget of tokens: three characters a token, less ``overhead``, a break between lines."""
    return greedy_cuts(lines, max(1, budget * 3 - overhead), by, order, chars, separator=1)
