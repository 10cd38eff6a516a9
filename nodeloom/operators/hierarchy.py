"""Parent-child links to full hierarchies by parallel tree contraction.

The forest is shrunk in rounds. A round rakes every leaf and splices out an independent
set of unary-chain nodes, each in the same pass, and records for every removed node the
surviving ancestor it hung from, the number of steps to it and (if asked for) the ids in
between. A cycle cannot be raked; its chain compresses until one node is its own parent,
which exposes it as a core. Undoing the recorded rounds backwards gives each node its
root, depth and path with one join a round. Rounds grow with the logarithm of the number
of nodes, not with the depth of the trees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import with_index
from ..runtime import Workspace

#: A round removes a constant share of the nodes, so even 2^60 nodes end far below this.
MAX_ROUNDS = 400
#: What a round makes of a node: it goes on, was recorded and taken out, or is the core of a cycle.
LIVE, GONE, CORE = 0, 1, 2


def resolve_hierarchy(edges: DataFrame, *, tree: str = "hierarchy", node: str = "node_id", parent: str = "parent_id", paths: bool = False) -> DataFrame:
    """Root and depth (and path) of every id at either end of ``edges``.

    ``edges`` has one row per link: the tree it belongs to, the child and its parent; other
    columns are ignored, so clashing names do no harm. Returns ``(hierarchy, node_id,
    root_id, node_depth)`` and, with ``paths``, ``path``: the ids from the root to the node.
    The nodes of all trees are numbered once in the order of their ids, so that the rounds
    compare, hash and shuffle eight bytes a node.

    Defined results: rows with a null end are dropped, repeated links count once, an empty
    string is an ordinary id, a child with several parents keeps the smallest parent id (the
    others are listed by :func:`conflicts`), a node on a cycle (a self-link is one) or below
    one has the cycle's smallest id as ``root_id``, -1 as ``node_depth`` and a null ``path``;
    an empty input gives no rows.
    """
    work = Workspace(edges.sparkSession, "hierarchy")
    given = work.stage(edges.select(F.col(tree).alias("t"), F.col(node).alias("child"), F.col(parent).alias("parent")).where("t is not null and child is not null and parent is not null").distinct())
    names = with_index(given.select("t", F.explode(F.array("child", "parent")).alias("id")).distinct(), "t", "id", name="no")
    number = lambda end, to: names.select("t", F.col("id").alias(end), F.col("no").alias(to))
    numbered = work.stage(given.join(number("child", "v"), ["t", "child"]).join(number("parent", "p"), ["t", "parent"]).select("v", "p", *([F.col("child").alias("vs"), F.col("parent").alias("ps")] if paths else [])))
    if paths:
        live = numbered.groupBy("v").agg(F.min("p").alias("p")).join(numbered, ["v", "p"]).withColumn("seg", F.array().cast("array<string>"))
    else:
        live = numbered.groupBy("v").agg(F.min("p").alias("p"))
    live, seen = work.stage_counted(live.withColumns({"w": F.lit(1).cast("bigint"), "low": F.lit(None).cast("bigint")}), n=F.count(F.lit(1)))
    first, left, rounds = live, seen["n"], []
    for k in range(MAX_ROUNDS):
        if not left:
            break
        state, seen = work.stage_counted(_round(live, k, paths), n=F.count_if(F.col("fate") == LIVE))
        rounds.append(state)
        live, left = state.where(F.col("fate") == LIVE).drop("fate"), seen["n"]
    else:
        raise RuntimeError("tree contraction did not end")

    none = F.lit(None).cast("array<string>").alias("path")
    kept = ["v", "root", "depth"] + (["path"] if paths else [])
    done = None
    if rounds:
        # the cores of all rounds come first: what hangs on one may have left in the same round
        cores = reduce(DataFrame.unionByName, [state.where(F.col("fate") == CORE) for state in rounds])
        done = work.stage(cores.select("v", F.least("v", "low").alias("root"), F.lit(-1).cast("bigint").alias("depth"), *([none] if paths else [])))
    for state in reversed(rounds):
        above = done.select(F.col("v").alias("p"), F.col("root").alias("r"), F.col("depth").alias("d"), *([F.col("path").alias("up")] if paths else []))
        depth = F.when(F.col("r").isNull(), F.col("w")).when(F.col("d") < 0, F.lit(-1).cast("bigint")).otherwise(F.col("d") + F.col("w"))
        path = F.when(F.col("d") < 0, F.lit(None)).otherwise(F.concat(F.coalesce("up", F.array("ps")), "seg", F.array("vs"))) if paths else None
        part = state.where(F.col("fate") == GONE).join(above, "p", "left").select("v", F.coalesce("r", "p").alias("root"), depth.alias("depth"), *([path.alias("path")] if paths else []))
        done = done.unionByName(work.stage(part.select(kept)))

    # ids that stand only in the parent column are roots
    top = numbered.select(F.col("p").alias("v"), *([F.col("ps").alias("vs")] if paths else [])).distinct().join(first.select("v"), "v", "left_anti")
    roots = top.select("v", F.col("v").alias("root"), F.lit(0).cast("bigint").alias("depth"), *([F.array("vs").alias("path")] if paths else []))
    out = roots if done is None else done.unionByName(roots)
    out = out.join(names.select(F.col("no").alias("v"), F.col("t").alias("hierarchy"), F.col("id").alias("node_id")), "v").join(names.select(F.col("no").alias("root"), F.col("id").alias("root_id")), "root")
    return out.select("hierarchy", "node_id", "root_id", F.col("depth").alias("node_depth"), *(["path"] if paths else []))


def _round(live: DataFrame, k: int, paths: bool) -> DataFrame:
    """One rake-and-compress pass; ``fate`` tells what becomes of each node.

    Children are counted per parent with a map-side combine, so a parent of a third of all
    nodes costs one partial row per task. A chain node is spliced if its hash of this round
    is below those of its parent and its only child: no two neighbours can both be spliced,
    so every recorded ancestor survives the round.
    """
    counts = live.groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("kids"), F.min("v").alias("kid"))
    seen = live.join(counts, "v", "left")
    rank = lambda c: F.xxhash64(F.lit(k), F.col(c))
    spliced = (F.col("kids") == 1) & (F.col("v") != F.col("p")) & (rank("v") < rank("p")) & (rank("v") < rank("kid"))
    cut = seen.where(spliced).select(F.col("kid").alias("v"), F.col("v").alias("mid"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("low").alias("low2"), *([F.col("vs").alias("mids"), F.col("ps").alias("ps2"), F.col("seg").alias("seg2")] if paths else []))
    both = seen.join(cut, "v", "left")
    fate = F.when(F.col("v") == F.col("p"), CORE).when(F.col("kids").isNull() | spliced, GONE).otherwise(LIVE)
    hit = F.col("mid").isNotNull()
    words = ["vs", F.coalesce("ps2", "ps").alias("ps"), F.when(hit, F.concat("seg2", F.array("mids"), "seg")).otherwise(F.col("seg")).alias("seg")]
    return both.select(
        "v",
        F.coalesce("p2", "p").alias("p"),
        (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
        F.when(hit, F.least("low", "low2", "mid")).otherwise(F.col("low")).alias("low"),
        *(words if paths else []),
        fate.alias("fate"),
    )


def conflicts(edges: DataFrame, *, tree: str = "hierarchy", node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Links that a tree cannot hold: (hierarchy, node_id, kept_parent_id, dropped_parent_id).

    A child with several parents keeps the smallest; each other parent gives a row. Rows with
    a null end are no links, repeated links count once.
    """
    given = edges.select(F.col(tree).alias("hierarchy"), F.col(node).alias("node_id"), F.col(parent).alias("dropped_parent_id")).dropna().distinct()
    kept = given.groupBy("hierarchy", "node_id").agg(F.min("dropped_parent_id").alias("kept_parent_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return given.join(kept, ["hierarchy", "node_id"]).where("dropped_parent_id != kept_parent_id").select("hierarchy", "node_id", "kept_parent_id", "dropped_parent_id")


def descendants(resolved: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair with the steps between them, from resolved paths.

    The output is as large as the summed depths, which is the size of the closure itself.
    Nodes on or below a cycle have no path and give no pairs.
    """
    return resolved.where("node_depth > 0").select("hierarchy", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id"), "node_id", "node_depth").select("hierarchy", "ancestor_id", "node_id", (F.col("node_depth") - F.col("at")).alias("steps"))


def link_hierarchies(links: DataFrame) -> DataFrame:
    """The containment and inheritance links of a link table as (hierarchy, node_id, parent_id).

    ``kind`` is compared without letter case and outer blanks; ``contains`` points from the
    parent to the child, ``extends`` from the child to the parent.
    """
    kind = F.lower(F.trim("kind"))
    return links.where(kind.isin("contains", "extends") & F.col("source").isNotNull() & F.col("target").isNotNull()).select(
        kind.alias("hierarchy"),
        F.when(kind == "contains", F.col("target")).otherwise(F.col("source")).alias("node_id"),
        F.when(kind == "contains", F.col("source")).otherwise(F.col("target")).alias("parent_id"),
    )
