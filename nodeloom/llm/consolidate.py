"""Pairwise matches to groups by seed-tree pruning.

Each round every vertex points its neighbours to the smallest id it sees. A vertex that no
longer is anyone's minimum drops out and hangs below its own minimum in a propagation
forest; only the minima go on, linked to each other. When no links are left, the remaining
vertices are the seeds of their groups, and the seeds flow down the forest, one round back
at a time. Hubs shrink first, so a group that holds a third of all pairs collapses in a
few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import with_index
from ..runtime import Workspace

MAX_ROUNDS = 200


def connected_groups(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """``(group_id, record_id)`` for every record of a pair; ``group_id`` is its group's smallest id.

    Defined results: pairs with a null end or equal ends are no links (a record only in
    such pairs has no row); order and repetition of pairs do not matter; an empty string is
    an ordinary id; an empty input gives no rows. Other columns are ignored.
    """
    work = Workspace(pairs.sparkSession, "groups")
    given = work.stage(pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b").distinct())
    # ids are numbered once in their own order, so that rounds compare and hash eight bytes instead of texts
    names = with_index(given.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", name="no")
    number = lambda end, to: names.select(F.col("id").alias(end), F.col("no").alias(to))
    links = given.join(number("a", "x"), "a").join(number("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    graph, seen = work.stage_counted(_both_ways(links).distinct(), n=F.count(F.lit(1)))
    left_over, forest, seeds = seen["n"], [], None
    for _ in range(MAX_ROUNDS):
        if not left_over:
            break
        # seed identification: u tells all of its neighbours, and itself, the least id it sees
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = graph.join(least, "u").select(F.col("v").alias("w"), F.col("m").alias("x")).unionByName(least.select(F.col("u").alias("w"), F.col("m").alias("x"))).distinct()
        told = work.stage(told)
        own = work.stage(told.groupBy("w").agg(F.min("x").alias("m"), F.max(F.col("x") == F.col("w")).alias("stays")))
        forest.append(own.where("not stays").select("w", "m"))
        # pruning: what w was told is linked to the least of it
        rest = told.join(own, "w").where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        graph, seen = work.stage_counted(_both_ways(rest).distinct(), n=F.count(F.lit(1)))
        left_over = seen["n"]
        # a minimum that is linked to no other is a seed
        alone = own.where("stays and w = m").select(F.col("w").alias("seed"), F.col("w").alias("no"))
        alone = alone.join(graph.select(F.col("u").alias("no")).distinct(), "no", "left_anti").select("seed", "no")
        seeds = alone if seeds is None else seeds.unionByName(alone)
    else:
        raise RuntimeError("seed-tree pruning did not end")
    if seeds is None:
        return names.select(F.col("id").alias("group_id"), F.col("id").alias("record_id"))
    known = work.stage(seeds)
    for level in reversed(forest):
        found = work.stage(level.join(known.select(F.col("no").alias("m"), "seed"), "m").select("seed", F.col("w").alias("no")))
        known = known.unionByName(found)
    return known.join(number("record_id", "no"), "no").join(number("group_id", "seed"), "seed").select("group_id", "record_id")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def matched_pairs(judged: DataFrame, at_least: float = 92.0) -> DataFrame:
    """The pairs that count: any judgement of theirs scores ``at_least`` (null scores never do)."""
    return judged.where((F.col("score") >= at_least) & ~F.isnan("score") & (F.col("left_id") != F.col("right_id"))).select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()


def fuzzy_merges(groups: DataFrame) -> DataFrame:
    """(groups, records, merges): a group of n records is n - 1 merges."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merges"))
