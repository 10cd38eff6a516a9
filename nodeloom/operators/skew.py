"""Per-key results over skewed keys by eager aggregation through joins.

Both inputs of a join are aggregated by the join key first (each with a map-side combine),
the compact states are joined one row to one row, and what the full join would have given
is then computed algebraically: its row count is the product of the counts, a sum of a
left column is the left sum times the right count. No row of the inputs meets the join, so
a key that holds a third of all rows costs one state row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace


def eager_join_states(left: DataFrame, right: DataFrame, on: list[str], *, left_by: tuple[str, ...] = (), left_aggs: dict | None = None, right_aggs: dict | None = None, sums: tuple[str, ...] = (), how: str = "left") -> DataFrame:
    """One row per key (and ``left_by`` group): states of both sides and the algebra of their join.

    ``left_aggs``/``right_aggs`` map a name to an aggregate of that side alone; ``sums``
    names left columns whose sum over the joined rows is wanted. Adds ``left_rows``,
    ``right_rows``, ``joined_rows`` and ``joined_sum_<column>``; rolling these up by any
    function of the keys gives what an aggregation of the full join would.

    Defined results: null keys match nothing but keep their own row (``how='left'``); a key
    without a partner has ``right_rows`` 0 and, as in an inner join, ``joined_rows`` 0; sums
    skip nulls and are 0 where nothing is summed; empty inputs give no rows. Only the named
    columns are read, so other columns of clashing names do no harm.
    """
    ls = left.groupBy(*left_by, *on).agg(F.count(F.lit(1)).alias("left_rows"), *[c.alias(n) for n, c in (left_aggs or {}).items()], *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{c}") for c in sums])
    rs = right.groupBy(*on).agg(F.count(F.lit(1)).alias("right_rows"), *[c.alias(n) for n, c in (right_aggs or {}).items()])
    n = F.coalesce("right_rows", F.lit(0))
    joined = {"right_rows": n, "joined_rows": F.coalesce("left_rows", F.lit(0)) * n} | {f"joined_sum_{c}": F.col(f"_sum_{c}") * n for c in sums}
    return ls.join(rs, on, how).withColumns(joined).drop(*[f"_sum_{c}" for c in sums])


def link_ends(links: DataFrame) -> DataFrame:
    """Each link twice: (side, node_id, other_id, weight, observed_at, link_id)."""
    end = lambda side, here, there: F.struct(F.lit(side).alias("side"), F.col(here).alias("node_id"), F.col(there).alias("other_id"))
    return links.select(F.explode(F.array(end("source", "source", "target"), end("target", "target", "source"))).alias("e"), "weight", "observed_at", F.col("id").alias("link_id")).select("e.*", "weight", "observed_at", "link_id")


def id_profiles(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per side and id: link rows, distinct neighbours, latest link, and the join with nodes.

    Links are first reduced to one state per (side, id, neighbour), which spreads a hot id
    over its neighbours, then rolled up to the id, so distinct neighbours are an exact count
    of state rows instead of a set held in one task. Null ids are left out.
    """
    pairs = link_ends(links).where("node_id is not null").groupBy("side", "node_id", "other_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("observed_at", "link_id")).alias("latest"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    states = pairs.groupBy("side", "node_id").agg(F.sum("n").alias("link_rows"), F.count("other_id").alias("neighbours"), F.max("latest").alias("latest"), F.sum("weight").alias("weight"))
    known = nodes.where("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.count(F.lit(1)).alias("node_rows"))
    n = F.coalesce("node_rows", F.lit(0))
    return states.join(known, "node_id", "left").select("side", "node_id", "link_rows", "neighbours", F.col("latest.link_id").alias("latest_link"), F.col("latest.observed_at").alias("latest_at"), F.round("weight", 4).alias("weight"), n.alias("node_rows"), (F.col("link_rows") * n).alias("joined_rows"))


def heavy_ids(links: DataFrame, nodes: DataFrame, share: float = 0.01) -> DataFrame:
    """(side, node_id) of each non-null id that stands in at least ``share`` of all link rows.

    The joined states of :func:`link_states` are written once; which ids are heavy, and the
    total they are measured by, are read from that table, so the links are scanned once.
    Every link row counts as delivered, redeliveries included; an empty table gives no rows.
    """
    states = Workspace(links.sparkSession, "skew").stage(link_states(links, nodes))
    total = states.where("side = 'target'").agg(F.sum("left_rows").alias("n"))
    return states.where(F.col("node_id").isNotNull() & (F.col("left_rows") >= F.lit(share) * total.scalar())).select("side", "node_id")


def link_states(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """States of the join of both link ends with the node deliveries of that id."""
    return eager_join_states(link_ends(links), nodes.select(F.col("id").alias("node_id")), ["node_id"], left_by=("side",), sums=("weight",))
