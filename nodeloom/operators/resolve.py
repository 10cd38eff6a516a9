"""Resolution after extraction: duplicate nodes, member calls through inheritance, framework routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import closure


def doc_twins(nodes: DataFrame) -> DataFrame:
    """(id, winner): a document's node ``x`` is replaced by ``x_doc`` of the same file, where both are documents.

    ``nodes(id, source_file, kind)``; nodes without a file have no twin.
    """
    docs = nodes.where("lower(kind) = 'document' and source_file != ''").select("id", "source_file")
    twins = docs.where(F.endswith("id", F.lit("_doc"))).select(F.col("id").alias("winner"), F.expr("substring(id, 1, length(id) - 4)").alias("id"), "source_file")
    return docs.join(twins, ["id", "source_file"]).select("id", "winner")


def ghost_duplicates(nodes: DataFrame, keys: tuple[str, ...] = ("source_file", "kind", "qualified_name")) -> DataFrame:
    """(id, winner): nodes not read from syntax whose identity belongs to exactly one node that was.

    ``nodes(id, origin, *keys)``; an identity with a null or empty part matches nothing.
    """
    whole = nodes.select("id", "origin", *keys)
    for k in keys:
        whole = whole.where(F.col(k) != "")
    is_ast = F.coalesce(F.lower("origin") == "ast", F.lit(False))
    only = whole.where(is_ast).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("winner")).where("n = 1")
    return whole.where(~is_ast).join(only, list(keys)).where("id != winner").select("id", "winner")


def member_calls(calls: DataFrame, types: DataFrame, members: DataFrame, supers: DataFrame) -> DataFrame:
    """(call_id, target, how): calls on a receiver of a named type, resolved through inheritance.

    ``calls(call_id, receiver, member, family)``, ``types(type_id, name, family)``,
    ``members(type_id, member, id)``, ``supers(type_id, super_id)``. The receiver's name must
    belong to one type of its language family; the member is looked for there, then in ever
    further super types, and must stand once at the nearest distance that has it. Names are
    only ever counted, so one that many types share is no burden; cycles of inheritance end.
    """
    named = types.groupBy("name", "family").agg(F.count_distinct("type_id").alias("n"), F.min("type_id").alias("type_id"))
    asked = calls.join(named.withColumnRenamed("name", "receiver"), ["receiver", "family"], "left")
    one = asked.where("n = 1").select("call_id", "member", "type_id")
    steps = supers.select(F.col("type_id").alias("here"), F.col("super_id").alias("there"), F.lit("").alias("eid"), F.lit("EXTENDS").alias("type")).where("here is not null and there is not null").distinct()
    start = one.select(F.col("type_id").alias("root"), F.col("type_id").alias("node")).distinct()
    above = closure(steps, start, None).select(F.col("root").alias("type_id"), F.col("node").alias("holder"), "depth")
    wanted = one.select("type_id", "member").distinct()
    held = wanted.join(above, "type_id").join(members.select(F.col("type_id").alias("holder"), "member", F.col("id").alias("target")), ["holder", "member"])
    near = held.groupBy("type_id", "member", "depth").agg(F.count_distinct("target").alias("k"), F.min("target").alias("target")).groupBy("type_id", "member").agg(F.min(F.struct("depth", "k", "target")).alias("m"))
    found = asked.join(near, ["type_id", "member"], "left")
    how = F.when(F.col("n").isNull(), "unknown_type").when(F.col("n") > 1, "ambiguous_type").when(F.col("m").isNull(), "missing_member").when(F.col("m.k") > 1, "ambiguous_member").when(F.col("m.depth") == 0, "own").otherwise("inherited")
    return found.select("call_id", F.when(how.isin("own", "inherited"), F.col("m.target")).alias("target"), how.alias("how"))


def _of(text, name: str):
    return F.get_json_object(text, f"$.{name}")


def route_facts(links: DataFrame) -> DataFrame:
    """(link_id, source, operation, path, reference, target) of every handler in the route details of links.

    ``links(id, source, attributes)``. Paths lose a closing slash, and parameters of any
    spelling (``{x}``, ``:x``, ``<x>``) become ``{}``. A single stage counts as a list of
    one; unreadable details give nothing.
    """
    detail = F.from_json("attributes", "details string")["details"]
    facts = links.select(F.col("id").alias("link_id"), "source", detail.alias("d")).where(_of(F.col("d"), "type") == "route")
    path = F.regexp_replace(F.regexp_replace(_of(F.col("d"), "data.path"), r"\{[^}]*\}|<[^>]*>|:[A-Za-z_][A-Za-z0-9_]*", "{}"), r"(.)/+$", "$1")
    stages = _of(F.col("d"), "data.stages")
    listed = F.when(stages.startswith("["), F.from_json(stages, "array<string>")).when(stages.startswith("{"), F.array(stages))
    each = facts.select("link_id", "source", F.upper(_of(F.col("d"), "data.operation")).alias("operation"), path.alias("path"), F.explode(listed).alias("s"))
    return each.where(_of(F.col("s"), "stage") == "handler").select("link_id", "source", "operation", "path", _of(F.col("s"), "reference").alias("reference"), _of(F.col("s"), "target").alias("target")).distinct()


def resolve_routes(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facts`` with (handler, resolution): the stated target if it is a node, else the only node of the referenced name in the repository.

    ``nodes(id, node_label, repo)``; several such nodes make a route ambiguous, none unresolved.
    """
    by_id = nodes.select(F.col("id").alias("target"), F.lit(True).alias("_known"))
    home = nodes.select(F.col("id").alias("source"), F.col("repo").alias("_repo"))
    names = nodes.groupBy(F.col("repo").alias("_repo"), F.col("node_label").alias("reference")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_one"))
    all_ = facts.join(by_id, "target", "left").join(home, "source", "left").join(names, ["_repo", "reference"], "left")
    how = F.when(F.col("_known"), "exact").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return all_.select("link_id", "operation", "path", "reference", F.when(F.col("_known"), F.col("target")).when(F.col("_n") == 1, F.col("_one")).alias("handler"), how.alias("resolution"))
