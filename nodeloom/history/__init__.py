"""Versioned graphs: structural diffs, trends, contract and behaviour changes, risk, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import projected_json
from ..operators.snapshots import content_hash, snapshot_changes

#: Points per finding and their cap, by factor.
RISK = {
    "public_contract_change": (20, 40),
    "affected_consumer": (4, 24),
    "cross_boundary_impact": (10, 20),
    "cycle": (20, 20),
    "weak_confidence_witness": (4, 16),
    "verification_gap": (12, 36),
    "incomplete_evidence": (20, 20),
    "merge_conflict": (30, 30),
}
#: Base of the review priority by finding.
PRIORITY = {"contract": 1000, "behavior": 900, "dependency": 750, "impact": 700, "verification_gap": 300, "structural": 200}
#: Fields that do not change what a record means, at any depth: places, clustering, looks, digests.
IGNORED_FIELDS = frozenset((
    "anchor", "anchors", "color", "community", "communityName", "community_name", "endByte", "endColumn", "endLine", "end_byte", "end_column", "line_end", "line_start", "norm_label", "relationshipSite", "relationship_site",
    "sourceDigest", "source_file", "source_hash", "source_location", "startByte", "startColumn", "startLine", "start_byte", "start_column", "wiringSite", "wiring_site",
))
#: The columns that hold such fields.
IGNORED = ("source_file", "start_line", "end_line", "community_id")


def structural_changes(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """Changes of records without the ignored columns, and without the ignored fields inside ``attributes``."""
    return snapshot_changes(snapshots.drop(*IGNORED), versions, json_form=projected_json(IGNORED_FIELDS))


def graph_delta(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(repo, part, id, target, kind, change): new and removed nodes and edges.

    Each side is (nodes(repo, id), edges(repo, source, target, kind)) without repeats. Both
    sides meet in one aggregation; null ends and kinds equal each other.
    """
    none = F.lit(None).cast("string")

    def rows(side, mark):
        n, e = side
        parts = n.select("repo", F.lit("node").alias("part"), "id", none.alias("target"), none.alias("kind")).unionByName(e.select("repo", F.lit("edge").alias("part"), F.col("source").alias("id"), "target", "kind"))
        return parts.withColumn("mark", F.lit(mark))

    both = rows(before, -1).unionByName(rows(after, 1)).groupBy("repo", "part", "id", "target", "kind").agg(F.sum("mark").alias("d"))
    return both.where("d != 0").select("repo", "part", "id", "target", "kind", F.when(F.col("d") > 0, "new").otherwise("removed").alias("change"))


def delta_summary(delta: DataFrame) -> DataFrame:
    """(repo, summary): the counts of :func:`graph_delta` in words."""
    n = lambda part, change: F.count_if((F.col("part") == part) & (F.col("change") == change))
    words = F.concat(n("node", "new"), F.lit(" new nodes, "), n("edge", "new"), F.lit(" new edges, "), n("node", "removed"), F.lit(" nodes removed, "), n("edge", "removed"), F.lit(" edges removed"))
    return delta.groupBy("repo").agg(words.alias("summary"))


def sharing(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """(repo, version_no, shared, total): records of each version that the version before also holds unchanged.

    Every column but the delivery counts, JSON by its values; a repository's first version
    shares nothing.
    """
    content = sorted(c for c in snapshots.columns if c not in ("repo", "version_no", "id", "delivered_at"))
    h = F.struct(F.col("delivered_at").alias("at"), content_hash(snapshots, content, ("attributes",)).alias("h"))
    last = snapshots.where("id is not null").groupBy("repo", "version_no", "id").agg(F.max(h).alias("r")).select("repo", "version_no", "id", F.col("r.h").alias("h"))
    w = Window.partitionBy("repo").orderBy("version_no")
    order = versions.select("repo", "version_no").distinct().withColumn("before", F.lag("version_no").over(w))
    now = last.join(order, ["repo", "version_no"])
    then = last.select("repo", F.col("version_no").alias("before"), "id", F.col("h").alias("h2"))
    return now.join(then, ["repo", "before", "id"], "left").groupBy("repo", "version_no").agg(F.count_if(F.col("h") == F.col("h2")).alias("shared"), F.count(F.lit(1)).alias("total"))


def ancestry(versions: DataFrame) -> DataFrame:
    """Each version with its predecessor and age rank, newest first."""
    w = Window.partitionBy("repo").orderBy("version_no")
    return versions.select("repo", "version_no", "commit_id", F.lag("commit_id").over(w).alias("parent"), F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("version_no"))).cast("bigint").alias("newest"))


def trend(observations: DataFrame, versions: DataFrame) -> DataFrame:
    """(repo, id, first_seen, last_seen, n, active): active if seen in the newest version that has any."""
    seen = observations.select("repo", "version_no", "id").distinct()
    newest = seen.groupBy("repo").agg(F.max("version_no").alias("newest"))
    per = seen.groupBy("repo", "id").agg(F.min("version_no").alias("first_seen"), F.max("version_no").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return per.join(newest, "repo").select("repo", "id", "first_seen", "last_seen", "n", (F.col("last_seen") == F.col("newest")).alias("active"))


def invalidated(changed: DataFrame, calls_old: DataFrame, calls_new: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Changed symbols and all their transitive callers in the old and new calls: (id, depth)."""
    from ..operators.traverse import closure

    both = calls_old.select("src", "dst").unionByName(calls_new.select("src", "dst")).distinct()
    adjacency = both.select(F.col("dst").alias("here"), F.col("src").alias("there"), F.concat_ws(">", "src", "dst").alias("eid"), F.lit("CALLS").alias("type"))
    seeds = changed.select(F.lit("all").alias("root"), F.col("id").alias("node")).distinct()
    return closure(adjacency, seeds, max_depth).select(F.col("node").alias("id"), "depth")


def risk(findings: DataFrame, by: str) -> DataFrame:
    """(by, score, band) of ``findings(by, factor, n)``: capped points per factor, 100 at most."""
    points = F.lit(0)
    for factor, (each, cap) in RISK.items():
        points = F.when(F.col("factor") == factor, F.least(F.col("n") * each, F.lit(cap))).otherwise(points)
    total = findings.groupBy(by, "factor").agg(F.sum("n").alias("n")).withColumn("points", points).groupBy(by).agg(F.least(F.sum("points"), F.lit(100)).alias("score"))
    s = F.col("score")
    return total.withColumn("band", F.when(s <= 19, "low").when(s <= 44, "moderate").when(s <= 69, "high").otherwise("critical"))


def risk_factors(findings: DataFrame, by: Column) -> DataFrame:
    """(version, factor, n) of the findings of a comparison, for :func:`risk`.

    Broken contracts, consumers of what changed, findings without a test, and changes of
    behaviour that the evidence does not explain.
    """
    kinds = {
        "public_contract_change": F.count_if((F.col("finding") == "contract") & F.col("compatibility").isin("proven_break", "possible_break")),
        "affected_consumer": F.coalesce(F.sum(F.when(F.col("finding") != "verification_gap", F.col("consumers"))), F.lit(0)),
        "verification_gap": F.count_if(F.col("finding") == "verification_gap"),
        "incomplete_evidence": F.count_if(F.col("compatibility") == "indeterminate"),
    }
    per = findings.groupBy(by.alias("version")).agg(F.array(*[F.struct(F.lit(k).alias("factor"), c.alias("n")) for k, c in kinds.items()]).alias("fs"))
    return per.select("version", F.explode("fs").alias("f")).select("version", "f.*")


def priority(kind: Column, consumers: Column) -> Column:
    base = F.lit(0)
    for k, v in PRIORITY.items():
        base = F.when(kind == k, v).otherwise(base)
    return base + F.least(consumers, F.lit(100))


def changed_files(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """(changed, source_file): a file matches if equal, or if either is a path suffix of the other.

    Every path lists its suffixes, and equal entries meet; at least one side must be whole.
    """
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    a = changed.select(F.col("path").alias("changed"), F.explode(tails("path")).alias("key")).distinct()
    b = sources.select("source_file", F.explode(tails("source_file")).alias("key")).distinct()
    return a.join(b, "key").where((F.col("key") == F.col("changed")) | (F.col("key") == F.col("source_file"))).select("changed", "source_file").distinct()


def change_impact(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """(community, nodes, files) that changed files touch; ``matched(changed, source_file)`` of :func:`changed_files`. A file that several changes match counts once."""
    hit = matched.select("source_file").distinct()
    return nodes.join(hit, "source_file").groupBy(F.col("community_id").alias("community")).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("source_file").alias("files"))


def feedback(memories: DataFrame, now: str, half_life: float = 30.0, at_least: int = 2) -> DataFrame:
    """(subject, score, status) of ``memories(subject, outcome, at)`` with exponential decay.

    useful +1, dead_end and corrected -1, others 0; a null time weighs 1. Both signs make a
    subject contested; else at least ``at_least`` useful ones prefer it, fewer are tentative.
    """
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome").isin("dead_end", "corrected"), -1).otherwise(0)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 86400e6
    weight = F.coalesce(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life), F.lit(1.0))
    per = memories.groupBy("subject").agg(F.round(F.sum(sign * weight), 9).alias("score"), F.count_if(sign > 0).alias("pos"), F.count_if(sign < 0).alias("neg"))
    status = F.when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") >= at_least, "preferred").when(F.col("pos") > 0, "tentative").when(F.col("neg") > 0, "avoid").otherwise("neutral")
    return per.select("subject", "score", status.alias("status"))


# -- program summaries -----------------------------------------------------------------------

PARAMETER = "struct<name:string,kind:string,required:boolean,default_digest:string>"
OPERATION = "struct<kind:string,path:string,resolved_symbols:array<string>>"
FUNCTION_SCHEMA = f"symbol_id string, language string, visibility string, execution_mode string, return_type string, complete boolean, body_digest string, parameters array<{PARAMETER}>, operations array<{OPERATION}>"


def function_summaries(functions: DataFrame) -> DataFrame:
    """(symbol_id, resolved, unresolved, reads, writes): sorted distinct sets per function."""
    of = lambda k: F.filter("operations", lambda o: o["kind"] == k)
    paths = lambda k: F.array_sort(F.array_distinct(F.transform(of(k), lambda o: o["path"])))
    resolved = F.array_sort(F.array_distinct(F.flatten(F.transform(of("call"), lambda o: F.coalesce(o["resolved_symbols"], F.array().cast("array<string>"))))))
    unresolved = F.array_sort(F.array_distinct(F.transform(F.filter(of("call"), lambda o: F.coalesce(F.size(o["resolved_symbols"]), F.lit(0)) <= 0), lambda o: o["path"])))
    return functions.select("symbol_id", "body_digest", resolved.alias("resolved"), unresolved.alias("unresolved"), paths("read").alias("reads"), paths("write").alias("writes"))


def reverse_calls(summaries: DataFrame) -> DataFrame:
    """(callee, caller) of resolved calls, a row a pair, so that a hub is spread over its callers."""
    return summaries.select(F.col("symbol_id").alias("caller"), F.explode("resolved").alias("callee")).select("callee", "caller").distinct()


def contract_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol_id, compatibility) of functions whose contract changed.

    Narrowed visibility, another execution mode, a parameter removed, of another kind, newly
    required, or a new required one prove a break; another return type, or a renamed
    parameter in Python, may break; another default changes behaviour; other changes are
    compatible. Proof weakens to a possibility where a contract is incomplete.
    """
    fields = ["language", "visibility", "execution_mode", "return_type", "complete", "parameters"]
    n = new.select("symbol_id", *[F.col(c).alias(f"n_{c}") for c in fields])
    both = old.select("symbol_id", *fields).join(n, "symbol_id")
    level = lambda c: F.when(F.col(c) == "public", 2).when(F.col(c) == "internal", 1).otherwise(0)
    pairs = F.zip_with(F.slice("parameters", 1, F.least(F.size("parameters"), F.size("n_parameters"))), F.slice("n_parameters", 1, F.least(F.size("parameters"), F.size("n_parameters"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    some = lambda f: F.exists(pairs, lambda p: F.coalesce(f(p["a"], p["b"]), F.lit(False)))
    added = F.slice("n_parameters", F.size("parameters") + 1, F.greatest(F.lit(0), F.size("n_parameters") - F.size("parameters")))
    proven = (level("n_visibility") < level("visibility")) | (F.col("execution_mode") != F.col("n_execution_mode")) | (F.size("n_parameters") < F.size("parameters")) | some(lambda a, b: a["kind"] != b["kind"]) | some(lambda a, b: ~a["required"] & b["required"]) | F.exists(added, lambda p: p["required"])
    possible = ~F.col("return_type").eqNullSafe(F.col("n_return_type")) | ((F.col("language") == "python") & some(lambda a, b: a["name"] != b["name"]))
    behaves = some(lambda a, b: ~a["default_digest"].eqNullSafe(b["default_digest"]))
    other = some(lambda a, b: a["name"] != b["name"]) | (F.size(added) > 0)
    whole = F.col("complete") & F.col("n_complete")
    verdict = F.when(proven & whole, "proven_break").when(proven | possible, "possible_break").when(behaves, "behavioral").when(other, "compatible")
    return both.select("symbol_id", verdict.alias("compatibility")).where("compatibility is not null")


def behavior_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol_id, verdict, gained, lost): set differences of calls, reads and writes where bodies differ."""
    all_of = F.array_distinct(F.concat(F.transform("resolved", lambda x: F.concat(F.lit("call:"), x)), F.transform("reads", lambda x: F.concat(F.lit("read:"), x)), F.transform("writes", lambda x: F.concat(F.lit("write:"), x))))
    a, b = (function_summaries(x).select("symbol_id", F.col("body_digest").alias(f"{p}_digest"), all_of.alias(p)) for x, p in ((old, "o"), (new, "n")))
    both = a.join(b, "symbol_id").where("o_digest != n_digest")
    gained, lost = F.array_sort(F.array_except("n", "o")), F.array_sort(F.array_except("o", "n"))
    return both.select("symbol_id", F.when((F.size(gained) + F.size(lost)) == 0, "indeterminate").otherwise("changed").alias("verdict"), gained.alias("gained"), lost.alias("lost"))
