"""Further graph checks: validation, hyperedges, resolution states, evidence gaps, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..text import tokens as tk
from . import analytics as an

#: Language families that share names across their languages.
FAMILIES = {"javascript": "web", "typescript": "web", "tsx": "web", "vue": "web", "svelte": "web", "c": "native", "cpp": "native", "objc": "native", "java": "jvm", "kotlin": "jvm", "scala": "jvm", "groovy": "jvm"}
#: Scores of the lexical ranking.
NAME, QUALIFIED, IDENTITY, COVERAGE, SOURCE = (180_000.0, 90_000.0, 8_000.0), (160_000.0, 64_000.0, 12_000.0), 200_000.0, 95_000.0, 1_500.0
#: Priority of recall channels.
CHANNELS = {"exact_id": 6, "exact_name": 5, "term": 3, "fuzzy": 1}


def quarantine(nodes: DataFrame) -> DataFrame:
    """(id, reason) of records that break a rule; the first broken rule counts."""
    reason = F.when(F.col("id").isNull() | (F.col("id") == ""), "no id").when(F.col("kind").isNull() | ~F.lower("kind").rlike("^[a-z][a-z0-9_]*$"), "unknown kind").when(F.col("start_line") > F.col("end_line"), "lines reversed").when(F.col("start_line") < 0, "negative line")
    return nodes.select("id", reason.alias("reason")).where("reason is not null")


def family(lang: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), lang), lang)


def phantom_edges(graph: PropertyGraph, types: tuple[str, ...] = ("CALLS", "REFERENCES")) -> DataFrame:
    """Edges between own nodes of unrelated languages, which name resolution should not have made."""
    n = lambda k, p: graph.nodes.where("repo is not null and lang is not null").select(F.col("id").alias(k), family(F.col("lang")).alias(p))
    e = graph.edges.where(F.col("type").isin(*types))
    return e.join(n("src", "x"), "src").join(n("dst", "y"), "dst").where("x != y").select("eid", "src", "dst", "type")


def hyperedges(raw: DataFrame, remap: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, members): n-ary relations with canonical members in first-seen order.

    ``raw(id, nodes, members, node_ids)``: the first alias that is a list counts, and alias
    lists lose repeats; members are remapped, unknown ones dropped, relations of fewer than
    two members left out.
    """
    chosen = F.coalesce("nodes", F.array_distinct("members"), F.array_distinct("node_ids"))
    each = raw.select("id", F.posexplode(chosen).alias("k", "member"))
    mapped = each.join(remap.select(F.col("id").alias("member"), "winner"), "member", "left").select("id", "k", F.coalesce("winner", "member").alias("member"))
    known = mapped.join(nodes.select(F.col("id").alias("member")), "member", "left_semi")
    per = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "member"))).alias("ms"))
    return per.select("id", F.transform("ms", lambda m: m["member"]).alias("members")).where(F.size("members") >= 2)


def call_resolution(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, resolution): unresolved if the target is unknown, inferred if deferred, else resolved."""
    calls = links.where("lower(trim(kind)) = 'calls' and target is not null").groupBy("id").agg(F.min("target").alias("target"), F.bool_or("is_deferred").alias("deferred"))
    known = nodes.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "unresolved").when(F.col("deferred"), "inferred").otherwise("resolved")
    return calls.join(known, "target", "left").select("id", state.alias("resolution"))


def majority(nodes: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the most frequent value of each group, ties to the smaller value."""
    counts = nodes.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def verification_gaps(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed nodes that no test relationship leads to: (id)."""
    tested = edges.where("type = 'TESTS'").select(F.col("dst").alias("id")).distinct()
    return changed.select("id").distinct().join(tested, "id", "left_anti")


def feature_groups(findings: DataFrame) -> DataFrame:
    """(id, feature): findings that share a source file, directly or through others."""
    links = findings.where("source_file is not null").select(F.concat(F.lit("n:"), "id").alias("a"), F.concat(F.lit("f:"), "source_file").alias("b")).distinct()
    groups = an.components(links).where(F.startswith("id", F.lit("n:")))
    least = groups.groupBy("component").agg(F.min("id").alias("least"))
    return groups.join(least, "component").select(F.substring("id", 3, 1 << 20).alias("id"), F.substring("least", 3, 1 << 20).alias("feature"))


def lexical_score(nodes: DataFrame, question: str, terms: list[str]) -> DataFrame:
    """(id, score) by the fixed points for names, qualified names, ids, covered terms and files."""
    q = question.strip().lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    tiers = lambda c, points: F.when(c == q, points[0]).when(c.startswith(q), points[1]).when(c.contains(q), points[2]).otherwise(0.0)
    name, qualified, ident, source = low("node_label"), low("qualified_name"), low("id"), low("source_file")
    score = (tiers(name, NAME) + tiers(qualified, QUALIFIED) + F.when(ident == q, IDENTITY).otherwise(0.0)) if q else F.lit(0.0)
    if terms:
        hit = lambda t: F.when(name.contains(t) | qualified.contains(t) | ident.contains(t), 1.0).otherwise(0.0)
        covered = hit(terms[0])
        for t in terms[1:]:
            covered = covered + hit(t)
        score = score + covered / len(terms) * COVERAGE
        for t in terms:
            score = score + F.when((source != "") & source.contains(t), SOURCE).otherwise(0.0)
    return nodes.select("id", F.round(score, 6).alias("score")).where("score > 0")


def recall_channels(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """(id, channel, priority): the best channel that recalls each node for a text.

    Exact id, exact name, shared term, and names one edit away.
    """
    q = text.strip().lower()
    name = tk.normalize_symbol(F.col("node_label"))
    shared = F.exists(tk.search_tokens(F.col("node_label")), lambda t: F.array_contains(F.transform(F.split(F.lit(q), r"\s+"), lambda w: w), t))
    channel = F.when(F.lower("id") == q, "exact_id").when(name == q, "exact_name").when(shared, "term").when((F.abs(F.length(name) - len(q)) <= 1) & (F.levenshtein(name, F.lit(q)) <= 1), "fuzzy")
    rank = F.lit(None)
    for c, p in CHANNELS.items():
        rank = F.when(F.col("channel") == c, p).otherwise(rank)
    return nodes.select("id", channel.alias("channel")).where("channel is not null").withColumn("priority", rank).orderBy(F.desc("priority"), "id").limit(limit)


def change_class(title: Column) -> Column:
    """Class of a change from the prefix of its title."""
    t = F.lower(F.trim(title))
    return F.when(t.rlike(r"^(fix|bug|hotfix)"), "fix").when(t.rlike(r"^(feat|add|implement)"), "feature").when(t.rlike(r"^(refactor|clean|rename|move)"), "refactor").when(t.rlike(r"^(doc|readme)"), "docs").when(t.rlike(r"^(test|spec)"), "test").otherwise("other")


def questions(graph: PropertyGraph) -> DataFrame:
    """(kind, subject, question): ambiguous links, bridges between communities, and isolated nodes."""
    m = an.communities(graph)
    cross = graph.edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("x")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("y")), "dst").where("x != y")
    bridges = cross.groupBy(F.col("src").alias("subject")).agg(F.count_distinct("y").alias("n")).where("n >= 4").select(F.lit("bridge").alias("kind"), "subject", F.concat(F.lit("Why does `"), "subject", F.lit("` connect "), F.col("n"), F.lit(" communities?")).alias("question"))
    d = graph.degrees()
    alone = d.where("degree <= 1").select(F.lit("isolated").alias("kind"), F.col("id").alias("subject"), F.concat(F.lit("What connects `"), "id", F.lit("` to the rest?")).alias("question"))
    out = bridges.unionByName(alone)
    if "confidence" in graph.edges.columns:
        label = lambda k, c: graph.nodes.select(F.col("id").alias(k), F.coalesce("node_label", F.lit("")).alias(c))
        doubt = graph.edges.where("confidence = 'AMBIGUOUS'").join(label("src", "x"), "src").join(label("dst", "y"), "dst")
        out = out.unionByName(doubt.select(F.lit("ambiguous_edge").alias("kind"), F.col("eid").alias("subject"), F.concat(F.lit("What is the exact relationship between `"), "x", F.lit("` and `"), "y", F.lit("`?")).alias("question")))
    return out


def split_large(graph: PropertyGraph, members: DataFrame, least: int = 10, share: float = 0.25, low: float = 0.05, size: int = 50) -> DataFrame:
    """(id, community): communities too large, or large and loose, divided by their own inner links."""
    e = an.simple_edges(graph)
    total = members.agg(F.count(F.lit(1)).alias("n")).scalar()
    c = an.cohesion(e, members)
    wide = c.where((F.col("size") > F.greatest(F.lit(least), F.floor(total * share))) | ((F.col("size") >= size) & (F.col("cohesion") < low))).select("community")
    inside = members.join(wide, "community", "left_semi")
    inner = e.join(inside.select(F.col("id").alias("a"), F.col("community").alias("x")), "a").join(inside.select(F.col("id").alias("b"), F.col("community").alias("y")), "b").where("x = y").select("a", "b")
    parts = an.louvain(inner).withColumnRenamed("community", "part")
    return members.join(parts, "id", "left").select("id", F.concat_ws("/", F.col("community").cast("string"), "part").alias("community"))
