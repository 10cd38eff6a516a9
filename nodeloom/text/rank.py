"""Lexical retrieval over nodes: postings, BM25, tiered scoring and relevance metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace
from . import tokens as tk

#: BM25 constants and field weights.
K1, B = 1.2, 0.75
FIELDS = {"node_label": 4.0, "qualified_name": 3.0, "kind": 1.0, "source_file": 0.5}
#: Scores of the full-scan ranker.
EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5


def postings(nodes: DataFrame) -> DataFrame:
    """(id, term, tf, length): weighted term frequency, and the node's number of tokens."""
    field = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), tk.search_tokens(F.coalesce(F.col(c), F.lit(""))).alias("ts")) for c, w in FIELDS.items()]))
    flat = nodes.select("id", field.alias("f")).select("id", "f.w", F.explode("f.ts").alias("term")).groupBy("id", "term").agg(F.sum("w").alias("tf"), F.count(F.lit(1)).alias("n"))
    lengths = flat.groupBy("id").agg(F.sum("n").alias("length"))
    return flat.join(lengths, "id").select("id", "term", "tf", "length")


@dataclass(frozen=True)
class Index:
    """The postings of nodes, written by term so that a question reads the row groups of its terms; and how many nodes there are, and how long."""

    postings: DataFrame
    n: int
    avg: float


def build_index(nodes: DataFrame) -> Index:
    p = Workspace(nodes.sparkSession, "postings").stage(postings(nodes).repartition("term").sortWithinPartitions("term"))
    docs = p.select("id", "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
    return Index(p, docs.n, docs.avg or 0.0)


def _term_scores(nodes: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, id, part): what each term adds to a node's score."""
    index = nodes if isinstance(nodes, Index) else build_index(nodes)
    terms = queries.select("query_id", F.explode(F.array_distinct(tk.query_terms(F.col("text")))).alias("term"))
    p = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = terms.join(df, "term").join(p, "term")
    n, avg = F.lit(index.n), F.lit(index.avg)
    part = tk.idf(n, F.col("df")) * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest(avg, F.lit(1.0)))))
    return hits.select("query_id", "term", "id", F.round(part, 9).alias("part"))


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id", "term").agg(F.min(F.struct((-F.col("part")).alias("p"), F.col("id").alias("id"))).alias("m")).select("query_id", "term", F.col("m.id").alias("id"), (-F.col("m.p")).alias("score"))


def best_per_term(nodes: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, id, score): the best node of each query term, ties by id."""
    return _best(_term_scores(nodes, queries))


def bm25(nodes: DataFrame | Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank) for ``queries(query_id, text)``.

    The best node of each query term is pinned: pinned nodes take places first, the rest
    follow by score, and the chosen ones are ranked by score, ties by id.
    """
    scored = _term_scores(nodes, queries)
    best = _best(scored).select("query_id", "id", F.lit(1).alias("pinned")).distinct()
    total = scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("pinned", F.lit(0))), F.desc("score"), "id")
    chosen = total.join(best, ["query_id", "id"], "left").withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    return chosen.select("query_id", "id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("bigint").alias("rank"))


def seeds(ranked: DataFrame, nodes: DataFrame, gap: float = 0.5, most: int = 3) -> DataFrame:
    """(query_id, id, seed): ranked nodes within ``gap`` of the best, one per name, at most ``most``."""
    named = ranked.join(nodes.select("id", F.lower("node_label").alias("name")), "id").withColumn("top", F.first("score").over(Window.partitionBy("query_id").orderBy("rank")))
    near = named.where(F.col("score") >= gap * F.col("top")).withColumn("k", F.row_number().over(Window.partitionBy("query_id", "name").orderBy("rank"))).where("k = 1")
    return near.withColumn("seed", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint")).where(F.col("seed") <= most).select("query_id", "id", "seed")


def _scanned(nodes: DataFrame, queries: DataFrame) -> tuple[DataFrame, F.Column, F.Column, F.Column]:
    """Every (query_id, term, id, name) that a term of a question hits, with its weight, its tier and its plain points."""
    name = tk.normalize_label(F.col("node_label"))
    docs = nodes.select("id", name.alias("name"), F.lower(F.coalesce("source_file", F.lit(""))).alias("file"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tk.query_terms(F.col("text")))).alias("term"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = terms.select("term").distinct().collect()  # a question has a handful of terms
    found = [F.when(F.contains(F.col("name"), F.lit(r.term)) | F.contains(F.col("file"), F.lit(r.term)), F.lit(r.term)) for r in rows]
    hit = docs.withColumn("term", F.explode(F.filter(F.array(*found) if found else F.array().cast("array<string>"), lambda x: x.isNotNull())))
    df = hit.where(F.contains("name", "term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.ln(1 + n / (1 + F.coalesce("df", F.lit(0))))
    tier = F.when(F.col("name") == F.col("term"), EXACT).when(F.startswith("name", "term"), PREFIX).otherwise(0.0)
    inner = F.when((tier == 0) & F.contains("name", "term"), SUBSTRING).otherwise(0.0) + F.when(F.contains("file", "term"), SOURCE).otherwise(0.0)
    return terms.join(hit, "term").join(df, "term", "left"), w, tier, inner


def best_by_scan(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, term, id, score): the best node of each term by the scan's tiers, ties to shorter names, then ids."""
    hits, w, tier, inner = _scanned(nodes, queries)
    scored = hits.select("query_id", "term", "id", F.length("name").alias("size"), F.round((tier + inner) * w, 6).alias("score"))
    best = scored.groupBy("query_id", "term").agg(F.min(F.struct((-F.col("score")).alias("s"), "size", "id")).alias("m"))
    return best.select("query_id", "term", F.col("m.id").alias("id"), (-F.col("m.s")).alias("score"))


def full_scan(nodes: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by exact, prefix and substring tiers of every node's name.

    Per term: exact 1000, prefix 100, substring 1, in the source file 0.5, each times
    ln(1 + N / (1 + df)); the tiers are scaled by the squared share of matched terms, and a
    name that matches the whole question counts ten times. Queries are a stated set; their
    terms meet the nodes through a join on nothing, as every node is scored.
    """
    asked = queries.select("query_id", F.array_distinct(tk.query_terms(F.col("text"))).alias("ts")).select("query_id", F.size("ts").alias("k"), F.array_join("ts", " ").alias("whole"))
    hits, w, tier, inner = _scanned(nodes, queries)
    per = hits.groupBy("query_id", "id", "name").agg(F.sum(tier * w).alias("tiers"), F.sum(inner * w).alias("flat"), F.count_if(F.contains("name", "term")).alias("matched"), F.greatest(F.lit(1.0), F.max(w)).alias("weight"))
    whole = F.when(F.col("name") == F.col("whole"), EXACT * 10 * F.col("weight")).when(F.startswith("name", "whole"), PREFIX * 10 * F.col("weight")).otherwise(0.0)
    score = F.round(whole + F.col("flat") + F.col("tiers") * (F.col("matched") / F.col("k")) ** 2, 6)
    out = per.join(asked, "query_id").select("query_id", "id", score.alias("score"), F.length("name").alias("size"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "size", "id"))
    return out.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def callee_recall(edges: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, covered): callers whose direct callees' names cover terms of the question."""
    names = nodes.select(F.col("id").alias("dst"), F.explode(F.array_distinct(tk.search_tokens(F.col("node_label")))).alias("term"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tk.query_terms(F.col("text")))).alias("term"))
    calls = edges.where("type = 'CALLS'").select("src", "dst").distinct()
    hit = terms.join(names, "term").join(calls, "dst").select("query_id", F.col("src").alias("id"), "term").distinct()
    return hit.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("covered"))


def fuzzy_variants(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, variant): vocabulary terms one edit away, found through deletion neighbours.

    Both sides list each term and what is left when one letter is dropped; equal entries are
    candidates, which the edit distance confirms, so no term meets the whole vocabulary.
    """
    cut = lambda c: F.explode(F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))))
    a = terms.select("term").where("length(term) > 2").distinct().withColumn("key", cut("term"))
    b = vocabulary.select(F.col("term").alias("variant")).where("length(variant) > 1").distinct().withColumn("key", cut("variant"))
    return a.join(b, "key").where("term != variant").select("term", "variant").distinct().where(F.levenshtein("term", "variant") <= 1)


def relevance(results: DataFrame, judged: DataFrame) -> DataFrame:
    """Metrics per query: success@1, reciprocal rank@10, recall@5/20, precision@10, nDCG@10.

    ``results(query_id, id, rank)``, ``judged(query_id, id, grade)``; grades from 1 are
    relevant, the gain is 2^grade - 1, the discount log2(rank + 1).
    """
    rel = judged.where("grade >= 1")
    total = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sort_array(F.collect_list(F.pow(F.lit(2.0), F.col("grade")) - 1), asc=False).alias("gains"))
    ideal = F.aggregate(F.transform(F.slice("gains", 1, 10), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    hits = results.join(rel, ["query_id", "id"]).groupBy("query_id").agg(
        F.min("rank").alias("first"),
        *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in (5, 10, 20)],
        F.sum(F.when(F.col("rank") <= 10, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    z = lambda c: F.coalesce(c, F.lit(0))
    return total.join(hits, "query_id", "left").select(
        "query_id",
        F.when(F.col("first") == 1, 1).otherwise(0).alias("success_1"),
        F.round(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0), 6).alias("mrr_10"),
        F.round(z("at5") / F.col("relevant"), 6).alias("recall_5"),
        F.round(z("at20") / F.col("relevant"), 6).alias("recall_20"),
        F.round(z("at10") / 10, 6).alias("precision_10"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_10"),
    )


# -- seeds, channels and typed ranking --------------------------------------------------------

#: Words of one meaning, for ranking only.
PREDICATES = {
    "record": "persist", "save": "persist", "persist": "persist", "write": "persist", "written": "persist", "store": "persist", "storage": "persist", "put": "persist",
    "acquire": "acquire", "add": "add", "contain": "check", "contains": "check", "check": "check", "ready": "check",
    "build": "create", "construct": "create", "create": "create", "instantiate": "create", "change": "configure", "configure": "configure", "set": "configure",
    "compact": "compact", "convert": "convert", "to": "convert", "decode": "decode", "delete": "delete", "discover": "discover", "dispatch": "dispatch", "detect": "detect", "drain": "drain",
    "extract": "extract", "find": "find", "generate": "generate", "generated": "generate", "freeze": "freeze", "get": "read", "read": "read", "select": "read",
    "increment": "update", "update": "update", "handle": "execute", "execute": "execute", "run": "execute", "schedule": "execute", "invoke": "invoke", "iter": "iterate", "iterate": "iterate",
    "load": "load", "begin": "start", "enter": "start", "start": "start", "merge": "merge", "open": "open", "optimize": "optimize", "parse": "parse", "process": "process",
    "recognize": "recognize", "register": "register", "refresh": "refresh", "represent": "represent", "resolve": "resolve", "raise": "raise", "restore": "restore", "send": "send",
    "stop": "stop", "unfreeze": "unfreeze", "vacuum": "vacuum",
}
#: Rank of a node's kind as a seed.
SEED_KINDS = {4: ("method", "function", "constructor"), 3: ("class", "interface", "struct", "trait", "type_alias"), 2: ("module", "package", "namespace", "file"), 1: ("field", "parameter", "variable", "constant")}
#: Folders of tests and of what is not written by hand.
ASIDE = ("test", "tests", "testing", "fixtures", "vendor", "generated")
#: Priority of the channels by which a search recalls nodes, and the most that fuzzy names may bring.
CHANNELS = {"exact_id": 6, "exact_name": 5, "alias": 4, "term": 3, "relation": 2, "fuzzy": 1}
MOST_FUZZY = 16


def predicate(term):
    """The meaning that a term stands for, null if it is no predicate."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv]), term)


def seed_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, backed, kind_rank, aside, degree, size): what tells seeds of equal score apart.

    Whether a node has a source file, the rank of its kind, whether its file lies among tests
    or generated files, its links to nodes with a source file, and the length of its name.
    """
    rank = F.lit(0)
    for k, kinds in SEED_KINDS.items():
        rank = F.when(F.lower("kind").isin(*kinds), k).otherwise(rank)
    file = F.lower(F.coalesce("source_file", F.lit("")))
    last = F.substring_index(file, "/", -1)
    aside = F.arrays_overlap(F.split(file, "/"), F.array(*map(F.lit, ASIDE))) | last.startswith("test_") | last.endswith("_test.go")
    backed = nodes.where("source_file != ''").select("id")
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    degree = ends.join(backed.withColumnRenamed("id", "other"), "other", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(degree, "id", "left").select("id", (file != "").alias("backed"), rank.alias("kind_rank"), aside.alias("aside"), F.coalesce("degree", F.lit(0)).alias("degree"), F.length(F.coalesce("node_label", F.lit(""))).alias("size"))


def order_seeds(scored: DataFrame, ranks: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): by score, then source-backed, kind, not aside, degree, short names, id."""
    order = [F.desc("score"), F.desc("backed"), F.desc("kind_rank"), "aside", F.desc("degree"), "size", "id"]
    got = scored.join(ranks, "id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint"))
    return got.where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def recall(nodes: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 200) -> DataFrame:
    """(query_id, id, channel, priority): what each of ``queries(query_id, text)`` recalls, by its best channel.

    Exact id; exact name; alias (the whole qualified name, or the name of a node that an
    ALIASES link leads to); a shared search term; a caller whose callees' names share a
    term; and, while fewer than ``limit`` nodes are found, names one edit away, at most 16.
    Names, ids and terms are joined by equality, edits through deletion neighbours.
    """
    q = queries.select("query_id", F.lower(F.trim("text")).alias("text"), F.array_distinct(tk.query_terms(F.col("text"))).alias("terms"))
    name = tk.normalize_symbol(F.coalesce("node_label", F.lit("")))
    n = nodes.select("id", F.lower("id").alias("low"), name.alias("name"), F.lower("qualified_name").alias("qualified"))
    asked = lambda c: q.select("query_id", F.col("text").alias(c))
    at = lambda df, c: df.select("query_id", "id", F.lit(c).alias("channel"))
    named = asked("name").join(n, "name")
    terms = q.select("query_id", F.explode("terms").alias("term"))
    held = nodes.select("id", F.explode(F.array_distinct(tk.search_tokens(F.coalesce("node_label", F.lit(""))))).alias("term"))
    by_term = terms.join(held, "term").select("query_id", "id").distinct()
    alias = edges.where("type = 'ALIASES'").select(F.col("src").alias("alias"), F.col("dst").alias("id"))
    parts = [
        at(asked("low").join(n, "low"), "exact_id"),
        at(named, "exact_name"),
        at(asked("qualified").join(n, "qualified"), "alias"),
        at(named.join(alias, "id").select("query_id", F.col("alias").alias("id")), "alias"),
        at(by_term, "term"),
        at(by_term.withColumnRenamed("id", "dst").join(edges.where("type = 'CALLS'").select("src", "dst").distinct(), "dst").select("query_id", F.col("src").alias("id")), "relation"),
    ]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    weight = F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv])
    pool = pool.distinct().select("*", F.element_at(weight, F.col("channel")).alias("priority"))
    pool = Workspace(nodes.sparkSession, "recall").stage(pool)
    best = pool.groupBy("query_id", "id").agg(F.max(F.struct("priority", "channel")).alias("m")).select("query_id", "id", "m.channel", "m.priority")
    small = q.select("query_id", "text").join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < limit)
    close = fuzzy_variants(small.select(F.col("text").alias("term")), n.select(F.col("name").alias("term")))
    fuzzy = small.select("query_id", F.col("text").alias("term")).join(close, "term").join(n.select(F.col("name").alias("variant"), "id"), "variant").join(best.select("query_id", "id"), ["query_id", "id"], "left_anti")
    fuzzy = fuzzy.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("k") <= MOST_FUZZY)
    return best.unionByName(fuzzy.select("query_id", "id", F.lit("fuzzy").alias("channel"), F.lit(CHANNELS["fuzzy"]).alias("priority")))


def typed_rank(nodes: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 20, index: Index | None = None) -> DataFrame:
    """(query_id, id, tier, evidence, score, rank) of recalled nodes.

    Tiers: 6 exact id, 5 exact name, 4 two or more terms of the question in the name or in
    the names of what it calls, 2 one term or an alias, 1 one term among its callees, 0
    others. Within a tier the terms covered by callees count, then the BM25 score, then what
    tells seeds apart. Predicates of one meaning count as one term.
    """
    work = Workspace(nodes.sparkSession, "typed")
    found = work.stage(recall(nodes, edges, queries))
    meaning = lambda t: F.coalesce(predicate(t), t)
    terms = queries.select("query_id", F.explode(F.array_distinct(F.transform(tk.query_terms(F.col("text")), meaning))).alias("term"))
    names = work.stage(nodes.select("id", F.explode(F.array_distinct(F.transform(tk.search_tokens(F.coalesce("node_label", F.lit(""))), meaning))).alias("term")))
    direct = terms.join(names, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("direct"))
    calls = edges.where("type = 'CALLS'").select("src", "dst").distinct()
    below = terms.join(names.withColumnRenamed("id", "dst"), "term").join(calls, "dst").select("query_id", F.col("src").alias("id"), "term").distinct().groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("evidence"))
    score = _term_scores(index or nodes, queries).groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    z = lambda c: F.coalesce(c, F.lit(0))
    all_ = found.join(direct, ["query_id", "id"], "left").join(below, ["query_id", "id"], "left").join(score, ["query_id", "id"], "left").join(seed_rank(nodes, edges), "id")
    tier = F.when(F.col("channel") == "exact_id", 6).when(F.col("channel") == "exact_name", 5).when((z("direct") >= 2) | (z("evidence") >= 2), 4).when(F.col("channel").isin("alias", "term"), 2).when(z("evidence") == 1, 1).otherwise(0)
    got = all_.select("query_id", "id", tier.alias("tier"), z("evidence").alias("evidence"), F.coalesce("score", F.lit(0.0)).alias("score"), "backed", "kind_rank", "aside", "degree", "size")
    order = [F.desc("tier"), F.desc("evidence"), F.desc("score"), F.desc("backed"), F.desc("kind_rank"), "aside", F.desc("degree"), "size", "id"]
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint")).where(F.col("rank") <= limit).select("query_id", "id", "tier", "evidence", "score", "rank")


#: Share of the larger score within which two candidates are not told apart, and alternatives shown per seed.
MARGIN, ALTERNATIVES = 0.01, 8


def ambiguity(ranked: DataFrame, seeds: int = 3) -> DataFrame:
    """(query_id, id, seed, score, ambiguous, alternative, alternatives, omitted) of the first seeds of :func:`typed_rank`.

    An alternative shares a seed's tier and evidence and lies within 1 % of the larger score
    (1 at least). Each of the first 8, by rank, gives a row; a seed without any gives one row
    with a null alternative. Scores are spelled with six decimals.
    """
    first = ranked.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("seed_id"), F.col("rank").alias("seed"), "tier", "evidence", F.col("score").alias("own"))
    near = first.join(ranked, ["query_id", "tier", "evidence"]).where("id != seed_id").where(F.abs(F.col("own") - F.col("score")) <= F.greatest(F.abs("own"), F.abs("score"), F.lit(1.0)) * MARGIN)
    counted = near.withColumns({"k": F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("rank")), "n": F.count(F.lit(1)).over(Window.partitionBy("query_id", "seed"))}).where(F.col("k") <= ALTERNATIVES)
    out = first.join(counted.select("query_id", "seed", F.col("id").alias("alternative"), "n"), ["query_id", "seed"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("query_id", F.col("seed_id").alias("id"), "seed", F.format_string("%.6f", "own").alias("score"), (n > 0).alias("ambiguous"), "alternative", n.alias("alternatives"), F.greatest(n - ALTERNATIVES, F.lit(0)).alias("omitted"))
