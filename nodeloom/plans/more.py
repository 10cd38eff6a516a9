"""Further registered queries: versions, summaries, seeds, hubs, declarations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import history as hi
from ..graph import code_graph, numbered_graph
from ..operators import analytics as an
from ..operators import traverse as tr
from ..query import routes
from ..runtime import table
from ..text import rank as rk
from ..text import tokens as tk
from .patterns import CODE_SQL
from .text_history import _first_and_last, _index, _questions, _terms, _tokens

WANTED = ("r000001:none", "update_snapshot", "pick_anchor", "docs", "render_lexer")


def sc15_version_scan(spark, d):
    return table(spark, d, "snapshot_nodes").where("version_no = 2").select("repo", "id", "kind", "delivered_at")


def t1_plain_names(spark, d):
    n = table(spark, d, "documents").select("doc_kind", "lang").distinct()
    return n.select("doc_kind", "lang", tk.strip_diacritics("lang").alias("plain"))


def w1_best_per_term(spark, d):
    return rk.best_per_term(_index(spark, d), _questions(spark))


def w3_seeds(spark, d):
    return rk.seeds(rk.bm25(_index(spark, d), _questions(spark), 20), code_graph(spark, d).nodes)


#: Questions about a name, as people put them.
ASKED = (
    "Who calls {}?", "Callers of {}", "which methods call {}", "where is {} called", "What does {} call?", "what functions does {} invoke", "Calls made by {}.", "What breaks if {} changes?", "what depends on {}", "impact of {}!",
    "If {} changes, what breaks?", "shortest path from {} to main", "How does {} reach the store?", "how is {} connected to parser", "where is {} defined", "Find {}", "search for {}", "{} and its callers and callees", "what uses {} in the write path", "how does {} work",
    "architecture around {}", "who is affected by {}", "the implementation flow of {}",
)


def d1_intents(spark, d):
    """Intent, confidence and direction of questions about every class."""
    names = code_graph(spark, d).nodes.where("label = 'Class'").select("node_label").distinct()
    asked = F.explode(F.array(*[F.concat(*[x for k, part in enumerate(q.split("{}")) for x in ((F.col("node_label"),) if k else ()) + (F.lit(part),)]) for q in ASKED]))
    return routes(names.select(asked.alias("question"))).select("question", "intent", "confidence", "direction")


def _asked(spark):
    """Questions that reach every channel."""
    rows = [(1, "where is update_snapshot and its scanner resolved"), (2, "render_lexer"), (3, "how does reset save the posting"), (4, "reset_postin"), (5, "r000001:join_quota_4nk"), (6, "planner::parser_362::reset_posting"), (7, "zzzz"), (8, "load block and store snapshot")]
    return spark.createDataFrame(rows, "query_id int, text string")


def r4_seed_order(spark, d):
    g = code_graph(spark, d)
    scored = rk.bm25(_index(spark, d), _questions(spark), 50).select("query_id", "id", F.floor("score").cast("double").alias("score"))
    return rk.order_seeds(scored, rk.seed_rank(g.nodes, g.edges), 20)


def r5_typed_rank(spark, d):
    g = code_graph(spark, d)
    return rk.typed_rank(g.nodes, g.edges, _asked(spark), index=_index(spark, d))


def r7_predicates(spark, d):
    words = table(spark, d, "documents").select(F.explode(tk.search_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", rk.predicate(F.col("word")).alias("meaning")).where("meaning is not null")


def q1_channels(spark, d):
    g = code_graph(spark, d)
    return rk.recall(g.nodes, g.edges, _asked(spark), 5).select("query_id", "id", "channel", "priority")


def d9_ambiguity(spark, d):
    g = code_graph(spark, d)
    return rk.ambiguity(rk.typed_rank(g.nodes, g.edges, _asked(spark), 100, _index(spark, d)))


def d7_hubs(spark, d):
    return tr.hub_threshold(code_graph(spark, d).degrees())


def q11_seed_ladder(spark, d):
    wanted = spark.createDataFrame([(w,) for w in WANTED], "wanted string")
    return tr.resolve_seed(code_graph(spark, d).nodes, wanted)


def ir2_summaries(spark, d):
    """What every node calls, reads and writes: a row for each."""
    return code_graph(spark, d).edges.where("type in ('CALLS', 'READS', 'WRITES')").groupBy(F.col("src").alias("id"), F.lower("type").alias("does"), F.col("dst").alias("to")).agg(F.count(F.lit(1)).alias("sites"))


def ir3_reverse_calls(spark, d):
    e = code_graph(spark, d).edges.where("type = 'CALLS'")
    return hi.reverse_calls(e.select(F.col("src").alias("symbol_id"), F.array("dst").alias("resolved")))


def u5_without_repository(spark, d):
    """The graph after one repository has been removed; builtin symbols stay while something uses them."""
    g = code_graph(spark, d)
    gone = g.nodes.where("repo is not null").agg(F.min("repo").alias("r")).scalar()
    left = g.nodes.where(F.col("repo").isNull() | (F.col("repo") != gone))
    kept = type(g)(left, g.edges).drop_dangling().edges
    used = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return left.where("repo is not null").select("id").unionByName(left.where("repo is null").select("id").join(used, "id", "left_semi"))


def g17_declarations(spark, d):
    """Declarations (interfaces, traits) merged into the one class or struct of their name in the repository."""
    n = code_graph(spark, d).nodes.where("repo is not null")
    body = n.where("label in ('Class', 'Struct', 'Function')").groupBy("repo", "node_label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("winner")).where("n = 1")
    return n.where("label in ('Interface', 'Trait', 'Method')").join(body, ["repo", "node_label"]).select("id", "winner")


def an9_incremental(spark, d):
    """Communities after only those that a changed node touches have been found again."""
    g = numbered_graph(spark, d)
    found = an.anew(an.simple_edges(g), an.communities(g), g.nodes.where("label = 'Interface'").select("id"))
    names = g.nodes.select("id", "name")
    shown = found.join(names, "id").join(names.withColumnsRenamed({"id": "fresh", "name": "first"}), "fresh", "left")
    return shown.select(F.col("name").alias("id"), F.coalesce("first", F.col("community").cast("string")).alias("community"))


def an21_diff_summary(spark, d):
    """What changed between the first and the last version of each repository, in words."""
    return hi.delta_summary(hi.graph_delta(*_first_and_last(spark, d)))


def u5_listed(spark, d):
    """The repositories in the graph, with their nodes and links."""
    g = code_graph(spark, d)
    n = g.nodes.where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"))
    e = g.edges.join(g.nodes.select(F.col("id").alias("src"), "repo"), "src").groupBy("repo").agg(F.count(F.lit(1)).alias("links"))
    return n.join(e, "repo", "left").select("repo", "nodes", F.coalesce("links", F.lit(0)).alias("links"))


def sc13_names(spark, d):
    """The name index of the graph: nodes per name and their least id."""
    return code_graph(spark, d).nodes.groupBy("node_label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def sc13_terms(spark, d):
    """The term index of the graph: nodes per search term of their names."""
    t = code_graph(spark, d).nodes.select("id", F.explode(F.array_distinct(tk.search_tokens(F.coalesce("node_label", F.lit(""))))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def sc13_files(spark, d):
    """The file index of the graph: nodes and lines per file."""
    return code_graph(spark, d).nodes.where("source_file is not null").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.max("end_line").alias("lines"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in ("queries", "oracle_sql")}


def _asked_sql() -> str:
    """Intents by what a question starts and ends with, written from the rules."""
    texts = " UNION ALL ".join("SELECT '" + q.replace("{}", "' || node_label || '").replace("'' || ", "", 0) + "' AS question FROM nl" for q in ASKED)
    return f"""{CODE_SQL}, nl AS (SELECT DISTINCT node_label FROM cn WHERE label = 'Class'), qs AS ({texts}), q0 AS (SELECT question, lower(rtrim(trim(question), '?!.')) AS t FROM qs),
      q1 AS (SELECT *, CASE WHEN regexp_matches(t, '^((shortest )?path|route|connection) from .+ to ') OR regexp_matches(t, '^how (does|can) .+ reach ') OR regexp_matches(t, '^how is .+ connected to ') THEN 'trail'
        WHEN regexp_matches(t, '^((find |show )?callers of|who calls|what calls|what functions call|what methods call|which functions call|which methods call) ') THEN 'callers' WHEN starts_with(t, 'where is ') AND ends_with(t, ' called') THEN 'called'
        WHEN regexp_matches(t, '^((find |show )?callees of|calls made by) ') OR regexp_matches(t, '^what (functions |methods )?does .+ (calls?|invokes?)$') THEN 'callees'
        WHEN regexp_matches(t, '\\bcallers?\\b') AND regexp_matches(t, '\\bcallees?\\b') THEN 'fallback'
        WHEN regexp_matches(t, '^(what is impacted by|what depends on|who depends on|what breaks if|what changes if|dependents of|impact of|what is the impact of|what would break if) ') THEN 'impact' WHEN regexp_matches(t, '^if .+ changes,? what breaks$') THEN 'impact_if'
        WHEN regexp_matches(t, '^((find )?definition of|search for) ') THEN 'search' WHEN regexp_matches(t, '^(show me|where is|where are|find|search|show) ') THEN CASE WHEN ends_with(t, ' defined') OR len(string_split(regexp_replace(t, '^(show me|where is|where are|find|search|show) ', ''), ' ')) = 1 THEN 'search' ELSE 'search_vague' END
        ELSE 'fallback' END AS i, ' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM q0),
      q2 AS (SELECT *, regexp_matches(w, 'caller|called by|used by|registered by|enforced at|affected by|referenced by|depends on this') AS inn, regexp_matches(w, ' calls | invokes | uses |implementation flow|writes to|calls from') OR (contains(w, 'depends on') AND NOT contains(w, 'depends on this')) AS ou,
        regexp_matches(w, 'architecture|related|connected|coupling') OR (contains(w, 'flow') AND NOT contains(w, 'implementation flow')) AS ne FROM q1)
      SELECT question, CASE i WHEN 'called' THEN 'callers' WHEN 'impact_if' THEN 'impact' WHEN 'search_vague' THEN 'search' ELSE i END AS intent, CASE i WHEN 'called' THEN 95 WHEN 'impact_if' THEN 95 WHEN 'search' THEN 90 WHEN 'search_vague' THEN 60 WHEN 'fallback' THEN 0 ELSE 100 END::INT AS confidence,
        CASE WHEN inn AND ou THEN 'both' WHEN i IN ('callers', 'called', 'impact', 'impact_if') THEN 'in' WHEN i IN ('callees', 'trail') THEN 'out' WHEN ne THEN 'both' WHEN inn AND NOT starts_with(w, ' how does ') THEN 'in' WHEN NOT inn AND (ou OR starts_with(w, ' how does ')) THEN 'out' ELSE 'both' END AS direction FROM q2"""


def oracle_sql() -> dict[str, str]:
    from .text_history import oracle_sql as others

    scored = others()["r1_bm25"].split(",\n        be AS")[0]
    values = ", ".join(f"('{w}')" for w in WANTED)
    steps = {"id": "id = wanted", "label": "node_label = wanted", "bare": "lower(node_label) = lower(wanted)", "file": "source_file = wanted", "substring": "contains(lower(node_label), lower(wanted))"}
    ladder = ", ".join(f"{k}_ AS (SELECT wanted, count(*) AS n, min(id) AS id FROM w JOIN cn ON {c} GROUP BY wanted)" for k, c in steps.items())
    ids = "CASE " + " ".join(f"WHEN {k}_.n = 1 THEN {k}_.id" for k in steps) + " END"
    hows = "CASE " + " ".join(f"WHEN {k}_.n = 1 THEN '{k}'" for k in steps) + " END"
    joins = " ".join(f"LEFT JOIN {k}_ ON {k}_.wanted = w.wanted" for k in steps)
    each = lambda t: f"coalesce(string_agg(DISTINCT CASE WHEN type = '{t}' THEN dst END, ',' ORDER BY CASE WHEN type = '{t}' THEN dst END), '')"
    rank = "CASE " + " ".join(f"WHEN lower(kind) IN ({', '.join(repr(x) for x in xs)}) THEN {k}" for k, xs in rk.SEED_KINDS.items()) + " ELSE 0 END"
    file = "lower(coalesce(source_file, ''))"
    seed_rank = f""", en AS (SELECT src AS id, dst AS o FROM ce UNION ALL SELECT dst, src FROM ce), dk AS (SELECT en.id, count(*) AS degree FROM en JOIN cn ON cn.id = o WHERE cn.source_file <> '' GROUP BY en.id),
      sr AS (SELECT cn.id, {file} <> '' AS backed, {rank} AS kind_rank, list_has_any(string_split({file}, '/'), {list(rk.ASIDE)}) OR starts_with(split_part({file}, '/', -1), 'test_') OR ends_with({file}, '_test.go') AS aside, coalesce(degree, 0) AS degree, length(coalesce(node_label, '')) AS size FROM cn LEFT JOIN dk USING (id))"""
    meaning = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rk.PREDICATES.items()) + " END"
    texts = "(VALUES (1, 'where is update_snapshot and its scanner resolved'), (2, 'render_lexer'), (3, 'how does reset save the posting'), (4, 'reset_postin'), (5, 'r000001:join_quota_4nk'), (6, 'planner::parser_362::reset_posting'), (7, 'zzzz'), (8, 'load block and store snapshot')) v(query_id, text)"
    stems = f"list_transform({_tokens('coalesce(node_label, chr(32))')}, lambda t: {tk.canonical_sql('t', 'duckdb')})"
    recall = f""", qs AS (SELECT query_id, text, list_distinct({_terms('text')}) AS terms FROM {texts}), nn AS (SELECT id, lower(id) AS low, lower(regexp_replace(regexp_replace(trim(coalesce(node_label, '')), '\\(\\)$', ''), '^\\.', '')) AS name, lower(qualified_name) AS q, {stems} AS st FROM cn),
      nt AS (SELECT DISTINCT id, unnest(st) AS term FROM nn), qt AS (SELECT query_id, unnest(terms) AS term FROM qs), bt AS (SELECT DISTINCT query_id, id FROM qt JOIN nt USING (term)),
      po AS (SELECT query_id, id, 6 AS p FROM qs JOIN nn ON low = text UNION ALL SELECT query_id, id, 5 FROM qs JOIN nn ON name = text UNION ALL SELECT query_id, id, 4 FROM qs JOIN nn ON q = text UNION ALL SELECT query_id, src, 4 FROM qs JOIN nn ON name = text JOIN ce ON dst = id AND type = 'ALIASES' UNION ALL SELECT query_id, id, 3 FROM bt UNION ALL SELECT query_id, src, 2 FROM bt JOIN ce ON dst = id AND type = 'CALLS'),
      be AS (SELECT query_id, id, max(p) AS p FROM po GROUP BY ALL), sm AS (SELECT qs.query_id, text FROM qs LEFT JOIN be USING (query_id) GROUP BY ALL HAVING count(id) < {{limit}}),
      fz AS (SELECT query_id, id FROM sm JOIN nn ON abs(length(name) - length(text)) <= 1 AND levenshtein(name, text) = 1 AND length(text) > 2 AND length(name) > 1 WHERE NOT EXISTS (SELECT 1 FROM be WHERE be.query_id = sm.query_id AND be.id = nn.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 16),
      rc AS (SELECT query_id, id, p FROM be UNION ALL SELECT query_id, id, 1 FROM fz)"""
    bm = others()["r1_bm25"]
    return {
        "sc13_files": CODE_SQL + "SELECT source_file, count(*) AS n, max(end_line) AS lines FROM cn WHERE source_file IS NOT NULL GROUP BY source_file",
        "sc13_terms": CODE_SQL + f", t AS (SELECT DISTINCT id, unnest({stems}) AS term FROM cn) SELECT term, count(*) AS n FROM t GROUP BY term",
        "sc13_names": CODE_SQL + "SELECT node_label, count(*) AS n, min(id) AS id FROM cn GROUP BY node_label",
        "u5_listed": CODE_SQL + ", e AS (SELECT repo, count(*) AS links FROM ce JOIN cn ON cn.id = src GROUP BY repo) SELECT cn.repo, count(*) AS nodes, coalesce(any_value(links), 0) AS links FROM cn LEFT JOIN e ON e.repo = cn.repo WHERE cn.repo IS NOT NULL GROUP BY cn.repo",
        "q1_channels": CODE_SQL + recall.replace("{limit}", "5") + " SELECT query_id, id, CASE p WHEN 6 THEN 'exact_id' WHEN 5 THEN 'exact_name' WHEN 4 THEN 'alias' WHEN 3 THEN 'term' WHEN 2 THEN 'relation' ELSE 'fuzzy' END AS channel, p AS priority FROM rc",
        "r7_predicates": f"WITH w AS (SELECT DISTINCT unnest({stems.replace('coalesce(node_label, chr(32))', 'text')}) AS word FROM documents) SELECT word, {meaning.format('word')} AS meaning FROM w WHERE {meaning.format('word')} IS NOT NULL",
        "r4_seed_order": bm.replace("WHERE k <= 20", "WHERE k <= 50").replace("SELECT query_id, id, score, row_number()", seed_rank + ", rr AS (SELECT query_id, id, score, row_number()").rstrip() + ") SELECT query_id, id, score, place AS rank FROM (SELECT query_id, id, floor(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY floor(score) DESC, backed DESC, kind_rank DESC, aside, degree DESC, size, id) AS place FROM rr JOIN sr USING (id)) WHERE place <= 20",
        "d1_intents": _asked_sql(),
        "sc15_version_scan": "SELECT repo, id, kind, delivered_at FROM snapshot_nodes WHERE version_no = 2",
        "t1_plain_names": "SELECT DISTINCT doc_kind, lang, strip_accents(lang) AS plain FROM documents",
        "w1_best_per_term": scored + " SELECT query_id, term, arg_min(id, (-part, id)) AS id, max(part) AS score FROM sc GROUP BY ALL",
        "w3_seeds": others()["r1_bm25"].replace("SELECT query_id, id, score, row_number()", ", rr AS (SELECT query_id, id, score, row_number()").rstrip() + "), lb AS (SELECT rr.*, lower(node_label) AS l, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM rr JOIN cn USING (id)), kk AS (SELECT *, row_number() OVER (PARTITION BY query_id, l ORDER BY rank) AS k FROM lb WHERE score >= 0.5 * top) SELECT query_id, id, seed FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seed FROM kk WHERE k = 1) WHERE seed <= 3",
        "d7_hubs": CODE_SQL + ", dg AS (SELECT id, coalesce(k, 0) AS degree FROM cn LEFT JOIN (SELECT x, count(*) AS k FROM (SELECT src AS x FROM ce UNION ALL SELECT dst FROM ce) GROUP BY x) ON x = id) SELECT id FROM dg WHERE degree >= (SELECT greatest(50, floor(quantile_cont(degree, 0.99))) FROM dg)",
        "q11_seed_ladder": CODE_SQL + f", w(wanted) AS (VALUES {values}), {ladder} SELECT w.wanted, {ids} AS id, {hows} AS how FROM w {joins}",
        "ir2_summaries": CODE_SQL + "SELECT src AS id, lower(type) AS does, dst AS to, count(*) AS sites FROM ce WHERE type IN ('CALLS', 'READS', 'WRITES') GROUP BY ALL",
        "ir3_reverse_calls": CODE_SQL + "SELECT DISTINCT dst AS callee, src AS caller FROM ce WHERE type = 'CALLS'",
        "u5_without_repository": CODE_SQL + ", g AS (SELECT min(repo) AS r FROM cn), l AS (SELECT cn.id, repo FROM cn, g WHERE repo IS NULL OR repo <> r), k AS (SELECT unnest([src, dst]) AS id FROM ce WHERE src IN (SELECT id FROM l) AND dst IN (SELECT id FROM l)) SELECT id FROM l WHERE repo IS NOT NULL OR id IN (SELECT id FROM k)",
        "g17_declarations": CODE_SQL + ", b AS (SELECT repo, node_label, min(id) AS winner FROM cn WHERE repo IS NOT NULL AND label IN ('Class', 'Struct', 'Function') GROUP BY ALL HAVING count(*) = 1) SELECT cn.id, winner FROM cn JOIN b ON b.repo = cn.repo AND b.node_label = cn.node_label WHERE label IN ('Interface', 'Trait', 'Method')",
        "an21_diff_summary": others()["u3_graph_diff"].replace("SELECT *, 'new' AS change", ", dl AS (SELECT *, 'new' AS change") + "), k AS (SELECT repo, count(*) FILTER (part = 'node' AND change = 'new') AS a, count(*) FILTER (part = 'edge' AND change = 'new') AS b, count(*) FILTER (part = 'node' AND change = 'removed') AS c, count(*) FILTER (part = 'edge' AND change = 'removed') AS e FROM dl GROUP BY repo) SELECT repo, a || ' new nodes, ' || b || ' new edges, ' || c || ' nodes removed, ' || e || ' edges removed' AS summary FROM k",
    }
