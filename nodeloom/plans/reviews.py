"""Registered checks of the review module, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import history as hi
from ..graph import code_graph, evidence_graph
from ..operators import analytics as an
from ..operators import cleaning as cl
from ..operators import review as rv
from ..operators import traverse as tr
from ..runtime import table
from .patterns import CODE_SQL
from .structure import CONFIDENCE_SQL
from .text_history import _tokens


def g7_phantoms(spark, d):
    return rv.phantom_edges(code_graph(spark, d))


def g9_hyperedges(spark, d):
    """Every diagnostic that names related nodes, as an n-ary relation; merged nodes stand for each other."""
    listed = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.startswith("{"), F.array(c))
    text = F.from_json("attributes", "diagnostics string")["diagnostics"]
    each = table(spark, d, "graph_nodes").select("id", text.alias("t")).distinct().select("id", F.posexplode(listed(F.col("t"))).alias("k", "x"))
    none = F.lit(None).cast("array<string>")
    raw = each.select(F.concat_ws("#", "id", "k").alias("id"), none.alias("nodes"), F.from_json(F.get_json_object("x", "$.relatedIds"), "array<string>").alias("members"), none.alias("node_ids")).where("members is not null").distinct()
    g = code_graph(spark, d)
    out = rv.hyperedges(raw, cl.exact_merges(g.nodes), g.nodes)
    return out.select("id", F.array_join("members", ",").alias("members"))


def g11_quarantine(spark, d):
    return rv.quarantine(table(spark, d, "graph_nodes").withColumn("start_line", F.col("start_line") + F.when(F.col("id").contains("parser"), 100000).otherwise(0)))


def ir4_call_resolution(spark, d):
    return rv.call_resolution(table(spark, d, "graph_links"), code_graph(spark, d).nodes)


def w6_majority_community(spark, d):
    return rv.majority(code_graph(spark, d).nodes, "source_file", "community_id")


def sd5_priorities(spark, d):
    """Structurally changed nodes with their number of callers in any version, by review priority."""
    c = hi.structural_changes(table(spark, d, "snapshot_nodes"), table(spark, d, "graph_versions"))
    calls = table(spark, d, "snapshot_links").where("kind = 'calls'").select(F.col("target").alias("id"), "source").distinct().groupBy("id").agg(F.count("source").alias("n"))
    kind = F.when(F.col("change_kind") == "changed", "contract").when(F.col("change_kind") == "removed", "impact").otherwise("structural")
    return c.join(calls, "id", "left").select("repo", "version_no", "id", hi.priority(kind, F.coalesce("n", F.lit(0))).alias("priority"))


def sd6_features(spark, d):
    c = hi.structural_changes(table(spark, d, "snapshot_nodes"), table(spark, d, "graph_versions")).select("id").distinct()
    files = table(spark, d, "snapshot_nodes").select("id", "source_file").distinct()
    return rv.feature_groups(c.join(files, "id"))


def sd7_verification_gaps(spark, d):
    c = hi.structural_changes(table(spark, d, "snapshot_nodes"), table(spark, d, "graph_versions"))
    tests = table(spark, d, "snapshot_links").select(F.upper("kind").alias("type"), F.col("target").alias("dst"))
    return rv.verification_gaps(c, tests)


def sd9_change_classes(spark, d):
    docs = table(spark, d, "documents").where("doc_kind = 'commit'")
    return docs.select("doc_id", rv.change_class(F.col("text")).alias("class"))


def r6_lexical_score(spark, d):
    return rv.lexical_score(code_graph(spark, d).nodes, "render_lexer", ["render", "lexer", "ledger"])


def q1_search(spark, d):
    return rv.recall_channels(code_graph(spark, d).nodes, "render_lexer", 200)


def q9_weakest_links(spark, d):
    """The weakest confidence along the witness path from every interface to what it impacts."""
    g = evidence_graph(spark, d)
    seeds = g.nodes.where("label = 'Interface'").select(F.col("id").alias("root"), F.col("id").alias("node"))
    return tr.weakest_links(g, seeds).where("depth > 0")


def an5_split_communities(spark, d):
    g = code_graph(spark, d)
    return rv.split_large(g, an.communities(g))


def an20_questions(spark, d):
    return rv.questions(evidence_graph(spark, d))


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in ("queries", "oracle_sql")}


def oracle_sql() -> dict[str, str]:
    from .text_history import oracle_sql as others

    changes = others()["h2_structural_diff"].rsplit(" SELECT ", 1)[0]
    fam = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rv.FAMILIES.items()) + f" ELSE {c} END"
    low = lambda c: f"lower(coalesce({c}, ''))"
    tier = lambda c, p: f"CASE WHEN {low(c)} = 'render_lexer' THEN {p[0]} WHEN starts_with({low(c)}, 'render_lexer') THEN {p[1]} WHEN contains({low(c)}, 'render_lexer') THEN {p[2]} ELSE 0 END"
    hit = lambda t: f"CASE WHEN contains({low('node_label')}, '{t}') OR contains({low('qualified_name')}, '{t}') OR contains({low('id')}, '{t}') THEN 1.0 ELSE 0 END"
    src = lambda t: f"CASE WHEN contains({low('source_file')}, '{t}') THEN {rv.SOURCE} ELSE 0 END"
    terms = ("render", "lexer", "ledger")
    norm = "lower(regexp_replace(regexp_replace(trim(node_label), '\\(\\)$', ''), '^\\.', ''))"
    from ..text.tokens import canonical_sql

    return {
        "g9_hyperedges": others()["g12_exact_merges"].rsplit(" SELECT ", 1)[0] + ", mg AS (SELECT " + others()["g12_exact_merges"].rsplit(" SELECT ", 1)[1] + """),
          d0 AS (SELECT DISTINCT id, CASE WHEN json_valid(attributes) THEN attributes->'$.diagnostics' END AS d FROM (SELECT DISTINCT id, attributes FROM graph_nodes)), d1 AS (SELECT id, CASE WHEN json_type(d) = 'VARCHAR' AND json_valid(d->>'$') THEN (d->>'$')::JSON ELSE d END AS d FROM d0),
          d2 AS (SELECT id, CASE WHEN json_type(d) = 'ARRAY' THEN json_extract(d, '$[*]') WHEN json_type(d) = 'OBJECT' THEN [d] ELSE [] END AS ds FROM d1), d3 AS (SELECT DISTINCT id || '#' || (k - 1) AS hid, (ds[k]->>'$.relatedIds[*]') AS ms FROM (SELECT id, ds, unnest(range(1, len(ds) + 1)) AS k FROM d2)),
          d4 AS (SELECT hid, ms, unnest(range(1, len(ms) + 1)) AS j FROM d3), d5 AS (SELECT hid, ms[j] AS m, min(j) AS j FROM d4 GROUP BY ALL), d6 AS (SELECT hid, coalesce(winner, m) AS m, j FROM d5 LEFT JOIN mg ON mg.id = m)
          SELECT hid AS id, string_agg(m, ',' ORDER BY j) AS members FROM d6 WHERE m IN (SELECT id FROM cn) GROUP BY hid HAVING count(*) >= 2""",
        "g7_phantoms": CODE_SQL + f"SELECT eid, src, dst, type FROM ce JOIN cn x ON x.id = src JOIN cn y ON y.id = dst WHERE type IN ('CALLS', 'REFERENCES') AND x.repo IS NOT NULL AND y.repo IS NOT NULL AND {fam('x.lang')} <> {fam('y.lang')}",
        "g11_quarantine": "SELECT id, CASE WHEN id = '' THEN 'no id' WHEN kind IS NULL OR NOT regexp_matches(lower(kind), '^[a-z][a-z0-9_]*$') THEN 'unknown kind' WHEN s > end_line THEN 'lines reversed' WHEN s < 0 THEN 'negative line' END AS reason FROM (SELECT *, start_line + CASE WHEN contains(id, 'parser') THEN 100000 ELSE 0 END AS s FROM graph_nodes) WHERE id = '' OR kind IS NULL OR NOT regexp_matches(lower(kind), '^[a-z][a-z0-9_]*$') OR s > end_line OR s < 0",
        "ir4_call_resolution": CODE_SQL + ", k AS (SELECT id, min(target) AS t, bool_or(is_deferred) AS d FROM graph_links WHERE lower(trim(kind)) = 'calls' AND target IS NOT NULL GROUP BY id) SELECT k.id, CASE WHEN cn.id IS NULL THEN 'unresolved' WHEN d THEN 'inferred' ELSE 'resolved' END AS resolution FROM k LEFT JOIN cn ON cn.id = t",
        "w6_majority_community": CODE_SQL + ", k AS (SELECT source_file, community_id, count(*) AS n FROM cn WHERE source_file IS NOT NULL AND community_id IS NOT NULL GROUP BY ALL) SELECT source_file, arg_min(community_id, (-n, community_id)) AS community_id, max(n) AS n FROM k GROUP BY source_file",
        "sd5_priorities": changes + ", k AS (SELECT target AS id, count(DISTINCT source) AS n FROM snapshot_links WHERE kind = 'calls' GROUP BY target) SELECT repo, version_no, c.id, CASE change_kind WHEN 'changed' THEN 1000 WHEN 'removed' THEN 700 ELSE 200 END + least(coalesce(n, 0), 100) AS priority FROM c LEFT JOIN k ON k.id = c.id WHERE change_kind IS NOT NULL",
        "sd6_features": changes.replace("WITH c", "WITH RECURSIVE c", 1) + ", f AS (SELECT DISTINCT s.id, s.source_file AS f FROM snapshot_nodes s JOIN c ON c.id = s.id WHERE c.change_kind IS NOT NULL AND s.source_file IS NOT NULL), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM f x JOIN f y ON y.f = x.f), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b) SELECT a AS id, min(b) AS feature FROM r GROUP BY a",
        "sd7_verification_gaps": changes + " SELECT DISTINCT id FROM c WHERE change_kind IS NOT NULL AND id NOT IN (SELECT target FROM snapshot_links WHERE upper(kind) = 'TESTS' AND target IS NOT NULL)",
        "sd9_change_classes": "SELECT doc_id, CASE WHEN regexp_matches(t, '^(fix|bug|hotfix)') THEN 'fix' WHEN regexp_matches(t, '^(feat|add|implement)') THEN 'feature' WHEN regexp_matches(t, '^(refactor|clean|rename|move)') THEN 'refactor' WHEN regexp_matches(t, '^(doc|readme)') THEN 'docs' WHEN regexp_matches(t, '^(test|spec)') THEN 'test' ELSE 'other' END AS class FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents WHERE doc_kind = 'commit')",
        "r6_lexical_score": CODE_SQL + f"SELECT * FROM (SELECT id, round({tier('node_label', rv.NAME)} + {tier('qualified_name', rv.QUALIFIED)} + CASE WHEN {low('id')} = 'render_lexer' THEN {rv.IDENTITY} ELSE 0 END + ({' + '.join(map(hit, terms))}) / 3 * {rv.COVERAGE} + {' + '.join(map(src, terms))}, 6)::DOUBLE AS score FROM cn) WHERE score > 0",
        "q1_search": CODE_SQL + f", k AS (SELECT id, CASE WHEN lower(id) = 'render_lexer' THEN 'exact_id' WHEN {norm} = 'render_lexer' THEN 'exact_name' WHEN list_contains(list_transform({_tokens('node_label')}, lambda t: {canonical_sql('t', 'duckdb')}), 'render_lexer') THEN 'term' WHEN abs(length({norm}) - 12) <= 1 AND levenshtein({norm}, 'render_lexer') <= 1 THEN 'fuzzy' END AS channel FROM cn) SELECT id, channel, CASE channel WHEN 'exact_id' THEN 6 WHEN 'exact_name' THEN 5 WHEN 'term' THEN 3 ELSE 1 END AS priority FROM k WHERE channel IS NOT NULL ORDER BY priority DESC, id LIMIT 200",
        "an20_questions": CODE_SQL + CONFIDENCE_SQL + ", m AS (SELECT id, community_id AS c FROM cn WHERE community_id IS NOT NULL), b AS (SELECT src, count(DISTINCT y.c) AS n FROM ce JOIN m x ON x.id = src JOIN m y ON y.id = dst WHERE x.c <> y.c GROUP BY src HAVING count(DISTINCT y.c) >= 4), dg AS (SELECT x, count(*) AS k FROM (SELECT src AS x FROM ce UNION ALL SELECT dst FROM ce) GROUP BY x) SELECT 'bridge' AS kind, src AS subject, 'Why does `' || src || '` connect ' || n || ' communities?' AS question FROM b UNION ALL SELECT 'isolated', id, 'What connects `' || id || '` to the rest?' FROM cn LEFT JOIN dg ON x = id WHERE coalesce(k, 0) <= 1" + " UNION ALL SELECT 'ambiguous_edge', eid, 'What is the exact relationship between `' || coalesce(x.node_label, '') || '` and `' || coalesce(y.node_label, '') || '`?' FROM ce JOIN cf USING (eid) JOIN cn x ON x.id = src JOIN cn y ON y.id = dst WHERE conf = 'AMBIGUOUS'",
    }
