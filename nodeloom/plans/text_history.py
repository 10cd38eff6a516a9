"""Registered retrieval, cleaning, history and windowing queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import history as hi
from ..functions.json import canonical_digest
from ..graph import code_graph, evidence_graph, made_once
from ..operators import cleaning as cl
from ..operators import snapshots
from ..runtime import table
from ..streaming import debounced, reconcile
from ..text import rank as rk
from ..text import tokens as tk
from .general import NODE_COLUMNS, json_facts, snapshot_sql
from .patterns import CODE_SQL
from .structure import CONFIDENCE_SQL

QUESTIONS = ((1, "where is update_snapshot and its scanner resolved"), (2, "how does pick_anchor reach validate_constraint"), (3, "filter_operator or render_lexer in ledger"))


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


def _index(spark, d):
    """The postings of the live graph, built once."""
    return made_once(spark, d, "postings", lambda: rk.build_index(code_graph(spark, d).nodes))


def _names(spark, d):
    return code_graph(spark, d).nodes.select("node_label").distinct()


def t2_identifier_tokens(spark, d):
    return _names(spark, d).select("node_label", F.array_join(tk.identifier_tokens(F.col("node_label")), " ").alias("tokens"))


def t3_canonical_tokens(spark, d):
    words = table(spark, d, "documents").select(F.explode(tk.identifier_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", tk.canonical_token(F.col("word")).alias("stem"))


def t4_query_terms(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.array_join(tk.query_terms(F.col("text")), " ").alias("terms"))


def t5_contexts(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.array_join(tk.context_filters(F.col("text")), ",").alias("contexts"))


def t7_labels(spark, d):
    return _names(spark, d).select("node_label", tk.normalize_label(F.col("node_label")).alias("norm"), tk.normalize_symbol(F.col("node_label")).alias("symbol"))


def t8_entropy(spark, d):
    return _names(spark, d).select("node_label", F.round(tk.entropy(F.col("node_label")), 6).alias("entropy"))


def t9_similarity(spark, d):
    p = table(spark, d, "ambiguous_pairs").where("left_id is not null and right_id is not null").select("left_id", "right_id").distinct()
    return p.select("left_id", "right_id", F.round(tk.jaro_score("left_id", "right_id"), 6).alias("jaro"), F.round(tk.jaro_winkler_score("left_id", "right_id"), 6).alias("jaro_winkler"))


def t9_damerau(spark, d):
    p = table(spark, d, "ambiguous_pairs").where("left_id is not null and right_id is not null").select("left_id", "right_id").distinct()
    return p.select("left_id", "right_id", tk.damerau_distance("left_id", "right_id").alias("edits"))


def t13_digests(spark, d):
    """Groups of equal attributes, by digest of their canonical JSON."""
    t = table(spark, d, "snapshot_nodes").where("attributes is not null").select("id", canonical_digest("attributes").alias("digest"))
    return t.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).drop("digest")


def w2_best_seed(spark, d):
    return rk.best_by_scan(code_graph(spark, d).nodes, _questions(spark))


def t12_typos(spark, d):
    words = _names(spark, d).select(F.explode(tk.identifier_tokens(F.col("node_label"))).alias("term")).distinct()
    return rk.fuzzy_variants(words, words)


def r1_bm25(spark, d):
    return rk.bm25(_index(spark, d), _questions(spark), 20)


def r3_full_scan(spark, d):
    return rk.full_scan(code_graph(spark, d).nodes, _questions(spark), 20)


def r8_callee_recall(spark, d):
    g = code_graph(spark, d)
    return rk.callee_recall(g.edges, g.nodes, _questions(spark))


def r9_relevance(spark, d):
    """Each record's matches by judgement date, graded by score."""
    from pyspark.sql import Window

    p = table(spark, d, "ambiguous_pairs").where("left_id is not null and right_id is not null and score is not null")
    per = p.groupBy(F.col("left_id").alias("query_id"), F.col("right_id").alias("id")).agg(F.min("decided_at").alias("at"), F.max("score").alias("s"))
    ranked = per.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")).alias("rank"))
    graded = per.select("query_id", "id", F.when(F.col("s") >= 97, 3).when(F.col("s") >= 94, 2).when(F.col("s") >= 92, 1).otherwise(0).alias("grade"))
    return rk.relevance(ranked, graded)


def g2_dedupe_nodes(spark, d):
    return cl.dedupe_nodes(table(spark, d, "graph_nodes")).select("id", "kind", "ingested_at", "deleted_at")


def g3_dedupe_edges(spark, d):
    return cl.dedupe_edges(table(spark, d, "graph_links").where("source is not null and target is not null").withColumn("kind", F.lower(F.trim("kind"))))


def g4_occurrences(spark, d):
    e = code_graph(spark, d).edges
    return e.select("eid", cl.occurrence_key("src", "dst", "type", "context").alias("key"))


def g5_evidence(spark, d):
    return cl.merge_evidence(code_graph(spark, d).edges.where("context is not null"), ("src", "dst", "type"), "context")


def g8_backfill(spark, d):
    g = code_graph(spark, d)
    return cl.backfill_source(g.nodes, g.edges)


def g10_inference(spark, d):
    """Nodes and edges that each level of inference admits."""
    out = None
    for level in cl.LEVELS:
        g = cl.inference_level(evidence_graph(spark, d), level)
        both = g.nodes.select(F.lit(level).alias("level"), F.lit("node").alias("what"), "id").unionByName(g.edges.select(F.lit(level).alias("level"), F.lit("edge").alias("what"), F.col("eid").alias("id")))
        out = both if out is None else out.unionByName(both)
    return out


def g12_exact_merges(spark, d):
    return cl.exact_merges(code_graph(spark, d).nodes)


def g12_fuzzy_names(spark, d):
    return cl.fuzzy_names(code_graph(spark, d).nodes)


def g14_rewired(spark, d):
    g = code_graph(spark, d)
    return cl.rewire(g.edges, cl.exact_merges(g.nodes)).select("eid", "src", "dst", "type")


def g16_resolved_calls(spark, d):
    """Call links to missing nodes, resolved by the name inside the missing id within its repository."""
    g = code_graph(spark, d)
    links = table(spark, d, "graph_links").where("lower(trim(kind)) = 'calls' and source is not null and target is not null")
    lost = links.join(g.nodes.select(F.col("id").alias("target")), "target", "left_anti")
    calls = lost.select(F.col("id").alias("call_id"), "source", F.regexp_extract("target", r"^[^:]*:(.*)_[^_]*$", 1).alias("name")).distinct().join(g.nodes.select(F.col("id").alias("source"), F.col("repo").alias("scope"), F.col("source_file").alias("file")), "source").drop("source")
    return cl.resolve_names(calls, g.nodes.select("id", F.col("node_label").alias("name"), F.col("repo").alias("scope"), F.col("source_file").alias("file")))


def u4_merged_graphs(spark, d):
    """The repositories of the live graph as graphs of their own, merged: nodes and edges."""
    g = code_graph(spark, d)
    home = g.nodes.select(F.col("id").alias("src"), F.col("repo").alias("tag"))
    edges = g.edges.join(home, "src").where("tag is not null")
    nodes, links = cl.merge_tagged(g.nodes.withColumn("tag", F.col("repo")), edges)
    return nodes.select(F.lit("node").alias("part"), "id", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("type")).unionByName(links.select(F.lit("edge").alias("part"), F.col("src").alias("id"), "dst", "type"))


def _first_and_last(spark, d):
    v = table(spark, d, "graph_versions").groupBy("repo").agg(F.min("version_no").alias("lo"), F.max("version_no").alias("hi"))
    of = lambda what, at, *cols: table(spark, d, f"snapshot_{what}").join(v.select("repo", F.col(at).alias("version_no")), ["repo", "version_no"]).select("repo", *cols).distinct()
    return [(of("nodes", at, "id"), of("links", at, "source", "target", "kind")) for at in ("lo", "hi")]


def u3_graph_diff(spark, d):
    """New and removed nodes and edges between the first and the last version of each repository."""
    return hi.graph_delta(*_first_and_last(spark, d))


def h2_structural_diff(spark, d):
    return hi.structural_changes(table(spark, d, "snapshot_nodes"), table(spark, d, "graph_versions"))


def h3_change_counts(spark, d):
    parts = [hi.structural_changes(table(spark, d, f"snapshot_{w}"), table(spark, d, "graph_versions")).withColumn("record_root", F.lit(w)) for w in ("nodes", "links")]
    return snapshots.change_counts(parts[0].unionByName(parts[1]), "record_root", "repo", "version_no")


def h4_sharing(spark, d):
    return hi.sharing(table(spark, d, "snapshot_nodes"), table(spark, d, "graph_versions"))


def h5_ancestry(spark, d):
    return hi.ancestry(table(spark, d, "graph_versions"))


def h8_trend(spark, d):
    return hi.trend(table(spark, d, "snapshot_nodes"), table(spark, d, "graph_versions"))


def sd4_invalidated(spark, d):
    """Structurally changed nodes and their transitive callers in any delivered version."""
    changed = hi.structural_changes(table(spark, d, "snapshot_nodes"), table(spark, d, "graph_versions")).select("id").distinct()
    calls = table(spark, d, "snapshot_links").where("kind = 'calls' and source is not null and target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return hi.invalidated(changed, calls, calls.limit(0))


def sd8_changed_files(spark, d):
    g = code_graph(spark, d)
    files = g.nodes.where("source_file is not null").select("source_file").distinct()
    paths = files.select(F.element_at(F.split("source_file", "/"), -1).alias("path")).where(F.contains("path", F.lit("_1"))).unionByName(files.select(F.concat(F.lit("src/main/"), "source_file").alias("path")).where(F.contains("path", F.lit("_2")))).distinct()
    return hi.changed_files(files, paths)


def sd8_impact(spark, d):
    """Nodes and communities that the changed files touch, each file counted once."""
    n = code_graph(spark, d).nodes.where("source_file is not null")
    return hi.change_impact(n, sd8_changed_files(spark, d))


def m1_feedback(spark, d):
    outcome = F.when(F.col("event_type") == "purchase", "useful").when(F.col("event_type") == "error", "dead_end").otherwise(F.col("event_type"))
    got = hi.feedback(table(spark, d, "events").select(F.col("user_id").alias("subject"), outcome.alias("outcome"), F.col("ts").alias("at")), "2025-01-01")
    return got.withColumn("score", F.round("score", 6))


def st2_sessions(spark, d):
    """Batches of events per user: closed by a quiet hour, or after five."""
    return debounced(table(spark, d, "events"), "ts", "user_id", 3_600_000_000, 1 << 60)


def st5_reconciled(spark, d):
    """What a full scan of the last versions finds to differ from the first."""
    v = table(spark, d, "graph_versions").groupBy("repo").agg(F.min("version_no").alias("lo"), F.max("version_no").alias("hi"))
    s = table(spark, d, "snapshot_nodes").where("id is not null")
    of = lambda at: s.join(v.select("repo", F.col(at).alias("version_no")), ["repo", "version_no"]).groupBy(F.concat_ws("@", "id", "repo").alias("key")).agg(F.max_by(F.struct("kind", "node_label", "source_file"), F.struct("delivered_at", "kind")).alias("r")).select("key", "r.*")
    return reconcile(of("lo"), of("hi"), "key", ["kind", "node_label", "source_file"])


def st_tumbling(spark, d):
    """An extra beside the reference's operators: events per day and type."""
    e = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "value")


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in ("queries", "oracle_sql")}


_SPLIT = "regexp_replace(regexp_replace({0}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"


def _tokens(c: str) -> str:
    old, new = (x.replace("'", "''") for x in tk._PLAIN)
    plain = f"regexp_replace(translate({c}, '{old}', '{new}'), '\\p{{Mn}}+', '', 'g')"
    return f"regexp_extract_all(lower({_SPLIT.format(plain)}), '[\\p{{L}}\\p{{N}}_]+')"


def _terms(c: str) -> str:
    """Query terms: canonical, searchable, without stop words unless nothing is left."""
    stems = f"list_transform({_tokens(c)}, lambda t: {tk.canonical_sql('t', 'duckdb')})"
    searched = f"list_filter({stems}, lambda t: NOT regexp_matches(t, '^[a-z]{{1,2}}$'))"
    stop = ", ".join(f"'{w}'" for w in tk.STOP_WORDS)
    content = f"list_filter({searched}, lambda t: t NOT IN ({stop}))"
    return f"CASE WHEN len({content}) = 0 THEN {searched} ELSE {content} END"


def oracle_sql() -> dict[str, str]:
    names = CODE_SQL + ", nl AS (SELECT DISTINCT node_label FROM cn) "
    norm = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    q = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in QUESTIONS) + ") v(query_id, text)"
    stem = tk.canonical_sql("w", "duckdb")
    docs = " UNION ALL ".join(f"SELECT id, {w} AS w, unnest({_tokens(f'coalesce({c}, chr(32))')}) AS w0 FROM cn" for c, w in rk.FIELDS.items())
    post = f", fl0 AS ({docs}), st AS (SELECT id, w AS wt, {tk.canonical_sql('w0', 'duckdb')} AS term FROM fl0), po AS (SELECT id, term, sum(wt) AS tf, count(*) AS n FROM st GROUP BY ALL), ln AS (SELECT id, sum(n) AS length FROM po GROUP BY id), qt AS (SELECT DISTINCT query_id, unnest({_terms('text')}) AS term FROM {q})"
    changed = """WITH v AS (SELECT DISTINCT repo, version_no, lag(version_no) OVER (PARTITION BY repo ORDER BY version_no) AS before FROM graph_versions),
      l AS (SELECT repo, version_no, id, {content} FROM (SELECT *, row_number() OVER (PARTITION BY repo, version_no, id ORDER BY delivered_at DESC) AS rn FROM {t}) WHERE rn = 1),
      n AS (SELECT l.*, v.before FROM l JOIN v USING (repo, version_no) WHERE v.before IS NOT NULL), o AS (SELECT l.*, v.version_no AS next FROM l JOIN v ON v.repo = l.repo AND v.before = l.version_no),
      c AS (SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.version_no, o.next) AS version_no, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN {differs} THEN 'changed' END AS change_kind
        FROM n FULL JOIN o ON o.repo = n.repo AND o.next = n.version_no AND o.id = n.id)"""

    meaning = lambda t, cols: f"WITH c AS ({snapshot_sql(t, cols, tuple(hi.IGNORED_FIELDS))})"

    def diff(t, cols):
        return changed.format(t=t, content=", ".join(cols), differs=" OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in cols))

    node_cols, link_cols = ("kind", "node_label"), ("source", "target", "kind", "weight", "context")
    risk_points = "CASE factor " + " ".join(f"WHEN '{k}' THEN least(n * {a}, {b})" for k, (a, b) in hi.RISK.items()) + " END"
    return {
        "w2_best_seed": CODE_SQL + f""", dc0 AS (SELECT id, {norm.format("coalesce(node_label, '')")} AS name, lower(coalesce(source_file, '')) AS file FROM cn), qq AS (SELECT query_id, list_distinct({_terms('text')}) AS ts FROM {q}), qt0 AS (SELECT query_id, len(ts) AS k, array_to_string(ts, ' ') AS whole, unnest(ts) AS term FROM qq),
          df0 AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM qt0) JOIN dc0 ON contains(name, term) GROUP BY term), h0 AS (SELECT query_id, k, whole, qt0.term, id, name, file, ln(1 + (SELECT count(*) FROM dc0) / (1 + coalesce(df, 0))) AS w FROM qt0 LEFT JOIN df0 ON df0.term = qt0.term JOIN dc0 ON contains(name, qt0.term) OR contains(file, qt0.term)),
          t0 AS (SELECT *, CASE WHEN name = term THEN 1000.0 WHEN starts_with(name, term) THEN 100.0 ELSE 0.0 END AS tier FROM h0) SELECT query_id, term, arg_min(id, (-s, length(name), id)) AS id, max(s) AS score FROM (SELECT query_id, term, id, name, round((tier + CASE WHEN tier = 0 AND contains(name, term) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(file, term) THEN 0.5 ELSE 0.0 END) * w, 6) AS s FROM t0) GROUP BY query_id, term""",
        "t13_digests": f"WITH {json_facts('snapshot_nodes')}, x AS (SELECT id, coalesce(facts::VARCHAR, attributes) AS f FROM (SELECT *, row_number() OVER () AS rid FROM snapshot_nodes) LEFT JOIN jf USING (rid) WHERE attributes IS NOT NULL) SELECT min(id) AS first, count(*) AS n FROM x GROUP BY f",
        "t9_damerau": "SELECT left_id, right_id, damerau_levenshtein(left_id, right_id) AS edits FROM (SELECT DISTINCT left_id, right_id FROM ambiguous_pairs WHERE left_id IS NOT NULL AND right_id IS NOT NULL)",
        "r3_full_scan": CODE_SQL + f""", dc0 AS (SELECT id, {norm.format("coalesce(node_label, '')")} AS name, lower(coalesce(source_file, '')) AS file FROM cn), qq AS (SELECT query_id, list_distinct({_terms('text')}) AS ts FROM {q}), qt0 AS (SELECT query_id, len(ts) AS k, array_to_string(ts, ' ') AS whole, unnest(ts) AS term FROM qq),
          df0 AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM qt0) JOIN dc0 ON contains(name, term) GROUP BY term), h0 AS (SELECT query_id, k, whole, qt0.term, id, name, file, ln(1 + (SELECT count(*) FROM dc0) / (1 + coalesce(df, 0))) AS w FROM qt0 LEFT JOIN df0 ON df0.term = qt0.term JOIN dc0 ON contains(name, qt0.term) OR contains(file, qt0.term)),
          t0 AS (SELECT *, CASE WHEN name = term THEN 1000.0 WHEN starts_with(name, term) THEN 100.0 ELSE 0.0 END AS tier FROM h0),
          p0 AS (SELECT query_id, id, name, any_value(k) AS k, any_value(whole) AS whole, sum(tier * w) AS tiers, sum((CASE WHEN tier = 0 AND contains(name, term) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(file, term) THEN 0.5 ELSE 0.0 END) * w) AS flat, count(*) FILTER (contains(name, term)) AS matched, greatest(1.0, max(w)) AS weight FROM t0 GROUP BY query_id, id, name),
          s0 AS (SELECT query_id, id, name, round(CASE WHEN name = whole THEN 10000.0 * weight WHEN starts_with(name, whole) THEN 1000.0 * weight ELSE 0.0 END + flat + tiers * (matched / k) ** 2, 6) AS score FROM p0)
          SELECT query_id, id, score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(name), id) AS place FROM s0) WHERE place <= 20""",
        "g16_resolved_calls": CODE_SQL + """, ca AS (SELECT DISTINCT l.id AS call_id, regexp_extract(l.target, '^[^:]*:(.*)_[^_]*$', 1) AS name, n.repo AS scope, n.source_file AS file FROM graph_links l JOIN cn n ON n.id = l.source WHERE lower(trim(l.kind)) = 'calls' AND l.target IS NOT NULL AND l.target NOT IN (SELECT id FROM cn)),
          de AS (SELECT DISTINCT node_label AS name, repo AS scope, id, source_file AS file, coalesce(regexp_matches(source_file, '(^|/)tests?/|_test[.]|test_'), false) AS test FROM cn WHERE node_label IS NOT NULL),
          nm AS (SELECT name, scope, count(*) AS n, min(id) AS one, count(*) FILTER (NOT test) AS np, min(id) FILTER (NOT test) AS plain FROM de GROUP BY ALL), fi AS (SELECT name, scope, file, count(*) AS nf, min(id) AS same FROM de WHERE file IS NOT NULL GROUP BY ALL),
          dp AS (SELECT name, scope, id, unnest(range(len(string_split(file, '/')))) AS depth, string_split(file, '/') AS ps FROM de WHERE file IS NOT NULL), df AS (SELECT name, scope, array_to_string(ps[1:depth], '/') AS folder, count(*) AS nn, min(id) AS near FROM dp GROUP BY ALL),
          cp AS (SELECT call_id, name, scope, unnest(range(len(string_split(file, '/')))) AS depth, string_split(file, '/') AS ps FROM ca WHERE file IS NOT NULL),
          ne AS (SELECT call_id, arg_max(nn, depth) AS nn, arg_max(near, depth) AS near FROM cp JOIN df ON df.name = cp.name AND df.scope = cp.scope AND df.folder = array_to_string(cp.ps[1:cp.depth], '/') GROUP BY call_id)
          SELECT ca.call_id, CASE WHEN n = 1 THEN one WHEN np = 1 THEN plain WHEN nf = 1 THEN same WHEN nn = 1 THEN near END AS target, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'unique' WHEN np = 1 THEN 'not_test' WHEN nf = 1 THEN 'same_file' WHEN nn = 1 THEN 'nearest' ELSE 'ambiguous' END AS how
          FROM ca LEFT JOIN nm ON nm.name = ca.name AND nm.scope = ca.scope LEFT JOIN fi ON fi.name = ca.name AND fi.scope = ca.scope AND fi.file = ca.file LEFT JOIN ne ON ne.call_id = ca.call_id""",
        "sd8_impact": CODE_SQL + ", f AS (SELECT DISTINCT source_file FROM cn WHERE source_file IS NOT NULL), p AS (SELECT split_part(source_file, '/', -1) AS path FROM f WHERE contains(split_part(source_file, '/', -1), '_1') UNION SELECT 'src/main/' || source_file FROM f WHERE contains(source_file, '_2')), m AS (SELECT DISTINCT source_file FROM p, f WHERE path = source_file OR ends_with(path, '/' || source_file) OR ends_with(source_file, '/' || path)) SELECT community_id AS community, count(*) AS nodes, count(DISTINCT source_file) AS files FROM cn JOIN m USING (source_file) GROUP BY community_id",
        "st5_reconciled": """WITH v AS (SELECT repo, min(version_no) AS lo, max(version_no) AS hi FROM graph_versions GROUP BY repo),
          s AS (SELECT id || '@' || repo AS key, version_no = lo AS old, row(kind, node_label, source_file) AS body FROM snapshot_nodes JOIN v USING (repo) WHERE id IS NOT NULL AND version_no IN (lo, hi) QUALIFY row_number() OVER (PARTITION BY repo, version_no, id ORDER BY delivered_at DESC, kind DESC) = 1),
          a AS (SELECT * FROM s WHERE old), b AS (SELECT * FROM s WHERE NOT old) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'remove' WHEN a.key IS NULL THEN 'add' ELSE 'update' END AS action FROM a FULL JOIN b ON a.key = b.key WHERE a.body IS DISTINCT FROM b.body OR a.key IS NULL OR b.key IS NULL""",
        "t2_identifier_tokens": names + f"SELECT node_label, array_to_string({_tokens('node_label')}, ' ') AS tokens FROM nl",
        "t3_canonical_tokens": f"SELECT word, {tk.canonical_sql('word', 'duckdb')} AS stem FROM (SELECT DISTINCT unnest({_tokens('text')}) AS word FROM documents)",
        "t4_query_terms": f"SELECT item_id, array_to_string({_terms('text')}, ' ') AS terms FROM eval_items",
        "t5_contexts": "SELECT item_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN list_has_any(regexp_split_to_array(lower(translate(text, '?,', '  ')), '\\s+'), {list(w)}) THEN '{k}' END" for k, w in tk.CONTEXT_HINTS.items()) + "], lambda x: x IS NOT NULL), ',') AS contexts FROM eval_items",
        "t7_labels": names + f"SELECT node_label, {norm.format('node_label')} AS norm, lower(regexp_replace(regexp_replace(trim(node_label), '\\(\\)$', ''), '^\\.', '')) AS symbol FROM nl",
        "t8_entropy": names + f", ch AS (SELECT node_label, c, count(*) AS k FROM (SELECT node_label, unnest(string_split({norm.format('node_label')}, '')) AS c FROM nl) GROUP BY ALL), tt AS (SELECT node_label, sum(k) AS n FROM ch GROUP BY ALL) SELECT node_label, round(-sum(k / n * log2(k / n)), 6) AS entropy FROM ch JOIN tt USING (node_label) GROUP BY node_label",
        "t9_similarity": "SELECT left_id, right_id, round(jaro_similarity(left_id, right_id) * 100, 6) AS jaro, round(jaro_winkler_similarity(left_id, right_id) * 100, 6) AS jaro_winkler FROM (SELECT DISTINCT left_id, right_id FROM ambiguous_pairs WHERE left_id IS NOT NULL AND right_id IS NOT NULL)",
        "t12_typos": names + f", w AS (SELECT DISTINCT unnest({_tokens('node_label')}) AS t FROM nl) SELECT a.t AS term, b.t AS variant FROM w a, w b WHERE a.t <> b.t AND length(a.t) > 2 AND length(b.t) > 1 AND levenshtein(a.t, b.t) <= 1",
        "r1_bm25": CODE_SQL
        + post
        + f""", av AS (SELECT count(*) AS n, avg(length) AS a FROM ln), dc AS (SELECT term, count(*) AS df FROM po GROUP BY term),
        sc AS (SELECT query_id, term, id, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * {rk.K1 + 1} / (tf + {rk.K1} * ({1 - rk.B} + {rk.B} * length / greatest(a, 1.0)))), 9) AS part FROM qt JOIN dc USING (term) JOIN (SELECT id, term, tf FROM po) USING (term) JOIN ln USING (id), (SELECT n AS n_docs, a FROM av)),
        be AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, term, arg_min(id, (-part, id)) AS id FROM sc GROUP BY ALL)), tt AS (SELECT query_id, id, round(sum(part), 6) AS score FROM sc GROUP BY ALL),
        ch AS (SELECT tt.*, row_number() OVER (PARTITION BY tt.query_id ORDER BY (be.id IS NOT NULL) DESC, score DESC, tt.id) AS k FROM tt LEFT JOIN be ON be.query_id = tt.query_id AND be.id = tt.id)
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ch WHERE k <= 20""",
        "r8_callee_recall": CODE_SQL + f", qt AS (SELECT DISTINCT query_id, unnest({_terms('text')}) AS term FROM {q}), nt AS (SELECT DISTINCT id, {stem} AS term FROM (SELECT id, unnest({_tokens('node_label')}) AS w FROM cn)) SELECT query_id, e.src AS id, count(DISTINCT qt.term) AS covered FROM qt JOIN nt USING (term) JOIN ce e ON e.dst = nt.id AND e.type = 'CALLS' GROUP BY ALL",
        "r9_relevance": """WITH p AS (SELECT left_id AS q, right_id AS id, min(decided_at) AS w, max(score) AS s FROM ambiguous_pairs WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
        r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY w, id) AS k, CASE WHEN s >= 97 THEN 3 WHEN s >= 94 THEN 2 WHEN s >= 92 THEN 1 ELSE 0 END AS g FROM p),
        i AS (SELECT q, sum((pow(2, g) - 1) / log2(j + 1)) FILTER (j <= 10) AS ideal FROM (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY g DESC) AS j FROM r WHERE g > 0) GROUP BY q)
        SELECT r.q AS query_id, max((k = 1 AND g > 0)::INT) AS success_1, round(coalesce(1 / nullif(min(k) FILTER (g > 0 AND k <= 10), 0), 0), 6) AS mrr_10, round(count(*) FILTER (g > 0 AND k <= 5) / count(*) FILTER (g > 0), 6) AS recall_5, round(count(*) FILTER (g > 0 AND k <= 20) / count(*) FILTER (g > 0), 6) AS recall_20, round(count(*) FILTER (g > 0 AND k <= 10) / 10, 6) AS precision_10, round(coalesce(sum((pow(2, g) - 1) / log2(k + 1)) FILTER (g > 0 AND k <= 10), 0) / any_value(ideal), 6) AS ndcg_10 FROM r JOIN i ON i.q = r.q GROUP BY r.q""",
        "g2_dedupe_nodes": "SELECT id, kind, ingested_at, deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM graph_nodes) WHERE rn = 1",
        "g3_dedupe_edges": "SELECT source, target, k AS kind, arg_min(id, (ingested_at, id)) AS id, count(*) AS merged FROM (SELECT *, lower(trim(kind)) AS k FROM graph_links WHERE source IS NOT NULL AND target IS NOT NULL) GROUP BY source, target, k",
        "g4_occurrences": CODE_SQL + "SELECT eid, sha256(concat_ws(chr(31), src, dst, type, coalesce(context, chr(0)))) AS key FROM ce",
        "g5_evidence": CODE_SQL + "SELECT src, dst, type, context, count(*) AS n FROM ce WHERE context IS NOT NULL GROUP BY ALL",
        "g8_backfill": CODE_SQL + ", h AS (SELECT e.dst AS id, min(n.source_file) AS f FROM ce e JOIN cn n ON n.id = e.src WHERE e.type = 'CONTAINS' GROUP BY 1) SELECT cn.id, replace(coalesce(source_file, f), '\\', '/') AS source_file FROM cn LEFT JOIN h ON h.id = cn.id",
        "g10_inference": CODE_SQL + CONFIDENCE_SQL + """, n0 AS (SELECT id, source_file, CASE WHEN json_valid(attributes) THEN attributes->'$.evidence' END AS e FROM alive WHERE rn = 1),
          n1 AS (SELECT id, CASE WHEN json_type(e) = 'VARCHAR' AND json_valid(e->>'$') THEN (e->>'$')::JSON ELSE e END AS e FROM n0), n2 AS (SELECT id, lower(CASE WHEN json_type(e) = 'ARRAY' THEN array_to_string(e->>'$[*].confidence', ',') ELSE e->>'$.confidence' END) AS s FROM n1),
          nc AS (SELECT cn.id, source_file IS NOT NULL AS backed, CASE WHEN contains(s, 'ambiguous') THEN 3 WHEN contains(s, 'inferred') THEN 2 WHEN contains(s, 'exact') THEN 1 END AS r FROM cn LEFT JOIN n2 USING (id)),
          ec AS (SELECT eid, src, dst, x.backed AND y.backed AS backed, CASE WHEN contains(cf.s, 'ambiguous') THEN 3 WHEN contains(cf.s, 'inferred') THEN 2 WHEN contains(cf.s, 'exact') THEN 1 END AS r,
            contains(e::VARCHAR, 'qualified-external"') AND contains(lower(e::VARCHAR), '"ast"') AS ext FROM ce JOIN cf USING (eid) JOIN nc x ON x.id = src JOIN nc y ON y.id = dst),
          lv(level, k) AS (VALUES ('low', 0), ('medium', 1), ('high', 2), ('max', 3)),
          ae AS (SELECT level, k, eid, src, dst FROM ec, lv WHERE r = 1 OR (r = 2 AND ((k >= 1 AND backed) OR (k >= 2 AND ext))) OR k = 3)
          SELECT level, 'edge' AS what, eid AS id FROM ae UNION ALL
          SELECT level, 'node', id FROM nc, lv WHERE k = 3 OR r = 1 OR (r = 2 AND k >= 1 AND backed) OR EXISTS (SELECT 1 FROM ae WHERE ae.level = lv.level AND (src = id OR dst = id))""",
        "g12_exact_merges": CODE_SQL + f", k AS (SELECT id, source_file, {norm.format('node_label')} AS name FROM cn WHERE source_file IS NOT NULL), w AS (SELECT source_file, name, arg_min(id, (regexp_matches(id, '_c[0-9]+$'), length(id), id)) AS winner FROM k WHERE name <> '' GROUP BY ALL HAVING count(*) > 1) SELECT id, winner FROM k JOIN w USING (source_file, name)",
        "g14_rewired": CODE_SQL + f", k AS (SELECT id, source_file, {norm.format('node_label')} AS name FROM cn WHERE source_file IS NOT NULL), w AS (SELECT source_file, name, arg_min(id, (regexp_matches(id, '_c[0-9]+$'), length(id), id)) AS winner FROM k WHERE name <> '' GROUP BY ALL HAVING count(*) > 1), m AS (SELECT id, winner FROM k JOIN w USING (source_file, name)) SELECT eid, coalesce(a.winner, src) AS src, coalesce(b.winner, dst) AS dst, type FROM ce LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst WHERE coalesce(a.winner, src) <> coalesce(b.winner, dst) OR src = dst OR type = 'CALLS'",
        "u3_graph_diff": """WITH v AS (SELECT repo, min(version_no) AS lo, max(version_no) AS hi FROM graph_versions GROUP BY repo),
          n0 AS (SELECT DISTINCT repo, 'node' AS part, id, NULL::VARCHAR AS target, NULL::VARCHAR AS kind FROM snapshot_nodes JOIN v USING (repo) WHERE version_no = lo), n1 AS (SELECT DISTINCT repo, 'node' AS part, id, NULL::VARCHAR AS target, NULL::VARCHAR AS kind FROM snapshot_nodes JOIN v USING (repo) WHERE version_no = hi),
          e0 AS (SELECT DISTINCT repo, 'edge' AS part, source AS id, target, kind FROM snapshot_links JOIN v USING (repo) WHERE version_no = lo), e1 AS (SELECT DISTINCT repo, 'edge' AS part, source AS id, target, kind FROM snapshot_links JOIN v USING (repo) WHERE version_no = hi),
          b AS (SELECT * FROM n0 UNION ALL SELECT * FROM e0), a AS (SELECT * FROM n1 UNION ALL SELECT * FROM e1)
          SELECT *, 'new' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
        "u4_merged_graphs": CODE_SQL + """, t AS (SELECT id, CASE WHEN repo IS NULL THEN id ELSE repo || '::' || id END AS pid, repo FROM cn)
          SELECT 'node' AS part, pid AS id, NULL::VARCHAR AS dst, NULL::VARCHAR AS type FROM t UNION ALL SELECT DISTINCT 'edge', x.pid, CASE WHEN y.repo IS NULL THEN y.id ELSE x.repo || '::' || y.id END, type FROM ce JOIN t x ON x.id = src JOIN t y ON y.id = dst WHERE x.repo IS NOT NULL""",
        "h2_structural_diff": meaning("snapshot_nodes", node_cols) + " SELECT repo, version_no, id, change_kind FROM c WHERE change_kind IS NOT NULL",
        "h3_change_counts": "SELECT 'nodes' AS record_root, * FROM (" + meaning("snapshot_nodes", node_cols) + " SELECT repo, version_no, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed, count(*) FILTER (change_kind = 'changed') AS changed FROM c WHERE change_kind IS NOT NULL GROUP BY ALL) UNION ALL SELECT 'links', * FROM (" + meaning("snapshot_links", link_cols) + " SELECT repo, version_no, count(*) FILTER (change_kind = 'added'), count(*) FILTER (change_kind = 'removed'), count(*) FILTER (change_kind = 'changed') FROM c WHERE change_kind IS NOT NULL GROUP BY ALL)",
        "h4_sharing": f"WITH ch AS ({snapshot_sql('snapshot_nodes', NODE_COLUMNS)}), t AS (SELECT s.repo, s.version_no, count(DISTINCT s.id) AS total FROM snapshot_nodes s JOIN graph_versions v ON v.repo = s.repo AND v.version_no = s.version_no GROUP BY ALL), k AS (SELECT repo, version_no, count(*) AS n FROM ch WHERE change_kind <> 'removed' GROUP BY ALL), f AS (SELECT repo, min(version_no) AS lo FROM graph_versions GROUP BY repo) SELECT t.repo, t.version_no, CASE WHEN t.version_no = lo THEN 0 ELSE total - coalesce(n, 0) END AS shared, total FROM t JOIN f USING (repo) LEFT JOIN k ON k.repo = t.repo AND k.version_no = t.version_no",
        "h5_ancestry": "SELECT repo, version_no, commit_id, lag(commit_id) OVER (PARTITION BY repo ORDER BY version_no) AS parent, row_number() OVER (PARTITION BY repo ORDER BY version_no DESC) AS newest FROM graph_versions",
        "h8_trend": "WITH s AS (SELECT DISTINCT repo, version_no, id FROM snapshot_nodes), m AS (SELECT repo, max(version_no) AS newest FROM s GROUP BY repo) SELECT repo, id, min(version_no) AS first_seen, max(version_no) AS last_seen, count(*) AS n, max(version_no) = any_value(newest) AS active FROM s JOIN m USING (repo) GROUP BY repo, id",
        "sd4_invalidated": meaning("snapshot_nodes", node_cols).replace("WITH c", "WITH RECURSIVE c", 1) + ", ca AS (SELECT DISTINCT source AS src, target AS dst FROM snapshot_links WHERE kind = 'calls' AND source IS NOT NULL AND target IS NOT NULL), r(id, depth) AS (SELECT DISTINCT id, 0 FROM c WHERE change_kind IS NOT NULL UNION SELECT src, depth + 1 FROM r JOIN ca ON dst = r.id WHERE depth < 64) SELECT id, min(depth) AS depth FROM r GROUP BY id",
        "sd8_changed_files": CODE_SQL + ", f AS (SELECT DISTINCT source_file FROM cn WHERE source_file IS NOT NULL), p AS (SELECT split_part(source_file, '/', -1) AS path FROM f WHERE contains(split_part(source_file, '/', -1), '_1') UNION SELECT 'src/main/' || source_file FROM f WHERE contains(source_file, '_2')) SELECT DISTINCT path AS changed, source_file FROM p, f WHERE path = source_file OR ends_with(path, '/' || source_file) OR ends_with(source_file, '/' || path)",
        "m1_feedback": "WITH w AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS s, pow(0.5, greatest((epoch_us(TIMESTAMP '2025-01-01') - epoch_us(ts)) / 86400e6, 0) / 30) AS d FROM events), g AS (SELECT user_id, round(sum(s * d), 6) AS score, count(*) FILTER (s > 0) AS p, count(*) FILTER (s < 0) AS n FROM w GROUP BY user_id) SELECT user_id AS subject, score, CASE WHEN p > 0 AND n > 0 THEN 'contested' WHEN p >= 2 THEN 'preferred' WHEN p > 0 THEN 'tentative' WHEN n > 0 THEN 'avoid' ELSE 'neutral' END AS status FROM g",
        "st2_sessions": """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE ts IS NOT NULL),
          w(user_id, k, first, last) AS (SELECT user_id, k, ts, ts FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.ts >= w.last + INTERVAL 1 HOUR OR e.ts >= w.first + INTERVAL 5 HOUR THEN e.ts ELSE w.first END, e.ts FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1),
          b AS (SELECT *, CASE WHEN first = last AND (k = 1 OR first <> lag(first) OVER (PARTITION BY user_id ORDER BY k)) THEN 1 ELSE 0 END AS opens FROM w)
          SELECT user_id, first, count(*) AS n FROM w GROUP BY user_id, first""",
        "st_tumbling": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    }
