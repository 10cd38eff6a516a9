"""Registered queries of program records and resolution, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import history as hi
from .. import program as pr
from ..graph import code_graph, evidence_graph
from ..history import compare as cm
from ..operators import resolve as rs
from ..operators import review as rv
from ..runtime import table
from .patterns import CODE_SQL
from .structure import CONFIDENCE_SQL


def _last_functions(spark, d):
    """Callable nodes of the last version of each repository."""
    s = table(spark, d, "snapshot_nodes")
    last = table(spark, d, "graph_versions").groupBy("repo").agg(F.max("version_no").alias("version_no"))
    return s.join(last, ["repo", "version_no"]).where(F.col("kind").isin(*pr.CALLABLE) & F.col("id").isNotNull())


def j16_program_join(spark, d):
    f = _last_functions(spark, d).select(F.concat_ws("@", "id", "repo").alias("symbol_id"), F.col("node_label").alias("name"), F.when(F.col("start_line") % 7 != 0, F.col("id")).alias("graph_node_id")).distinct()
    return pr.join_program(f, code_graph(spark, d).nodes)


def j17_call_sites(spark, d):
    """The innermost callable that contains each call site."""
    g = code_graph(spark, d)
    calls = table(spark, d, "graph_links").where("lower(trim(kind)) = 'calls' and source is not null")
    site = F.from_json("attributes", "relationshipSite struct<file: string, startLine: string>")["relationshipSite"]
    homes = g.nodes.select(F.col("id").alias("source"), "source_file")
    sites = calls.join(homes, "source").select(F.col("id").alias("site_id"), F.coalesce(site["file"], "source_file").alias("file"), F.expr("try_cast(" + "from_json(attributes, 'relationshipSite struct<file: string, startLine: string>').relationshipSite.startLine" + " as int)").alias("line")).where("file is not null and line is not null").groupBy("site_id").agg(F.min("file").alias("file"), F.min("line").alias("line"))
    return pr.innermost(sites, g.nodes.where(F.col("kind").isin(*pr.CALLABLE)).select("id", F.col("source_file").alias("file"), "start_line", "end_line"))


def ir1_bundle(spark, d):
    """One record per node from what all extractors say."""
    e = F.from_json(F.from_json("attributes", "evidence string")["evidence"], "array<struct<extractor: string, confidence: string, score: string>>")
    facts = table(spark, d, "graph_nodes").select(F.col("id").alias("symbol_id"), "attributes").distinct().select("symbol_id", F.explode(e).alias("e")).where("e.extractor is not null")
    return pr.merge_providers(facts.select("symbol_id", F.col("e.extractor").alias("provider"), F.col("e.confidence").alias("confidence"), F.expr("try_cast(e.score as double)").alias("score")))


def _calls(spark, d):
    g = evidence_graph(spark, d)
    return pr.call_edges(g.edges.where("type = 'CALLS'"), g)


def ir4_call_graph(spark, d):
    roots = code_graph(spark, d).nodes.where("label = 'Method'").select("id")
    return pr.call_graph(_calls(spark, d), roots, max_nodes=16)[0]


def ir4_call_graph_edges(spark, d):
    roots = code_graph(spark, d).nodes.where("label = 'Method'").select("id")
    return pr.call_graph(_calls(spark, d), roots, "in", 3, 16, 8)[1]


def ir5_universal_calls(spark, d):
    return pr.universal_calls(_calls(spark, d))


def ir7_validation(spark, d):
    s = table(spark, d, "snapshot_nodes")
    return pr.validate(s.select(F.concat_ws("@", "repo", "version_no").alias("module"), F.col("id").alias("symbol_id"), F.when(F.col("start_line") % 50 == 0, F.concat(F.lit("../"), "source_file")).otherwise(F.col("source_file")).alias("source_file"), "start_line", "end_line"))


def g6_ghosts(spark, d):
    return rs.ghost_duplicates(evidence_graph(spark, d).nodes.where("repo is not null"), ("repo", "kind", "node_label"))


def g6_doc_twins(spark, d):
    """Twins among documents named after their nodes."""
    docs = table(spark, d, "documents").where("node_id is not null").select("node_id", "doc_path", F.explode(F.array(F.lit(""), F.when(F.col("doc_kind") == "readme", F.lit("_doc")))).alias("end")).where("end is not null")
    return rs.doc_twins(docs.select(F.concat("node_id", "end").alias("id"), F.col("doc_path").alias("source_file"), F.lit("Document").alias("kind")).distinct()).distinct()


def g18_member_calls(spark, d):
    """Calls on members of named types, resolved again from the names alone."""
    g = code_graph(spark, d)
    kinds = ("Class", "Interface", "Struct", "Trait", "Enum", "Module", "Namespace")
    n = g.nodes.where("repo is not null").withColumn("family", F.coalesce(rv.family(F.col("lang")), F.lit("none")))
    types = n.where(F.col("label").isin(*kinds)).select(F.col("id").alias("type_id"), F.col("node_label").alias("name"), "family")
    holds = g.edges.where("type = 'CONTAINS'").select(F.col("src").alias("type_id"), F.col("dst").alias("id")).distinct()
    members = holds.join(types.select("type_id"), "type_id").join(n.select("id", F.col("node_label").alias("member")), "id").select("type_id", "member", "id")
    supers = g.edges.where("type = 'EXTENDS'").select(F.col("src").alias("type_id"), F.col("dst").alias("super_id"))
    owners = members.groupBy("id").agg(F.min("type_id").alias("type_id"), F.min("member").alias("member")).join(types, "type_id")
    calls = g.edges.where("type in ('CALLS', 'READS', 'WRITES', 'REFERENCES')").join(owners.withColumnRenamed("id", "dst"), "dst").select(F.col("eid").alias("call_id"), F.col("name").alias("receiver"), "member", "family")
    return rs.member_calls(calls, types, members, supers)


def g19_routes(spark, d):
    facts = rs.route_facts(table(spark, d, "graph_links").where("source is not null"))
    return rs.resolve_routes(facts, code_graph(spark, d).nodes.where("repo is not null"))


def _version(spark, d, pick):
    """Contracts and operations of the first or the last version of each repository."""
    v = table(spark, d, "graph_versions").groupBy("repo").agg(pick("version_no").alias("version_no"))
    n = table(spark, d, "snapshot_nodes").join(v, ["repo", "version_no"]).where(F.col("id").isNotNull())
    n = n.groupBy("repo", "id").agg(F.max_by(F.struct("kind", "attributes"), F.struct("delivered_at", "attributes")).alias("r")).select("repo", "id", "r.*").where(F.col("kind").isin(*pr.CALLABLE))
    data = F.from_json(F.from_json("attributes", "details string")["details"], "data string")["data"]
    mods = F.coalesce(F.from_json(F.get_json_object(data, "$.modifiers"), "array<string>"), F.array().cast("array<string>"))
    names = F.filter(F.split(F.regexp_extract(F.get_json_object(data, "$.signature"), r"\(([^)]*)\)", 1), r"\s*,\s*"), lambda x: x != "")
    parameter = lambda x: F.struct(x.alias("name"), F.lit("positional").alias("kind"), F.lit(True).alias("required"), F.lit(None).cast("string").alias("default_digest"))
    functions = n.select(
        F.concat_ws("@", "id", "repo").alias("symbol_id"), F.lit("any").alias("language"), F.when(F.array_contains(mods, "pub"), "public").otherwise("private").alias("visibility"), F.when(F.array_contains(mods, "async"), "async").otherwise("sync").alias("execution_mode"),
        F.lit(None).cast("string").alias("return_type"), F.lit(True).alias("complete"), F.concat_ws("/", "kind", F.get_json_object(data, "$.arity")).alias("body_digest"), F.coalesce(F.transform(names, parameter), F.array().cast(f"array<{hi.PARAMETER}>")).alias("parameters"),
    )
    does = F.when(F.col("kind") == "calls", "call").when(F.col("kind") == "reads", "read").when(F.col("kind") == "writes", "write").when(F.col("kind").isin("imports", "depends_on"), "dependency")
    links = table(spark, d, "snapshot_links").join(v, ["repo", "version_no"])
    operations = links.select(F.concat_ws("@", "source", "repo").alias("symbol_id"), does.alias("kind"), F.concat_ws("@", "target", "repo").alias("path")).where("kind is not null and symbol_id is not null and path is not null").distinct()
    tests = links.where("kind = 'tests' and target is not null").select(F.concat_ws("@", "target", "repo").alias("symbol_id"))
    return functions, operations, tests


def _compared(spark, d):
    (old, before, _), (new, after, tests) = _version(spark, d, F.min), _version(spark, d, F.max)
    return cm.compare(old, new, before, after, tests)


def sd1_findings(spark, d):
    return _compared(spark, d)


def sd2_contracts(spark, d):
    return hi.contract_changes(_version(spark, d, F.min)[0], _version(spark, d, F.max)[0])


def sd3_behavior(spark, d):
    (old, before, _), (new, after, _) = _version(spark, d, F.min), _version(spark, d, F.max)
    return cm.behavior(old, new, before, after)


def sd10_risk(spark, d):
    """Risk of each repository's change from its first to its last version."""
    return hi.risk(hi.risk_factors(_compared(spark, d), F.substring_index("symbol_id", "@", -1)), "version")


def sk13_sarif(spark, d):
    """The results of the log, read back."""
    n = table(spark, d, "snapshot_nodes").groupBy("id", "repo").agg(F.min("source_file").alias("source_file"), F.min("start_line").alias("start_line"))
    got = cm.sarif(_compared(spark, d), n.select(F.concat_ws("@", "id", "repo").alias("symbol_id"), "source_file", "start_line")).where("ord = 1")
    line = F.regexp_replace("line", "^,", "")
    return got.select(F.get_json_object(line, "$.ruleId").alias("rule"), F.get_json_object(line, "$.level").alias("level"), F.get_json_object(line, "$.message.text").alias("message"), F.get_json_object(line, "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


def sk13_markdown(spark, d):
    return cm.review_lines(_compared(spark, d), markdown=True)


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in ("queries", "oracle_sql")}


def _list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def oracle_sql() -> dict[str, str]:
    bare = "regexp_replace(regexp_replace({0}, '(\\(\\))+$', ''), '^\\.+', '')"
    calls = CODE_SQL + CONFIDENCE_SQL + """, ca AS (SELECT eid, src, dst, CASE WHEN contains(s, 'ambiguous') THEN 'ambiguous' WHEN contains(s, 'inferred') OR is_deferred THEN 'inferred' ELSE 'resolved' END AS resolution FROM ce JOIN cf USING (eid) WHERE type = 'CALLS')"""
    reach = """, ad AS ({ways}), r(root, node, depth) AS (SELECT id, id, 0 FROM cn WHERE label = 'Method' UNION SELECT r.root, t, depth + 1 FROM r JOIN ad ON h = node WHERE depth < {depth}), mi AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
      nd AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY node) <= 16 OR node = root AS kept FROM mi)"""
    family = "CASE " + " ".join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in rv.FAMILIES.items()) + " ELSE coalesce(lang, 'none') END"
    vis = "CASE WHEN vis = 'public' THEN 2 ELSE 0 END"
    side = """{p}v AS (SELECT repo, {pick}(version_no) AS version_no FROM graph_versions GROUP BY repo), {p}n AS (SELECT * FROM snapshot_nodes JOIN {p}v USING (repo, version_no) WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY delivered_at DESC, attributes DESC) = 1),
      {p}d AS (SELECT id || '@' || repo AS sym, kind, CASE WHEN json_valid(attributes) THEN attributes->'$.details.data' END AS j FROM {p}n WHERE kind IN ('function', 'method', 'constructor', 'closure')),
      {p}f AS (SELECT sym, CASE WHEN list_contains(coalesce(j->>'$.modifiers[*]', []), 'pub') THEN 'public' ELSE 'private' END AS vis, CASE WHEN list_contains(coalesce(j->>'$.modifiers[*]', []), 'async') THEN 'async' ELSE 'sync' END AS mode, concat_ws('/', kind, j->>'$.arity') AS body,
        list_filter(regexp_split_to_array(coalesce(regexp_extract(j->>'$.signature', '\\(([^)]*)\\)', 1), ''), '\\s*,\\s*'), lambda x: x <> '') AS ps FROM {p}d),
      {p}o AS (SELECT DISTINCT source || '@' || repo AS sym, CASE kind WHEN 'calls' THEN 'call' WHEN 'reads' THEN 'read' WHEN 'writes' THEN 'write' ELSE 'dependency' END AS kind, target || '@' || repo AS path FROM snapshot_links JOIN {p}v USING (repo, version_no) WHERE kind IN ('calls', 'reads', 'writes', 'imports', 'depends_on') AND source IS NOT NULL AND target IS NOT NULL)"""
    compared = "WITH RECURSIVE " + side.format(p="a", pick="min") + ", " + side.format(p="b", pick="max") + f""",
      ct AS (SELECT sym, CASE WHEN {vis.replace('vis', 'y.vis')} < {vis.replace('vis', 'x.vis')} OR x.mode <> y.mode OR len(x.ps) <> len(y.ps) THEN 'proven_break' WHEN x.ps <> y.ps THEN 'compatible' END AS c FROM af x JOIN bf y USING (sym)),
      dl AS (SELECT *, 'gained' AS ch FROM (SELECT * FROM bo EXCEPT SELECT * FROM ao) UNION ALL SELECT *, 'lost' FROM (SELECT * FROM ao EXCEPT SELECT * FROM bo)), dc AS (SELECT sym, count(*) FILTER (ch = 'gained') AS gained, count(*) FILTER (ch = 'lost') AS lost FROM dl GROUP BY sym),
      bh AS (SELECT x.sym, CASE WHEN x.sym IN (SELECT sym FROM ao) AND x.sym IN (SELECT sym FROM bo) AND coalesce(gained + lost, 0) > 0 THEN 'changed' ELSE 'indeterminate' END AS verdict, coalesce(gained, 0) AS gained, coalesce(lost, 0) AS lost FROM af x JOIN bf y USING (sym) LEFT JOIN dc ON dc.sym = x.sym WHERE x.body <> y.body),
      fi AS (SELECT sym, 'structural' AS finding, 'compatible' AS compatibility FROM bf WHERE sym NOT IN (SELECT sym FROM af) UNION ALL SELECT sym, 'contract', CASE WHEN vis = 'public' THEN 'proven_break' ELSE 'possible_break' END FROM af WHERE sym NOT IN (SELECT sym FROM bf) UNION ALL SELECT sym, 'contract', c FROM ct WHERE c IS NOT NULL
        UNION ALL SELECT sym, 'behavior', CASE verdict WHEN 'changed' THEN 'behavioral' ELSE 'indeterminate' END FROM bh UNION ALL SELECT DISTINCT sym, 'dependency', CASE ch WHEN 'gained' THEN 'compatible' ELSE 'possible_break' END FROM dl WHERE kind = 'dependency'),
      cs AS (SELECT path AS h, sym AS t FROM ao WHERE kind = 'call' UNION SELECT path, sym FROM bo WHERE kind = 'call'), r(root, node) AS (SELECT sym, sym FROM fi UNION SELECT root, t FROM r JOIN cs ON h = node), cn AS (SELECT root AS sym, count(*) - 1 AS n FROM r GROUP BY root),
      ts AS (SELECT DISTINCT target || '@' || repo AS sym FROM snapshot_links JOIN bv USING (repo, version_no) WHERE kind = 'tests' AND target IS NOT NULL), kn AS (SELECT fi.*, coalesce(n, 0) AS consumers, sym IN (SELECT sym FROM ts) AS tested FROM fi LEFT JOIN cn USING (sym)),
      al AS (SELECT * FROM kn UNION ALL SELECT DISTINCT sym, 'verification_gap', 'not_applicable', consumers, tested FROM kn WHERE NOT tested),
      re AS (SELECT sym AS symbol_id, finding, compatibility, consumers, tested, CASE finding {' '.join(f"WHEN '{k}' THEN {v}" for k, v in hi.PRIORITY.items())} END + least(consumers, 100) AS priority FROM al) """
    points = " + ".join(f"least({c} * {hi.RISK[k][0]}, {hi.RISK[k][1]})" for k, c in (("public_contract_change", "count(*) FILTER (finding = 'contract' AND compatibility IN ('proven_break', 'possible_break'))"), ("affected_consumer", "coalesce(sum(consumers) FILTER (finding <> 'verification_gap'), 0)"), ("verification_gap", "count(*) FILTER (finding = 'verification_gap')"), ("incomplete_evidence", "count(*) FILTER (compatibility = 'indeterminate')")))
    return {
        "sd10_risk": compared + f", sc AS (SELECT split_part(symbol_id, '@', -1) AS version, least({points}, 100)::BIGINT AS score FROM re GROUP BY 1) SELECT version, score, CASE WHEN score <= 19 THEN 'low' WHEN score <= 44 THEN 'moderate' WHEN score <= 69 THEN 'high' ELSE 'critical' END AS band FROM sc",
        "sd1_findings": compared + "SELECT * FROM re",
        "sd2_contracts": compared + "SELECT sym AS symbol_id, c AS compatibility FROM ct WHERE c IS NOT NULL",
        "sd3_behavior": compared + "SELECT sym AS symbol_id, verdict, gained, lost FROM bh",
        "sk13_sarif": compared + ", pl AS (SELECT id || '@' || repo AS symbol_id, min(source_file) AS uri FROM snapshot_nodes GROUP BY 1) SELECT finding AS rule, CASE compatibility WHEN 'proven_break' THEN 'error' WHEN 'possible_break' THEN 'warning' WHEN 'behavioral' THEN 'warning' ELSE 'note' END AS level, symbol_id || ': ' || finding || ', ' || compatibility AS message, uri FROM re LEFT JOIN pl USING (symbol_id)",
        "sk13_markdown": compared + "SELECT 0 AS ord, finding AS key, '- ' || finding || ': ' || count(*) AS line FROM re GROUP BY finding UNION ALL SELECT 1, printf('%05d', 99999 - priority) || '|' || symbol_id || '|' || finding, '- `' || symbol_id || '` ' || finding || ' (' || compatibility || ', ' || consumers || ' consumers' || CASE WHEN tested THEN '' ELSE ', untested' END || ')' FROM re",
        "j16_program_join": CODE_SQL + f""", lv AS (SELECT repo, max(version_no) AS version_no FROM graph_versions GROUP BY repo), f AS (SELECT DISTINCT id || '@' || repo AS symbol_id, node_label AS name, CASE WHEN start_line % 7 <> 0 THEN id END AS nid FROM snapshot_nodes JOIN lv USING (repo, version_no) WHERE kind IN {_list(pr.CALLABLE)} AND id IS NOT NULL)
          SELECT symbol_id, cn.id AS node_id, CASE WHEN nid IS NULL THEN 'orphan' WHEN cn.id IS NULL THEN 'absent' WHEN {bare.format('node_label')} IS NOT DISTINCT FROM {bare.format('name')} THEN 'joined' ELSE 'conflict' END AS state FROM f LEFT JOIN cn ON cn.id = nid""",
        "j17_call_sites": CODE_SQL + f""", s0 AS (SELECT l.id, n.source_file AS f, CASE WHEN json_valid(attributes) THEN attributes->'$.relationshipSite' END AS site FROM graph_links l JOIN cn n ON n.id = l.source WHERE lower(trim(l.kind)) = 'calls'),
          s1 AS (SELECT id AS site_id, coalesce(site->>'$.file', f) AS file, try_cast(site->>'$.startLine' AS INT) AS line FROM s0), s AS (SELECT site_id, min(file) AS file, min(line) AS line FROM s1 WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY site_id),
          h AS (SELECT site_id, arg_min(cn.id, (end_line - start_line, cn.id)) AS owner_id FROM s JOIN cn ON cn.source_file = file AND line BETWEEN start_line AND end_line WHERE kind IN {_list(pr.CALLABLE)} GROUP BY site_id) SELECT site_id, owner_id FROM s LEFT JOIN h USING (site_id)""",
        "ir1_bundle": """WITH e0 AS (SELECT DISTINCT id, CASE WHEN json_valid(attributes) THEN attributes->'$.evidence' END AS e FROM (SELECT DISTINCT id, attributes FROM graph_nodes)), e1 AS (SELECT id, CASE WHEN json_type(e) = 'VARCHAR' AND json_valid(e->>'$') THEN (e->>'$')::JSON ELSE e END AS e FROM (SELECT id, CASE WHEN json_valid(attributes) THEN attributes->'$.evidence' END AS e FROM (SELECT DISTINCT id, attributes FROM graph_nodes))),
          x AS (SELECT id, unnest(CASE WHEN json_type(e) = 'ARRAY' THEN json_extract(e, '$[*]') WHEN json_type(e) = 'OBJECT' THEN [e] ELSE [] END) AS v FROM e1), f AS (SELECT id, v->>'$.extractor' AS p, v->>'$.confidence' AS c, coalesce(try_cast(v->>'$.score' AS DOUBLE), -1) AS s FROM x WHERE (v->>'$.extractor') IS NOT NULL),
          o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE c WHEN 'exact' THEN 0 WHEN 'inferred' THEN 1 WHEN 'ambiguous' THEN 2 ELSE 3 END, s DESC, p) AS k FROM f)
          SELECT id AS symbol_id, count(DISTINCT p) AS providers, count(*) AS facts, max(p) FILTER (k = 1) AS provider, max(c) FILTER (k = 1) AS confidence, coalesce(min(c) <> max(c), false) AS conflict FROM o GROUP BY id""",
        "ir4_call_graph": calls + reach.format(ways="SELECT src AS h, dst AS t FROM ca UNION SELECT dst, src FROM ca", depth=2) + " SELECT root, node, depth, kept FROM nd",
        "ir4_call_graph_edges": calls + reach.format(ways="SELECT DISTINCT dst AS h, src AS t FROM ca", depth=3) + " SELECT x.root, eid, row_number() OVER (PARTITION BY x.root ORDER BY eid) <= 8 AS kept FROM ca JOIN nd x ON x.node = src AND x.kept JOIN nd y ON y.node = dst AND y.kept AND y.root = x.root",
        "ir5_universal_calls": calls + ", fi AS (SELECT DISTINCT src FROM ca WHERE resolution = 'resolved') SELECT DISTINCT src, dst, CASE WHEN src IN (SELECT src FROM fi) THEN 'program' ELSE 'structural' END AS layer FROM ca WHERE resolution = 'resolved' OR src NOT IN (SELECT src FROM fi)",
        "ir7_validation": """WITH f AS (SELECT concat_ws('@', repo, version_no) AS module, id AS symbol_id, CASE WHEN start_line % 50 = 0 THEN '../' || source_file ELSE source_file END AS p, start_line, end_line FROM snapshot_nodes)
          SELECT DISTINCT module, symbol_id, 'no symbol' AS problem FROM f WHERE coalesce(symbol_id, '') = '' UNION ALL SELECT DISTINCT module, symbol_id, 'path' FROM f WHERE p = '' OR starts_with(p, '/') OR contains(p, chr(92)) OR regexp_matches(p, '(^|/)[.][.](/|$)') OR regexp_matches(p, '^[A-Za-z]:')
          UNION ALL SELECT DISTINCT module, symbol_id, 'lines' FROM f WHERE start_line > end_line OR start_line < 1 UNION ALL SELECT module, symbol_id, 'repeated' FROM f WHERE symbol_id IS NOT NULL GROUP BY module, symbol_id HAVING count(*) > 1""",
        "g6_ghosts": CODE_SQL + """, o0 AS (SELECT id, CASE WHEN json_valid(attributes) THEN attributes->'$.evidence' END AS e FROM alive WHERE rn = 1), o1 AS (SELECT id, CASE WHEN json_type(e) = 'VARCHAR' AND json_valid(e->>'$') THEN (e->>'$')::JSON ELSE e END AS e FROM o0),
          oo AS (SELECT cn.id, repo, kind, node_label, coalesce(lower(CASE WHEN json_type(e) = 'ARRAY' THEN e->>'$[0].origin' ELSE e->>'$.origin' END) = 'ast', false) AS ast FROM cn LEFT JOIN o1 USING (id) WHERE repo <> '' AND kind <> '' AND node_label <> ''),
          u AS (SELECT repo, kind, node_label, min(id) AS winner FROM oo WHERE ast GROUP BY ALL HAVING count(*) = 1) SELECT id, winner FROM oo JOIN u USING (repo, kind, node_label) WHERE NOT ast AND id <> winner""",
        "g6_doc_twins": "WITH n AS (SELECT DISTINCT node_id AS id, doc_path AS f FROM documents WHERE node_id IS NOT NULL AND doc_path <> ''), w AS (SELECT DISTINCT node_id AS id, doc_path AS f FROM documents WHERE node_id IS NOT NULL AND doc_path <> '' AND doc_kind = 'readme') SELECT DISTINCT n.id, n.id || '_doc' AS winner FROM n JOIN w USING (id, f)",
        "g18_member_calls": CODE_SQL + f""", nn AS (SELECT *, {family} AS family FROM cn WHERE repo IS NOT NULL), ty AS (SELECT id AS t, node_label AS name, family FROM nn WHERE label IN ('Class', 'Interface', 'Struct', 'Trait', 'Enum', 'Module', 'Namespace')),
          me AS (SELECT DISTINCT src AS t, node_label AS member, nn.id FROM ce JOIN ty ON ty.t = src JOIN nn ON nn.id = dst WHERE type = 'CONTAINS'), ow AS (SELECT id, min(t) AS t, min(member) AS member FROM me GROUP BY id),
          cl AS (SELECT eid, ty.name AS receiver, ow.member, family FROM ce JOIN ow ON ow.id = dst JOIN ty ON ty.t = ow.t WHERE type IN ('CALLS', 'READS', 'WRITES', 'REFERENCES')),
          na AS (SELECT name, family, count(DISTINCT t) AS n, min(t) AS t FROM ty GROUP BY ALL), su(t, h, depth) AS (SELECT t, t, 0 FROM ty UNION SELECT su.t, dst, depth + 1 FROM su JOIN ce ON src = h AND type = 'EXTENDS' WHERE depth < 40), sm AS (SELECT t, h, min(depth) AS depth FROM su GROUP BY t, h),
          he AS (SELECT sm.t, member, depth, count(DISTINCT me.id) AS k, min(me.id) AS target FROM sm JOIN me ON me.t = h GROUP BY ALL), ne AS (SELECT * FROM he QUALIFY row_number() OVER (PARTITION BY t, member ORDER BY depth) = 1)
          SELECT eid AS call_id, CASE WHEN n = 1 AND k = 1 THEN target END AS target, CASE WHEN n IS NULL THEN 'unknown_type' WHEN n > 1 THEN 'ambiguous_type' WHEN k IS NULL THEN 'missing_member' WHEN k > 1 THEN 'ambiguous_member' WHEN depth = 0 THEN 'own' ELSE 'inherited' END AS how
          FROM cl LEFT JOIN na ON na.name = receiver AND na.family = cl.family LEFT JOIN ne ON ne.t = na.t AND ne.member = cl.member AND n = 1""",
        "g19_routes": CODE_SQL + """, d0 AS (SELECT DISTINCT id, source, CASE WHEN json_valid(attributes) THEN attributes->'$.details' END AS d FROM graph_links WHERE source IS NOT NULL), d1 AS (SELECT id, source, CASE WHEN json_type(d) = 'VARCHAR' AND json_valid(d->>'$') THEN (d->>'$')::JSON ELSE d END AS d FROM d0),
          d2 AS (SELECT id, source, d->'$.data' AS d, d->'$.data.stages' AS st FROM d1 WHERE (d->>'$.type') = 'route'), d3 AS (SELECT id, source, d, unnest(CASE WHEN json_type(st) = 'ARRAY' THEN json_extract(st, '$[*]') WHEN json_type(st) = 'OBJECT' THEN [st] ELSE [] END) AS s FROM d2),
          f AS (SELECT DISTINCT id, source, upper(d->>'$.operation') AS operation, regexp_replace(regexp_replace(d->>'$.path', '\\{[^}]*\\}|<[^>]*>|:[A-Za-z_][A-Za-z0-9_]*', '{}', 'g'), '(.)/+$', '\\1') AS path, s->>'$.reference' AS reference, s->>'$.target' AS target FROM d3 WHERE (s->>'$.stage') = 'handler'),
          ln AS (SELECT repo, node_label, count(*) AS n, min(id) AS one FROM cn WHERE repo IS NOT NULL GROUP BY ALL)
          SELECT f.id AS link_id, operation, path, reference, CASE WHEN k.id IS NOT NULL THEN target WHEN n = 1 THEN one END AS handler, CASE WHEN k.id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution
          FROM f LEFT JOIN cn k ON k.id = target AND k.repo IS NOT NULL LEFT JOIN cn h ON h.id = source AND h.repo IS NOT NULL LEFT JOIN ln ON ln.repo = h.repo AND ln.node_label = reference""",
    }
