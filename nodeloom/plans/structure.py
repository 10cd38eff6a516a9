"""Registered structural queries and analytics over the code graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import code_graph, evidence_graph, numbered_graph, with_index
from ..operators import analytics as an
from ..operators import traverse as tr
from ..query import scoped
from ..runtime import table
from .patterns import CODE_SQL


def _seeds(graph, label="Interface"):
    return graph.nodes.where(F.col("label") == label).select(F.col("id").alias("root"), F.col("id").alias("node"))


def _pairs(graph):
    """The first caller and the last callee of each repository."""
    calls = graph.edges.where("type = 'CALLS'").join(graph.nodes.select(F.col("id").alias("src"), "repo"), "src")
    return calls.where("repo is not null").groupBy("repo").agg(F.min("src").alias("a"), F.max("dst").alias("b")).select("a", "b")


def _file_graph(graph):
    f = lambda k, p: graph.nodes.select(F.col("id").alias(k), F.col("source_file").alias(p)).where(f"{p} is not null")
    e = graph.edges.where("type = 'IMPORTS' and not coalesce(is_deferred, false)")
    return e.join(f("src", "x"), "src").join(f("dst", "y"), "dst").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()


def q2_resolve_symbol(spark, d):
    g = code_graph(spark, d)
    return tr.resolve_symbol(g.nodes, g.nodes.where("label = 'Class'").select(F.col("node_label").alias("symbol")).distinct())


def q3_callers(spark, d):
    return tr.callers(code_graph(spark, d))


def q4_callees(spark, d):
    return tr.callees(code_graph(spark, d))


def q5_impact(spark, d):
    g = code_graph(spark, d)
    return tr.impact(g, _seeds(g)).select("root", "node", "depth", "parent", "eid")


def q6_explore(spark, d):
    g = code_graph(spark, d)
    return tr.trails(g, _pairs(g), direction="both").select("a", "b", "hops")


def q7_node_trail(spark, d):
    g = code_graph(spark, d)
    return tr.node_trail(g, _pairs(g)).select("a", "b", "hops", "diagnostic")


def q10_affected(spark, d):
    g = code_graph(spark, d)
    return tr.affected(g, _seeds(g, "Class")).select("root", "node", "depth", F.lower("type").alias("relation"))


def q12_find_node(spark, d):
    return tr.find_node(code_graph(spark, d).nodes, "parser", 100000)


def q14_explain(spark, d):
    return tr.explain(code_graph(spark, d))


def q17_pages(spark, d):
    n = code_graph(spark, d).nodes.where("source_file is not null").select("source_file", "id", F.char_length("qualified_name").cast("bigint").alias("chars"))
    return tr.text_pages(n, 20, "source_file", "id", "chars")


def sc14_incident(spark, d):
    g = code_graph(spark, d)
    return tr.neighbours(g, tr.LENSES["data"], "both").select("symbol", "neighbour", "eid")


def sc16_contexts(spark, d):
    return code_graph(spark, d).with_contexts("call", "import").edges.select("eid", "src", "dst", "type", "context")


def sk14_lenses(spark, d):
    e = code_graph(spark, d).edges
    lens = F.explode(F.filter(F.array(*[F.when(F.col("type").isin(*t), F.lit(n)) for n, t in tr.LENSES.items()]), lambda x: x.isNotNull()))
    return e.select(lens.alias("lens"), "type").groupBy("lens", "type").agg(F.count(F.lit(1)).alias("n"))


def d5_neighbourhood(spark, d):
    g = code_graph(spark, d)
    return tr.discover(g, _seeds(g))[0]


def d6_induced_edges(spark, d):
    g = code_graph(spark, d)
    return tr.discover(g, _seeds(g))[1].select("root", "eid")


def o6_bounded(spark, d):
    """What each interface impacts, at most 20 nodes, and what that leaves out."""
    g = code_graph(spark, d)
    return tr.bounded(tr.impact(g, _seeds(g)).select("root", "node", "depth"), "root", ("depth", "node"), 20)


def d4_scoped(spark, d):
    """Nodes and links of one package."""
    g = scoped(code_graph(spark, d), package="planner")
    return g.nodes.select(F.lit("node").alias("part"), "id").unionByName(g.edges.select(F.lit("link").alias("part"), F.col("eid").alias("id")))


def f14_node_index(spark, d):
    return with_index(code_graph(spark, d).nodes.select("id"), "id")


def an1_degree(spark, d):
    return code_graph(spark, d).degrees()


def an2_god_nodes(spark, d):
    return an.god_nodes(code_graph(spark, d), 25)


def an3_louvain(spark, d):
    return an.louvain(an.simple_edges(code_graph(spark, d)))


def an4_modularity(spark, d):
    g = code_graph(spark, d)
    return an.modularity(an.simple_edges(g), an.communities(g))


def an6_hubs(spark, d):
    g = code_graph(spark, d)
    return an.exclude_hubs(g, an.communities(g), 99)


def an7_cohesion(spark, d):
    g = code_graph(spark, d)
    return an.cohesion(an.simple_edges(g), an.communities(g))


def an8_community_order(spark, d):
    return an.community_order(an.communities(code_graph(spark, d)))


def an10_stable_ids(spark, d):
    g = numbered_graph(spark, d)
    stable = an.remap_communities(an.louvain(an.simple_edges(g)), an.communities(g))
    return stable.join(g.nodes.select(F.col("id").alias("community"), "name"), "community").select(F.col("name").alias("community"), "stable_id")


def an11_community_hubs(spark, d):
    g = code_graph(spark, d)
    return an.community_hubs(g, an.communities(g))


def an13_betweenness(spark, d):
    return an.node_betweenness(an.simple_edges(code_graph(spark, d)))


def an14_edge_betweenness(spark, d):
    g = code_graph(spark, d)
    return an.edge_betweenness(an.simple_edges(g))


def an15_surprises(spark, d):
    return an.surprises(evidence_graph(spark, d))


def an16_cross_community(spark, d):
    return an.cross_community(evidence_graph(spark, d))


def an17_import_cycles(spark, d):
    return an.import_cycles(_file_graph(code_graph(spark, d)))


def an18_blind_spots(spark, d):
    return an.blind_spots(code_graph(spark, d))


def an19_components(spark, d):
    return an.disconnected(code_graph(spark, d))


def an22_cycle_edges(spark, d):
    g = code_graph(spark, d)
    e = g.edges.where("type in ('CALLS', 'IMPORTS', 'EXTENDS', 'DEPENDS_ON') and not coalesce(is_deferred, false)")
    return an.cycle_edges(e).select("src", "dst")


def a11_graph_stats(spark, d):
    g = code_graph(spark, d)
    n = g.nodes.agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n"))
    e = g.edges.agg(F.lit("edges").alias("what"), F.count(F.lit(1)).alias("n"))
    c = g.nodes.agg(F.lit("communities").alias("what"), F.count_distinct("community_id").alias("n"))
    return n.unionByName(e).unionByName(c)


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in ("queries", "oracle_sql")}


def _types(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_BOTH = ", bo AS (SELECT src AS h, dst AS t FROM ce UNION ALL SELECT dst, src FROM ce WHERE src <> dst)"
_PAIRS = ", pr AS (SELECT min(e.src) AS a, max(e.dst) AS b FROM ce e JOIN cn n ON n.id = e.src WHERE e.type = 'CALLS' AND n.repo IS NOT NULL GROUP BY n.repo)"
_SIMPLE = ", se AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ce WHERE src <> dst), m AS (SELECT id, community_id AS c FROM cn WHERE community_id IS NOT NULL)"
_DEGREE = ", dg AS (SELECT id, (SELECT 0) + coalesce(k, 0) AS degree FROM cn LEFT JOIN (SELECT x, count(*) AS k FROM (SELECT src AS x FROM ce UNION ALL SELECT dst FROM ce) GROUP BY x) ON x = id)"
_END = "lower(regexp_extract({0}, '\\.([^./]*)$', 1))"
_CAT = "CASE WHEN {0} IN " + "(" + ", ".join(f"'{x}'" for x in an.CODE_ENDINGS) + ") THEN 'code' WHEN {0} = 'pdf' THEN 'paper' WHEN {0} IN (" + ", ".join(f"'{x}'" for x in an.IMAGE_ENDINGS) + ") THEN 'image' ELSE 'doc' END"
_FAM = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(x) for x in xs)}) THEN '{n}'" for n, xs in an.LANGUAGES.items()) + " END"
#: tn(id, label, file, community, degree, is_file, is_concept, is_real); needs dg.
_TOPICAL = f""", t0 AS (SELECT id, coalesce(node_label, '') AS nm, coalesce(source_file, '') AS f, community_id AS c, degree FROM cn JOIN dg USING (id)),
 t1 AS (SELECT *, nm <> '' AND ((f <> '' AND split_part(f, '/', -1) = nm) OR (starts_with(nm, '.') AND ends_with(nm, '()')) OR (ends_with(nm, '()') AND degree <= 1)) AS is_file,
  f = '' OR NOT contains(split_part(f, '/', -1), '.') AS is_concept, ends_with(lower(f), '.json') AND lower(trim(nm)) IN {_types(an.JSON_LABELS)} AS is_key FROM t0),
 tn AS (SELECT *, NOT is_file AND NOT is_concept AND NOT is_key AS is_real FROM t1)"""
#: cf(eid, conf): the weakest confidence in a link's evidence, EXTRACTED where there is none.
CONFIDENCE_SQL = """, e0 AS (SELECT id AS eid, CASE WHEN json_valid(attributes) THEN attributes->'$.evidence' END AS e FROM fl WHERE rn = 1),
 e1 AS (SELECT eid, CASE WHEN json_type(e) = 'VARCHAR' AND json_valid(e->>'$') THEN (e->>'$')::JSON ELSE e END AS e FROM e0),
 e2 AS (SELECT eid, e, lower(CASE WHEN json_type(e) = 'ARRAY' THEN array_to_string(e->>'$[*].confidence', ',') ELSE e->>'$.confidence' END) AS s FROM e1),
 cf AS (SELECT eid, e, s, CASE WHEN contains(s, 'ambiguous') THEN 'AMBIGUOUS' WHEN contains(s, 'inferred') THEN 'INFERRED' ELSE 'EXTRACTED' END AS conf FROM e2)"""
_CONF = CONFIDENCE_SQL


def _closure(seeds, types, depth, witness):
    """Reverse closure to a depth; the witness of a node is the least link among those that reach it from the level above."""
    return CODE_SQL + f""", r(root, node, depth) AS (SELECT root, node, 0 FROM ({seeds}) UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN ce e ON e.dst = r.node WHERE r.depth < {depth} AND e.type IN {_types(types)}), m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
      w AS (SELECT m.root, m.node, arg_min(up.node, e.eid) AS parent, min(e.eid) AS eid, arg_min(lower(e.type), e.eid) AS relation FROM m JOIN ce e ON e.src = m.node AND e.type IN {_types(types)} JOIN m up ON up.root = m.root AND up.node = e.dst AND up.depth = m.depth - 1 GROUP BY m.root, m.node)
      SELECT m.root, m.node, m.depth, {witness} FROM m LEFT JOIN w ON w.root = m.root AND w.node = m.node"""


def oracle_sql() -> dict[str, str]:
    norm = "lower(regexp_replace(regexp_replace(trim({0}), '\\(\\)$', ''), '^\\.', ''))"
    walk = lambda rel: f", r(a, node, depth) AS (SELECT a, a, 0 FROM pr UNION SELECT r.a, e.t, r.depth + 1 FROM r JOIN {rel} e ON e.h = r.node WHERE r.depth < 8)"
    lens = " UNION ALL ".join(f"SELECT '{n}' AS lens, type, count(*) AS n FROM ce WHERE type IN {_types(t)} GROUP BY type" for n, t in tr.LENSES.items())
    reach = """, th AS (SELECT greatest(50, floor(quantile_cont(degree, 0.99))) AS cut FROM dg), hub AS (SELECT id FROM dg, th WHERE degree >= cut),
      s AS (SELECT id AS root, id AS node FROM cn WHERE label = 'Interface'), one AS (SELECT DISTINCT root, t AS node FROM s JOIN bo ON h = node WHERE t <> root),
      two AS (SELECT DISTINCT root, t AS node FROM one JOIN bo ON h = node WHERE node NOT IN (SELECT id FROM hub)),
      al AS (SELECT root, node, 0 AS depth FROM s UNION ALL SELECT root, node, 1 FROM one UNION ALL SELECT root, node, 2 FROM two),
      mi AS (SELECT root, node, min(depth) AS depth FROM al GROUP BY root, node), rk AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS rank FROM mi), nb AS (SELECT root, node, depth FROM rk WHERE rank <= 64)"""
    files = ", fg AS (SELECT DISTINCT a.source_file AS src, b.source_file AS dst FROM ce e JOIN cn a ON a.id = e.src JOIN cn b ON b.id = e.dst WHERE e.type = 'IMPORTS' AND NOT coalesce(e.is_deferred, false) AND a.source_file IS NOT NULL AND b.source_file IS NOT NULL)"
    return {
        "d4_scoped": CODE_SQL + ", s AS (SELECT id FROM cn WHERE starts_with(source_file, 'planner/')) SELECT 'node' AS part, id FROM s UNION ALL SELECT 'link', eid FROM ce WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)",
        "o6_bounded": _closure("SELECT id AS root, id AS node FROM cn WHERE label = 'Interface'", tr.IMPACT_TYPES, 8, "parent").replace("SELECT m.root, m.node, m.depth, parent FROM", ", al AS (SELECT m.root, m.node, m.depth FROM") + ") SELECT root, node, depth, n > 20 AS truncated, greatest(n - 20, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS k, count(*) OVER (PARTITION BY root) AS n FROM al) WHERE k <= 20",
        "q2_resolve_symbol": CODE_SQL + f", w AS (SELECT DISTINCT node_label AS symbol FROM cn WHERE label = 'Class'), nm AS (SELECT {norm.format('node_label')} AS name, count(*) AS n, min(id) AS named FROM cn GROUP BY 1) SELECT symbol, CASE WHEN symbol IN (SELECT id FROM cn) THEN symbol WHEN n = 1 THEN named END AS id, CASE WHEN symbol IN (SELECT id FROM cn) THEN 'id' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS how FROM w LEFT JOIN nm ON nm.name = {norm.format('symbol')}",
        "q3_callers": CODE_SQL + f"SELECT dst AS symbol, src AS neighbour, eid, type FROM ce WHERE type IN {_types(tr.CALLER_TYPES)}",
        "q4_callees": CODE_SQL + "SELECT src AS symbol, dst AS neighbour, eid, type FROM ce WHERE type = 'CALLS'",
        "q5_impact": _closure("SELECT id AS root, id AS node FROM cn WHERE label = 'Interface'", tr.IMPACT_TYPES, 8, "parent, eid"),
        "q6_explore": CODE_SQL + _PAIRS + _BOTH + walk("bo") + " SELECT pr.a, pr.b, min(depth) AS hops FROM pr LEFT JOIN r ON r.a = pr.a AND r.node = pr.b GROUP BY pr.a, pr.b",
        "q7_node_trail": CODE_SQL + _PAIRS + _BOTH + ", ou AS (SELECT src AS h, dst AS t FROM ce)" + walk("ou") + walk("bo").replace("r(a", "r2(a").replace("FROM r JOIN", "FROM r2 AS r JOIN") + ", x AS (SELECT pr.a, pr.b, min(depth) AS hops FROM pr LEFT JOIN r ON r.a = pr.a AND r.node = pr.b GROUP BY pr.a, pr.b) SELECT a, b, hops, CASE WHEN hops IS NULL AND EXISTS (SELECT 1 FROM r2 WHERE r2.a = x.a AND r2.node = x.b) THEN 'direction_mismatch' END AS diagnostic FROM x",
        "q10_affected": _closure("SELECT id AS root, id AS node FROM cn WHERE label = 'Class' UNION SELECT c.id, e.dst FROM cn c JOIN ce e ON e.src = c.id WHERE c.label = 'Class' AND e.type IN ('METHOD', 'CONTAINS')", tr.AFFECTED_TYPES, 8, "relation"),
        "q12_find_node": CODE_SQL + "SELECT * FROM (SELECT id, node_label, source_file, CASE WHEN lower(source_file) = 'parser' THEN 0 WHEN lower(node_label) = 'parser' THEN 1 WHEN starts_with(lower(node_label), 'parser') THEN 2 WHEN contains(lower(node_label), 'parser') THEN 3 END AS tier FROM cn) WHERE tier IS NOT NULL",
        "q14_explain": CODE_SQL + "SELECT id, direction, type, count(*) AS n FROM (SELECT src AS id, 'out' AS direction, type FROM ce UNION ALL SELECT dst, 'in', type FROM ce) GROUP BY ALL",
        "q17_pages": CODE_SQL + """, x AS (SELECT source_file, id, length(qualified_name) AS n, row_number() OVER (PARTITION BY source_file ORDER BY id) AS k FROM cn WHERE source_file IS NOT NULL),
          w AS (SELECT source_file, id, n, k, n AS used, 0 AS page FROM x WHERE k = 1 UNION ALL SELECT x.source_file, x.id, x.n, x.k, CASE WHEN w.used + 1 + x.n > 60 THEN x.n ELSE w.used + 1 + x.n END, w.page + CASE WHEN w.used + 1 + x.n > 60 THEN 1 ELSE 0 END
            FROM w JOIN x ON x.source_file = w.source_file AND x.k = w.k + 1) SELECT source_file, id, n AS chars, page::BIGINT AS page FROM w""",
        "sc14_incident": CODE_SQL + f"SELECT src AS symbol, dst AS neighbour, eid FROM ce WHERE type IN {_types(tr.LENSES['data'])} UNION ALL SELECT dst, src, eid FROM ce WHERE type IN {_types(tr.LENSES['data'])} AND src <> dst",
        "sc16_contexts": CODE_SQL + "SELECT eid, src, dst, type, context FROM ce WHERE context IN ('call', 'import')",
        "sk14_lenses": CODE_SQL + lens,
        "d5_neighbourhood": CODE_SQL + _BOTH + _DEGREE + reach + " SELECT root, node, depth FROM nb",
        "d6_induced_edges": CODE_SQL + _BOTH + _DEGREE + reach + " SELECT root, eid FROM (SELECT x.root, eid, row_number() OVER (PARTITION BY x.root ORDER BY eid) AS k FROM ce JOIN nb x ON x.node = src JOIN nb y ON y.node = dst AND y.root = x.root) WHERE k <= 128",
        "f14_node_index": CODE_SQL + "SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM cn",
        "an1_degree": CODE_SQL + _DEGREE + " SELECT id, degree FROM dg",
        "an2_god_nodes": CODE_SQL + _DEGREE + _TOPICAL + f" SELECT id, nm AS name, degree FROM tn WHERE is_real AND nm NOT IN {_types(an.NOISE_LABELS)} ORDER BY degree DESC, id LIMIT 25",
        "an4_modularity": CODE_SQL + _SIMPLE + ", n AS (SELECT count(*) AS m FROM se), p AS (SELECT x.c AS ca, y.c AS cb FROM se LEFT JOIN m x ON x.id = a LEFT JOIN m y ON y.id = b), q AS (SELECT c, count(*) AS k, sum(i) AS i FROM (SELECT ca AS c, (ca = cb)::INT AS i FROM p UNION ALL SELECT cb, 0 FROM p) WHERE c IS NOT NULL GROUP BY c) SELECT round(sum(coalesce(i, 0) / m - (k / (2 * m)) ** 2), 6) AS modularity FROM q, n",
        "an6_hubs": CODE_SQL + _SIMPLE + _DEGREE + ", so AS (SELECT list(degree ORDER BY degree) AS ds FROM dg), h AS (SELECT id FROM dg, so WHERE degree > ds[greatest(floor(len(ds) * 0.99)::BIGINT, 1)]), bb AS (SELECT a AS id, b AS o FROM se UNION ALL SELECT b, a FROM se), v AS (SELECT h.id, m.c, count(*) AS n FROM h JOIN bb ON bb.id = h.id JOIN m ON m.id = bb.o WHERE bb.o NOT IN (SELECT id FROM h) GROUP BY ALL) SELECT h.id, arg_min(c, (-n, c)) AS community FROM h LEFT JOIN v ON v.id = h.id GROUP BY h.id",
        "an7_cohesion": CODE_SQL + _SIMPLE + ", s AS (SELECT c, count(*) AS n FROM m GROUP BY c), i AS (SELECT x.c, count(*) AS k FROM se JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.c = y.c GROUP BY x.c) SELECT s.c AS community, n AS size, coalesce(k, 0) AS edges, round(CASE WHEN n <= 1 THEN 1.0 ELSE coalesce(k, 0) / (n * (n - 1) / 2) END, 6) AS cohesion FROM s LEFT JOIN i ON i.c = s.c",
        "an8_community_order": CODE_SQL + _SIMPLE + " SELECT c AS community, count(*) AS size, min(id) AS first, sha256(string_agg(id || chr(0), '' ORDER BY id))[1:16] AS signature, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS rank FROM m GROUP BY c",
        "an11_community_hubs": CODE_SQL + _SIMPLE + ", un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ce), du AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM un UNION ALL SELECT b FROM un) GROUP BY id), b AS (SELECT c, arg_min(m.id, (-coalesce(degree, 0), m.id)) AS hub FROM m LEFT JOIN du ON du.id = m.id GROUP BY c) SELECT b.c AS community, hub, node_label AS name FROM b JOIN cn ON cn.id = hub",
        "an15_surprises": CODE_SQL
        + _DEGREE
        + _TOPICAL
        + _CONF
        + f""", p AS (SELECT eid, src, dst, type, conf, x.f AS xf, y.f AS yf, x.c AS xc, y.c AS yc, least(x.degree, y.degree) <= 2 AND greatest(x.degree, y.degree) >= 5 AS hub, {_END.format('x.f')} AS xe, {_END.format('y.f')} AS ye
          FROM ce JOIN cf USING (eid) JOIN tn x ON x.id = src JOIN tn y ON y.id = dst WHERE type NOT IN {_types(an.WIRING)} AND NOT x.is_file AND NOT y.is_file AND NOT x.is_concept AND NOT y.is_concept AND x.f <> y.f),
        q AS (SELECT *, {_CAT.format('xe')} AS xk, {_CAT.format('ye')} AS yk, coalesce({_FAM.format('xe')} <> {_FAM.format('ye')}, false) AS far FROM p)
        SELECT eid, src, dst, type, conf AS confidence, CASE WHEN conf = 'INFERRED' AND type IN ('CALLS', 'USES') AND (far OR (xk = 'code' AND yk = 'doc') OR (xk = 'doc' AND yk = 'code')) THEN 0
          ELSE CASE conf WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN xk <> yk THEN 2 ELSE 0 END + CASE WHEN split_part(xf, '/', 1) <> split_part(yf, '/', 1) THEN 2 ELSE 0 END + CASE WHEN xc <> yc THEN 1 ELSE 0 END END
          + CASE WHEN hub THEN 1 ELSE 0 END AS score FROM q""",
        "an16_cross_community": CODE_SQL
        + _DEGREE
        + _TOPICAL
        + _CONF
        + f""", k AS (SELECT least(x.c, y.c) AS l, greatest(x.c, y.c) AS r, eid, conf, CASE conf WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS o FROM ce JOIN cf USING (eid) JOIN tn x ON x.id = src JOIN tn y ON y.id = dst
          WHERE x.c <> y.c AND NOT x.is_file AND NOT y.is_file AND type NOT IN {_types(an.WIRING)}) SELECT l AS "left", r AS "right", arg_min(eid, (o, eid)) AS eid, arg_min(conf, (o, eid)) AS confidence, count(*) AS edges FROM k GROUP BY l, r""",
        "an17_import_cycles": CODE_SQL + files + """, w(c, f, n) AS (SELECT [src], src, 1 FROM (SELECT DISTINCT src FROM fg) UNION ALL SELECT list_append(c, dst), dst, n + 1 FROM w JOIN fg ON fg.src = f WHERE n < 5 AND dst > c[1] AND NOT list_contains(c, dst))
          SELECT DISTINCT array_to_string(c, ' -> ') AS cycle, n AS length FROM w JOIN fg ON fg.src = f AND fg.dst = c[1]""",
        "an18_blind_spots": CODE_SQL
        + _DEGREE
        + _TOPICAL
        + f""", te AS (SELECT a, b, x.c AS x, y.c AS y FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ce WHERE src <> dst AND type NOT IN {_types(an.GAP_WIRING)}) JOIN tn x ON x.id = a AND x.is_real JOIN tn y ON y.id = b AND y.is_real),
        sz AS (SELECT c, count(*) AS n FROM tn WHERE is_real AND c IS NOT NULL GROUP BY c), il AS (SELECT x AS c, count(*) AS k FROM te WHERE x = y GROUP BY x),
        el AS (SELECT c FROM sz LEFT JOIN il USING (c) WHERE n >= 4 AND coalesce(k, 0) * 2.0 / n >= 1.2),
        nr AS (SELECT DISTINCT id, c FROM (SELECT a AS id, y AS c FROM te UNION ALL SELECT b, x FROM te) WHERE c IN (SELECT c FROM el)),
        ok AS (SELECT id FROM nr GROUP BY id HAVING count(*) BETWEEN 2 AND 32),
        px AS (SELECT p.c AS l, q.c AS r, sum(1 / sqrt(greatest(degree, 1))) AS w FROM nr p JOIN nr q ON q.id = p.id AND p.c < q.c JOIN ok ON ok.id = p.id JOIN dg ON dg.id = p.id GROUP BY ALL),
        dr AS (SELECT least(x, y) AS l, greatest(x, y) AS r, count(*) AS n FROM te WHERE x <> y GROUP BY ALL)
        SELECT px.l AS "left", px.r AS "right", round(w, 6) AS proximity, coalesce(n, 0) AS direct, round(w / (1 + coalesce(n, 0)), 6) AS score FROM px LEFT JOIN dr ON dr.l = px.l AND dr.r = px.r""",
        "an19_components": CODE_SQL + _BOTH + _DEGREE + _TOPICAL + ", r(id, o) AS (SELECT id, id FROM cn UNION SELECT r.id, bo.t FROM r JOIN bo ON bo.h = r.o), c AS (SELECT id, min(o) AS comp FROM r GROUP BY id) SELECT 'component:' || comp AS component, count(*) AS size, count(*) FILTER (is_real) AS real FROM c JOIN tn USING (id) GROUP BY comp HAVING count(*) FILTER (is_real) >= 2",
        "an22_cycle_edges": CODE_SQL + ", de AS (SELECT DISTINCT src, dst FROM ce WHERE type IN ('CALLS', 'IMPORTS', 'EXTENDS', 'DEPENDS_ON') AND NOT coalesce(is_deferred, false)), r(a, b) AS (SELECT src, dst FROM de UNION SELECT r.a, de.dst FROM r JOIN de ON de.src = r.b) SELECT src, dst FROM de WHERE src = dst OR EXISTS (SELECT 1 FROM r WHERE r.a = de.dst AND r.b = de.src)",
        "a11_graph_stats": CODE_SQL + "SELECT 'nodes' AS what, count(*) AS n FROM cn UNION ALL SELECT 'edges', count(*) FROM ce UNION ALL SELECT 'communities', count(DISTINCT community_id) FROM cn",
    }
