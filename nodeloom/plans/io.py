"""Registered source, sink and ingestion queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as so
from ..graph import code_graph
from ..runtime import Workspace, table
from ..sources import manifests as mf
from ..sources import sinks as sk
from ..sources.store import KeyedStore
from ..streaming import Ingest, watch
from .patterns import CODE_SQL


def _document_text(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def sc12_page(spark, d):
    return so.page(code_graph(spark, d).nodes.select("id", "label"), "id", after="r000001:", limit=100, prefix="r000001:")


def sc17_languages(spark, d):
    n = code_graph(spark, d).nodes.where("source_file is not null")
    return n.select(so.language_of(F.col("source_file")).alias("by_ending"), "lang").groupBy("by_ending", "lang").agg(F.count(F.lit(1)).alias("n"))


def sc18_scope(spark, d):
    n = code_graph(spark, d).nodes.where("source_file is not null")
    return n.where(so.in_scope(F.col("source_file"), ("*.py", "*.rs"), ("*/parser_*", "docs/*"))).select("id", "source_file")


def _manifest(spark, d, pick):
    s = table(spark, d, "snapshot_nodes").where("source_file is not null")
    v = s.groupBy("repo").agg(pick("version_no").alias("version_no"))
    each = s.join(v, ["repo", "version_no"]).select("repo", "source_file", "id").distinct()  # a digest by sums, whatever the order and number of ids
    return each.groupBy(F.concat_ws("/", "repo", "source_file").alias("path")).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint"))).alias("digest"))


def sc19_manifest(spark, d):
    return so.manifest_delta(_manifest(spark, d, F.min), _manifest(spark, d, F.max))


def sc20_uncached(spark, d):
    return so.uncached(_manifest(spark, d, F.max), _manifest(spark, d, F.min))


def sc23_sql_objects(spark, d):
    return so.sql_objects(_document_text(spark, d), "doc_id", "text")


def sc24_markdown(spark, d):
    return so.markdown_parts(_document_text(spark, d), "doc_id", "text")


def sc32_url_kinds(spark, d):
    """What addresses of many hosts and endings, made with every document's path, lead to."""
    hosts = ("https://GitHub.com/", "http://arxiv.org/", "https://export.arxiv.org/", "https://x.com/", "https://www.twitter.com/", "https://youtu.be/", "https://www.youtube.com/", "https://docs.example.org/", "https://notgithub.com/", "ftp://github.com/", "")
    docs = table(spark, d, "documents").where("doc_path is not null").select("doc_id", F.explode(F.array(*[F.concat(F.lit(h), "doc_path", F.lit(e)) for h in hosts for e in ("", ".PDF?x=1", ".png#a")])).alias("url"))
    return docs.select("doc_id", "url", so.url_kind(F.col("url")).alias("kind"))


def sc35_batches(spark, d):
    items = table(spark, d, "eval_items").select("suite", "item_id", F.floor((F.length("text") + 160) / 4).alias("tokens"))
    return so.token_batches(items, 500, "item_id", "tokens", "suite")


def sk4_node_link(spark, d):
    """The documents, read back and laid out by member."""
    got = sk.node_link(code_graph(spark, d))
    at = lambda part, *names: F.when(F.col("part") == part, F.array(*[F.get_json_object("document", f"$.{n}") for n in names]))
    cells = F.coalesce(at("nodes", "id", "label", "kind", "source_file", "community"), at("links", "source", "target", "relation", "weight", "context"))
    return got.select("part", "key", *[cells[i].alias(c) for i, c in enumerate("abcde")])


def sk5_graphml(spark, d):
    return sk.graphml(code_graph(spark, d)).where("ord in (1, 2)")


def sk6_cypher(spark, d):
    return sk.cypher_script(code_graph(spark, d))


def sk3_result_lines(spark, d):
    """A result of the language as JSON lines, read back."""
    from .. import cql

    got = sk.result_lines(cql.query(code_graph(spark, d), "MATCH (a:Class)-[:CONTAINS]->(m:Method) RETURN a.id AS class, m.id AS method"))
    cells = F.from_json(F.get_json_object("line", "$.values"), "array<string>")
    value = lambda i: F.get_json_object(cells[i], "$.v")
    return got.select("ord", F.when(F.col("ord") == 1, value(0)).when(F.col("ord") == 2, F.get_json_object("line", "$.rows")).alias("first"), F.when(F.col("ord") == 1, value(1)).alias("second"))


def sk9_view_model(spark, d):
    return sk.view_model(code_graph(spark, d))


def sk11_notes(spark, d):
    return sk.notes(code_graph(spark, d))


def sk11_canvas(spark, d):
    """The canvas, read back."""
    got = sk.canvas(code_graph(spark, d))
    return got.select("part", "key", *[F.get_json_object("document", f"$.{n}").alias(n) for n in ("file", "y", "fromNode", "toNode", "label")])


def sk12_report(spark, d):
    return sk.report(code_graph(spark, d))


def st7_ingested(spark, d):
    """The node table built by the ingestion stream: each id's latest delivery."""
    work = Workspace(spark, "ingest")
    nodes = table(spark, d, "graph_nodes")
    job = Ingest(spark, work.root, nodes.schema, "id", "ingested_at", "deleted_at", ["kind", "attributes", "deleted_at"])
    job.start(watch(spark, f"{d}/graph_nodes.parquet*", nodes.schema)).awaitTermination()
    return job.state().select("id", "kind", "ingested_at", "deleted_at")


def _depends(spark, d):
    """Packages and what they depend on, as names."""
    g = code_graph(spark, d)
    name = lambda k, c: g.nodes.where("repo is not null").select(F.col("id").alias(k), F.col("node_label").alias(c), F.col("repo").alias(f"{c}_repo"))
    return g.edges.where("type in ('DEPENDS_ON', 'IMPORTS')").join(name("src", "a"), "src").join(name("dst", "b"), "dst")


def sc28_packages(spark, d):
    """Manifests written for every dependency of a repository, read again."""
    each = _depends(spark, d).select("a_repo", "b", "type").distinct()
    version = F.create_map("b", F.concat(F.lit("^"), F.length("b")))
    docs = each.select(F.to_json(F.struct(F.col("a_repo").alias("name"), F.when(F.col("type") != "IMPORTS", version).alias("dependencies"), F.when(F.col("type") == "IMPORTS", version).alias("devDependencies"))).alias("text"), F.lit(0).alias("k"))
    return mf.package_dependencies(docs, "k", "text").drop("k")


def sc27_terraform(spark, d):
    """Blocks written for every database node, read again."""
    n = code_graph(spark, d).nodes.where("label like 'Database%' and repo is not null")
    text = F.concat(F.lit("# resource \"no\" \"no\" {\n/* variable \"gone\" { */\nresource \""), "kind", F.lit("\" \""), "node_label", F.lit("\" {\n  size = var."), "node_label", F.lit("\n}\noutput \""), "id", F.lit("\" {\n value = data."), "kind", F.lit(".x\n}\n"))
    docs = n.select("id", text.alias("text"))
    blocks = mf.terraform_blocks(docs, "id", "text").select("id", "kind", F.coalesce("type", F.lit("")).alias("type"), "name")
    return blocks.unionByName(mf.terraform_references(docs, "id", "text").select("id", F.concat(F.lit("uses "), "kind").alias("kind"), F.lit("").alias("type"), "name"))


def sc29_symbols(spark, d):
    """Occurrences written for every file out of the nodes in it, read again."""
    n = code_graph(spark, d).nodes.where("source_file is not null and start_line is not null and end_line is not null")
    occurrence = F.struct(F.when(F.col("start_line") == F.col("end_line"), F.array("start_line", F.lit(0), F.lit(9))).otherwise(F.array("start_line", F.lit(0), "end_line", F.lit(9))).alias("range"), F.col("id").alias("symbol"), F.when(F.col("start_line") % 3 == 0, 1).otherwise(8).alias("symbol_roles"))
    docs = n.select(F.to_json(F.struct(F.array(F.struct(F.col("source_file").alias("relative_path"), F.array(occurrence).alias("occurrences"))).alias("documents"))).alias("text"))
    return mf.scip_occurrences(docs, "text")


def sc31_cargo(spark, d):
    """Manifests written for every dependency between named nodes, read again."""
    each = _depends(spark, d).select("a", "b").distinct()
    lines = F.concat_ws("\n", F.concat(F.lit('[package]\nname = "'), "a", F.lit('"\n[dependencies]')), F.concat(F.lit('other = { package = "'), "b", F.lit('", version = "1" }')), F.lit('serde = "1"'))
    return mf.cargo_workspace(each.select(F.concat_ws("/", "a", "b").alias("path"), lines.alias("text")))


def sc36_git_log(spark, d):
    """A history written out of the delivered versions, read again."""
    v = table(spark, d, "graph_versions")
    head = F.concat_ws("|", F.sha1("commit_id"), F.lit(""), F.lit("dev"), F.unix_micros(F.col("captured_at").cast("timestamp")).cast("string"), F.concat(F.lit("version | "), "version_no"))
    return mf.git_log(v.select("repo", F.concat(head, F.lit("\n\nsrc/"), "repo", F.lit(".py\nREADME.md\n")).alias("text")), "repo", "text").select("repo", "commit", "parent", "at", "subject", "path")


def sk2_result_document(spark, d):
    """Rows of a result document."""
    from .. import cql

    got = sk.result_document(cql.query(code_graph(spark, d), "MATCH (n:Class) RETURN n.id AS id, n.start_line AS line, n.lang AS lang"))
    return got.where("ord = 1").select("key", "line")


def sk16_stored(spark, d):
    """The node table put into a keyed store in deliveries by month, with a deletion in between."""
    t = table(spark, d, "graph_nodes").where("id is not null").select("id", "kind", "node_label", "ingested_at")
    store = KeyedStore.open(spark, Workspace(spark, "store").root, t.schema, "id")
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    store = store.merge(t.where(F.col("ingested_at") < cut), "ingested_at", expected=0)
    store = store.delete(t.where("kind = 'parameter'"), expected=1)
    return store.merge(t.where((F.col("ingested_at") >= cut) | F.col("ingested_at").isNull()), "ingested_at", expected=2).table()


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in ("queries", "oracle_sql")}


def oracle_sql() -> dict[str, str]:
    ends = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in so.LANGUAGES.items())
    manifest = "SELECT concat_ws('/', repo, source_file) AS path, concat_ws(':', count(DISTINCT id), sum(DISTINCT ('0x' || md5(id)[1:8])::BIGINT)) AS digest FROM snapshot_nodes JOIN (SELECT repo, {0}(version_no) AS version_no FROM snapshot_nodes WHERE source_file IS NOT NULL GROUP BY repo) USING (repo, version_no) WHERE source_file IS NOT NULL GROUP BY 1"
    both = f"WITH o AS ({manifest.format('min')}), n AS ({manifest.format('max')}) "
    text = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
    part = lambda k, rx, g: f"SELECT doc_id, '{k}' AS part, unnest(range(len(v))) AS pos, unnest(v) AS value FROM (SELECT doc_id, regexp_extract_all({text}, '{rx}', {g}) AS v FROM documents)"
    md = " UNION ALL ".join([part("heading", "(?m)^#{1,6} +\\S.*$", 0), part("link", "\\[[^\\]\\n]*\\]\\(([^)\\s]+)\\)", 1), part("code", "(?m)^```([A-Za-z0-9_+-]+)", 1), part("symbol", "`([A-Za-z_][A-Za-z0-9_]*)`", 1)])
    xml = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    quote = lambda c: f"'''' || replace(replace({c}, '\\', '\\\\'), '''', '\\''') || ''''"
    return {
        "sk16_stored": "WITH t AS (SELECT id, kind, node_label, ingested_at FROM graph_nodes WHERE id IS NOT NULL), p AS (SELECT DISTINCT id FROM t WHERE kind = 'parameter'), l AS (SELECT * FROM t WHERE NOT (ingested_at < '2025-06-01' AND id IN (SELECT id FROM p))) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, kind DESC, node_label DESC) = 1",
        "sk2_result_document": CODE_SQL + "SELECT printf('%020d', row_number() OVER (ORDER BY id, start_line, lang) - 1) AS key, CASE WHEN row_number() OVER (ORDER BY id, start_line, lang) > 1 THEN ',' ELSE '' END || '[' || to_json(id) || ',' || coalesce(to_json(start_line)::VARCHAR, 'null') || ',' || coalesce(to_json(lang)::VARCHAR, 'null') || ']' AS line FROM cn WHERE label = 'Class'",
        "sc36_git_log": "SELECT repo, sha1(commit_id) AS commit, NULL::VARCHAR AS parent, epoch_us(captured_at) AS at, 'version | ' || version_no AS subject, unnest(['src/' || repo || '.py', 'README.md']) AS path FROM graph_versions",
        "sc31_cargo": CODE_SQL + ", e AS (SELECT DISTINCT a.node_label AS crate, b.node_label AS dependency FROM ce JOIN cn a ON a.id = src JOIN cn b ON b.id = dst WHERE type IN ('DEPENDS_ON', 'IMPORTS') AND a.repo IS NOT NULL AND b.repo IS NOT NULL) SELECT crate, dependency, 'normal' AS kind FROM e WHERE dependency IN (SELECT crate FROM e)",
        "sc29_symbols": CODE_SQL + "SELECT source_file AS file, id AS symbol, CASE WHEN start_line % 3 = 0 THEN 'definition' ELSE 'reference' END AS role, start_line, 0 AS start_column, end_line, 9 AS end_column FROM cn WHERE source_file IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL",
        "sc27_terraform": CODE_SQL + ", n AS (SELECT * FROM cn WHERE label LIKE 'Database%' AND repo IS NOT NULL) SELECT id, 'resource' AS kind, kind AS type, node_label AS name FROM n UNION ALL SELECT id, 'output', '', id FROM n UNION ALL SELECT id, 'uses var', '', node_label FROM n UNION ALL SELECT id, 'uses data', '', kind || '.x' FROM n",
        "sc28_packages": CODE_SQL + "SELECT DISTINCT a.repo AS package, CASE type WHEN 'IMPORTS' THEN 'devDependencies' ELSE 'dependencies' END AS section, b.node_label AS name, '^' || length(b.node_label) AS version FROM ce JOIN cn a ON a.id = src JOIN cn b ON b.id = dst WHERE type IN ('DEPENDS_ON', 'IMPORTS') AND a.repo IS NOT NULL AND b.repo IS NOT NULL",
        "sk11_canvas": CODE_SQL + "SELECT 'nodes' AS part, id AS key, id || '.md' AS file, (coalesce(community_id, -1) * 400)::VARCHAR AS y, NULL::VARCHAR AS \"fromNode\", NULL::VARCHAR AS \"toNode\", NULL::VARCHAR AS label FROM cn UNION ALL SELECT 'edges', eid, NULL, NULL, src, dst, lower(type) FROM ce",
        "sk3_result_lines": CODE_SQL + ", r AS (SELECT a.id AS x, m.id AS y FROM ce JOIN cn a ON a.id = src JOIN cn m ON m.id = dst WHERE type = 'CONTAINS' AND a.label = 'Class' AND m.label = 'Method') SELECT 0 AS ord, NULL::VARCHAR AS first, NULL::VARCHAR AS second UNION ALL SELECT 1, x, y FROM r UNION ALL SELECT 2, count(*)::VARCHAR, NULL FROM r",
        "sk4_node_link": CODE_SQL + """SELECT 'nodes' AS part, id AS key, id AS a, node_label AS b, kind AS c, source_file AS d, community_id::VARCHAR AS e FROM cn UNION ALL SELECT 'links', eid, src, dst, lower(type), weight::VARCHAR, context FROM ce""",
        "sc23_sql_objects": """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?is)\\bcreate\\s+(?:or\\s+replace\\s+)?(?:unique\\s+|temporary\\s+|materialized\\s+)*(table|view|index|function|procedure|trigger|schema)\\s+(?:if\\s+not\\s+exists\\s+)?[`"\\[]?([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS kind,
          unnest(regexp_extract_all(text, '(?is)\\bcreate\\s+(?:or\\s+replace\\s+)?(?:unique\\s+|temporary\\s+|materialized\\s+)*(table|view|index|function|procedure|trigger|schema)\\s+(?:if\\s+not\\s+exists\\s+)?[`"\\[]?([A-Za-z_][A-Za-z0-9_.]*)', 2)) AS name FROM documents) SELECT doc_id, 'database_' || lower(kind) AS kind, name FROM m""",
        "sc12_page": CODE_SQL + "SELECT id, label FROM cn WHERE id > 'r000001:' AND starts_with(id, 'r000001:') ORDER BY id LIMIT 100",
        "sc17_languages": CODE_SQL + f"SELECT CASE lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) {ends} END AS by_ending, lang, count(*) AS n FROM cn WHERE source_file IS NOT NULL GROUP BY ALL",
        "sc18_scope": CODE_SQL + "SELECT id, source_file FROM cn WHERE (source_file LIKE '%.py' OR source_file LIKE '%.rs') AND NOT (source_file LIKE '%/parser\\_%' ESCAPE '\\' OR source_file LIKE 'docs/%')",
        "sc19_manifest": both + "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON n.path = o.path WHERE o.digest IS DISTINCT FROM n.digest",
        "sc20_uncached": both + "SELECT path, digest FROM n WHERE (path, digest) NOT IN (SELECT (path, digest) FROM o)",
        "sc24_markdown": md,
        "sc32_url_kinds": """WITH h(h) AS (VALUES ('https://GitHub.com/'), ('http://arxiv.org/'), ('https://export.arxiv.org/'), ('https://x.com/'), ('https://www.twitter.com/'), ('https://youtu.be/'), ('https://www.youtube.com/'), ('https://docs.example.org/'), ('https://notgithub.com/'), ('ftp://github.com/'), ('')), e(e) AS (VALUES (''), ('.PDF?x=1'), ('.png#a')),
          u AS (SELECT doc_id, h || doc_path || e AS url FROM documents, h, e WHERE doc_path IS NOT NULL), p AS (SELECT *, lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, lower(split_part(split_part(url, '?', 1), '#', 1)) AS path FROM u)
          SELECT doc_id, url, CASE WHEN NOT (starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://')) THEN 'invalid' WHEN host IN ('twitter.com', 'x.com', 'www.twitter.com', 'www.x.com') THEN 'tweet' WHEN host = 'arxiv.org' OR ends_with(host, '.arxiv.org') THEN 'arxiv' WHEN host = 'github.com' OR ends_with(host, '.github.com') THEN 'github'
            WHEN host IN ('youtube.com', 'youtu.be') OR ends_with(host, '.youtube.com') OR ends_with(host, '.youtu.be') THEN 'youtube' WHEN ends_with(path, '.pdf') THEN 'pdf' WHEN ends_with(path, '.png') THEN 'image' ELSE 'web' END AS kind FROM p""",
        "sc35_batches": """WITH RECURSIVE x AS (SELECT suite, item_id, (length(text) + 160) // 4 AS tokens, row_number() OVER (PARTITION BY suite ORDER BY item_id) AS k FROM eval_items),
          w AS (SELECT suite, item_id, tokens, k, tokens AS used, 0 AS batch FROM x WHERE k = 1 UNION ALL SELECT x.suite, x.item_id, x.tokens, x.k, CASE WHEN w.used + x.tokens > 500 THEN x.tokens ELSE w.used + x.tokens END, w.batch + CASE WHEN w.used + x.tokens > 500 THEN 1 ELSE 0 END
            FROM w JOIN x ON x.suite = w.suite AND x.k = w.k + 1) SELECT suite, item_id, tokens, batch::BIGINT AS batch FROM w""",
        "sk5_graphml": CODE_SQL + f"SELECT 1 AS ord, id AS key, '<node id=\"' || {xml('id')} || '\"><data key=\"label\">' || {xml('coalesce(node_label, id)')} || '</data></node>' AS line FROM cn UNION ALL SELECT 2, eid, '<edge id=\"' || {xml('eid')} || '\" source=\"' || {xml('src')} || '\" target=\"' || {xml('dst')} || '\"><data key=\"relation\">' || lower(type) || '</data></edge>' FROM ce",
        "sk6_cypher": CODE_SQL + f"SELECT 1 AS ord, id AS key, 'MERGE (n:' || label || ' {{id: ' || {quote('id')} || '}}) SET n.label = ' || {quote('coalesce(node_label, id)')} || ';' AS line FROM cn UNION ALL SELECT 2, eid, 'MATCH (a {{id: ' || {quote('src')} || '}}), (b {{id: ' || {quote('dst')} || '}}) MERGE (a)-[:' || type || ']->(b);' FROM ce",
        "sk9_view_model": CODE_SQL + ", se AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ce WHERE src <> dst), m AS (SELECT id, community_id AS c FROM cn WHERE community_id IS NOT NULL), un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ce), dg AS (SELECT x AS id, count(*) AS k FROM (SELECT a AS x FROM un UNION ALL SELECT b FROM un) GROUP BY x), i AS (SELECT x.c, count(*) AS k FROM se JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.c = y.c GROUP BY x.c) SELECT m.c AS community, count(*) AS nodes, coalesce(any_value(i.k), 0) AS edges, arg_min(m.id, (-coalesce(dg.k, 0), m.id)) AS hub FROM m LEFT JOIN dg ON dg.id = m.id LEFT JOIN i ON i.c = m.c GROUP BY m.c",
        "sk11_notes": CODE_SQL + "SELECT id AS name, 0 AS ord, '# ' || coalesce(node_label, id) AS line FROM cn UNION ALL SELECT id, 1, 'kind: ' || coalesce(kind, '') FROM cn UNION ALL SELECT DISTINCT src, 2, '- ' || lower(type) || ' [[' || dst || ']]' FROM ce",
        "sk12_report": CODE_SQL + "SELECT 0 AS ord, 'nodes: ' || count(*) AS line FROM cn UNION ALL SELECT 1, 'edges: ' || count(*) FROM ce UNION ALL SELECT 2, '- label ' || label || ': ' || count(*) FROM cn GROUP BY label UNION ALL SELECT 3, '- type ' || type || ': ' || count(*) FROM ce GROUP BY type",
        "st7_ingested": "SELECT id, kind, ingested_at, deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM graph_nodes) WHERE rn = 1",
    }
