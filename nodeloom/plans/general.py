"""Registered queries of the general operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, nested, references, skew, snapshots
from ..runtime import table


def p1_found(spark, d):
    return hierarchy.resolve_hierarchy(hierarchy.link_hierarchies(table(spark, d, "graph_links")))


def p1_paths(spark, d):
    out = hierarchy.resolve_hierarchy(hierarchy.link_hierarchies(table(spark, d, "graph_links")), paths=True)
    return out.withColumn("path", F.to_json("path"))


def p1_descendants(spark, d):
    out = hierarchy.resolve_hierarchy(hierarchy.link_hierarchies(table(spark, d, "graph_links")), paths=True)
    return hierarchy.descendants(out)


def p1_conflicts(spark, d):
    return hierarchy.conflicts(hierarchy.link_hierarchies(table(spark, d, "graph_links")))


def _changes(spark, d, what):
    return snapshots.snapshot_changes(table(spark, d, f"snapshot_{what}"), table(spark, d, "graph_versions"))


def p2_found(spark, d):
    parts = [_changes(spark, d, w).select(F.lit(w).alias("record_root"), F.col("id").alias("record_id"), F.col("version_no").cast("bigint").alias("version_no"), "change_kind") for w in ("nodes", "links")]
    return parts[0].unionByName(parts[1])


def p2_counts(spark, d):
    """Exact counts over nodes and links per version, next to those the source reported."""
    both = _changes(spark, d, "nodes").unionByName(_changes(spark, d, "links"))
    exact = snapshots.change_counts(both, "repo", "version_no")
    kinds = ("added", "removed", "changed")
    listed = table(spark, d, "graph_versions").groupBy("repo", "version_no").agg(*[F.max(c).alias(f"reported_{c}") for c in kinds])
    first = listed.groupBy("repo").agg(F.min("version_no").alias("first"))
    later = listed.join(first, "repo").where("version_no > first")  # a version without changes has a row too
    return later.join(exact, ["repo", "version_no"], "left").select("repo", "version_no", *[F.coalesce(c, F.lit(0)).alias(c) for c in kinds], *[f"reported_{c}" for c in kinds])


def _owners(spark, d):
    parts = [table(spark, d, t).select(F.lit(t).alias("owner_table"), F.col("id").alias("owner_id"), "attributes") for t in ("graph_nodes", "graph_links")]
    return parts[0].unionByName(parts[1])


def p3_found(spark, d):
    return nested.resolution_candidates(_owners(spark, d))


def _hex(df, *columns):
    return df.withColumns({c: F.lower(F.hex(c)) for c in columns})


def p3_bridge(spark, d):
    return _hex(nested.flatten(_owners(spark, d)).bridge, "document", "parent_hash", "child_hash").drop("parent_path")


def p3_objects(spark, d):
    return _hex(nested.flatten(_owners(spark, d)).objects, "object_hash")


def p3_unreadable(spark, d):
    return nested.flatten(_owners(spark, d)).unreadable


def p4_found(spark, d):
    return skew.heavy_ids(table(spark, d, "graph_links"), table(spark, d, "graph_nodes"))


def p4_profiles(spark, d):
    return skew.id_profiles(table(spark, d, "graph_links"), table(spark, d, "graph_nodes"))


def p4_joined(spark, d):
    """Rows and weights the join of links with node deliveries would give, per side, from states."""
    states = skew.link_states(table(spark, d, "graph_links"), table(spark, d, "graph_nodes"))
    return states.groupBy("side").agg(F.sum("left_rows").alias("link_rows"), F.sum("joined_rows").alias("joined_rows"), F.round(F.sum("joined_sum_weight"), 2).alias("joined_weight"))


def _ledger(spark, d, cuts):
    t = lambda n: table(spark, d, n)
    links, snapshots = t("graph_links"), t("snapshot_links")
    buckets = references.buckets_for(2 * (links.count() + snapshots.count()))  # counts come from the files' footers
    return references.ledger_of(links, t("graph_nodes"), t("shared_nodes"), snapshots, t("snapshot_nodes"), t("graph_versions"), cuts=references.middle_of(links) if cuts else (), buckets=buckets)


def p6_found(spark, d):
    return _ledger(spark, d, True).orphans()


def p6_report(spark, d):
    return _ledger(spark, d, True).report()


def p6_history(spark, d):
    return _ledger(spark, d, True).history()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_conflicts, p2_found, p2_counts, p3_found, p3_bridge, p3_objects, p3_unreadable, p4_found, p4_profiles, p4_joined, p6_found, p6_report, p6_history)}


_TREE = """
WITH RECURSIVE e AS (
  SELECT h, v, min(p) AS p FROM (
    SELECT lower(trim(kind)) AS h, CASE WHEN lower(trim(kind)) = 'contains' THEN target ELSE source END AS v, CASE WHEN lower(trim(kind)) = 'contains' THEN source ELSE target END AS p
    FROM graph_links WHERE lower(trim(kind)) IN ('contains', 'extends') AND source IS NOT NULL AND target IS NOT NULL) GROUP BY h, v),
tops AS (SELECT DISTINCT h, p AS v FROM e WHERE NOT EXISTS (SELECT 1 FROM e AS x WHERE x.h = e.h AND x.v = e.p)),
down AS (
  SELECT h, v, v AS root_id, 0::BIGINT AS node_depth, [v] AS path FROM tops
  UNION ALL SELECT e.h, e.v, d.root_id, d.node_depth + 1, list_append(d.path, e.v) FROM down d JOIN e ON e.h = d.h AND e.p = d.v),
rest AS (SELECT h, v, p FROM e WHERE NOT EXISTS (SELECT 1 FROM down WHERE down.h = e.h AND down.v = e.v)),
up AS (SELECT h, v, p AS a FROM rest UNION SELECT up.h, up.v, r.p FROM up JOIN rest r ON r.h = up.h AND r.v = up.a),
on_cycle AS (SELECT h, v FROM up WHERE v = a),
rings AS (SELECT up.h, up.v, min(up.a) AS root_id FROM up JOIN on_cycle c ON c.h = up.h AND c.v = up.a GROUP BY up.h, up.v)
"""

_REFS = """
WITH n AS (SELECT id, min(ingested_at) AS first_at, min(deleted_at) AS gone_at FROM (SELECT id, ingested_at, deleted_at FROM graph_nodes UNION ALL SELECT id, ingested_at, NULL FROM shared_nodes) GROUP BY id),
l AS (SELECT id, source, target, observed_at, min(ingested_at) AS since FROM graph_links GROUP BY ALL),
r AS (SELECT 'source' AS ref_field, id, source AS key, observed_at, since FROM l UNION ALL SELECT 'target', id, target, observed_at, since FROM l),
live AS (SELECT 'graph_links' AS ref_table, ref_field, r.id AS row_id,
  CASE WHEN n.id IS NULL THEN 'missing' WHEN gone_at <= observed_at THEN 'deleted' WHEN first_at > since THEN 'late' END AS reason, strftime(observed_at, '%Y-%m') AS ref_month
  FROM r LEFT JOIN n ON n.id = r.key WHERE key IS NOT NULL),
s AS (SELECT 'source' AS ref_field, repo, version_no, id, source AS key FROM snapshot_links UNION ALL SELECT 'target', repo, version_no, id, target FROM snapshot_links),
snap AS (SELECT 'snapshot_links' AS ref_table, ref_field, s.id AS row_id, 'missing' AS reason, strftime(captured_at, '%Y-%m') AS ref_month
  FROM s LEFT JOIN graph_versions v USING (repo, version_no)
  WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snapshot_nodes k WHERE k.repo = s.repo AND k.version_no = s.version_no AND k.id = s.key)),
o AS (SELECT * FROM live WHERE reason IS NOT NULL UNION SELECT * FROM snap)
"""

_ENDS = "WITH e AS (SELECT 'source' AS side, source AS node_id, target AS other_id, weight, observed_at, id FROM graph_links UNION ALL SELECT 'target', target, source, weight, observed_at, id FROM graph_links)"


def json_facts(table_name: str, ignored: tuple[str, ...] = ()) -> str:
    """CTE jf(rid, facts): what a JSON text says, as the sorted list of its members, null ones and ``ignored`` left out."""
    skip = "AND NOT regexp_matches(t.fullkey, '[.]\"?(" + "|".join(sorted(ignored)) + ")\"?([.\\[]|$)')" if ignored else ""
    return f"""jf AS (SELECT s.rowid AS rid, list(t.fullkey || ':' || CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN t.type WHEN t.type = 'VARCHAR' THEN t.atom::VARCHAR WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN (t.atom::VARCHAR::DOUBLE)::VARCHAR ELSE t.type || t.atom::VARCHAR END ORDER BY t.fullkey) AS facts
      FROM (SELECT row_number() OVER () AS rowid, * FROM {table_name}) s, json_tree(CASE WHEN json_valid(s.attributes) THEN s.attributes END) t WHERE NOT (t.type = 'NULL' AND t.key IS NOT NULL AND NOT ends_with(t.fullkey, ']')) {skip} GROUP BY s.rowid)"""


def snapshot_sql(table_name: str, columns: tuple[str, ...], ignored: tuple[str, ...] = ()) -> str:
    """Changes between consecutive listed versions of a snapshot table, as a query."""
    return f"""SELECT * FROM (WITH v AS (SELECT repo, version_no, lag(version_no) OVER w AS before FROM (SELECT DISTINCT repo, version_no FROM graph_versions) WINDOW w AS (PARTITION BY repo ORDER BY version_no)),
      {json_facts(table_name, ignored)},
      l AS (SELECT repo, version_no, id, row({", ".join(columns)}, coalesce(facts::VARCHAR, attributes)) AS body FROM (SELECT *, row_number() OVER () AS rid FROM {table_name}) LEFT JOIN jf USING (rid)
        WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, version_no, id ORDER BY delivered_at DESC NULLS LAST) = 1),
      n AS (SELECT v.repo, v.version_no, l.id, l.body FROM v JOIN l USING (repo, version_no) WHERE before IS NOT NULL), o AS (SELECT v.repo, v.version_no, l.id, l.body FROM v JOIN l ON l.repo = v.repo AND l.version_no = v.before),
      c AS (SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.version_no, o.version_no) AS version_no, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.body IS DISTINCT FROM o.body THEN 'changed' END AS change_kind
        FROM n FULL JOIN o ON o.repo = n.repo AND o.version_no = n.version_no AND o.id = n.id)
      SELECT repo, version_no, id, change_kind FROM c WHERE change_kind IS NOT NULL)"""


NODE_COLUMNS = ("kind", "node_label", "source_file", "start_line", "end_line", "community_id")
LINK_COLUMNS = ("source", "target", "kind", "weight", "context")


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """WITH RECURSIVE w(t, id, path, key, idx, v) AS (
            SELECT t, id, '', '', 0::BIGINT, a::JSON FROM (SELECT DISTINCT 'graph_nodes' AS t, id, attributes AS a FROM graph_nodes UNION SELECT DISTINCT 'graph_links', id, attributes FROM graph_links) WHERE json_valid(a)
            UNION ALL
            SELECT w.t, w.id, CASE WHEN json_type(w.v) = 'VARCHAR' THEN w.path WHEN json_type(w.v) = 'ARRAY' THEN w.path || '[' || e.key || ']' WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END || CASE WHEN json_type(w.v) = 'OBJECT' AND e.key IN ('evidence', 'stages', 'mergedFrom', 'candidates') AND json_type(CASE WHEN json_type(e.value) = 'VARCHAR' AND json_valid(e.value->>'$') THEN (e.value->>'$')::JSON ELSE e.value END) = 'OBJECT' THEN '[0]' ELSE '' END,
              e.key, 0, CASE WHEN json_type(e.value) = 'VARCHAR' AND regexp_matches(e.value->>'$', '^\\s*[\\[{]') AND json_valid(e.value->>'$') THEN (e.value->>'$')::JSON ELSE e.value END
            FROM w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY')),
          h AS (SELECT t, id, path, CASE WHEN json_type(c) = 'VARCHAR' AND json_valid(c->>'$') THEN (c->>'$')::JSON ELSE c END AS c FROM (SELECT t, id, path, v->'$.candidates' AS c FROM w WHERE json_type(v) = 'OBJECT')),
          x AS (SELECT t, id, path, (unnest(range(json_array_length(c)::BIGINT)))::BIGINT AS idx, c FROM h WHERE json_type(c) = 'ARRAY'),
          y AS (SELECT t, id, path, idx, c->idx AS c FROM x UNION ALL SELECT t, id, path, 0, c FROM h WHERE json_type(c) = 'OBJECT'),
          z AS (SELECT t, id, path, idx, CASE WHEN json_type(c) = 'VARCHAR' AND regexp_matches(c->>'$', '^\\s*[\\[{]') AND json_valid(c->>'$') THEN (c->>'$')::JSON ELSE c END AS c FROM y)
          SELECT DISTINCT t AS owner_table, id AS owner_id, path AS parent_path, idx, CASE WHEN json_type(c) = 'OBJECT' THEN coalesce(c->>'$.nodeId', c->>'$.node_id') ELSE c->>'$' END AS candidate_id FROM z WHERE json_type(c) IN ('OBJECT', 'VARCHAR')""",
        "p3_unreadable": """SELECT DISTINCT t AS owner_table, id AS owner_id FROM (SELECT 'graph_nodes' AS t, id, attributes AS a FROM graph_nodes UNION ALL SELECT 'graph_links', id, attributes FROM graph_links) WHERE CASE WHEN a IS NULL THEN false WHEN json_valid(a) THEN json_type(a) NOT IN ('OBJECT', 'ARRAY') ELSE true END""",
        "p1_found": _TREE + "SELECT h AS hierarchy, v AS node_id, root_id, node_depth FROM down UNION ALL SELECT h, v, root_id, -1 FROM rings",
        "p1_paths": _TREE + "SELECT h AS hierarchy, v AS node_id, root_id, node_depth, to_json(path)::VARCHAR AS path FROM down UNION ALL SELECT h, v, root_id, -1, NULL FROM rings",
        "p1_descendants": _TREE + "SELECT h AS hierarchy, path[i] AS ancestor_id, v AS node_id, node_depth - i + 1 AS steps FROM down, unnest(range(1, node_depth + 1)) AS u(i) WHERE node_depth > 0",
        "p2_found": " UNION ALL ".join(f"SELECT '{w}' AS record_root, id AS record_id, version_no::BIGINT AS version_no, change_kind FROM ({snapshot_sql(f'snapshot_{w}', c)})" for w, c in (("nodes", NODE_COLUMNS), ("links", LINK_COLUMNS))),
        "p2_counts": f"""WITH c AS ({snapshot_sql('snapshot_nodes', NODE_COLUMNS)} UNION ALL {snapshot_sql('snapshot_links', LINK_COLUMNS)})
          SELECT v.repo, v.version_no, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed, count(*) FILTER (change_kind = 'changed') AS changed, any_value(v.added) AS reported_added, any_value(v.removed) AS reported_removed, any_value(v.changed) AS reported_changed
          FROM graph_versions v LEFT JOIN c ON c.repo = v.repo AND c.version_no = v.version_no WHERE v.version_no > (SELECT min(version_no) FROM graph_versions f WHERE f.repo = v.repo) GROUP BY v.repo, v.version_no""",
        "p1_conflicts": """WITH g AS (SELECT DISTINCT lower(trim(kind)) AS h, CASE WHEN lower(trim(kind)) = 'contains' THEN target ELSE source END AS v, CASE WHEN lower(trim(kind)) = 'contains' THEN source ELSE target END AS p
          FROM graph_links WHERE lower(trim(kind)) IN ('contains', 'extends') AND source IS NOT NULL AND target IS NOT NULL), k AS (SELECT *, min(p) OVER (PARTITION BY h, v) AS low FROM g)
          SELECT h AS hierarchy, v AS node_id, low AS kept_parent_id, p AS dropped_parent_id FROM k WHERE p <> low""",
        "p4_found": _ENDS + "SELECT side, node_id FROM e WHERE node_id IS NOT NULL GROUP BY side, node_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM graph_links)",
        "p4_profiles": _ENDS
        + """, k AS (SELECT id, count(*) AS c FROM graph_nodes GROUP BY id),
        a AS (SELECT side, node_id, count(*) AS link_rows, count(DISTINCT other_id) AS neighbours, max(row(observed_at, id)) AS latest, round(coalesce(sum(weight), 0), 4) AS weight FROM e WHERE node_id IS NOT NULL GROUP BY side, node_id)
        SELECT side, node_id, link_rows, neighbours, latest[2] AS latest_link, latest[1] AS latest_at, weight, coalesce(c, 0) AS node_rows, link_rows * coalesce(c, 0) AS joined_rows FROM a LEFT JOIN k ON k.id = a.node_id""",
        "p4_joined": _ENDS + ", j AS (SELECT side, count(*) AS n, round(sum(weight), 2) AS w FROM e JOIN graph_nodes k ON k.id = e.node_id GROUP BY side) SELECT e.side, count(*) AS link_rows, any_value(n) AS joined_rows, any_value(w) AS joined_weight FROM e LEFT JOIN j ON j.side = e.side GROUP BY e.side",
        "p6_found": _REFS + "SELECT ref_table, ref_field, row_id, reason, ref_month FROM o",
        "p6_report": _REFS + "SELECT ref_table, ref_field, ref_month, reason, count(*) AS n FROM o GROUP BY ALL",
    }
