"""Registered pattern-language queries over the trade and code graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import cql
from ..graph import code_graph, trade_graph

#: Views shared by the SQL of code-graph queries: cn(nodes) and ce(edges).
CODE_SQL = """
WITH RECURSIVE alive AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM graph_nodes WHERE deleted_at IS NULL AND ingested_at IS NOT NULL),
cn0 AS (
  SELECT id, repo, kind, node_label, qualified_name, lang, source_file, start_line, end_line, community_id FROM alive
  WHERE rn = 1 AND id NOT IN (SELECT id FROM graph_nodes WHERE deleted_at IS NOT NULL)
  UNION ALL SELECT id, NULL, kind, node_label, NULL, lang, NULL, NULL, NULL, NULL FROM shared_nodes),
cn AS (
  SELECT *, CASE WHEN regexp_matches(c, '^[a-z]') THEN upper(c[1]) || c[2:] ELSE 'Entity' END AS label
  FROM (SELECT *, regexp_replace(lower(kind), '[^a-z0-9_]', '', 'g') AS c FROM cn0)),
fl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM graph_links WHERE source IS NOT NULL AND target IS NOT NULL),
ce AS (
  SELECT id AS eid, source AS src, target AS dst, upper(regexp_replace(trim(kind), '[^A-Za-z0-9_]', '', 'g')) AS type, weight, context, is_deferred, observed_at FROM fl
  WHERE rn = 1 AND source IN (SELECT id FROM cn) AND target IN (SELECT id FROM cn))
"""

#: name -> (graph, query, SQL without the shared views, digits of rounded columns)
TRADE = {
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 1000.0 RETURN c.id AS id, count(*) AS n, sum(o.totalprice) AS total ORDER BY total DESC, id LIMIT 20",
        "SELECT 'customer:' || o_custkey AS id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, id LIMIT 20",
        {"total": 2},
    ),
    "sc1_full_scan": ("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders", {}),
    "sc3_id_lookup": ("MATCH (c {id: 'customer:7'}) RETURN c.name AS name, c.acctbal AS acctbal", "SELECT c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 7", {}),
    "sc4_label_scan": ("MATCH (c:Customer) RETURN c.id AS id, c.segment AS segment", "SELECT 'customer:' || c_custkey AS id, c_mktsegment AS segment FROM customer", {}),
    "sc7_type_scan": ("MATCH ()-[r:PLACED]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM orders", {}),
    "sc8_out_adjacency": ("MATCH (c {id: 'customer:11'})-[:PLACED]->(o) RETURN o.id AS id, o.totalprice AS price", "SELECT 'order:' || o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_custkey = 11", {}),
    "sc9_in_adjacency": ("MATCH (p {id: 'part:5'})<-[r:CONTAINS]-(o) RETURN o.id AS id, r.quantity AS quantity", "SELECT 'order:' || l_orderkey AS id, l_quantity AS quantity FROM lineitem WHERE l_partkey = 5", {}),
    "j1_expand": ("MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) WHERE p.size > 40 RETURN s.id AS s, p.id AS p", "SELECT DISTINCT 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40", {}),
    "j3_undirected": ("MATCH (n:Nation)-[r]-(x) RETURN n.name AS name, count(*) AS n", "SELECT n_name AS name, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation", {}),
    "j4_chain": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, o.status AS status, count(*) AS n, sum(o.totalprice) AS total",
        "SELECT r_name AS region, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
        {"total": 2},
    ),
    "j5_natural": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
        {},
    ),
    "j9_optional": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000.0 RETURN c.id AS id, count(o) AS n",
        "SELECT 'customer:' || c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey",
        {},
    ),
    "j12_semi": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.priority = '1-URGENT' } RETURN c.id AS id", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", {}),
    "j13_anti": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->() } RETURN c.id AS id", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", {}),
    "pr25_exists_flag": ("MATCH (c:Customer) RETURN EXISTS { (c)-[:PLACED]->() } AS placed, count(*) AS n", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS placed, count(*) AS n FROM customer GROUP BY 1", {}),
    "j14_theta": ("MATCH (a:Region), (b:Region) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y WHERE x.r_name < y.r_name", {}),
    "j15_cartesian": ("MATCH (a:Region), (b:Nation) RETURN a.name AS a, b.name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation", {}),
    "j10_null_start": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o {status: 'P'}) MATCH (o)-[:CONTAINS]->(p) RETURN c.id AS c, count(*) AS n", "SELECT 'customer:' || o_custkey AS c, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_custkey", {}),
    "j10_rebinding": ("MATCH (n:Nation {id: 'nation:3'}) MATCH (n)-[:IN_REGION]->(r) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 3", {}),
    "j6_var_length": (
        "MATCH (r:Region {id: 'region:1'})<-[rs*1..2]-(x) RETURN x.id AS id, size(rs) AS hops",
        "SELECT 'nation:' || n_nationkey AS id, 1 AS hops FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1",
        {},
    ),
    "j7_shortest": ("MATCH p = shortestPath((a:Supplier {id: 'supplier:1'})-[*1..3]->(r:Region)) RETURN length(p) AS hops, r.name AS region", "SELECT 2 AS hops, r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey = 1", {}),
    "j8_all_shortest": ("MATCH p = allShortestPaths((a:Customer {id: 'customer:1'})-[*1..4]-(b:Supplier {id: 'supplier:2'})) RETURN length(p) AS hops, count(*) AS n", """SELECT 3 AS hops, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) s ON s.l_partkey = lineitem.l_partkey WHERE o_custkey = 1 AND s.l_suppkey = 2 HAVING count(*) > 0""", {}),
    "j11_path": ("MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN nodes(p)[0] AS a, nodes(p)[1] AS b, length(p) AS n", "SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b, 1 AS n FROM nation", {}),
    "pr2_wildcard": ("MATCH (r:Region) WITH r.name AS name, r.id AS id RETURN *", "SELECT 'region:' || r_regionkey AS id, r_name AS name FROM region", {}),
    "pr3_with_barrier": ("MATCH (c:Customer) WITH c.segment AS segment, c.acctbal AS bal WHERE bal > 5000.0 RETURN segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1", {}),
    "pr5_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 12 RETURN c.id AS id, n", "SELECT 'customer:' || o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", {}),
    "pr6_inline_map": ("MATCH (c:Customer {segment: 'BUILDING'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'", {}),
    "pr8_rel_map": ("MATCH (o:Order)-[r:CONTAINS {quantity: 25.0}]->(p:Part) RETURN o.id AS o, p.id AS p", "SELECT 'order:' || l_orderkey AS o, 'part:' || l_partkey AS p FROM lineitem WHERE l_quantity = 25", {}),
    "pr9_types": ("MATCH (a)-[r:IN_NATION|IN_REGION]->(b) RETURN type(r) AS type, count(*) AS n", "SELECT 'IN_NATION' AS type, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'IN_REGION', count(*) FROM nation", {}),
    "pr10_label_test": ("MATCH (x)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, x:Supplier AS supplier, count(*) AS n", "SELECT n_name AS nation, s AS supplier, count(*) AS n FROM (SELECT c_nationkey AS k, false AS s FROM customer UNION ALL SELECT s_nationkey, true FROM supplier) JOIN nation ON n_nationkey = k GROUP BY ALL", {}),
    "pr12_parameter": ("MATCH (p:Part) WHERE p.size = $size RETURN p.id AS id", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_size = 15", {}),
    "pr14_logic": (
        "MATCH (c:Customer) RETURN (c.acctbal > 0.0 AND NOT c.segment = 'BUILDING') OR c.segment = 'MACHINERY' AS a, c.acctbal > 0.0 XOR c.segment = 'BUILDING' AS b, count(*) AS n",
        "SELECT (c_acctbal > 0 AND NOT c_mktsegment = 'BUILDING') OR c_mktsegment = 'MACHINERY' AS a, (c_acctbal > 0) <> (c_mktsegment = 'BUILDING') AS b, count(*) AS n FROM customer GROUP BY ALL",
        {},
    ),
    "pr14_nulls": (
        "UNWIND [true, false, null] AS x UNWIND [true, false, null] AS y RETURN toString(x) AS x, toString(y) AS y, x AND y AS a, x OR y AS o, x XOR y AS e, NOT x AS n",
        "SELECT CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y, x AND y AS a, x OR y AS o, x <> y AS e, NOT x AS n FROM (SELECT unnest([true, false, null]) AS x), (SELECT unnest([true, false, null]) AS y)",
        {},
    ),
    "pr17_list_equality": ("RETURN [1, 2] = [1, 2] AS a, [1, 2] = [1, 3] AS b, [1] = [1, 2] AS c, 1 = 1.0 AS d, 1 = 'x' AS e, null = 1 AS f", "SELECT true AS a, false AS b, false AS c, true AS d, false AS e, CAST(NULL AS BOOLEAN) AS f", {}),
    "pr18_cross_type": ("RETURN 'a' < 1 AS a, 1 < 'a' AS b, true < 1 AS c, [1] < 'x' AS d", "SELECT true AS a, false AS b, true AS c, true AS d", {}),
    "pr19_in": ("UNWIND [1, 3, null] AS x RETURN toString(x) AS x, x IN [1, 2] AS a, x IN [1, null] AS b", "SELECT CAST(x AS VARCHAR) AS x, x IN (1, 2) AS a, x IN (1, NULL) AS b FROM (SELECT unnest([1, 3, NULL]) AS x)", {}),
    "pr20_strings": ("MATCH (p:Part) WHERE p.name STARTS WITH 'sm' OR p.name ENDS WITH 'bolt' OR p.name CONTAINS 'd w' RETURN p.id AS id", "SELECT 'part:' || p_partkey AS id FROM part WHERE starts_with(p_name, 'sm') OR suffix(p_name, 'bolt') OR contains(p_name, 'd w')", {}),
    "pr21_regex": ("MATCH (c:Customer) WHERE c.name =~ '1[0-4]' RETURN c.id AS id", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE regexp_matches(c_name, '1[0-4]')", {}),
    "pr22_null_test": ("MATCH (n) WHERE n.acctbal IS NOT NULL AND n.segment IS NULL RETURN n.id AS id", "SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal IS NOT NULL", {}),
    "pr23_precedence": ("RETURN 2 + 3 * 4 ^ 2 AS a, 2 ^ 3 ^ 2 AS b, true OR false AND false AS c, 7 - 2 - 1 AS d, -2 ^ 2 AS e", "SELECT 50.0::DOUBLE AS a, 512.0::DOUBLE AS b, true AS c, 4::BIGINT AS d, -4.0::DOUBLE AS e", {}),
    "pr24_case": (
        "MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'medium' ELSE 'large' END AS band, CASE p.size WHEN 1 THEN 'one' WHEN null THEN 'none' END AS exact, count(*) AS n",
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, CASE WHEN p_size IS NOT DISTINCT FROM 1 THEN 'one' WHEN p_size IS NULL THEN 'none' END AS exact, count(*) AS n FROM part GROUP BY ALL",
        {},
    ),
    "pr26_unwind": ("MATCH (r:Region) UNWIND [1, 2] AS k RETURN r.name AS name, k", "SELECT r_name AS name, unnest([1, 2]) AS k FROM region", {}),
    "pr27_distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part", {}),
    "a1_grouping": (
        "MATCH (o:Order) RETURN o.status AS status, o.priority AS priority, count(*) AS n, sum(o.totalprice) AS s, avg(o.totalprice) AS a, min(o.totalprice) AS lo, max(o.totalprice) AS hi",
        "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL",
        {"s": 2, "a": 4},
    ),
    "a1_empty": ("MATCH (o:Order) WHERE o.totalprice < 0.0 RETURN count(*) AS n, sum(o.totalprice) AS s, avg(o.totalprice) AS a, size(collect(o.status)) AS c", "SELECT 0 AS n, 0.0::DOUBLE AS s, CAST(NULL AS DOUBLE) AS a, 0 AS c", {}),
    "a3_distinct": ("MATCH (p:Part) RETURN count(DISTINCT p.brand) AS brands, count(p.size) AS sizes, sum(DISTINCT p.size) AS s", "SELECT count(DISTINCT p_brand) AS brands, count(p_size) AS sizes, sum(DISTINCT p_size)::BIGINT AS s FROM part", {}),
    "a7_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n.name) AS names RETURN r.name AS region, size(names) AS n, head(names) AS first, last(names) AS last", "SELECT r_name AS region, count(*) AS n, min(n_name) AS first, max(n_name) AS last FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name", {}),
    "a9_nested": ("MATCH (o:Order) RETURN o.status AS status, count(o) * 2 + 1 AS n", "SELECT o_orderstatus AS status, count(*) * 2 + 1 AS n FROM orders GROUP BY 1", {}),
    "o1_order": ("MATCH (n) WHERE n.size IS NULL OR n.size > 48 RETURN n.size AS size, n.id AS id ORDER BY size DESC, id LIMIT 40", "SELECT NULL::INTEGER AS size, id FROM (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'order:' || o_orderkey FROM orders) ORDER BY id LIMIT 40", {}),
    "o3_skip_limit": ("MATCH (c:Customer) RETURN c.id AS id, c.acctbal AS bal ORDER BY bal DESC, id SKIP 5 LIMIT 10", "SELECT 'customer:' || c_custkey AS id, c_acctbal AS bal FROM customer ORDER BY bal DESC, id LIMIT 10 OFFSET 5", {}),
    "o4_unordered_limit": ("MATCH (s:Supplier) RETURN s.id AS id LIMIT 5", "SELECT 'supplier:' || s_suppkey AS id FROM supplier ORDER BY id LIMIT 5", {}),
    "u1_union_all": ("MATCH (a:Region) RETURN a.name AS name UNION ALL MATCH (b:Nation) RETURN b.name AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation", {}),
    "u2_union": ("MATCH (a:Customer) RETURN a.segment AS x UNION MATCH (b:Customer) RETURN b.segment AS x UNION MATCH (c:Part) RETURN c.brand AS x", "SELECT DISTINCT c_mktsegment AS x FROM customer UNION SELECT p_brand FROM part", {}),
    "f1_f5_text": ("MATCH (p:Part) RETURN p.id AS id, size(p.name) AS n, toUpper(p.brand) AS u, toLower(p.brand) AS l, trim('  ' + p.brand + ' ') AS t, replace(p.brand, '#', '-') AS r, split(p.brand, '#')[1] AS s", "SELECT 'part:' || p_partkey AS id, length(p_name) AS n, upper(p_brand) AS u, lower(p_brand) AS l, p_brand AS t, replace(p_brand, '#', '-') AS r, split_part(p_brand, '#', 2) AS s FROM part", {}),
    "f4_coalesce": ("MATCH (n) WHERE n.size IS NULL RETURN coalesce(n.segment, n.status, labels(n)[0]) AS x, count(*) AS n", "SELECT x, count(*) AS n FROM (SELECT c_mktsegment AS x FROM customer UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT 'Region' FROM region UNION ALL SELECT 'Nation' FROM nation UNION ALL SELECT 'Supplier' FROM supplier) GROUP BY x", {}),
    "f6_f9_casts": (
        "UNWIND ['12', '1.5', 'x', 'TRUE', '-7'] AS v RETURN v, toInteger(v) AS i, toFloat(v) AS f, toBoolean(v) AS b, toString(2.0) AS s, toInteger(2.9) AS t",
        "SELECT v, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN CAST(v AS BIGINT) END AS i, TRY_CAST(v AS DOUBLE) AS f, CASE lower(v) WHEN 'true' THEN true WHEN 'false' THEN false END AS b, '2' AS s, 2::BIGINT AS t FROM (SELECT unnest(['12', '1.5', 'x', 'TRUE', '-7']) AS v)",
        {},
    ),
    "f12_f17_entities": ("MATCH (n:Nation)-[r:IN_REGION]->(x) RETURN id(n) AS id, labels(n)[0] AS label, type(r) AS type, properties(n).name AS name, keys(n)[0] AS key", "SELECT 'nation:' || n_nationkey AS id, 'Nation' AS label, 'IN_REGION' AS type, n_name AS name, 'id' AS key FROM nation", {}),
    "f18_quantifiers": (
        "UNWIND [[1, 2, 3], [2, 4], [5]] AS l RETURN size(l) AS n, any(x IN l WHERE x > 3) AS a, all(x IN l WHERE x > 1) AS b, none(x IN l WHERE x > 4) AS c, single(x IN l WHERE x > 2) AS d",
        "SELECT len(l) AS n, len(list_filter(l, lambda x: x > 3)) > 0 AS a, len(list_filter(l, lambda x: x > 1)) = len(l) AS b, len(list_filter(l, lambda x: x > 4)) = 0 AS c, len(list_filter(l, lambda x: x > 2)) = 1 AS d FROM (SELECT unnest([[1, 2, 3], [2, 4], [5]]) AS l)",
        {},
    ),
    "f19_f21_arithmetic": ("UNWIND [7, -7] AS x RETURN x / 2 AS d, x % 2 AS m, x * 2.5 AS p, x - 1 AS s, x ^ 2 AS q, x / 2.0 AS f, 'a' + 'b' AS t", "SELECT x // 2 + (CASE WHEN x < 0 AND x % 2 <> 0 AND x // 2 * 2 > x THEN 0 ELSE 0 END) AS d, x % 2 AS m, (x * 2.5)::DOUBLE AS p, x - 1 AS s, pow(x, 2) AS q, x / 2.0 AS f, 'ab' AS t FROM (SELECT unnest([7, -7])::BIGINT AS x)", {}),
    "f22_f24_lists": ("UNWIND [[1, 2, 3, 4]] AS l RETURN l[0] AS a, l[-1] AS b, l[9] AS c, l[1..3][0] AS d, size(l[-2..]) AS e, size(l + 5) AS f, {k: 3}.k AS g", "SELECT 1 AS a, 4 AS b, NULL::BIGINT AS c, 2 AS d, 2 AS e, 5 AS f, 3 AS g", {}),
    "j2_incoming": ("MATCH (n:Nation {id: 'nation:4'})<-[:IN_NATION]-(x:Supplier) RETURN x.id AS id, x.acctbal AS bal", "SELECT 'supplier:' || s_suppkey AS id, s_acctbal AS bal FROM supplier WHERE s_nationkey = 4", {}),
    "pr1_projection": ("MATCH (n:Nation) RETURN n.name, n.id AS key", "SELECT n_name AS \"n.name\", 'nation:' || n_nationkey AS key FROM nation", {}),
    "pr4_where": ("MATCH (o:Order) WHERE o.totalprice >= 100000.0 AND o.status <> 'F' RETURN o.id AS id", "SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'", {}),
    "pr7_inline_label": ("MATCH (x)-[:IN_NATION]->(:Nation) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier", {}),
    "pr11_property": ("MATCH (n:Region) RETURN n.name AS name, n.absent AS absent, {a: {b: 2}}.a.b AS deep", "SELECT r_name AS name, NULL::VARCHAR AS absent, 2 AS deep FROM region", {}),
    "pr13_literals": ("RETURN 9223372036854775807 AS i, -1.5e3 AS f, 'it\\'s' AS s, [1, 2][1] AS l, null AS n, true AS b", "SELECT 9223372036854775807 AS i, -1500.0::DOUBLE AS f, 'it''s' AS s, 2 AS l, NULL::VARCHAR AS n, true AS b", {}),
    "pr16_unary": ("MATCH (p:Part) RETURN p.id AS id, -p.size AS m, +p.size AS s, NOT p.size > 20 AS small", "SELECT 'part:' || p_partkey AS id, -p_size AS m, p_size AS s, NOT p_size > 20 AS small FROM part", {}),
    "a2_count_rows": ("MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN p.brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1", {}),
    "a4_sum": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.size AS size, sum(r.quantity) AS q, sum(p.size) AS s", "SELECT p_size AS size, sum(l_quantity) AS q, sum(p_size)::BIGINT AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1", {"q": 2}),
    "a5_avg": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.id AS id, avg(c.acctbal) AS a", "SELECT 'nation:' || c_nationkey AS id, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY 1", {"a": 6}),
    "a6_min_max": ("MATCH (c:Customer)-[:PLACED]->(o) RETURN c.id AS id, min(o.totalprice) AS lo, max(o.priority) AS hi", "SELECT 'customer:' || o_custkey AS id, min(o_totalprice) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY 1", {}),
    "a8_distinct_aggregates": ("MATCH (p:Part) RETURN p.brand AS brand, count(DISTINCT p.size) AS n, sum(DISTINCT p.size) AS s, avg(DISTINCT p.size) AS a, size(collect(DISTINCT p.size)) AS c", "SELECT p_brand AS brand, count(DISTINCT p_size) AS n, sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 6) AS a, count(DISTINCT p_size) AS c FROM part GROUP BY 1", {"a": 6}),
    "o7_ordered_window": ("MATCH (p:Part) WITH p.brand AS brand, max(p.retailprice) AS top ORDER BY top DESC, brand LIMIT 3 RETURN brand, top", "SELECT p_brand AS brand, max(p_retailprice) AS top FROM part GROUP BY 1 ORDER BY top DESC, brand LIMIT 3", {}),
    "f2_f15_paths": ("MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r:Region) RETURN nodes(p)[2] AS region, length(p) AS n, size(relationships(p)) AS k, count(*) AS rows", "SELECT 'region:' || n_regionkey AS region, 2 AS n, 2 AS k, count(*) AS rows FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", {}),
    "f3_head_last": ("UNWIND [[3, 1], [7]] AS l RETURN head(l) AS h, last(l) AS t, head(l[5..]) AS e", "SELECT 3 AS h, 1 AS t, NULL::BIGINT AS e UNION ALL SELECT 7, 7, NULL", {}),
}
CODE = {
    "sc5_display_label": ("MATCH (n {node_label: 'render_lexer'}) RETURN n.id AS id, n.kind AS kind", "SELECT id, kind FROM cn WHERE node_label = 'render_lexer'", {}),
    "sc6_one_file": ("MATCH (n) WHERE n.source_file = 'planner/parser_362.go' RETURN n.id AS id", "SELECT id FROM cn WHERE source_file = 'planner/parser_362.go'", {}),
    "cq_calls": ("MATCH (a:Function)-[:CALLS]->(b) RETURN a.id AS caller, b.id AS callee", "SELECT a.id AS caller, e.dst AS callee FROM ce e JOIN cn a ON a.id = e.src WHERE a.label = 'Function' AND e.type = 'CALLS'", {}),
    "cq_labels": ("MATCH (n) RETURN labels(n)[0] AS label, n.lang AS lang, count(*) AS n", "SELECT label, lang, count(*) AS n FROM cn GROUP BY ALL", {}),
    "cq_types": ("MATCH (a)-[r]->(b) RETURN type(r) AS type, count(*) AS n, avg(r.weight) AS weight", "SELECT type, count(*) AS n, round(avg(weight), 6) AS weight FROM ce GROUP BY type", {"weight": 6}),
    "cq_source_file": ("MATCH (n)-[:CONTAINS]->(m) WHERE n.source_file IS NOT NULL AND n.source_file = m.source_file RETURN n.source_file AS file, count(*) AS n", "SELECT a.source_file AS file, count(*) AS n FROM ce e JOIN cn a ON a.id = e.src JOIN cn b ON b.id = e.dst WHERE e.type = 'CONTAINS' AND a.source_file = b.source_file GROUP BY 1", {}),
    "cq_edge_unique": ("MATCH (a)-[r:EXTENDS]->(b)<-[s:EXTENDS]-(c) RETURN b.id AS base, count(*) AS n", "SELECT e.dst AS base, count(*) AS n FROM ce e JOIN ce f ON f.dst = e.dst AND f.eid <> e.eid WHERE e.type = 'EXTENDS' AND f.type = 'EXTENDS' GROUP BY 1", {}),
    "cq_two_hops": ("MATCH (a:Class)-[:CONTAINS]->(b)-[:CALLS]->(c:Function) RETURN a.id AS a, count(DISTINCT c) AS n", "SELECT a.id AS a, count(DISTINCT c.id) AS n FROM cn a JOIN ce e ON e.src = a.id AND e.type = 'CONTAINS' JOIN ce f ON f.src = e.dst AND f.type = 'CALLS' JOIN cn c ON c.id = f.dst WHERE a.label = 'Class' AND c.label = 'Function' GROUP BY a.id", {}),
    "cq_trails": (
        "MATCH (a:Class)-[rs:EXTENDS*1..3]->(b) RETURN a.id AS a, b.id AS b, size(rs) AS hops",
        "SELECT a.id AS a, e1.dst AS b, 1 AS hops FROM cn a JOIN ce e1 ON e1.src = a.id AND e1.type = 'EXTENDS' WHERE a.label = 'Class' UNION ALL SELECT a.id, e2.dst, 2 FROM cn a JOIN ce e1 ON e1.src = a.id AND e1.type = 'EXTENDS' JOIN ce e2 ON e2.src = e1.dst AND e2.type = 'EXTENDS' AND e2.eid <> e1.eid WHERE a.label = 'Class' UNION ALL SELECT a.id, e3.dst, 3 FROM cn a JOIN ce e1 ON e1.src = a.id AND e1.type = 'EXTENDS' JOIN ce e2 ON e2.src = e1.dst AND e2.type = 'EXTENDS' AND e2.eid <> e1.eid JOIN ce e3 ON e3.src = e2.dst AND e3.type = 'EXTENDS' AND e3.eid <> e2.eid AND e3.eid <> e1.eid WHERE a.label = 'Class'",
        {},
    ),
    "cq_untested": ("MATCH (f:Method) WHERE NOT EXISTS { (t)-[:TESTS]->(f) } RETURN f.repo AS repo, count(*) AS n", "SELECT repo, count(*) AS n FROM cn WHERE label = 'Method' AND id NOT IN (SELECT dst FROM ce WHERE type = 'TESTS') GROUP BY repo", {}),
    "cq_context": ("MATCH (a)-[r {context: 'call'}]->(b) RETURN type(r) AS type, r.is_deferred AS deferred, count(*) AS n", "SELECT type, is_deferred AS deferred, count(*) AS n FROM ce WHERE context = 'call' GROUP BY ALL", {}),
}
PARAMETERS = {"pr12_parameter": {"size": 15}}


def _runner(view, name, source, digits):
    def run(spark, d):
        out = cql.query(view(spark, d), source, **PARAMETERS.get(name, {}))
        return out.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else out

    return run


def queries() -> dict:
    out = {n: _runner(trade_graph, n, q, d) for n, (q, _, d) in TRADE.items()}
    return out | {n: _runner(code_graph, n, q, d) for n, (q, _, d) in CODE.items()} | {"sc2_access_paths": sc2_access_paths, "l_refused": l_refused}


#: Columns that are 64-bit integers in the language but smaller in SQL.
#: Queries and the node their patterns start at.
STARTS = {
    "MATCH (n {id: 'x'})-->(m) RETURN n.id": ("id",), "MATCH (n:Class) WHERE n.source_file = 'a.py' RETURN n.id": ("source_file",), "MATCH (n {node_label: 'x'}) RETURN n.id": ("display_label",), "MATCH (n:Class) RETURN n.id": ("label",),
    "MATCH (n)-->(m) RETURN n.id": ("scan",), "MATCH (n:Class) MATCH (n)-->(m) RETURN m.id": ("label", "bound"), "MATCH (n:Class) WHERE n.lang = 'go' AND n.id = 'y' RETURN n.id": ("id",), "MATCH (n:Class) WHERE n.id = 'y' OR n.lang = 'go' RETURN n.id": ("label",),
}
#: Queries that the language refuses, and the code of each refusal.
REFUSED = {
    "CREATE (n) RETURN n": "CQL1007", "MATCH (n) SET n.x = 1 RETURN n": "CQL1007", "CALL db.labels() YIELD x RETURN x": "CQL1007", "MATCH (n)": "CQL2002", "MATCH (a)-[*]->(b) RETURN a": "CQL3002", "MATCH (a)-[*1..33]->(b) RETURN a": "CQL3002", "RETURN x": "CQL2004", "RETURN foo(1)": "CQL2016",
    "RETURN sum(*)": "CQL2016", "RETURN 1 AS a, 2 AS a": "CQL2015", "RETURN 1 AS a UNION RETURN 1 AS b": "CQL2014", "MATCH p = shortestPath((a)-[*1..2]->(b)-[*1..2]->(c)) RETURN p": "CQL2020", "RETURN 99999999999999999999": "CQL1009", "RETURN (((": "CQL1002",
    "MATCH (n) WITH n LIMIT 2 WHERE n.num = 1 RETURN n": "CQL1002", "MATCH (n) WHERE EXISTS { (n)-->(m) WHERE EXISTS { (m)-->() } } RETURN n": "CQL1008", "RETURN $p": "CQL4001", "RETURN 1 LIMIT -1": "CQL4002", "UNWIND 1 AS x RETURN x": "CQL4003", "RETURN 'a' =~ '(?=x)'": "CQL4018",
}


def sc2_access_paths(spark, d):
    rows = [(q, k, path) for q in STARTS for k, (_, _, path) in enumerate(cql.access_paths(q))]
    return spark.createDataFrame(rows, "query string, pattern bigint, path string")


def l_refused(spark, d):
    """The code with which each query is refused."""
    g = code_graph(spark, d)

    def code(q):
        try:
            cql.query(g, q)
        except cql.QueryError as refused:
            return refused.code

    return spark.createDataFrame([(q, code(q)) for q in REFUSED], "query string, code string")


LONGS = {"j6_var_length": "hops", "j7_shortest": "hops", "j8_all_shortest": "hops", "j11_path": "n", "pr26_unwind": "k", "a1_empty": "n c", "f22_f24_lists": "a b d e f g", "pr11_property": "deep", "pr13_literals": "l", "f2_f15_paths": "n k", "f3_head_last": "h t", "cq_trails": "hops"}


def oracle_sql() -> dict[str, str]:
    text = lambda t: "'" + t.replace("'", "''") + "'"
    starts = ", ".join(f"({text(q)}, {k}::BIGINT, '{path}')" for q, paths in STARTS.items() for k, path in enumerate(paths))
    refused = ", ".join(f"({text(q)}, '{code}')" for q, code in REFUSED.items())
    stated = {"sc2_access_paths": f"SELECT * FROM (VALUES {starts}) t(query, pattern, path)", "l_refused": f"SELECT * FROM (VALUES {refused}) t(query, code)"}
    out = stated | {n: sql for n, (_, sql, _) in TRADE.items() if sql} | {n: CODE_SQL + sql for n, (_, sql, _) in CODE.items()}
    for n, cols in LONGS.items():
        casts = ", ".join(f"{c}::BIGINT AS {c}" for c in cols.split())
        out[n] = f"SELECT * REPLACE ({casts}) FROM ({out[n]})"
    return out
