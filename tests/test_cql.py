import pytest

from nodeloom import cql
from nodeloom.graph import PropertyGraph, with_index
from nodeloom.query import answer, direction, plan, scoped


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "Function", "a()", "src/a.rs", 1), ("b", "Function", "b()", "src/b.rs", 2), ("c", "Function", "c()", "src/c.rs", None), ("test", "Function", "test_a()", "tests/a.rs", 3), ("k", "Class", "K", "src/a.rs", 3)]
    edges = [("e0", "a", "b", "CALLS", "EXTRACTED"), ("e1", "b", "c", "CALLS", "EXTRACTED"), ("e2", "test", "a", "TESTS", "INFERRED"), ("e3", "k", "k", "CALLS", "EXTRACTED"), ("e4", "a", "b", "CALLS", "INFERRED")]
    n = spark.createDataFrame(nodes, "id string, label string, node_label string, source_file string, num bigint").selectExpr("*", "'function' kind", "cast(null as string) qualified_name", "cast(null as int) community_id")
    return PropertyGraph(n, spark.createDataFrame(edges, "eid string, src string, dst string, type string, confidence string"), closed=True)


def rows(graph, q, **p):
    return cql.rows(graph, q, max_seconds=None, **p)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (a)-[:CALLS]->(b) RETURN a.id, b.id", [("a", "b"), ("a", "b"), ("b", "c"), ("k", "k")]),
        ("MATCH (a)-[r:CALLS]-(b) WHERE a.id = 'k' RETURN b.id", [("k",)]),
        ("MATCH (a)-[r:CALLS {confidence: 'INFERRED'}]->(b) RETURN r.confidence, type(r)", [("INFERRED", "CALLS")]),
        ("MATCH (a)-[x:CALLS]->(b)<-[y:CALLS]-(a) RETURN a.id, x.id, y.id", [("a", "e0", "e4"), ("a", "e4", "e0")]),
        ("MATCH (a)-[x:CALLS]->(b), (a)-[y:CALLS]->(b) WHERE a.id = 'a' RETURN count(*) AS n", [(4,)]),
        ("MATCH (a {id: 'a'})-[*0..2]->(b) RETURN b.id AS b, count(*) AS n", [("a", 1), ("b", 2), ("c", 2)]),
        ("MATCH (k {id: 'k'})-[r*1..3]->(x) RETURN size(r) AS n", [(1,)]),
        ("MATCH p = shortestPath((a {id: 'test'})-[*1..5]->(c {id: 'c'})) RETURN length(p) AS n, nodes(p)[1] AS m", [(3, "a")]),
        ("MATCH p = allShortestPaths((a {id: 'test'})-[*1..5]->(c {id: 'c'})) RETURN relationships(p)[1] AS e", [("e0",), ("e4",)]),
        ("MATCH (n:Function) OPTIONAL MATCH (n)-[:CALLS]->(m) RETURN n.id AS n, m.id AS m", [("a", "b"), ("a", "b"), ("b", "c"), ("c", None), ("test", None)]),
        ("MATCH (n) WHERE EXISTS { (n)<-[:TESTS]-() } RETURN n.id", [("a",)]),
        ("MATCH (n) WHERE NOT EXISTS { (n)-[:CALLS]->(m) WHERE m.id <> n.id } RETURN n.id", [("c",), ("k",), ("test",)]),
        ("MATCH (n) RETURN n.num AS v ORDER BY v DESC LIMIT 2", [(None,), (3,)]),
        ("MATCH (n) WITH n.num AS v WHERE v > 1 RETURN sum(v) AS s, collect(v) AS c", [(8, [2, 3, 3])]),
        ("MATCH (n) WHERE n.num = 9 RETURN count(*) AS n, sum(n.num) AS s, collect(n.id) AS c", [(0, 0, [])]),
        ("MATCH (n) WHERE n.num = 9 RETURN n.id, count(*) AS n", []),
        ("UNWIND null AS x RETURN x", []),
        ("UNWIND [1, 2, 2] AS x RETURN DISTINCT x", [(1,), (2,)]),
        ("RETURN 1 AS x UNION ALL RETURN 1 AS x UNION RETURN 1 AS x", [(1,)]),
        ("RETURN CASE null WHEN null THEN 'same' ELSE 'other' END AS x", [("same",)]),
        ("RETURN single(x IN [1, null] WHERE x = 1) AS a, any(x IN [null, 1] WHERE x = 1) AS b, 2 IN [1, null] AS c", [(None, True, None)]),
        ("RETURN 'it''s' = \"it's\" OR true AS x", None),
        ("MATCH (n:Function) WITH n LIMIT 2 RETURN n.id", [("a",), ("b",)]),
        ("MATCH (n {id: 'a'}) RETURN n", [(("a", "Function"),)]),
        ("MATCH (a {id: 'a'}), (b {id: 'c'}) MATCH (a)-[:CALLS]->(x)-[:CALLS]->(b) RETURN DISTINCT x.id AS x", [("b",)]),
    ],
)
def test_results(graph, query, want):
    if want is None:
        with pytest.raises(cql.QueryError):
            rows(graph, query)
        return
    got = [tuple(tuple(v) if type(v).__name__ == "Row" else v for v in r) for r in rows(graph, query)]
    assert got == sorted(want, key=repr) or got == want


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ("CREATE (n) RETURN n", "CQL1007"), ("MATCH (n)", "CQL2002"), ("MATCH (a)-[*]->(b) RETURN a", "CQL3002"), ("MATCH (a)-[*1..33]->(b) RETURN a", "CQL3002"),
        ("RETURN x", "CQL2004"), ("RETURN foo(1)", "CQL2016"), ("RETURN $p", "CQL4001"), ("RETURN 1 AS a, 2 AS a", "CQL2015"), ("RETURN 1 AS a UNION RETURN 1 AS b", "CQL2014"),
        ("MATCH (n) WHERE n.num RETURN n", "CQL2006"), ("RETURN 'a' =~ '(?=x)'", "CQL4018"), ("UNWIND 1 AS x RETURN x", "CQL4003"), ("RETURN 1 LIMIT -1", "CQL4002"), ("RETURN 'a' + 1", "CQL4003"),
        ("MATCH p = shortestPath((a)-[*1..2]->(b)-[*1..2]->(c)) RETURN p", "CQL2020"), ("RETURN 99999999999999999999", "CQL1009"), ("RETURN (((", "CQL1002"), ("MATCH (n) UNWIND [1] AS n RETURN n", "CQL2005"),
        ("MATCH (n) WITH n LIMIT 2 WHERE n.num = 1 RETURN n", "CQL1002"), ("MATCH (n) WHERE EXISTS { (n)-->(m) WHERE EXISTS { (m)-->() } } RETURN n", "CQL1008"),
        ("MATCH (n) RETURN 1 / (n.num - n.num) AS x", "CQL4006"), ("MATCH (n) RETURN 1.5 / (n.num - n.num) AS x", "CQL4005"), ("MATCH (n) RETURN n.num % (n.num - n.num) AS x", "CQL4006"), ("RETURN 9223372036854775807 + 1 AS x", "CQL4006"),
        ("MATCH (n) RETURN n.id =~ ('(?' + '=x)') AS x", "CQL4018"), ("MATCH (n) RETURN split(n.none, ',') AS x", "CQL4003"),
    ],
)
def test_errors(graph, query, code):
    with pytest.raises(cql.QueryError) as e:
        rows(graph, query)
    assert e.value.code == code


def test_limits_parameters_and_explain(graph):
    with pytest.raises(cql.QueryError) as e:
        cql.rows(graph, "MATCH (n) RETURN n.id", max_rows=2, max_seconds=None)
    assert e.value.code == "CQL3004"
    assert rows(graph, "MATCH (n) WHERE n.id IN $ids RETURN n.id", ids=["a", "zz"]) == [("a",)]
    assert cql.explain("MATCH (a)-->(b) WHERE a.x = 1 WITH DISTINCT b ORDER BY b.id LIMIT 3 RETURN count(*) AS n") == ["NodeScan", "Expand", "Filter", "Project", "Distinct", "Sort", "Limit", "Aggregate"]


def test_modes_deadline_and_size(graph):
    assert rows(graph, "EXPLAIN MATCH (n)-->(m) RETURN n.id") == [(0, "NodeScan"), (1, "Expand"), (2, "Project")]
    assert rows(graph, "PROFILE MATCH (n) RETURN n.id")[-1] == (1, "Project", 5)
    with pytest.raises(cql.QueryError) as e:
        cql.rows(graph, "MATCH (a), (b), (c) RETURN a.id, b.id, c.id", max_seconds=0.0)
    assert e.value.code == "CQL3007"
    with pytest.raises(cql.QueryError) as e:
        cql.rows(graph, "MATCH (n) RETURN n.id", max_seconds=None, max_bytes=10)
    assert e.value.code == "CQL3006"
    with pytest.raises(cql.QueryError) as e:
        rows(graph, "MATCH (n) RETURN n.id =~ $p AS x", p="(a)\\1")
    assert e.value.code == "CQL4018"


def test_filters_reach_the_scan(spark):
    from nodeloom.graph import trade_graph

    df = cql.query(trade_graph(spark, "/root/testdata/sf0.001"), "MATCH (p:Part) WHERE p.size > 40 RETURN p.id AS id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "p_size" in plan and "GreaterThan(p_size,40)" in plan.replace(" ", "") and "p_retailprice" not in plan and "c_custkey" not in plan


def test_intents_and_directions():
    assert plan("Who calls parse_token?").intent == "callers" and plan("what does Foo.bar call").operands == ("Foo.bar",)
    assert plan("shortest path from a to b") .operands == ("a", "b") and plan("What breaks if Store changes?").operands == ("Store",)
    assert not plan("callers and callees of everything").routed and plan("where is parse_token").confidence == 90 and plan("where is the parser").confidence == 60
    assert [direction(q) for q in ("who calls x", "how does x reach y", "what is related to x", "x is used by y and calls z", "how does caching work", "")] == ["in", "out", "both", "both", "out", "both"]


def test_answers(graph):
    assert {(r.node, r.depth) for r in answer(graph, "who calls b").collect()} == {("a", 1)}
    assert [r.node for r in answer(graph, "shortest path from test to c").orderBy("depth").collect()] == ["test", "a", "b", "c"]
    assert {r.node for r in answer(graph, "what depends on c").collect()} == {"b", "a"}
    assert scoped(graph, package="tests").nodes.count() == 1
    assert graph.with_types("TESTS").edges.count() == 1 and len(graph.schema_fingerprint()) == 64
    assert [r.idx for r in with_index(graph.nodes, "id").orderBy("id").collect()] == [0, 1, 2, 3, 4]
