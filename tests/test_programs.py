"""Program records, resolution and comparison: small cases, nulls, ties and empty tables."""

import json

from nodeloom import history as hi
from nodeloom import program as pr
from nodeloom.graph import PropertyGraph, evidence_confidence
from nodeloom.history import compare as cm
from nodeloom.operators import cleaning as cl
from nodeloom.operators import resolve as rs


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return {tuple(r) for r in df.collect()}


def test_innermost(spark):
    sites = frame(spark, "site_id string, file string, line int, clash int", ("a", "f", 5, 0), ("b", "f", 200, 0), ("c", "g", 5, 0), ("d", "f", None, 0), ("e", None, 5, 0), ("t", "f", 1000, 0))
    ranges = frame(spark, "id string, file string, start_line int, end_line int", ("out", "f", 1, 900), ("in", "f", 4, 6), ("rev", "f", 9, 1), ("null", "f", None, 6), ("t2", "f", 1000, 1001), ("t1", "f", 999, 1000))
    for cell in (1, 7, 64, 10_000):
        assert got(pr.innermost(sites, ranges, cell)) == {("a", "in"), ("b", "out"), ("c", None), ("d", None), ("e", None), ("t", "t1")}
    assert pr.innermost(sites.limit(0), ranges, 64).count() == 0


def test_program_join_and_providers(spark):
    f = frame(spark, "symbol_id string, name string, graph_node_id string", ("1", "f()", "a"), ("2", ".g", "b"), ("3", "x", "c"), ("4", "y", None), ("5", "z", "zz"), ("6", None, "n"))
    n = frame(spark, "id string, node_label string", ("a", ".f"), ("b", "g()"), ("c", "other"), ("n", None))
    assert got(pr.join_program(f, n)) == {("1", "a", "joined"), ("2", "b", "joined"), ("3", "c", "conflict"), ("4", None, "orphan"), ("5", None, "absent"), ("6", "n", "joined")}
    facts = frame(spark, "symbol_id string, provider string, confidence string, score double", ("s", "p", "inferred", 0.9), ("s", "q", "exact", None), ("s", "r", "exact", 0.1), ("t", "p", None, None), (None, "p", "exact", 1.0))
    assert got(pr.merge_providers(facts)) == {("s", 3, 3, "r", "exact", True), ("t", 1, 1, "p", None, False)}


def test_call_graph_and_layers(spark):
    nodes = frame(spark, "id string, label string", *[(i, "Function") for i in "abcd"])
    links = frame(spark, "eid string, src string, dst string, is_deferred boolean, confidence string", ("1", "a", "b", None, None), ("2", "b", "c", True, "EXTRACTED"), ("3", "b", "d", False, "AMBIGUOUS"), ("4", "c", "gone", None, None))
    calls = pr.call_edges(links, PropertyGraph(nodes, links)).cache()
    assert got(calls.select("eid", "resolution")) == {("1", "resolved"), ("2", "inferred"), ("3", "ambiguous"), ("4", "unresolved")}
    n, e = pr.call_graph(calls, frame(spark, "id string", ("a",)), "out", 2, max_nodes=3, max_edges=1)
    assert got(n) == {("a", "a", 0, True), ("a", "b", 1, True), ("a", "c", 2, True), ("a", "d", 2, False)} and got(e) == {("a", "1", True), ("a", "2", False)}
    assert got(pr.universal_calls(calls)) == {("a", "b", "program"), ("b", "c", "structural"), ("b", "d", "structural")}


def test_validation(spark):
    f = frame(spark, "module string, symbol_id string, source_file string, start_line int, end_line int", ("m", "s", "a.py", 1, 2), ("m", "s", "a.py", 1, 2), ("m", "p", "../a", 1, 2), ("m", "l", None, 3, 2), ("m", None, "a", None, None), ("m", "z", "c:\\x", 0, 1))
    assert got(pr.validate(f)) == {("m", "s", "repeated"), ("m", "p", "path"), ("m", "l", "lines"), ("m", None, "no symbol"), ("m", "z", "path"), ("m", "z", "lines")}


def test_duplicates(spark):
    n = frame(spark, "id string, source_file string, kind string", ("x", "a.md", "document"), ("x_doc", "a.md", "Document"), ("y", "b.md", "document"), ("y_doc", "c.md", "document"), ("z_doc", None, "document"), ("z", None, "document"))
    assert got(rs.doc_twins(n)) == {("x", "x_doc")}
    g = frame(spark, "id string, origin string, source_file string, kind string, qualified_name string", ("real", "ast", "f", "function", "q"), ("ghost", "semantic", "f", "function", "q"), ("none", None, "f", "function", "q"), ("two1", "ast", "f", "function", "d"), ("two2", "AST", "f", "function", "d"), ("g2", "x", "f", "function", "d"), ("n", "x", None, "function", "q"))
    assert got(rs.ghost_duplicates(g)) == {("ghost", "real"), ("none", "real")}


def test_member_calls(spark):
    types = frame(spark, "type_id string, name string, family string", ("B", "Base", "jvm"), ("D", "Derived", "jvm"), ("X1", "Twice", "jvm"), ("X2", "Twice", "jvm"), ("P", "Derived", "python"), ("L", "Loop", "jvm"))
    members = frame(spark, "type_id string, member string, id string", ("B", "run", "B.run"), ("D", "stop", "D.stop"), ("D", "twice", "D.t1"), ("D", "twice", "D.t2"), ("P", "run", "P.run"))
    supers = frame(spark, "type_id string, super_id string", ("D", "B"), ("L", "L"), ("L", None))
    calls = frame(spark, "call_id string, receiver string, member string, family string", *[(str(k), r, m, f) for k, (r, m, f) in enumerate((("Derived", "stop", "jvm"), ("Derived", "run", "jvm"), ("Twice", "run", "jvm"), ("Nobody", "run", "jvm"), ("Derived", "fly", "jvm"), ("Derived", "twice", "jvm"), ("Derived", "run", "python"), ("Loop", "run", "jvm"), (None, "run", "jvm")))])
    want = [("D.stop", "own"), ("B.run", "inherited"), (None, "ambiguous_type"), (None, "unknown_type"), (None, "missing_member"), (None, "ambiguous_member"), ("P.run", "own"), (None, "missing_member"), (None, "unknown_type")]
    assert got(rs.member_calls(calls, types, members, supers)) == {(str(k), *w) for k, w in enumerate(want)}
    assert rs.member_calls(calls.limit(0), types, members, supers).count() == 0


def test_routes(spark):
    text = lambda stages, path="/a/{x}/:id/<k>/": json.dumps({"details": {"type": "route", "data": {"operation": "get", "path": path, "stages": stages}}})
    links = frame(spark, "id string, source string, attributes string", ("1", "s", text({"stage": "handler", "reference": "h"})), ("2", "s", text([{"stage": "middleware", "reference": "m"}, {"stage": "handler", "reference": "two", "target": "zz"}])), ("3", "s", text([{"stage": "handler", "reference": "h", "target": "n"}], "/")), ("4", "s", "{"), ("5", "s", None), ("6", "s", text("none")))
    nodes = frame(spark, "id string, node_label string, repo string", ("s", "src", "r"), ("n", "h", "r"), ("p", "two", "r"), ("q", "two", "r"), ("o", "h", "other"))
    assert got(rs.resolve_routes(rs.route_facts(links), nodes)) == {("1", "GET", "/a/{}/{}/{}", "h", "n", "name"), ("2", "GET", "/a/{}/{}/{}", "two", None, "ambiguous"), ("3", "GET", "/", "h", "n", "exact")}


def test_confidence_and_inference(spark):
    texts = ['{"evidence":[{"confidence":"exact"},{"confidence":"INFERRED"}]}', '{"evidence":{"confidence":"ambiguous"}}', '{"evidence":"[{\\"confidence\\":\\"exact\\"}]"}', "{}", "{", None]
    df = frame(spark, "k int, t string", *enumerate(texts))
    assert [r.c for r in df.select("k", evidence_confidence(df.t).alias("c")).orderBy("k").collect()] == ["INFERRED", "AMBIGUOUS", "EXTRACTED", None, None, None]
    nodes = frame(spark, "id string, source_file string, confidence string", ("a", "f", None), ("b", "f", None), ("x", None, None), ("lone", None, "EXTRACTED"), ("maybe", "f", "INFERRED"))
    edges = frame(spark, "eid string, src string, dst string, confidence string, qualified_external boolean", ("1", "a", "b", "EXTRACTED", False), ("2", "a", "b", "INFERRED", False), ("3", "a", "x", "INFERRED", True), ("4", "a", "b", "AMBIGUOUS", False), ("5", "a", "b", None, False))
    level = {k: cl.inference_level(PropertyGraph(nodes, edges), k) for k in cl.LEVELS}
    assert {k: {r.eid for r in g.edges.collect()} for k, g in level.items()} == {"low": {"1"}, "medium": {"1", "2"}, "high": {"1", "2", "3"}, "max": {"1", "2", "3", "4", "5"}}
    assert {k: {r.id for r in g.nodes.collect()} for k, g in level.items()} == {"low": {"a", "b", "lone"}, "medium": {"a", "b", "lone", "maybe"}, "high": {"a", "b", "x", "lone", "maybe"}, "max": {"a", "b", "x", "lone", "maybe"}}


def test_compare(spark):
    f = lambda *rows: spark.createDataFrame([dict(symbol_id=s, language="go", visibility=v, execution_mode="sync", return_type=None, complete=True, body_digest=b, parameters=[], operations=[]) for s, v, b in rows], hi.FUNCTION_SCHEMA)
    ops = lambda *rows: frame(spark, "symbol_id string, kind string, path string", *rows)
    old, new = f(("gone", "public", "1"), ("kept", "public", "1"), ("acts", "public", "1"), ("mute", "private", "1")), f(("kept", "private", "1"), ("acts", "public", "2"), ("mute", "private", "2"), ("fresh", "public", "1"))
    before, after = ops(("acts", "read", "t"), ("user", "call", "acts"), ("top", "call", "user"), ("acts", "call", "user")), ops(("acts", "write", "t"), ("user", "call", "acts"), ("user", "dependency", "m"))
    rows = {(r.symbol_id, r.finding): (r.compatibility, r.consumers, r.tested, r.priority) for r in cm.compare(old, new, before, after, frame(spark, "symbol_id string", ("acts",), ("acts",))).collect()}
    gap = ("not_applicable", 0, False, 300)
    assert rows == {
        ("gone", "contract"): ("proven_break", 0, False, 1000), ("kept", "contract"): ("proven_break", 0, False, 1000), ("acts", "behavior"): ("behavioral", 2, True, 902), ("mute", "behavior"): ("indeterminate", 0, False, 900), ("fresh", "structural"): ("compatible", 0, False, 200),
        ("user", "dependency"): ("compatible", 2, False, 752), ("gone", "verification_gap"): gap, ("kept", "verification_gap"): gap, ("mute", "verification_gap"): gap, ("fresh", "verification_gap"): gap, ("user", "verification_gap"): ("not_applicable", 2, False, 302),
    }
    findings = cm.compare(old, new, before, after, frame(spark, "symbol_id string"))
    log = json.loads("".join(r.line for r in cm.sarif(findings, frame(spark, "symbol_id string, source_file string, start_line int", ("gone", "a.go", 0))).orderBy("ord", "key").collect()))
    results = log["runs"][0]["results"]
    assert len(results) == findings.count() and {r["level"] for r in results} == {"error", "warning", "note"} and sum("locations" in r for r in results) == 2
    assert [r.line for r in cm.review_lines(findings, True).where("ord = 1").orderBy("key").limit(1).collect()] == ["- `gone` contract (proven_break, 0 consumers, untested)"]
    none = f().limit(0)
    assert cm.compare(none, none, ops(), ops(), frame(spark, "symbol_id string")).count() == 0
