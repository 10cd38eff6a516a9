import json
import random
from datetime import datetime

import pytest

from nodeloom import history as hi
from nodeloom import sources as so
from nodeloom.graph import PropertyGraph
from nodeloom.operators import analytics as an
from nodeloom.operators import cleaning as cl
from nodeloom.operators import traverse as tr
from nodeloom.sources import sinks as sk
from nodeloom.streaming import Ingest, retry_delay, watch
from nodeloom.text import tokens as tk


def make(spark, edges, labels=None):
    ids = sorted({x for e in edges for x in e[:2]})
    labels = labels or {}
    n = spark.createDataFrame([(i, labels.get(i, "Function"), i, f"src/{i}.py", "function", None) for i in ids], "id string, label string, node_label string, source_file string, kind string, community_id int")
    e = spark.createDataFrame([(f"e{k:03}", a, b, t) for k, (a, b, t) in enumerate(edges)], "eid string, src string, dst string, type string")
    return PropertyGraph(n, e, closed=True)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a string, b string")


def test_components_random(spark):
    import random

    rng = random.Random(2)
    rows = [(f"{rng.randrange(300):03}", f"{rng.randrange(300):03}") for _ in range(180)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(100)] + [(None, "x"), ("s", "s")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {(r.id, r.component) for r in an.components(pairs(spark, rows)).collect()}
    assert got == {(x, find(x)) for x in root}


def test_cycles(spark):
    g = make(spark, [("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"), ("c", "d", "X"), ("d", "e", "X"), ("e", "d", "X"), ("f", "f", "X"), ("e", "g", "X"), ("z", "a", "X")])
    got = {(r.src, r.dst) for r in an.cycle_edges(g.edges).collect()}
    assert got == {("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "f")}
    assert {(r.cycle, r.length) for r in an.import_cycles(g.edges.select("src", "dst")).collect()} == {("a -> b -> c", 3), ("d -> e", 2), ("f", 1)}


def brandes(edges, sources):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    score = dict.fromkeys(adj, 0.0)
    for s in sources:
        order, dist, paths = [s], {s: 0}, {s: 1}
        for v in order:
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                    paths[w] = 0
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        d = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    d[v] += paths[v] / paths[w] * (1 + d[w])
            if w != s:
                score[w] += d[w]
    return score


def test_betweenness(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("a", "e"), ("e", "f")]
    ids = sorted({x for e in edges for x in e})
    node, edge = an.betweenness(pairs(spark, edges), spark.createDataFrame([(i,) for i in ids], "id string"))
    got = {r.id: r.score for r in node.collect()}
    for k, v in brandes(edges, ids).items():
        assert abs(got.get(k, 0.0) - v) < 1e-5
    assert edge.count() == len(edges)


def test_louvain_finds_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(6) for j in range(i)] + [("x0", "y0"), ("y1", "z1")]
    got = an.louvain(pairs(spark, [(min(e), max(e)) for e in edges])).collect()
    assert {frozenset(r.id for r in got if r.community == c) for c in {r.community for r in got}} == {frozenset(f"{g}{i}" for i in range(6)) for g in "xyz"}


def test_remap_is_greedy(spark):
    rng = random.Random(4)
    new = [(f"n{i:03}", rng.randrange(12)) for i in range(200)]
    old = [(i, rng.randrange(9) * 2) for i, _ in new[:150]]
    was, overlap = dict(old), {}
    for i, c in new:
        if i in was:
            overlap[was[i], c] = overlap.get((was[i], c), 0) + 1
    want = {}
    for o, c in sorted(overlap, key=lambda x: (-overlap[x], *x)):
        if o not in want.values() and c not in want:
            want[c] = o
    members = {}
    for i, c in new:
        members.setdefault(c, []).append(i)
    free = (k for k in range(999) if k not in set(want.values()))
    for c in sorted(set(members) - set(want), key=lambda c: (-len(members[c]), min(members[c]))):
        want[c] = next(free)
    frames = (spark.createDataFrame(x, "id string, community int") for x in (new, old))
    assert {r.community: r.stable_id for r in an.remap_communities(*frames).collect()} == want


def test_pages_never_exceed_their_capacity(spark):
    rng = random.Random(6)
    rows = [(f"g{rng.randrange(5)}", f"{i:04}", rng.choice((None, 0, 1, 7, 30, 61, 200)), "clash") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k string, n int, page string")
    got = tr.greedy_cuts(df, 60, "g", "k", "n", separator=1).collect()
    assert len(got) == 600
    pages, order = {}, {}
    for r in sorted(got, key=lambda r: (r.g, r.k)):
        pages.setdefault((r.g, r.page), []).append(r.n or 0)
        order.setdefault(r.g, []).append(r.page)
    room = lambda p: sum(p) + len(p) - 1
    assert all(len(p) == 1 or room(p) <= 60 for p in pages.values())
    assert all(o == sorted(o) and set(o) == set(range(o[-1] + 1)) for o in order.values())
    for g, page in pages:
        if page:
            assert room(pages[g, page - 1]) + 1 + pages[g, page][0] > 60
    assert tr.greedy_cuts(df.limit(0), 60, "g", "k", "n").count() == 0


def test_remap_and_modularity(spark):
    new = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "id string, community int")
    old = spark.createDataFrame([("a", 7), ("b", 7), ("c", 3)], "id string, community int")
    assert {(r.community, r.stable_id) for r in an.remap_communities(new, old).collect()} == {(0, 7), (1, 3), (2, 0)}
    assert an.modularity(pairs(spark, [("a", "b"), ("c", "d")]), spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "id string, community int")).first()[0] == 0.5


def test_traversal(spark):
    g = make(spark, [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("x", "b", "IMPORTS"), ("k", "a", "CONTAINS"), ("c", "a", "CALLS"), ("h", "a", "ROUTES_TO")])
    seeds = spark.createDataFrame([("c", "c"), (None, None)], "root string, node string")
    assert {(r.node, r.depth) for r in tr.impact(g, seeds, 8).collect()} == {("c", 0), ("b", 1), ("a", 2), ("x", 2), ("h", 3)}
    seed_k = spark.createDataFrame([("k", "k")], "root string, node string")
    assert {(r.node, r.depth) for r in tr.affected(g, seed_k, 1).collect()} == {("k", 0), ("a", 0), ("c", 1)}
    t = {(r.a, r.b): (r.hops, r.path, r.diagnostic) for r in tr.node_trail(g, pairs(spark, [("a", "c"), ("c", "x"), ("a", "zz")])).collect()}
    assert t == {("a", "c"): (2, ["a", "b", "c"], None), ("c", "x"): (None, None, "direction_mismatch"), ("a", "zz"): (None, None, None)}
    names = spark.createDataFrame([("a",), ("A()",), ("nope",)], "symbol string")
    assert {(r.symbol, r.id, r.how) for r in tr.resolve_symbol(g.nodes, names).collect()} == {("a", "a", "id"), ("A()", "a", "name"), ("nope", None, "unknown")}


def test_cleaning(spark):
    calls = spark.createDataFrame([("1", "f", "r", "src/a/x.py"), ("2", "g", "r", "src/a/x.py"), ("3", "h", "r", "src/a/x.py"), ("4", "q", "r", None), ("5", "m", "r", "src/a/x.py")], "call_id string, name string, scope string, file string")
    defs = spark.createDataFrame([("f1", "f", "r", "src/b.py"), ("g1", "g", "r", "src/b.py"), ("g2", "g", "r", "tests/b.py"), ("h1", "h", "r", "src/a/y.py"), ("h2", "h", "r", "lib/y.py"), ("m1", "m", "r", "lib/1.py"), ("m2", "m", "r", "lib/2.py")], "id string, name string, scope string, file string")
    assert {tuple(r) for r in cl.resolve_names(calls, defs).collect()} == {("1", "f1", "unique"), ("2", "g1", "not_test"), ("3", "h1", "nearest"), ("4", None, "unknown"), ("5", None, "ambiguous")}
    e = spark.createDataFrame([("1", "a", "b", "CALLS"), ("2", "a", "b", "USES"), ("3", "c", "c", "USES")], "eid string, src string, dst string, type string")
    remap = spark.createDataFrame([("b", "a")], "id string, winner string")
    assert {r.eid for r in cl.rewire(e, remap).collect()} == {"1", "3"}
    long = "configuration manager for the distributed worker pool registry of modules"
    typo, numbered = long.replace("distributed", "distribated"), long.replace("pool", "pool 2")
    n = spark.createDataFrame([(x,) for x in (long, long.upper(), typo, numbered, "unrelated thing here", "aaaa")], "node_label string")
    rows = cl.fuzzy_names(n).collect()
    got = {r.name: r.class_name for r in rows}
    assert len(rows) == len(got) == 4 and got[long] == got[typo] != got[numbered] and "aaaa" not in got


def test_string_metrics():
    assert round(tk.jaro("martha", "marhta"), 4) == 0.9444 and round(tk.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert tk.damerau_levenshtein("ca", "abc") == 2 and tk.damerau_levenshtein("abcd", "acbd") == 1 and tk.jaro("", "a") == 0.0


def test_tokens(spark):
    df = spark.createDataFrame([("parseHTTPResponse_v2 naïve",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(tk.identifier_tokens(tk.strip_diacritics("t"))).collect()]
    assert got[0] == ["parse", "http", "response_v2", "naive"] and got[2] == []
    forms = {"resolving": "resolve", "queries": "query", "classes": "class", "boxes": "box", "tokens": "token", "status": "status", "stopping": "stop", "caching": "cach", "updated": "update", "tried": "try", "naïves": "naïves", "red": "red"}
    words = spark.createDataFrame([(k,) for k in forms], "w string")
    assert {r.w: r.s for r in words.select("w", tk.canonical_token(words.w).alias("s")).collect()} == forms


FN = {"language": "rust", "visibility": "public", "execution_mode": "sync", "return_type": "u8", "complete": True, "body_digest": "1", "parameters": [("x", "value", True, None)], "operations": [("call", "f", ["s.f"]), ("call", "g", []), ("read", "p", None)]}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, None), ({"visibility": "private"}, "proven_break"), ({"execution_mode": "async"}, "proven_break"), ({"parameters": []}, "proven_break"),
        ({"parameters": [("x", "value", True, None), ("y", "value", True, None)]}, "proven_break"), ({"parameters": [("x", "value", True, None), ("y", "value", False, None)]}, "compatible"),
        ({"return_type": None}, "possible_break"), ({"parameters": [("x", "value", True, "d")]}, "behavioral"), ({"parameters": [("z", "value", True, None)]}, "compatible"),
        ({"parameters": [], "complete": False}, "possible_break"),
    ],
)
def test_contracts(spark, change, want):
    f = lambda d: spark.createDataFrame([{"symbol_id": "s", **FN, **d}], hi.FUNCTION_SCHEMA)
    got = [r.compatibility for r in hi.contract_changes(f({}), f(change)).collect()]
    assert got == ([want] if want else [])


def test_summaries_and_behavior(spark):
    f = lambda **d: spark.createDataFrame([{"symbol_id": "s", **FN, **d}], hi.FUNCTION_SCHEMA)
    s = hi.function_summaries(f()).first()
    assert (s.resolved, s.unresolved, s.reads, s.writes) == (["s.f"], ["g"], ["p"], [])
    assert [tuple(r) for r in hi.reverse_calls(hi.function_summaries(f())).collect()] == [("s.f", "s")]
    new = f(body_digest="2", operations=[("call", "f", ["s.f"]), ("write", "w", None)])
    assert [tuple(r) for r in hi.behavior_changes(f(), new).collect()] == [("s", "changed", ["write:w"], ["read:p"])]
    assert [r.verdict for r in hi.behavior_changes(f(), f(body_digest="2")).collect()] == ["indeterminate"]


def test_risk_and_priority(spark):
    rows = [("a", "public_contract_change", 5), ("a", "cycle", 1), ("a", "verification_gap", 9), ("b", "affected_consumer", 2), ("c", "merge_conflict", 1)]
    got = {r.v: (r.score, r.band) for r in hi.risk(spark.createDataFrame(rows, "v string, factor string, n int"), "v").collect()}
    assert got == {"a": (96, "critical"), "b": (8, "low"), "c": (30, "moderate")}


def test_graph_document_round_trip(spark, tmp_path):
    doc = {"directed": True, "multigraph": True, "nodes": [{"id": "a", "label": "a()", "file_type": "function", "source_file": "a.rs"}, {"id": "b", "label": "B", "kind": "database_table"}, {"id": None}], "links": [{"source": "a", "target": "b", "relation": "calls"}, {"source": "a", "target": "gone", "relation": "calls"}]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(doc))
    g = so.open_graph(spark, str(path))
    assert {(r.id, r.label) for r in g.nodes.collect()} == {("a", "Function"), ("b", "Database_table")}
    assert [(r.src, r.dst, r.type, r.confidence) for r in g.edges.collect()] == [("a", "b", "CALLS", "EXTRACTED")]
    sk.save_graph(g, str(tmp_path / "saved"))
    assert so.open_graph(spark, str(tmp_path / "saved")).edges.count() == 1
    sk.write_lines(sk.graphml(g), str(tmp_path / "xml"))
    import xml.dom.minidom

    text = "".join(p.read_text() for p in sorted((tmp_path / "xml").glob("part-*")))
    assert len(xml.dom.minidom.parseString(text).getElementsByTagName("node")) == 2
    assert sk.aligned([(1, None)], ["id", "x"]) == "id | x\n---+--\n1  |"


def test_versions_and_garbage(spark, tmp_path):
    root = str(tmp_path / "v")
    sk.publish(spark.range(2).toDF("x"), root, "1")
    sk.publish(spark.range(3).toDF("x"), root, "2")
    assert sk.current(spark, root).count() == 3
    v = spark.createDataFrame([("1", None), ("2", "1"), ("3", None)], "version string, parent string")
    assert [r.version for r in sk.garbage(v, spark.createDataFrame([("2",)], "version string")).collect()] == ["3"]


def test_extractors(spark, tmp_path):
    t = spark.createDataFrame([(1, "# A\r\n[x](y.md) `sym`\n```rust\nCREATE TABLE IF NOT EXISTS db.users (id int); create unique index i on t(x)"), (2, None)], "k int, t string")
    assert {(r.part, r.value) for r in so.markdown_parts(t, "k", "t").collect()} == {("heading", "# A"), ("link", "y.md"), ("symbol", "sym"), ("code", "rust")}
    assert {(r.kind, r.name) for r in so.sql_objects(t, "k", "t").collect()} == {("database_table", "db.users"), ("database_index", "i")}
    html = spark.createDataFrame([(1, "<p><A class='q' HREF=\"u?x=1\">t</A>")], "k int, h string")
    assert [r.href for r in so.html_links(html, "k", "h").collect()] == ["u?x=1"]
    files = spark.createDataFrame([("m.py", "import os\nclass A:\n  def f(self):\n    g(1)\n"), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    facts = {(r.path, r.kind, r.name, r.parent) for r in so.python_facts(files).collect()}
    assert {("m.py", "import", "os", None), ("m.py", "class", "A", None), ("m.py", "function", "f", "A"), ("m.py", "call", "g", "f"), ("bad.py", "error", None, None), ("none.py", "module", "none.py", None)} == facts - {("m.py", "module", "m.py", None)}
    j = spark.createDataFrame([('{"a": "//x", /* c */ "b": [1, 2,], // d\n}',)], "j string")
    assert json.loads(j.select(so.jsonc(j.j)).first()[0]) == {"a": "//x", "b": [1, 2]}
    (tmp_path / "f.py").write_text("x")
    assert [(r.size, r.lang) for r in so.discover_files(spark, str(tmp_path), "*.py").collect()] == [(1, "python")]


def test_ingestion_replays_and_neutral_changes(spark, tmp_path):
    schema = "id string, v string, at timestamp_ntz, gone timestamp_ntz"
    from pyspark.sql import types as T

    typed = T._parse_datatype_string(schema)
    day = lambda d: datetime(2025, 1, d)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    job = Ingest(spark, str(tmp_path / "out"), typed, "id", "at", "gone", ["v", "gone"], on_batch=lambda df, k: seen.append((k, df.count())))
    run = lambda: job.start(watch(spark, str(tmp_path / "in"), typed)).awaitTermination()
    put([("a", "1", day(2), None), ("a", "0", day(1), None), ("b", "1", day(1), None), (None, "x", day(1), None)])
    run()
    put([("a", "1", day(3), None), ("b", "2", day(2), None), ("c", None, day(1), day(1))])
    run()
    assert {(r.id, r.v) for r in job.state().collect()} == {("a", "1"), ("b", "2"), ("c", None)}
    assert seen == [(0, 2), (1, 2)]
    before = job.version()
    job.batch(job.state(), before)
    assert job.version() == before and [retry_delay(n) for n in (0, 1, 3, 6, 99)] == [0, 1, 4, 30, 30]
