"""Results that bounds on depth, length or number used to cut."""

from nodeloom.graph import CONFIDENCE, PropertyGraph, code_graph, evidence_graph
from nodeloom.operators import analytics as an
from nodeloom.operators import traverse as tr
from nodeloom.plans import reviews, structure, text_history
from nodeloom.sources import sinks as sk


def graph(spark, edges, communities=None):
    ids = sorted({x for e in edges for x in e[:2]})
    n = spark.createDataFrame([(i, "Function", i, f"src/{i}.py", (communities or {}).get(i)) for i in ids], "id string, label string, node_label string, source_file string, community_id int")
    e = spark.createDataFrame([(f"e{k:04}", a, b, t) for k, (a, b, t) in enumerate(edges)], "eid string, src string, dst string, type string")
    return PropertyGraph(n, e, closed=True)


def test_blind_spots_of_busy_nodes(spark):
    """Nodes beside 9 and 32 dense communities relate them, one beside 33 does not; thin and small ones do not count."""
    member = {f"c{k:02}{m}": k for k in range(35) for m in range(4 if k < 34 else 3)}
    ring = [(f"c{k:02}{m}", f"c{k:02}{(m + 1) % 4}", "CALLS") for k in range(33) for m in range(4)] + [(f"c34{m}", f"c34{(m + 1) % 3}", "CALLS") for m in range(3)] + [("c330", "c331", "CALLS")]
    beside = [(x, f"c{k:02}0", "CALLS") for x, n in (("x", 9), ("y", 32), ("z", 33)) for k in range(n)] + [("w", "c330", "CALLS"), ("w", "c340", "CALLS"), ("w", "c000", "CALLS")]
    direct = [("c000", "c010", "CALLS"), ("c001", "c010", "CALLS"), ("c002", "c010", "CONTAINS")]
    got = {(r.left, r.right): (r.proximity, r.direct, r.score) for r in an.blind_spots(graph(spark, ring + beside + direct, member)).collect()}
    want = {}
    for n in (9, 32):
        for a in range(n):
            for b in range(a + 1, n):
                want[a, b] = want.get((a, b), 0) + n**-0.5
    # the direct links between the first two communities also put their ends beside both
    degree = {"c000": 2 + 3 + 1 + 1, "c001": 2 + 1, "c010": 2 + 3 + 3}
    want[0, 1] += sum(degree[i] ** -0.5 for i in degree)
    assert got.keys() == want.keys()
    for p, w in want.items():
        d = 2 if p == (0, 1) else 0
        assert abs(got[p][0] - w) < 1e-5 and got[p][1] == d and abs(got[p][2] - w / (1 + d)) < 1e-5


def reached(step, root, most=8):
    """Depths of a breadth-first search of the reference's default depth."""
    depth, level = {root: 0}, [root]
    for k in range(1, most + 1):
        level = sorted({y for x in level for y in step.get(x, ()) if y not in depth})
        depth.update(dict.fromkeys(level, k))
    return depth


def test_structural_queries_reach_the_default_depth(spark, data):
    g = code_graph(spark, data)
    edges = [(r.src, r.dst, r.type) for r in g.edges.select("src", "dst", "type").collect()]
    back, out, both = {}, {}, {}
    for a, b, t in edges:
        out.setdefault(a, set()).add(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
        if t in tr.IMPACT_TYPES:
            back.setdefault(b, set()).add(a)
    roots = [r.id for r in g.nodes.where("label = 'Interface'").select("id").collect()]
    want = {(r, n, k) for r in roots for n, k in reached(back, r).items()}
    assert {(r.root, r.node, r.depth) for r in structure.q5_impact(spark, data).collect()} == want and max(k for _, _, k in want) > 3
    firm = {r.eid: r.confidence or "EXTRACTED" for r in evidence_graph(spark, data).edges.collect()}
    least = {}
    for r in sorted(g.edges.collect(), key=lambda r: r.eid):
        if r.type in tr.IMPACT_TYPES:
            least.setdefault(r.dst, []).append((r.eid, r.src))
    weak = {}
    for root in roots:
        level = {root: 0}
        known = dict(level)
        while level:
            best = {}
            for x in level:
                for eid, y in least.get(x, ()):
                    if y not in known and (y not in best or eid < best[y][0]):
                        best[y] = (eid, max(level[x], CONFIDENCE.index(firm[eid])))
            level = {y: w for y, (_, w) in best.items()}
            known.update(level)
        weak |= {(root, y): CONFIDENCE[w] for y, w in known.items()}
    got = {(r.root, r.node): r.weakest for r in reviews.q9_weakest_links(spark, data).collect()}
    assert got == {k: w for k, w in weak.items() if k in {(r, n) for r, n, d in want if d}} and len(set(got.values())) > 1
    pairs = [tuple(r) for r in structure._pairs(g).collect()]
    assert {tuple(r) for r in structure.q6_explore(spark, data).collect()} == {(a, b, reached(both, a).get(b)) for a, b in pairs}
    hops = {(a, b): reached(out, a).get(b) for a, b in pairs}
    lost = {(a, b) for a, b in pairs if hops[a, b] is None and b in reached(both, a)}
    assert {tuple(r) for r in structure.q7_node_trail(spark, data).collect()} == {(*p, hops[p], "direction_mismatch" if p in lost else None) for p in pairs}


def test_louvain_goes_on_until_no_merge_gains(spark):
    n = 700
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n - 1)], "a string, b string")
    label = {r.id: r.community for r in an.louvain(edges).collect()}
    assert len(label) == n
    total, links, degree = 2 * (n - 1), {}, {}
    for i in range(n - 1):
        a, b = label[f"{i:03}"], label[f"{i + 1:03}"]
        links[a, b] = links.get((a, b), 0) + 1
        for c in (a, b):
            degree[c] = degree.get(c, 0) + 1
    for (a, b), w in links.items():
        if a != b:
            assert 2 * w / total - 2 * degree[a] * degree[b] / total**2 <= 1e-3


def test_import_cycles_of_five_files(spark):
    ring = lambda p, n: [(f"{p}{i}", f"{p}{(i + 1) % n}") for i in range(n)]
    e = spark.createDataFrame(ring("a", 4) + ring("b", 5) + ring("c", 6), "src string, dst string")
    assert {(r.cycle, r.length) for r in an.import_cycles(e).collect()} == {("a0 -> a1 -> a2 -> a3", 4), ("b0 -> b1 -> b2 -> b3 -> b4", 5)}


def test_garbage_keeps_far_ancestors(spark):
    n = 67
    v = spark.createDataFrame([(f"{i:02}", f"{i - 1:02}" if i else None) for i in range(n)] + [("lost", None)], "version string, parent string")
    kept = spark.createDataFrame([(f"{n - 1}",)], "version string")
    assert [r.version for r in sk.garbage(v, kept).collect()] == ["lost"]


def test_invalidated_has_far_callers(spark, monkeypatch):
    links = spark.createDataFrame([(f"{i + 1:02}", f"{i:02}", "calls") for i in range(11)], "source string, target string, kind string")
    monkeypatch.setattr(text_history, "table", lambda *a: links)
    monkeypatch.setattr(text_history.hi, "structural_changes", lambda *a: spark.createDataFrame([("00",)], "id string"))
    assert {tuple(r) for r in text_history.sd4_invalidated(spark, "").collect()} == {(f"{i:02}", i) for i in range(12)}


def test_edge_betweenness_from_all_nodes(spark, monkeypatch):
    n = 10
    g = graph(spark, [(f"{i:02}", f"{i + 1:02}", "CALLS") for i in range(n - 1)])
    want = {(f"{i:02}", f"{i + 1:02}"): round(2.0 * (i + 1) * (n - 1 - i) / (n * (n - 1)), 12) for i in range(n - 1)}
    assert {(r.a, r.b): r.score for r in an.edge_betweenness(an.simple_edges(g), 5).collect()} == want
    monkeypatch.setattr(structure, "code_graph", lambda *a: g)
    assert {(r.a, r.b): r.score for r in structure.an14_edge_betweenness(spark, "").collect()} == want
    assert {r.id: r.score for r in structure.an13_betweenness(spark, "").collect() if r.score} == {f"{i:02}": round(2.0 * i * (n - 1 - i) / ((n - 1) * (n - 2)), 12) for i in range(1, n - 1)}
    few = {r.id: r.score for r in an.node_betweenness(an.simple_edges(g), exact=5, sources=4).collect()}
    assert len(few) == n and few["00"] == 0 and 0 < max(few.values()) <= 1


def test_trails_from_both_ends(spark):
    """Shortest paths of many pairs at once, through hubs, against a breadth-first search of each."""
    import random

    rng = random.Random(3)
    n = 60
    edges = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(90)} | {("hub", f"n{i:02}") for i in range(0, n, 3)} | {(f"n{i:02}", "hub") for i in range(1, n, 7)} | {(f"c{i}", f"c{i + 1}") for i in range(12)}
    g = graph(spark, [(a, b, "CALLS") for a, b in sorted(edges)])
    ids = sorted({x for e in edges for x in e})
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [("c0", "c8"), ("c0", "c9"), ("c3", "c3"), ("n00", "nowhere"), ("c5", "c1")]
    frame = spark.createDataFrame([*pairs, ("c0", None)], "a string, b string")
    for direction in ("out", "both"):
        step = {}
        for a, b in edges:
            step.setdefault(a, set()).add(b)
            if direction == "both":
                step.setdefault(b, set()).add(a)
        got = {(r.a, r.b): (r.hops, r.path) for r in tr.trails(g, frame, direction=direction).collect()}
        assert got.keys() == set(pairs)
        for (a, b), (hops, path) in got.items():
            assert hops == reached(step, a).get(b), (a, b)
            assert path is None if hops is None else (path[0], path[-1], len(path)) == (a, b, hops + 1) and all(y in step[x] for x, y in zip(path, path[1:]))


def test_louvain_in_few_jobs_and_in_blocks(spark):
    """One task clusters what it can hold; blocks lose no node and find as good communities."""
    inner = [(f"{g:02}{i}", f"{g:02}{j}") for g in range(30) for i in range(6) for j in range(i)]
    edges = spark.createDataFrame([(min(e), max(e)) for e in inner + [(f"{g:02}0", f"{(g + 1) % 30:02}1") for g in range(30)]], "a string, b string")
    spark.sparkContext.setJobGroup("louvain", "")
    one = {r.id: r.community for r in an.louvain(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 30
    many = an.louvain(edges, held=100)
    assert {r.id for r in many.collect()} == set(one) and all(one[c] == c for c in one.values())
    quality = [an.modularity(edges, m).first()[0] for m in (spark.createDataFrame(list(one.items()), "id string, community string"), many)]
    assert min(quality) > 0.85


def test_betweenness_of_held_graphs_in_few_jobs(spark):
    """Tasks that hold the graph find what joins in blocks of sources find."""
    edges = spark.createDataFrame([(f"{i:02}", f"{(i * k + k) % 60:02}") for i in range(60) for k in (1, 7) if i < (i * k + k) % 60] + [("p", "q")], "a string, b string")
    for f, few in ((an.edge_betweenness, {"block": 30}), (an.node_betweenness, {"rows": 2000}), (lambda *a, **k: an.node_betweenness(*a, exact=5, sources=7, **k), {"rows": 100})):
        spark.sparkContext.setJobGroup("paths", "")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("paths"))
        held = [tuple(r) for r in f(edges).collect()]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("paths")) - before
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs < 25
        joined = {tuple(r[:-1]): r[-1] for r in f(edges, held=0, **few).collect()}
        assert len(held) == len(joined) and all(abs(r[-1] - joined[r[:-1]]) < 1e-11 for r in held)
