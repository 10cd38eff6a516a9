import random

from nodeloom.operators.hierarchy import conflicts, descendants, link_hierarchies, resolve_hierarchy


def brute(edges):
    parent = {}
    for t, v, p in edges:
        if None not in (t, v, p):
            parent[t, v] = min(p, parent.get((t, v), p))
    out = {}
    for t, x in {(t, x) for t, v, p in edges if None not in (t, v, p) for x in (v, p)}:
        path, at = [x], x
        while (t, at) in parent and parent[t, at] not in path:
            at = parent[t, at]
            path.append(at)
        if (t, at) in parent:
            ring = path[path.index(parent[t, at]) :]
            out[t, x] = (min(ring), -1, None)
        else:
            out[t, x] = (at, len(path) - 1, path[::-1])
    return out


def run(spark, edges, paths=True):
    df = spark.createDataFrame(edges, "hierarchy string, node_id string, parent_id string")
    return resolve_hierarchy(df, paths=paths)


def check(spark, edges):
    got = {(r.hierarchy, r.node_id): (r.root_id, r.node_depth, r.path) for r in run(spark, edges).collect()}
    assert got == brute(edges)


def test_random_forests_with_cycles_and_repeats(spark):
    rng = random.Random(5)
    edges = []
    for t in ("x", "y"):
        for i in range(1, 120):
            edges.append((t, f"{i}", f"{rng.randrange(max(0, i - 6), i)}"))
        edges += [(t, f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [(t, "hang", "c3"), (t, "below", "hang"), (t, "self", "self")]
    check(spark, edges + edges[:20])


def test_long_chain_and_hub(spark):
    check(spark, [("t", f"{i:03}", f"{i - 1:03}") for i in range(1, 90)] + [("t", f"leaf{i}", "000") for i in range(200)])


def test_nulls_empty_ids_and_several_parents(spark):
    check(spark, [("t", None, "a"), ("t", "a", None), (None, "a", "b"), ("t", "", "r"), ("t", "k", ""), ("t", "m", "z"), ("t", "m", "b")])


def test_empty_and_clashing_columns(spark):
    assert run(spark, []).count() == 0
    df = spark.createDataFrame([("t", "b", "a", "x", 1)], "hierarchy string, node_id string, parent_id string, v string, w int")
    assert resolve_hierarchy(df).count() == 2


def test_descendants_and_kinds(spark):
    links = spark.createDataFrame([("a", "b", " Contains"), ("c", "d", "EXTENDS"), ("a", None, "contains"), ("a", "q", "calls")], "source string, target string, kind string")
    assert {tuple(r) for r in link_hierarchies(links).collect()} == {("contains", "b", "a"), ("extends", "c", "d")}
    got = {tuple(r) for r in descendants(run(spark, [("t", "b", "a"), ("t", "c", "b")])).collect()}
    assert got == {("t", "a", "b", 1), ("t", "a", "c", 2), ("t", "b", "c", 1)}


def test_conflicts(spark):
    edges = [("t", "m", "z"), ("t", "m", "b"), ("t", "m", "b"), ("t", "m", "k"), ("u", "m", "a"), ("t", "n", "a"), ("t", None, "a"), ("t", "n", None)]
    df = spark.createDataFrame(edges, "hierarchy string, node_id string, parent_id string")
    assert {tuple(r) for r in conflicts(df).collect()} == {("t", "m", "b", "z"), ("t", "m", "b", "k")}
    assert conflicts(df.limit(0)).count() == 0
