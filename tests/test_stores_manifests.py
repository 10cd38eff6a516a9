"""Keyed stores, publications, debounced batches and manifest readers."""

import json
import os
from datetime import datetime, timedelta

import pytest

from nodeloom.sources import graph_artifact, manifests, sinks, store
from nodeloom.streaming import debounced, reconcile

SCHEMA = "id string, v int, at int"
T0 = datetime(2025, 1, 1)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def seen(s):
    return {r.id: (r.v, r.at) for r in s.table().collect()}


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}"
    open_ = lambda **k: store.KeyedStore.open(spark, root, rows(spark).schema, "id", buckets=8, **k)
    first = open_()
    assert first.version == 0 and first.table().count() == 0
    one = first.merge(rows(spark, *[(f"k{i}", i, 1) for i in range(40)], (None, 0, 0)), "at", expected=0, note="a")
    files = {p: os.stat(p).st_mtime_ns for d, _, fs in os.walk(tmp_path) for p in (os.path.join(d, f) for f in fs)}
    two = one.merge(rows(spark, ("k1", 100, 2), ("k1", 99, 1), ("k2", 0, 0)), "at")
    assert seen(two) == {f"k{i}": (i, 1) for i in range(40)} | {"k1": (100, 2)}
    assert all(os.stat(p).st_mtime_ns == t for p, t in files.items()) and sum(one.state["files"][b] != r for b, r in two.state["files"].items()) <= 2
    three = two.delete(rows(spark, ("k1", 0, 0), ("none", 0, 0))).put(rows(spark, ("k3", 7, 7), ("new", 1, None)))
    assert seen(three) == {f"k{i}": (i, 1) for i in range(40) if i != 1} | {"k3": (7, 7), "new": (1, None)}
    assert {r.id for r in three.get(rows(spark, ("k3", 0, 0), ("zz", 0, 0))).collect()} == {"k3"}
    # older versions stay readable; stale writers are refused
    assert seen(open_(version=1)) == seen(one) and open_().version == 4 and open_(version=1).state["note"] == "a"
    with pytest.raises(store.Conflict):
        one.put(rows(spark, ("x", 1, 1)))
    with pytest.raises(store.Conflict):
        three.put(rows(spark, ("x", 1, 1)), expected=2)
    with pytest.raises(ValueError, match="twice"):
        three.put(rows(spark, ("x", 1, 1), ("x", 2, 1)))
    with pytest.raises(KeyError):
        open_(version=9)
    (tmp_path / "manifest-000000000077.json").write_text("{")
    assert open_().version == 4
    os.remove(tmp_path / "manifest-000000000077.json")
    assert open_().vacuum() and seen(open_()) == seen(three)


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert sinks.published(spark, root) is None
    sinks.prepare(spark.range(2).toDF("x"), root, "1")
    assert sinks.published(spark, root) is None
    sinks.commit(spark, root, "1")
    sinks.publish(spark.range(3).toDF("x"), root, "2", expected="1")
    sinks.prepare(spark.range(4).toDF("x"), root, "3")
    with pytest.raises(store.Conflict):
        sinks.commit(spark, root, "3", expected="1")
    with pytest.raises(KeyError):
        sinks.commit(spark, root, "9")
    (tmp_path / "pointer-000000003.json").write_text("")  # a writer lost half-way
    assert sinks.published(spark, root) == "2" and sinks.current(spark, root).count() == 3
    sinks.commit(spark, root, "3", expected="2")
    assert sinks.current(spark, root).count() == 4


def test_debounced(spark):
    at = lambda *secs: [("a", T0 + timedelta(seconds=s)) for s in secs]
    df = spark.createDataFrame([*at(0, 0.5, 0.9, 5, *(10 + 0.9 * i for i in range(8))), ("b", T0), ("b", None)], "k string, ts timestamp_ntz")
    got = sorted((r.k, (r.first - T0).total_seconds(), r.n) for r in debounced(df, "ts", "k", 1_000_000).collect())
    # a burst that never rests is cut after five windows
    assert got == [("a", 0.0, 3), ("a", 5.0, 1), ("a", 10.0, 6), ("a", 15.4, 2), ("b", 0.0, 1)]
    assert debounced(df.limit(0), "ts", "k", 1_000_000).count() == 0


def test_reconcile(spark):
    a = rows(spark, ("same", 1, None), ("old", 1, 1), ("turned", 1, None))
    b = rows(spark, ("same", 1, None), ("new", 1, 1), ("turned", None, 1))
    assert {tuple(r) for r in reconcile(a, b, "id", ["v", "at"]).collect()} == {("old", "remove"), ("new", "add"), ("turned", "update")}


def test_manifests(spark):
    d = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = manifests.package_dependencies(d('{"name":"p","dependencies":{"a":"1"},"devDependencies":{"b":"^2"}}', "{", None, "[]", '{"dependencies":3}'), "k", "t")
    assert {tuple(r) for r in got.collect()} == {(0, "p", "dependencies", "a", "1"), (0, "p", "devDependencies", "b", "^2")}
    got = manifests.mcp_servers(d('{"mcpServers":{"s":{"command":"run","args":["x","y"],"env":{"KEY":"no"}},"u":{"url":"http://h"}}}', "no"), "k", "t")
    assert {tuple(r) for r in got.collect()} == {(0, "s", "run", None, 2), (0, "u", None, "http://h", 0)}
    got = manifests.dotnet_references(d('<Project><PackageReference Include="N.J" Version="13" />\n<projectreference include="..\\x.csproj"/></Project>'), "k", "t")
    assert {tuple(r) for r in got.collect()} == {(0, "package", "N.J", "13"), (0, "project", "..\\x.csproj", None)}
    hcl = '# resource "c" "c" {\nresource "aws_s3" "logs" {\n  name = var.name\n  x = data.aws_ami.this.id\n}\n/* variable "gone" { */\nvariable "name" {}\nmodule "m" {\n}\n'
    assert [(r.kind, r.type, r.name) for r in manifests.terraform_blocks(d(hcl), "k", "t").orderBy("pos").collect()] == [("resource", "aws_s3", "logs"), ("variable", None, "name"), ("module", None, "m")]
    assert {(r.kind, r.name) for r in manifests.terraform_references(d(hcl), "k", "t").collect()} == {("var", "name"), ("data", "aws_ami.this")}
    index = {"documents": [{"relativePath": "a.rs", "occurrences": [{"range": [1, 2, 5], "symbol": "s", "symbolRoles": 1}, {"range": [1, 2, 3, 4], "symbol": "t"}, {"range": [1], "symbol": "u"}]}]}
    assert {tuple(r) for r in manifests.scip_occurrences(d(json.dumps(index), "x"), "t").collect()} == {("a.rs", "s", "definition", 1, 2, 1, 5), ("a.rs", "t", "reference", 1, 2, 3, 4)}
    toml = spark.createDataFrame([("a", '[package]\nname="a"\n[dependencies]\nb={path="../b"}\nserde="1"\n[dev-dependencies]\nx={package="c"}'), ("b", '[package]\nname="b"'), ("c", '[package]\nname="c"'), ("w", "[workspace]"), ("bad", "["), ("n", None)], "path string, text string")
    assert {tuple(r) for r in manifests.cargo_workspace(toml).collect()} == {("a", "b", "normal"), ("a", "c", "dev")}
    one, two = "1" * 40, "2" * 40
    log = f"{two}|{one} {one}|me|17|fix: a | b\n\nx.py\ny.py\n\n{one}||you|bad|start\n"
    got = {(r.commit[0], r.parent and r.parent[0], r.at, r.subject, r.path) for r in manifests.git_log(d(log, "", None), "k", "t").collect()}
    assert got == {("2", "1", 17, "fix: a | b", "x.py"), ("2", "1", 17, "fix: a | b", "y.py"), ("1", None, None, "start", None)}


def test_bounded_artifact(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"nodes": [{"id": "a", "kind": "function"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "calls"}]}))
    g, files = graph_artifact(spark, str(path))
    assert g.edges.count() == 1 and files.first().bytes == path.stat().st_size
    with pytest.raises(ValueError, match="more than 10"):
        graph_artifact(spark, str(path), 10)
