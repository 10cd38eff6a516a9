import json

import pytest
from pyspark.sql import functions as F

from nodeloom.functions.json import canonical_text, decode, write
from nodeloom.operators.nested import _unwrap, flatten, resolution_candidates
from nodeloom.runtime import table

SCHEMA = "owner_table string, owner_id string, attributes string"


def brute(table_name, owner, text):
    def inner(v):
        while isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    out = []

    def walk(o, path):
        o = inner(o)
        if isinstance(o, list):
            for i, x in enumerate(o):
                walk(x, f"{path}[{i}]")
        if not isinstance(o, dict):
            return
        for k, v in o.items():
            v = inner(v)
            here = f"{path}.{k}" if path else k
            if k == "candidates":
                for i, c in enumerate(v if isinstance(v, list) else [v] if isinstance(v, dict) else []):
                    c = inner(c)
                    if isinstance(c, dict):
                        out.append((table_name, owner, path, i, c.get("nodeId") or c.get("node_id")))
                    elif isinstance(c, str):
                        out.append((table_name, owner, path, i, c))
            walk(v, here + "[0]" if isinstance(v, dict) and k in ("evidence", "stages", "mergedFrom", "candidates") else here)

    try:
        walk(json.loads(text), "")
    except (ValueError, TypeError):
        pass
    return out


def test_cases(spark):
    texts = [
        '{"evidence":{"candidates":["a",{"nodeId":"b"},{"node_id":"c"}]}}',
        '{"evidence":[{"x":1},{"resolution":{"state":"s","candidates":{"nodeId":"d"}}}]}',
        '{"evidence":"[{\\"candidates\\":\\"[{\\\\\\"nodeId\\\\\\":\\\\\\"e\\\\\\"}]\\"}]"}',
        '{"candidates":null,"details":{"candidates":3,"data":{"stages":{"candidates":["f"]}}}}',
        '{"mergedFrom":[{"attributes":{"evidence":[{"candidates":[{"nodeId":"g","candidates":["h"]}]}]}}]}',
        '{"c\\u0061ndidates":["escaped \\u00e9"]}', '{"candidates":["cut"', "", None, "[]", '"text"', '{"candidates":[{"reason":"no id"}]}',
    ]
    rows = [("t", f"o{i}", t) for i, t in enumerate(texts)]
    want = sorted({x for r in rows for x in brute(*r)}, key=repr)
    got = sorted((tuple(r) for r in resolution_candidates(spark.createDataFrame(rows + rows[:2], SCHEMA)).collect()), key=repr)
    assert got == want and len(want) == 10


def test_against_brute_force(spark, data):
    rows = [(n, r.id, r.attributes) for n in ("graph_nodes", "graph_links") for r in table(spark, data, n).select("id", "attributes").collect()]
    want = {x for r in rows for x in brute(*r)}
    got = [tuple(r) for r in resolution_candidates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got) == want and len(got) == len(want) and want


def rebuild(bridge, objects):
    """Canonical text of each document, put together from the flat tables alone."""
    bodies = {bytes(r.object_hash): r.body for r in objects}
    held = {}
    for r in bridge:
        held.setdefault((r.owner_table, r.owner_id, bytes(r.document), r.parent), []).append(r)
    out = {}
    for r in bridge:
        if r.parent is not None:
            continue
        doc = (r.owner_table, r.owner_id, bytes(r.document))
        made = {}
        todo = [r]
        while todo:
            top = todo[-1]
            below = sorted(held.get((*doc, top.occurrence), []), key=lambda x: x.occurrence)
            waiting = [x for x in below if x.occurrence not in made]
            if waiting:
                todo.extend(waiting)
                continue
            todo.pop()
            value = decode(bodies[bytes(top.child_hash)])
            for x in below:
                if x.member is None:
                    value.append(made[x.occurrence])
                elif x.listed:
                    value.setdefault(x.member, []).append(made[x.occurrence])
                else:
                    value[x.member] = made[x.occurrence]
            made[top.occurrence] = value
        out[r.owner_id] = write(made[r.occurrence])
    return out


def test_identities_and_occurrences(spark):
    rows = [("t", "1", '{"a":{"x":1,"y":[{"z":2}]},"b":{"y":[{"z":2}],"x":1}}'), ("t", "2", '{"a":[{"z":2},{"z":3}]}')]
    bridge, objects, _ = flatten(spark.createDataFrame(rows, SCHEMA))
    b = bridge.collect()
    assert len({bytes(r.child_hash) for r in b if r.owner_id == "1" and r.member in ("a", "b")}) == 1
    z2 = next(bytes(r.child_hash) for r in b if r.owner_id == "2" and r.idx == 0 and r.member == "a")
    assert sum(bytes(r.child_hash) == z2 for r in b) == 3
    bodies = {bytes(r.object_hash): r.body for r in objects.collect()}
    assert bodies[z2] == '{"z":2e0}' and len(bodies) == 5
    assert {bytes(r.child_hash) for r in b} == set(bodies)


def test_equal_numbers_have_one_identity(spark):
    rows = [("t", str(i), t) for i, t in enumerate(('{"x":1,"y":[100]}', '{ "y":[1e2], "x":1.0 }'))]
    assert flatten(spark.createDataFrame(rows, SCHEMA)).bridge.select("document").distinct().count() == 1


def test_round_trip(spark):
    texts = [
        '{"a":[[{"x":1}]]}', '[{"x":1}]', '[[],[[1,null,"s"]],{}]', '{"a":[],"b":{},"c":[{}],"d":[[],[true]]}', '{"a":{"x":1}}', '{"a":[{"x":1}]}',
        '{"e":"[{\\"k\\":[1,2]}]","f":"{not json","g":" x"}', '{"":{"":[{"":1}]}}', '{"u":"\\u00e9\\ud800","\\ud800":[1]}', "[]", "{}",
    ]
    bridge, objects, unreadable = flatten(spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)] + [("t", "bad", "{"), ("t", "null", None), ("t", "word", '"x"')], SCHEMA))
    got = rebuild(bridge.collect(), objects.collect())
    for i, t in enumerate(texts):
        if i not in (6, 8):
            assert got[str(i)] == canonical_text(t)
    assert got["6"] == canonical_text('{"e":[{"k":[1,2]}],"f":"{not json","g":" x"}') and got["8"].startswith('{"?":[1e0]')
    assert {r.owner_id for r in unreadable.collect()} == {"bad", "word"}


def test_round_trip_of_the_table(spark, data):
    rows = [("t", f"{i}", r.attributes) for i, r in enumerate(table(spark, data, "graph_links").select("attributes").collect())]

    def plain(v):
        v = _unwrap(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    bridge, objects, unreadable = flatten(spark.createDataFrame(rows, SCHEMA))
    got, bad = rebuild(bridge.collect(), objects.collect()), {r.owner_id for r in unreadable.collect()}
    assert got
    for _, owner, text in rows:
        if owner in got:
            assert got[owner] == write(plain(decode(text)))
        else:
            assert text is None or owner in bad


@pytest.mark.parametrize("depth", [400, 10_000, 100_000])
def test_any_depth(spark, depth):
    deep = '{"a":' * depth + '{"candidates":["x"],"n":[1.50]}' + "}" * depth
    lists = "[" * depth + "]" * depth
    owners = spark.createDataFrame([("t", "d", deep), ("t", "l", lists), ("t", "cut", deep[:-1])], SCHEMA)
    bridge, objects, unreadable = flatten(owners)
    n = {r.owner_id: r.n for r in bridge.groupBy("owner_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"d": depth + 3, "l": depth} and [r.owner_id for r in unreadable.collect()] == ["cut"]
    assert bridge.join(objects, F.col("child_hash") == F.col("object_hash"), "left_anti").count() == 0
    (found,) = resolution_candidates(owners).collect()
    assert found.candidate_id == "x" and found.parent_path == ".".join("a" * depth)


def test_empty(spark):
    assert resolution_candidates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [x.count() for x in flatten(spark.createDataFrame([], SCHEMA))] == [0, 0, 0]
