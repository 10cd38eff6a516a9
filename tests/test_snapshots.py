import json

from nodeloom.functions.json import canonical_text
from nodeloom.operators.snapshots import change_counts, snapshot_changes
from nodeloom.runtime import table


def test_canonical_json():
    same = ['{"a":1,"b":[1,2]}', ' { "b": [1.0, 2e0], "a": 1.00, "c": null } ', '{"b":[10e-1,2],"a":1}']
    assert len({canonical_text(t) for t in same}) == 1
    different = ['{"a":1}', '{"a":"1"}', '{"a":true}', '{"a":[1]}', '{"a":[1,null]}', "{}", "[]", "null", '"x"', "{bad", None, '{"a":-1}', '{"a":1e400}', '{"a":1e401}', '{"a":123456789012345678901234567890}', '{"a":123456789012345678901234567891}']
    assert len({canonical_text(t) for t in different}) == len(different)


SNAP = "repo string, version_no int, id string, kind string, attributes string, delivered_at timestamp_ntz"


def snap(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(*r[:5], datetime(2025, 1, r[5]) if r[5] else None) for r in rows], SNAP)


def test_changes_between_listed_versions(spark):
    versions = spark.createDataFrame([("r", 1), ("r", 3), ("r", 4), ("r", 4), ("q", 1), (None, 1)], "repo string, version_no int")
    rows = [
        ("r", 1, "gone", "f", None, 1), ("r", 1, "same", "f", '{"a":1,"b":2}', 1), ("r", 1, "turned", "f", "{}", 1), ("r", 1, None, "f", None, 1),
        ("r", 2, "never listed", "f", None, 1),
        ("r", 3, "same", "f", '{"b":2.0,"a":1,"c":null}', 2), ("r", 3, "turned", "f", '{"x":1}', 2), ("r", 3, "turned", "f", "{}", 1), ("r", 3, "new", None, None, 2),
        ("r", 4, "same", "f", '{"b":2,"a":1}', 3), ("r", 4, "turned", "f", '{"x":1}', 3), ("r", 4, "new", "f", None, None),
        ("q", 1, "first", "f", None, 1),
    ]
    got = snapshot_changes(snap(spark, rows), versions)
    assert {tuple(r) for r in got.collect()} == {("r", 3, "gone", "removed"), ("r", 3, "turned", "changed"), ("r", 3, "new", "added"), ("r", 4, "new", "changed")}
    assert [tuple(r) for r in change_counts(got, "repo").collect()] == [("r", 2 - 1, 1, 2)]


def test_empty(spark):
    versions = spark.createDataFrame([], "repo string, version_no int")
    assert snapshot_changes(snap(spark, []), versions).count() == 0


def test_against_brute_force(spark, data):
    rows = table(spark, data, "snapshot_nodes").collect()
    listed = {}
    for r in table(spark, data, "graph_versions").collect():
        listed.setdefault(r.repo, set()).add(r.version_no)
    last = {}
    for r in sorted(rows, key=lambda r: r.delivered_at):
        a = r.attributes
        strip = lambda o: {k: strip(v) for k, v in o.items() if v is not None} if isinstance(o, dict) else [strip(v) for v in o] if isinstance(o, list) else o
        try:
            a = strip(json.loads(a)) if a is not None else None
        except ValueError:
            pass
        last[r.repo, r.version_no, r.id] = (r.kind, r.node_label, r.source_file, r.start_line, r.end_line, r.community_id, a)
    want = set()
    for repo, vs in listed.items():
        vs = sorted(vs)
        for before, v in zip(vs, vs[1:]):
            old = {k[2]: x for k, x in last.items() if k[:2] == (repo, before)}
            new = {k[2]: x for k, x in last.items() if k[:2] == (repo, v)}
            want |= {(repo, v, k, "added" if k not in old else "removed" if k not in new else "changed") for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    got = {tuple(r) for r in snapshot_changes(table(spark, data, "snapshot_nodes"), table(spark, data, "graph_versions")).collect()}
    assert got == want and want
