from datetime import datetime, timedelta

import pytest

from nodeloom.operators import references, skew
from nodeloom.runtime import table

LINKS = "id string, source string, target string, weight double, observed_at timestamp_ntz, ingested_at timestamp_ntz, node_id string"
T0 = datetime(2025, 1, 1)


def links(spark, rows):
    return spark.createDataFrame([(i, s, t, w, T0 + timedelta(days=o), T0 + timedelta(days=g), "clash") for i, s, t, w, o, g in rows], LINKS)


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_eager_states_equal_the_join(spark):
    rows = [(str(i), "hub" if i % 3 else f"s{i}", f"t{i % 5}" if i % 7 else None, float(i) if i % 4 else None, i % 9, 0) for i in range(300)]
    l, n = links(spark, rows), nodes(spark, ["hub"] * 3 + ["t1", "t1", "s3", None])
    got = {r.node_id: r for r in skew.link_states(l, n).where("side = 'source'").collect()}
    assert got["hub"].left_rows == 200 and got["hub"].right_rows == 3 and got["hub"].joined_rows == 600
    assert abs(got["hub"].joined_sum_weight - 3 * sum(r[3] or 0 for r in rows if r[1] == "hub")) < 1e-6
    assert got["s0"].joined_rows == 0


def test_heavy_and_profiles(spark):
    rows = [(str(i), "hub" if i < 98 else f"s{i}", f"t{i}", 1.0, i, 0) for i in range(200)] + [("x", None, None, None, 1, 1)]
    l, n = links(spark, rows), nodes(spark, ["hub"])
    assert {tuple(r) for r in skew.heavy_ids(l, n).collect()} == {("source", "hub")}
    p = {(r.side, r.node_id): r for r in skew.id_profiles(l, n).collect()}
    assert p["source", "hub"].neighbours == 98 and p["source", "hub"].latest_link == "97"
    assert skew.heavy_ids(l.limit(0), n).count() == 0 and skew.id_profiles(l.limit(0), n).count() == 0


def test_heavy_ids_come_from_the_joined_states(spark, data, monkeypatch):
    plans = []

    class Watched(skew.Workspace):
        def stage(self, df, *by):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            assert {"left_rows", "right_rows", "joined_rows"} <= set(df.columns)
            return super().stage(df, *by)

    monkeypatch.setattr(skew, "Workspace", Watched)
    heavy = skew.heavy_ids(table(spark, data, "graph_links"), table(spark, data, "graph_nodes"))
    assert len(plans) == 1 and "Join LeftOuter" in plans[0] and plans[0].count("Aggregate [") == 2
    read = heavy._jdf.queryExecution().optimizedPlan().toString()
    assert heavy.count() and "observed_at" not in read


def test_ledger_in_any_split(spark, data):
    t = [table(spark, data, n) for n in ("graph_links", "graph_nodes", "shared_nodes", "snapshot_links", "snapshot_nodes", "graph_versions")]
    want = {tuple(r) for r in references.ledger_of(*t).orphans().collect()}
    cuts = (datetime(2025, 3, 1), datetime(2025, 7, 1), datetime(2025, 12, 1))
    got = {tuple(r) for r in references.ledger_of(*t, cuts=cuts).orphans().collect()}
    assert got == want and want


def test_ledger_states(spark):
    ledger = references.OrphanLedger.empty(spark)
    ref = "ref_table string, ref_field string, row_id string, ref_month string, space string, key string, seen_at timestamp_ntz, since timestamp_ntz"
    par = "space string, key string, first_at timestamp_ntz, gone_at timestamp_ntz"
    r = lambda rows: spark.createDataFrame([("l", "source", i, "m", "s", k, T0 + timedelta(days=o), T0 + timedelta(days=g)) for i, k, o, g in rows], ref)
    p = lambda rows: spark.createDataFrame([("s", k, T0 + timedelta(days=a), None if d is None else T0 + timedelta(days=d)) for k, a, d in rows], par)
    state = lambda: {x.row_id: x.reason for x in ledger.orphans().collect()}
    ledger = ledger.advance(r([("1", "a", 5, 5), ("2", "b", 5, 5), ("3", None, 5, 5), ("4", "", 5, 5)]), p([("b", 1, None)]))
    assert state() == {"1": "missing", "4": "missing"}
    ledger = ledger.advance(r([]), p([("a", 9, None)]))
    assert state() == {"1": "late", "4": "missing"}
    ledger = ledger.advance(r([("5", "a", 10, 10)]), p([("b", 9, 3), ("a", 2, None)]))
    assert state() == {"2": "deleted", "4": "missing"}
    assert sum(x.n for x in ledger.report().collect()) == 2


REFS = "ref_table string, ref_field string, row_id string, ref_month string, space string, key string, seen_at timestamp_ntz, since timestamp_ntz"
PARENTS = "space string, key string, first_at timestamp_ntz, gone_at timestamp_ntz"


def test_a_small_delivery_rewrites_its_buckets_only(spark, tmp_path):
    import os

    ref = lambda rows: spark.createDataFrame([("l", "source", i, "m", "s", k, T0, T0) for i, k in rows], REFS)
    par = lambda keys: spark.createDataFrame([("s", k, T0, None) for k in keys], PARENTS)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs}
    ledger = references.OrphanLedger.open(spark, f"file://{tmp_path}", 32)
    ledger = ledger.advance(ref([(str(i), f"k{i}") for i in range(200)]), par([f"k{i}" for i in range(0, 200, 2)]))
    before, state = files(), ledger.state
    assert ledger.orphans().count() == 100
    again = references.OrphanLedger.open(spark, f"file://{tmp_path}").advance(ref([]), par(["k1"]))
    assert {r.row_id for r in again.orphans().collect()} == {str(i) for i in range(3, 200, 2)}
    assert all(files()[f] == t for f, t in before.items())
    assert sum(g.startswith("delivery=2/") for g in again.state["index"].values()) == 1 and sum(again.state["pending"].get(b) != g for b, g in state["pending"].items()) == 1
    assert len({d for d in map(os.path.dirname, files()) if "references/delivery=2" in d and "bucket" in d}) <= 2
    assert {(r.delivery, r.n) for r in again.history().collect()} == {(1, 100), (2, 99)}
    # redelivered references stand in the state once, and a second writer of one delivery is refused
    third = again.advance(ref([("3", "k3"), ("3", "k3"), ("0", "k0")]), par([]))
    assert third._references(None, "pending", "resolved").count() == 200
    with pytest.raises(Exception, match="already exists"):
        again.advance(ref([]), par(["k5"]))
    # a manifest cut short does not count
    (tmp_path / "manifest-000000009.json").write_text("{")
    assert references.OrphanLedger.open(spark, f"file://{tmp_path}").state == third.state


def test_ledger_of_empty_tables(spark, data):
    t = [table(spark, data, n).limit(0) for n in ("graph_links", "graph_nodes", "shared_nodes", "snapshot_links", "snapshot_nodes", "graph_versions")]
    assert references.middle_of(t[0]) == () and references.ledger_of(*t).orphans().count() == 0
