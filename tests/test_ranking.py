"""Recall channels, typed ranking and ambiguity on a small graph."""

from nodeloom.graph import PropertyGraph
from nodeloom.text import rank as rk

NODES = "id string, label string, kind string, node_label string, qualified_name string, source_file string"
EDGES = "eid string, src string, dst string, type string"


def graph(spark):
    rows = [
        ("m:save", "Method", "method", "saveBatch", "store::saveBatch", "src/store.py"),
        ("m:write", "Method", "method", "writeBatch", "store::writeBatch", "tests/test_store.py"),
        ("m:top", "Function", "function", "flushAll", "app::flushAll", "src/app.py"),
        ("m:other", "Function", "function", "render", "ui::render", "src/ui.py"),
        ("m:alias", "Function", "function", "r", "ui::r", None),
        ("m:twin", "Method", "method", "saveBatch", "other::saveBatch", "src/other.py"),
    ]
    edges = [("e1", "m:top", "m:save", "CALLS"), ("e2", "m:top", "m:write", "CALLS"), ("e3", "m:alias", "m:other", "ALIASES"), ("e4", "m:other", "m:top", "CALLS")]
    return PropertyGraph(spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, EDGES), closed=True)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_channels(spark):
    g = graph(spark)
    got = {}
    for r in rk.recall(g.nodes, g.edges, asked(spark, "M:SAVE", "render", "rendr", "batch", "ui::r", "")).collect():
        got.setdefault(r.query_id, {})[r.id] = r.channel
    assert got[0]["m:save"] == "exact_id"
    assert got[1] == {"m:other": "exact_name", "m:alias": "alias"}
    assert got[2] == {"m:other": "fuzzy"}
    assert got[3] == {"m:save": "term", "m:write": "term", "m:twin": "term", "m:top": "relation"}
    assert got[4]["m:alias"] == "alias" and 5 not in got
    assert rk.recall(g.nodes.limit(0), g.edges.limit(0), asked(spark, "batch")).count() == 0


def test_typed_rank_and_ambiguity(spark):
    g = graph(spark)
    ranked = rk.typed_rank(g.nodes, g.edges, asked(spark, "persist the batch", "saveBatch")).cache()
    first = [r for r in sorted(ranked.collect(), key=lambda r: (r.query_id, r.rank)) if r.query_id == 0]
    # save and write are one meaning, so all three methods and their caller cover both terms
    assert {r.id for r in first if r.tier == 4} == {"m:save", "m:write", "m:twin", "m:top"}
    assert first[0].id == "m:top" and first[0].evidence == 2 and first[-1].id == "m:write"
    second = [r for r in sorted(ranked.collect(), key=lambda r: (r.query_id, r.rank)) if r.query_id == 1]
    assert [(r.id, r.tier) for r in second[:2]] == [("m:save", 5), ("m:twin", 5)]
    doubt = {(r.query_id, r.id): (r.ambiguous, r.alternative) for r in rk.ambiguity(ranked, 1).collect()}
    assert doubt == {(0, "m:top"): (False, None), (1, "m:save"): (True, "m:twin")}


def test_seed_order(spark):
    g = graph(spark)
    ranks = {r.id: r for r in rk.seed_rank(g.nodes, g.edges).collect()}
    assert ranks["m:write"].aside and not ranks["m:save"].aside and ranks["m:top"].degree == 3 and not ranks["m:alias"].backed
    scored = spark.createDataFrame([(1, i, 1.0) for i in ranks], "query_id int, id string, score double")
    order = [r.id for r in sorted(rk.order_seeds(scored, rk.seed_rank(g.nodes, g.edges)).collect(), key=lambda r: r.rank)]
    assert order == ["m:top", "m:other", "m:save", "m:twin", "m:write", "m:alias"]
