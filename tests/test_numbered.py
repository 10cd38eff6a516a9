"""Queries over the graph of numbers: what the graph of texts gives, with less shuffled."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.graph import code_graph
from nodeloom.operators import analytics as an
from nodeloom.operators import arrays
from nodeloom.plans import more, structure


def shuffled(spark, query, data, folder) -> tuple[list, float]:
    """Rows of a query over tables that no query has read yet, and bytes shuffled for it over those of the graph's tables."""
    fresh = folder / "sf"
    fresh.symlink_to(data)
    context = spark.sparkContext
    context.setJobGroup(str(fresh), "")
    rows = query(spark, str(fresh)).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(str(fresh)) for s in tracker.getJobInfo(j).stageIds}
    written = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    return rows, written / sum(os.path.getsize(f"{data}/{t}.parquet") for t in ("graph_links", "graph_nodes"))


def test_an9_incremental_shuffles_numbers(spark, data, tmp_path):
    rows, share = shuffled(spark, more.an9_incremental, data, tmp_path)
    assert share < 1.6
    g = code_graph(spark, data)
    members = an.communities(g).withColumn("community", F.col("community").cast("string"))
    want = an.recluster(g, members, g.nodes.where("label = 'Interface'").select("id")).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in want} and len(rows) == len(want)


def test_few_changed_communities_are_found_again(spark):
    links = [(a + str(i), a + str(j)) for a in "pqrstu" for i in range(4) for j in range(i + 1, 4)] + [("p0", "q0")]
    edges = spark.createDataFrame(links, "a string, b string")
    members = spark.createDataFrame([(f"{a}{i}", a) for a in "pqrstu" for i in range(4)] + [("p9", "p")], "id string, community string")
    got = {r.id: (r.community, r.fresh) for r in an.anew(edges, members, spark.createDataFrame([("p1",), ("nowhere",)], "id string")).collect()}
    assert got == {f"{a}{i}": (a, "p0" if a == "p" else None) for a in "pqrstu" for i in range(4)} | {"p9": ("p", "p9")}


@pytest.mark.parametrize("loops", [False, True])
def test_whole_graphs_cluster_as_their_link_ends(loops, monkeypatch):
    """Links given once, in parts of few ends, give what sorted ends in both directions give."""
    rng = np.random.default_rng(5)
    n, m = 400, 1500
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    b = np.where(rng.random(m) < 0.8, a // 20 * 20 + b % 20, b)
    if not loops:
        keys = np.unique(np.minimum(a, b)[a != b] * n + np.maximum(a, b)[a != b])
        a, b = keys // n, keys % n
    keys, w = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    k = np.bincount(keys // n, w, n)[keys // n]
    want = arrays.communities(keys // n, keys % n, w.astype(float), k, float(w.sum()))
    monkeypatch.setattr(arrays, "ENDS_AT_ONCE", 64)
    for wide in (0, 1 << 40):  # numbers may have gaps
        got = arrays.communities_of(a + wide, b + wide)
        assert all((x + wide == y).all() for x, y in zip(want, got, strict=True))
    assert 5 < len(set(want[1])) < 100


def test_an10_stable_ids_shuffles_numbers(spark, data, tmp_path):
    rows, share = shuffled(spark, structure.an10_stable_ids, data, tmp_path)
    assert share < 2.2
    g = code_graph(spark, data)
    want = an.remap_communities(an.louvain(an.simple_edges(g)), an.communities(g)).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in want} and len(rows) == len(want)
