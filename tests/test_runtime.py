import os

import pytest
from pyspark.sql import functions as F

from nodeloom import runtime
from nodeloom.runtime import Workspace, shared_dir


def test_staging_reads_the_session_setting(spark, tmp_path, monkeypatch):
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: f"file://{tmp_path}/" if key == "spark.checkpoint.dir" else get(self, key, *rest))
    assert shared_dir(spark) == f"file://{tmp_path}"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        def __init__(self, master):
            self.master = master
            self._jsc = self

        getConf = sc = lambda self: self
        get = lambda self, *_: None
        getCheckpointDir = lambda self: type("None", (), {"isDefined": staticmethod(lambda: False)})

    for master in ("spark://a:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        session = type("Session", (), {"conf": Context(master), "sparkContext": Context(master)})
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session)


def test_staging_and_dropping(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda s: f"file://{tmp_path}")
    work = Workspace(spark, "t")
    df, seen = work.stage_counted(spark.range(5), n=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"n": 5, "top": 4} and df.count() == 5
    (root,) = os.scandir(tmp_path)
    assert len(os.listdir(root.path)) == 1
    work.drop(df)
    assert not os.listdir(root.path)


def test_empty_tables_can_be_staged(spark):
    df, seen = Workspace(spark, "t").stage_counted(spark.range(0), n=F.count(F.lit(1)))
    assert seen["n"] == 0 and df.count() == 0


def test_the_cleaned_graph_is_made_once_and_again_where_it_is_gone(spark, data):
    from nodeloom.graph import code_graph, evidence_graph
    from nodeloom.runtime import Files

    first = evidence_graph(spark, data)
    assert evidence_graph(spark, data) is first
    n = code_graph(spark, data).edges.count()
    Files(spark).remove(first.edges._staged_path)
    assert evidence_graph(spark, data) is not first and code_graph(spark, data).edges.count() == n > 0
