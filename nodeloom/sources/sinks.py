"""Sinks: graphs and results as lines of text, documents and tables.

A sink is first a DataFrame of (ord, line) or of documents, which scales and can be tested;
``write_lines`` puts it into files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, with_index
from ..operators import analytics as an
from ..runtime import Files
from .store import Conflict


def _xml(c) -> Column:
    out = F.regexp_replace(c, "&", "&amp;")
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.regexp_replace(out, a, b)
    return out


def _quote(c) -> Column:
    return F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), "'", r"\\\\'"), F.lit("'"))


def graphml(graph: PropertyGraph) -> DataFrame:
    """(ord, key, line): header, nodes by id, edges by id, footer."""
    spark = graph.spark
    head = spark.createDataFrame([(0, "", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "ord int, key string, line string")
    n = graph.nodes.select(F.lit(1).alias("ord"), F.col("id").alias("key"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="label">'), _xml(F.coalesce("node_label", "id")), F.lit("</data></node>")).alias("line"))
    e = graph.edges.select(F.lit(2).alias("ord"), F.col("eid").alias("key"), F.concat(F.lit('<edge id="'), _xml(F.col("eid")), F.lit('" source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="relation">'), F.lower("type"), F.lit("</data></edge>")).alias("line"))
    return head.unionByName(n).unionByName(e)


def cypher_script(graph: PropertyGraph) -> DataFrame:
    """(ord, key, line): MERGE statements for nodes, then for relationships."""
    n = graph.nodes.select(F.lit(1).alias("ord"), F.col("id").alias("key"), F.concat(F.lit("MERGE (n:"), F.col("label"), F.lit(" {id: "), _quote(F.col("id")), F.lit("}) SET n.label = "), _quote(F.coalesce("node_label", "id")), F.lit(";")).alias("line"))
    e = graph.edges.select(F.lit(2).alias("ord"), F.col("eid").alias("key"), F.concat(F.lit("MATCH (a {id: "), _quote(F.col("src")), F.lit("}), (b {id: "), _quote(F.col("dst")), F.lit("}) MERGE (a)-[:"), F.col("type"), F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def node_link(graph: PropertyGraph) -> DataFrame:
    """(part, key, document): one JSON document per node and link."""
    n = graph.nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("key"), F.to_json(F.struct("id", F.col("node_label").alias("label"), "kind", "source_file", F.col("community_id").alias("community"))).alias("document"))
    e = graph.edges.select(F.lit("links").alias("part"), F.col("eid").alias("key"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.lower("type").alias("relation"), "weight", "context")).alias("document"))
    return n.unionByName(e)


def result_lines(df: DataFrame, name: str = "result") -> DataFrame:
    """A result as JSON lines: header with columns, a line per row, summary with the count."""
    spark = df.sparkSession
    cols = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema]
    head = spark.createDataFrame([(0, json.dumps({"schema": f"{name}/1", "columns": cols}))], "ord int, line string")
    rows = df.select(F.lit(1).alias("ord"), F.to_json(F.struct(F.lit("row").alias("kind"), F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in df.columns]).alias("values"))).alias("line"))
    tail = df.agg(F.lit(2).alias("ord"), F.to_json(F.struct(F.lit("summary").alias("kind"), F.count(F.lit(1)).alias("rows"))).alias("line"))
    return head.unionByName(rows).unionByName(tail)


def result_document(df: DataFrame, name: str = "result", order: tuple[str, ...] = ()) -> DataFrame:
    """(ord, key, line): a result as one JSON document, a row a line.

    Lines joined in order are ``{"schema", "columns", "rows"}``; rows stand in the order of
    ``order`` or, without one, of all columns, and hold JSON values in the columns' order.
    """
    cols = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema]
    # a null would vanish from a struct, so each value is written on its own
    cell = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
    row = F.concat(F.lit("["), F.concat_ws(",", *[F.when(F.col(c).isNull(), "null").otherwise(cell(c)) for c in df.columns]), F.lit("]"))
    each = with_index(df.select(*[F.col(c) for c in (order or df.columns)], row.alias("_row")), *(order or df.columns), name="_k")
    lines = each.select(F.lit(1).alias("ord"), F.format_string("%020d", "_k").alias("key"), F.concat(F.when(F.col("_k") > 0, ",").otherwise(""), "_row").alias("line"))
    frame = df.sparkSession.createDataFrame([(0, "", json.dumps({"schema": f"{name}/1", "columns": cols})[:-1] + ', "rows": ['), (2, "", "]}")], "ord int, key string, line string")
    return frame.unionByName(lines)


def aligned(rows: list[tuple], columns: list[str]) -> str:
    """A small result as an aligned table."""
    cells = [[*columns], *[["" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


def view_model(graph: PropertyGraph) -> DataFrame:
    """(community, nodes, edges, hub): what a viewer shows of each community."""
    m = an.communities(graph)
    c = an.cohesion(an.simple_edges(graph), m)
    return c.join(an.community_hubs(graph, m), "community").select("community", F.col("size").alias("nodes"), "edges", "hub")


def notes(graph: PropertyGraph) -> DataFrame:
    """(name, ord, line): the lines of a Markdown page per node, for note collections and wikis.

    A title, the kind, then a link a line in order; the page of a hub is as long as its links
    and never held as one value.
    """
    node = lambda n, line: graph.nodes.select(F.col("id").alias("name"), F.lit(n).alias("ord"), line.alias("line"))
    links = graph.edges.select(F.col("src").alias("name"), F.lit(2).alias("ord"), F.concat(F.lit("- "), F.lower("type"), F.lit(" [["), F.col("dst"), F.lit("]]")).alias("line")).distinct()
    return node(0, F.concat(F.lit("# "), F.coalesce("node_label", "id"))).unionByName(node(1, F.concat(F.lit("kind: "), F.coalesce("kind", F.lit(""))))).unionByName(links)


def canvas(graph: PropertyGraph, spread: int = 400) -> DataFrame:
    """(part, key, document): nodes and edges of a JSON canvas; nodes lie in rows by community, by a hash within."""
    at = F.pmod(F.xxhash64("id"), F.lit(1000)) * spread
    row = F.coalesce("community_id", F.lit(-1)) * spread
    n = graph.nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("key"), F.to_json(F.struct("id", F.lit("file").alias("type"), F.concat("id", F.lit(".md")).alias("file"), at.alias("x"), row.alias("y"))).alias("document"))
    e = graph.edges.select(F.lit("edges").alias("part"), F.col("eid").alias("key"), F.to_json(F.struct(F.col("eid").alias("id"), F.col("src").alias("fromNode"), F.col("dst").alias("toNode"), F.lower("type").alias("label"))).alias("document"))
    return n.unionByName(e)


def report(graph: PropertyGraph) -> DataFrame:
    """(ord, line): a Markdown summary of sizes, labels and relationship types."""
    sizes = graph.nodes.agg(F.lit(0).alias("ord"), F.concat(F.lit("nodes: "), F.count(F.lit(1))).alias("line")).unionByName(graph.edges.agg(F.lit(1).alias("ord"), F.concat(F.lit("edges: "), F.count(F.lit(1))).alias("line")))
    labels = graph.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("ord"), F.concat(F.lit("- label "), "label", F.lit(": "), "n").alias("line"))
    types = graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(3).alias("ord"), F.concat(F.lit("- type "), "type", F.lit(": "), "n").alias("line"))
    return sizes.unionByName(labels).unionByName(types)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, range-partitioned into text files, with the atomic commit of the file writer."""
    cols = [c for c in ("ord", "key") if c in lines.columns]
    lines.repartitionByRange(*cols).sortWithinPartitions(*cols).select("line").write.mode("overwrite").text(path)


def save_graph(graph: PropertyGraph, path: str, bucket: str | None = None) -> None:
    """Nodes by label and edges by type, so that typed scans read their folders only."""
    graph.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def _pointers(files: Files, root: str) -> tuple[int, str | None]:
    """The number of the last publication, and the version of the last that is whole."""
    names = sorted((n for n in files.names(root) if n.startswith("pointer-")), reverse=True)
    for n in names:
        try:
            return int(names[0][8:17]), json.loads(files.read(f"{root}/{n}"))["version"]
        except ValueError:  # its writer was lost before the pointer was whole
            continue
    return (int(names[0][8:17]) if names else 0), None


def published(spark, root: str) -> str | None:
    """The version that readers see now."""
    return _pointers(Files(spark), root)[1]


def prepare(df: DataFrame, root: str, version: str) -> None:
    """Write a version beside the others; no reader sees it yet."""
    df.write.mode("errorifexists").parquet(f"{root}/versions/{version}")


def commit(spark, root: str, version: str, expected: str | None = None) -> None:
    """Make a prepared version the one that readers see.

    The pointer is a new file under the next number, created and never overwritten: of two
    writers the second is refused, and a reader finds one version or the other. ``expected``
    demands that this version is published now.
    """
    files = Files(spark)
    if version not in files.names(f"{root}/versions"):
        raise KeyError(f"version {version} has not been prepared")
    number, now = _pointers(files, root)
    if expected is not None and now != expected:
        raise Conflict(f"{now} is published, not {expected}")
    try:
        files.create(f"{root}/pointer-{number + 1:09d}.json", json.dumps({"version": version}))
    except Exception as refused:
        if "exist" in str(refused).lower():
            raise Conflict(f"publication {number + 1} has been made by another") from refused
        raise


def publish(df: DataFrame, root: str, version: str, expected: str | None = None) -> None:
    """:func:`prepare` and :func:`commit` a version."""
    prepare(df, root, version)
    commit(df.sparkSession, root, version, expected)


def current(spark, root: str) -> DataFrame:
    version = published(spark, root)
    if version is None:
        raise KeyError("nothing has been published")
    return spark.read.parquet(f"{root}/versions/{version}")


def garbage(versions: DataFrame, kept: DataFrame) -> DataFrame:
    """Versions that nothing kept refers to, directly or through ``parent``."""
    from ..operators.traverse import closure

    up = versions.where("parent is not null").select(F.col("version").alias("here"), F.col("parent").alias("there"), F.concat_ws(">", "version", "parent").alias("eid"), F.lit("PARENT").alias("type"))
    reached = closure(up, kept.select(F.lit("all").alias("root"), F.col("version").alias("node")), None)
    return versions.join(reached.select(F.col("node").alias("version")), "version", "left_anti").select("version")
