"""Property graphs as two DataFrames, and the graph views over the delivered tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Files, Workspace, table

NODE_FIELDS = ("id", "label")
EDGE_FIELDS = ("eid", "src", "dst", "type")


def node_label(kind) -> F.Column:
    """Label of a kind: lower case with a capital, other characters dropped, else ``Entity``."""
    clean = F.regexp_replace(F.lower(kind), "[^a-z0-9_]", "")
    shown = F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 20))
    return F.when(clean.rlike("^[a-z]"), shown).otherwise("Entity")


def relation_type(kind) -> F.Column:
    """Upper-case relationship type, other characters dropped, else ``RELATES_TO``."""
    clean = F.upper(F.regexp_replace(kind, "[^A-Za-z0-9_]", ""))
    return F.when(clean.rlike("^[A-Z]"), clean).otherwise("RELATES_TO")


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes(id, label, ...)`` and ``edges(eid, src, dst, type, ...)``; other columns are properties.

    ``closed`` promises that every edge end is a node, which lets plans skip joins that
    would only confirm it.
    """

    nodes: DataFrame
    edges: DataFrame
    closed: bool = False

    @property
    def spark(self):
        return self.nodes.sparkSession

    def drop_dangling(self) -> PropertyGraph:
        ids = self.nodes.select(F.col("id"))
        kept = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(self.nodes, kept.select(*self.edges.columns), closed=True)

    def with_contexts(self, *contexts: str) -> PropertyGraph:
        """The same nodes with only the edges of these contexts."""
        return PropertyGraph(self.nodes, self.edges.where(F.col("context").isin(*contexts)), self.closed)

    def with_types(self, *types: str) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.where(F.col("type").isin(*types)), self.closed)

    def degrees(self) -> DataFrame:
        """(id, degree) of every node; a self-loop counts twice, parallel edges each."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def schema_fingerprint(self) -> str:
        """Digest of labels, types and property names; equal for equal schemas."""
        labels = [r[0] for r in self.nodes.select("label").distinct().collect()]
        types = [r[0] for r in self.edges.select("type").distinct().collect()]
        entries = [f"N:L:{x}" for x in labels] + [f"N:P:{c}" for c in self.nodes.columns] + [f"R:T:{x}" for x in types] + [f"R:P:{c}" for c in self.edges.columns]
        import hashlib

        return hashlib.sha256("\n".join(sorted(entries)).encode()).hexdigest()


def with_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Consecutive numbers in the order of ``order`` without a single-task sort.

    Rows are range-partitioned, counted per partition, and numbered within; the counts (one
    number a partition) come to the driver.
    """
    work = Workspace(df.sparkSession, "index")
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    staged = work.stage(parts.select("*", local.alias("_m")))
    block = F.shiftright("_m", 33)
    sizes = {r.b: r.n for r in staged.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for b in sorted(sizes):
        offsets.append((b, total))
        total += sizes[b]
    at = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(b).cast("bigint"), F.lit(o).cast("bigint")) for b, o in offsets])), block) if offsets else F.lit(0).cast("bigint")
    return staged.select(*df.columns, (at + F.col("_m").bitwiseAND((1 << 33) - 1)).alias(name))


#: How firmly evidence states what it tells, from firm to weak.
CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


def evidence_of(attributes) -> F.Column:
    """The entries of ``evidence`` in a record's JSON: array of (confidence, origin, rule); null without any.

    A single object counts as a list of one and a string that holds JSON as that value;
    unreadable JSON has no evidence.
    """
    text = F.from_json(attributes, "evidence string")["evidence"]
    return F.from_json(text, "array<struct<confidence:string,origin:string,rule:string>>")


def evidence_confidence(attributes) -> F.Column:
    """The weakest confidence among a record's evidence, null without evidence; ``exact`` is EXTRACTED."""
    said = F.transform(evidence_of(attributes), lambda x: F.lower(x["confidence"]))
    return F.when(F.array_contains(said, "ambiguous"), CONFIDENCE[2]).when(F.array_contains(said, "inferred"), CONFIDENCE[1]).when(F.array_contains(said, "exact"), CONFIDENCE[0])


def _latest(raw: DataFrame, *cols: str) -> DataFrame:
    latest = raw.groupBy("id").agg(F.max_by(F.struct(*cols), F.when(F.col("deleted_at").isNull(), F.col("ingested_at"))).alias("r"), F.max("deleted_at").alias("gone"))
    return latest.where("gone is null and r is not null").select("id", "r.*")


def _first(raw: DataFrame, *cols: str) -> DataFrame:
    links = raw.where("source is not null and target is not null")
    return links.groupBy("id").agg(F.min_by(F.struct(*cols), F.col("ingested_at")).alias("r")).select("id", "r.*")


def _latest_nodes(raw: DataFrame) -> DataFrame:
    own = _latest(raw, "repo", "kind", "node_label", "qualified_name", "lang", "source_file", "start_line", "end_line", "community_id", "attributes")
    return own.withColumns({"confidence": evidence_confidence(F.col("attributes")), "origin": F.try_element_at(evidence_of(F.col("attributes")), F.lit(1))["origin"]}).drop("attributes")


def _first_links(raw: DataFrame) -> DataFrame:
    first = _first(raw, "source", "target", "kind", "weight", "context", "is_deferred", "observed_at", "attributes")
    external = F.exists(evidence_of(F.col("attributes")), lambda x: (F.lower(x["origin"]) == "ast") & (F.lower(x["confidence"]) == "inferred") & x["rule"].endswith("qualified-external"))
    return first.select(
        F.col("id").alias("eid"), F.col("source").alias("src"), F.col("target").alias("dst"), relation_type(F.trim("kind")).alias("type"), "weight", "context", "is_deferred", "observed_at",
        evidence_confidence(F.col("attributes")).alias("confidence"), F.coalesce(external, F.lit(False)).alias("qualified_external"),
    )


def evidence_graph(spark, sf_dir: str) -> PropertyGraph:
    """The live code graph with the ``confidence`` of each node's and link's evidence, and the ``origin`` of a node's first.

    Each node and link stands once, deleted nodes are left out, dangling links dropped. The
    latest delivery of a node that still has contents stands for it; shared builtin symbols
    are nodes too. Of a link delivered again the first delivery counts.

    The cleaned graph is written once a session and state of its tables, ordered by label and
    type within its files, so that later plans read columns and row groups instead of
    cleaning the deliveries again.
    """

    def make():
        work = Workspace(spark, "graph")
        shared = table(spark, sf_dir, "shared_nodes").select("id", "kind", "node_label", "lang")
        nodes = _latest_nodes(table(spark, sf_dir, "graph_nodes")).unionByName(shared, allowMissingColumns=True).withColumn("label", node_label("kind"))
        nodes = work.stage(nodes.sortWithinPartitions("label"))
        live = PropertyGraph(nodes, _first_links(table(spark, sf_dir, "graph_links"))).drop_dangling()
        return PropertyGraph(nodes, work.stage(live.edges.sortWithinPartitions("type")), closed=True)

    return made_once(spark, sf_dir, "graph", make)


def made_once(spark, sf_dir: str, what: str, make):
    """What ``make`` derives from the graph tables of a folder, once a session and state of their files.

    It is derived again where the tables it was written to are gone.
    """
    files = Files(spark)
    state = tuple(files.state(f"{sf_dir}/{n}.parquet") for n in ("graph_nodes", "graph_links", "shared_nodes"))
    kept = spark.__dict__.setdefault("_nodeloom_made", {})
    known = kept.get((what, sf_dir, state))
    if known is None or not all(files.names(x._staged_path) for x in vars(known).values() if hasattr(x, "_staged_path")):
        known = kept[what, sf_dir, state] = make()
    return known


def code_graph(spark, sf_dir: str) -> PropertyGraph:
    """The live code graph as the language sees it: :func:`evidence_graph` without evidence."""
    g = evidence_graph(spark, sf_dir)
    return PropertyGraph(g.nodes.drop("confidence", "origin"), g.edges.drop("confidence", "qualified_external"), closed=True)


def numbered_graph(spark, sf_dir: str) -> PropertyGraph:
    """The live code graph with numbers for ids, in their order: nodes (id, name, label, community_id) and links (src, dst).

    For what needs nothing else of it: only these columns of the deliveries are shuffled, and
    later plans shuffle eight bytes an end.
    """

    def make():
        work = Workspace(spark, "numbers")
        nodes = _latest(table(spark, sf_dir, "graph_nodes"), "kind", "community_id").unionByName(table(spark, sf_dir, "shared_nodes").select("id", "kind"), allowMissingColumns=True)
        nodes = work.stage(with_index(nodes.select(F.col("id").alias("name"), node_label("kind").alias("label"), "community_id"), "name", name="id"))
        end = lambda k, n: nodes.select(F.col("name").alias(k), F.col("id").alias(n))
        links = _first(table(spark, sf_dir, "graph_links"), "source", "target")
        return PropertyGraph(nodes, work.stage(links.join(end("source", "src"), "source").join(end("target", "dst"), "target").select("src", "dst")), closed=True)

    return made_once(spark, sf_dir, "numbers", make)


def trade_graph(spark, sf_dir: str) -> PropertyGraph:
    """Customers, orders, parts, suppliers, nations and regions as one property graph."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    nothing = {"name": "string", "acctbal": "double", "segment": "string", "status": "string", "totalprice": "double", "priority": "string", "brand": "string", "size": "int", "retailprice": "double"}

    def view(df, label, ident, **props):
        return df.select(ident.alias("id"), F.lit(label).alias("label"), *[(F.col(props[p]) if p in props else F.lit(None)).cast(k).alias(p) for p, k in nothing.items()])

    nodes = [
        view(t("region"), "Region", key("region", "r_regionkey"), name="r_name"),
        view(t("nation"), "Nation", key("nation", "n_nationkey"), name="n_name"),
        view(t("customer"), "Customer", key("customer", "c_custkey"), name="c_name", acctbal="c_acctbal", segment="c_mktsegment"),
        view(t("supplier"), "Supplier", key("supplier", "s_suppkey"), name="s_name", acctbal="s_acctbal"),
        view(t("part"), "Part", key("part", "p_partkey"), name="p_name", brand="p_brand", size="p_size", retailprice="p_retailprice"),
        view(t("orders"), "Order", key("order", "o_orderkey"), status="o_orderstatus", totalprice="o_totalprice", priority="o_orderpriority"),
    ]
    line = t("lineitem")

    def rel(df, kind, src, dst, eid, quantity=None, price=None):
        return df.select(F.concat(F.lit(kind + ":"), eid).alias("eid"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.col(quantity) if quantity else F.lit(None)).cast("double").alias("quantity"), (F.col(price) if price else F.lit(None)).cast("double").alias("price"))

    whole = F.concat_ws("|", *[F.col(c).cast("string") for c in line.columns])
    edges = [
        rel(t("nation"), "IN_REGION", key("nation", "n_nationkey"), key("region", "n_regionkey"), F.col("n_nationkey").cast("string")),
        rel(t("customer"), "IN_NATION", key("customer", "c_custkey"), key("nation", "c_nationkey"), key("c", "c_custkey")),
        rel(t("supplier"), "IN_NATION", key("supplier", "s_suppkey"), key("nation", "s_nationkey"), key("s", "s_suppkey")),
        rel(t("orders"), "PLACED", key("customer", "o_custkey"), key("order", "o_orderkey"), F.col("o_orderkey").cast("string")),
        rel(line, "CONTAINS", key("order", "l_orderkey"), key("part", "l_partkey"), whole, "l_quantity", "l_extendedprice"),
        rel(line.select("l_suppkey", "l_partkey").distinct(), "SUPPLIES", key("supplier", "l_suppkey"), key("part", "l_partkey"), F.concat_ws("|", "l_suppkey", "l_partkey")),
    ]
    union = lambda xs: xs[0] if len(xs) == 1 else union(xs[:-1]).unionByName(xs[-1])
    return PropertyGraph(union(nodes), union(edges), closed=True)
