"""Graph analytics as joins and aggregations; iterative ones stage a table a step."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, with_index
from ..runtime import Workspace
from . import arrays
from .arrays import LEVEL_GAIN, SWEEPS_GAIN

#: Labels that every program brings and that tell nothing about a project.
NOISE_LABELS = (
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object", "True", "False", "MagicMock", "Mock", "AsyncMock", "NonCallableMock", "NonCallableMagicMock", "PropertyMock", "patch", "sentinel",
    "Path", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "ClassVar", "Final", "Literal", "Protocol", "Counter", "defaultdict", "OrderedDict", "datetime", "Enum", "os", "sys", "re", "json", "io", "abc", "typing",
)
#: Keys that every JSON file brings.
JSON_LABELS = (
    "start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version",
    "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies",
)
#: Relationships that wire a graph together: those that no surprise lies in, and those that say nothing about topics.
WIRING = ("CONTAINS", "IMPORTS", "IMPORTS_FROM", "METHOD")
GAP_WIRING = ("CONTAINS", "DECLARES", "DEFINES", "IMPORTS", "IMPORTS_FROM", "MEMBER_OF", "METHOD", "RE_EXPORTS")


def topical(graph: PropertyGraph) -> DataFrame:
    """Nodes with their degree and what they stand for: ``is_file``, ``is_concept``, ``is_json_key``, ``real``.

    A file's node bears the file's name (or is a bare call target); a concept has no file
    with an ending behind it; a JSON key is one of the usual ones in a JSON file; the rest is
    ``real``. A node without a label is no file.
    """
    name, file = F.coalesce("node_label", F.lit("")), F.coalesce("source_file", F.lit(""))
    last = F.substring_index(file, "/", -1)
    is_file = (name != "") & (((file != "") & (last == name)) | (name.startswith(".") & name.endswith("()")) | (name.endswith("()") & (F.col("degree") <= 1)))
    is_key = F.lower(file).endswith(".json") & F.lower(F.trim(name)).isin(*JSON_LABELS)
    n = graph.nodes.join(graph.degrees(), "id")
    return n.withColumns({"is_file": is_file, "is_concept": (file == "") | ~last.contains("."), "is_json_key": is_key}).withColumn("real", ~F.col("is_file") & ~F.col("is_concept") & ~F.col("is_json_key"))


def god_nodes(graph: PropertyGraph, top: int = 10) -> DataFrame:
    """Nodes of the highest degree, without files, concepts, JSON keys and builtin names."""
    shown = topical(graph).where(F.col("real") & ~F.coalesce("node_label", F.lit("")).isin(*NOISE_LABELS))
    return shown.orderBy(F.desc("degree"), "id").limit(top).select("id", F.col("node_label").alias("name"), "degree")


def communities(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.where("community_id is not null").select("id", F.col("community_id").alias("community"))


def simple_edges(graph: PropertyGraph) -> DataFrame:
    """Undirected edges without self-loops, parallel ones merged: (a, b)."""
    return graph.edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Sum over communities of in/m - resolution * (degree / 2m)^2, over (a, b) edges of weight 1.

    Edges with an end outside all communities still count in m and in degrees.
    """
    m = edges.agg(F.count(F.lit(1)).alias("m")).scalar()
    left = members.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    right = members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    both = edges.join(left, "a", "left").join(right, "b", "left")
    ends = both.select(F.explode(F.array(F.struct(F.col("ca").alias("community"), F.when(F.col("ca") == F.col("cb"), 1).otherwise(0).alias("inner")), F.struct(F.col("cb").alias("community"), F.lit(0).alias("inner")))).alias("e"))
    per = ends.where("e.community is not null").groupBy("e.community").agg(F.count(F.lit(1)).alias("degree"), F.sum("e.inner").alias("inside"))
    return per.agg(F.round(F.coalesce(F.sum(F.col("inside") / m - resolution * (F.col("degree") / (2 * m)) ** 2), F.lit(0.0)), 6).alias("modularity"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, size, edges, cohesion): inner edges over possible ones; a singleton has 1."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    inner = edges.join(members.select(F.col("id").alias("a"), "community"), "a").join(members.select(F.col("id").alias("b"), F.col("community").alias("other")), "b").where("community = other").groupBy("community").agg(F.count(F.lit(1)).alias("edges"))
    n = F.col("size")
    share = F.when(n <= 1, 1.0).otherwise(F.col("edges") / (n * (n - 1) / 2))
    return sizes.join(inner, "community", "left").select("community", "size", F.coalesce("edges", F.lit(0)).alias("edges")).withColumn("cohesion", F.round(share, 6))


def community_order(members: DataFrame) -> DataFrame:
    """Stable numbers: larger communities first, then by their smallest member; and a signature.

    The signature is the first 16 hex digits of SHA-256 over the sorted members, each
    followed by NUL. The members of a community are hashed as a stream in their order, so
    that the largest one needs no more memory than the smallest.
    """

    def sign(batches):
        at, sha, size, first = None, None, 0, None
        out: list[tuple] = []
        for batch in batches:
            for community, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha is None or community != at:
                    if sha is not None:
                        out.append((at, size, first, sha.hexdigest()[:16]))
                    at, sha, size, first = community, hashlib.sha256(), 0, member
                sha.update(member.encode() + b"\0")
                size += 1
        if sha is not None:
            out.append((at, size, first, sha.hexdigest()[:16]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.string()))], names=["community", "size", "first", "signature"])

    kind = pa.int64() if dict(members.dtypes)["community"] in ("int", "bigint") else pa.string()
    name = "bigint" if kind == pa.int64() else "string"
    streams = members.select(F.col("community").cast(name).alias("community"), "id").repartition("community").sortWithinPartitions("community", "id")
    per = streams.mapInArrow(sign, f"community {name}, size bigint, first string, signature string")
    per = per.select(F.col("community").cast(dict(members.dtypes)["community"]).alias("community"), "size", "first", "signature", (-F.col("size")).alias("_smaller"))
    return with_index(per, "_smaller", "first", name="rank").drop("_smaller")


def community_hubs(graph: PropertyGraph, members: DataFrame) -> DataFrame:
    """(community, hub, name): the member with the most neighbours, ties to the smaller id.

    Parallel links count once, in whatever direction; a link to itself counts twice.
    """
    once = graph.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = once.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    d = members.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = d.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("id").alias("id"))).alias("m"))
    return best.join(graph.nodes.select(F.col("id").alias("hub"), F.col("node_label").alias("name")), F.col("m.id") == F.col("hub")).select("community", "hub", "name")


def remap_communities(new: DataFrame, old: DataFrame) -> DataFrame:
    """(community, stable_id): old ids go greedily to the new communities that share most members.

    Overlaps are taken from the largest down (ties: smaller old, then smaller new id), each
    id once. In a round every overlap that is the best left for both its ends is taken, which
    gives what taking them one by one would. New communities without an old one get the least
    ids not in use, larger communities first, then by their smallest member.
    """
    work = Workspace(new.sparkSession, "remap")
    left = new.join(old.select("id", F.col("community").cast("bigint").alias("before")), "id").groupBy("community", "before").agg(F.count(F.lit(1)).alias("n"))
    order = with_index(new.select("community").distinct(), "community", name="code")
    left, seen = work.stage_counted(left.join(order, "community").select("community", "before", "n", (-F.col("code")).alias("code")), n=F.count(F.lit(1)))
    taken = left.select("community", F.col("before").alias("stable_id")).limit(0)
    own = F.struct("n", (-F.col("before")).alias("b"), F.col("code").alias("c"))
    best = lambda end: F.max(own).over(Window.partitionBy(end))
    while seen["n"]:
        ranked = left.select("*", best("community").alias("x"), best("before").alias("y"))
        won = work.stage(ranked.where((own == F.col("x")) & (own == F.col("y"))).select("community", "before"))
        taken = taken.unionByName(won.select("community", F.col("before").alias("stable_id")))
        rest = left.join(won.select("community"), "community", "left_anti").join(won.select("before"), "before", "left_anti")
        left, seen = work.stage_counted(rest.select("community", "before", "n", "code"), n=F.count(F.lit(1)))
    sizes = new.groupBy("community").agg((-F.count(F.lit(1))).alias("smaller"), F.min("id").alias("first"))
    rest = with_index(sizes.join(taken, "community", "left_anti"), "smaller", "first", name="k")
    # the k-th of them gets the k-th id that is not taken: used ids below it shift it up
    used = with_index(taken.select("stable_id"), "stable_id", name="r").select((F.col("stable_id") - F.col("r")).alias("free"))
    ahead = used.groupBy("free").agg(F.count(F.lit(1)).alias("m"))
    steps = ahead.select("free", F.sum("m").over(Window.orderBy("free").rowsBetween(Window.unboundedPreceding, 0)).alias("shift"))  # one row a gap among communities
    shifted = rest.join(steps, F.col("free") <= F.col("k"), "left").groupBy("community", "k").agg(F.coalesce(F.max("shift"), F.lit(0)).alias("shift"))
    return taken.unionByName(shifted.select("community", (F.col("k") + F.col("shift")).alias("stable_id")))


def exclude_hubs(graph: PropertyGraph, members: DataFrame, percentile: int = 99) -> DataFrame:
    """Hubs above a degree percentile and the community most of their neighbours are in.

    (id, community): the percentile is the degree at place n * percentile / 100 (rounded
    down) of the n degrees in order; ties among communities fall to the smaller one. A hub
    without voters has null: it is a community of its own.
    """
    degrees = graph.degrees()
    # counts per degree in order stand for the sorted list of all degrees
    per = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    upto = per.withColumn("upto", F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)))
    place = per.agg(F.greatest(F.floor(F.sum("n") * F.lit(percentile) / 100), F.lit(1)).alias("place")).scalar()
    cut = upto.where(F.col("upto") >= place).agg(F.min("degree").alias("c"))
    hubs = degrees.where(F.col("degree") > cut.scalar()).select("id")
    e = simple_edges(graph)
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("x.*")
    votes = both.join(hubs, "id").join(hubs.select(F.col("id").alias("other")), "other", "left_anti").join(members.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("community").alias("community"))).alias("m"))
    return hubs.join(best, "id", "left").select("id", F.col("m.community").alias("community"))


#: File endings of code, papers and images; all others are documents.
CODE_ENDINGS = (
    "py", "ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "ejs", "ets", "go", "rs", "java", "groovy", "gradle", "cpp", "cc", "cxx", "c", "h", "hpp", "cu", "cuh", "metal", "rb", "rake", "swift", "kt", "kts", "cs", "scala", "php", "lua", "luau", "toc", "zig", "ps1", "psm1", "psd1",
    "ex", "exs", "m", "mm", "jl", "vue", "svelte", "astro", "dart", "v", "sv", "svh", "sql", "r", "f", "f90", "f95", "f03", "f08", "pas", "pp", "dpr", "dpk", "lpr", "inc", "dfm", "lfm", "lpk", "sh", "bash", "json", "tf", "tfvars", "hcl", "dm", "dme", "dmi", "dmm", "dmf", "sln", "slnx",
    "csproj", "fsproj", "vbproj", "xaml", "razor", "cshtml", "cls", "trigger",
)
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "svg")
#: Families of languages by file ending, across which an inferred call is no surprise.
LANGUAGES = {
    "python": ("py", "pyw"), "js": ("js", "jsx", "mjs", "cjs", "ejs", "ts", "tsx", "mts", "cts", "vue", "svelte"), "go": ("go",), "rust": ("rs",), "jvm": ("java", "kt", "kts", "scala"),
    "c": ("c", "h", "cpp", "cc", "cxx", "hpp"), "ruby": ("rb", "rake"), "swift": ("swift",), "dotnet": ("cs",), "php": ("php",), "r": ("r",),
}


def _ending(c) -> F.Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]*)$", 1))


def _file_category(c) -> F.Column:
    return F.when(_ending(c).isin(*CODE_ENDINGS), "code").when(_ending(c) == "pdf", "paper").when(_ending(c).isin(*IMAGE_ENDINGS), "image").otherwise("doc")


def _family(c) -> F.Column:
    family = F.lit(None).cast("string")
    for name, endings in LANGUAGES.items():
        family = F.when(_ending(c).isin(*endings), name).otherwise(family)
    return family


def surprises(graph: PropertyGraph, top: int | None = None) -> DataFrame:
    """Cross-file links scored by how unexpected they are: (eid, src, dst, type, confidence, score).

    Points: confidence 1 to 3 (edges without one count as extracted), 2 across kinds of
    files, 2 across top directories, 1 across communities, 1 from a peripheral node to a
    hub; similarity links weigh half as much again. Inferred calls across languages, or
    between code and documents, score for the last point only. ``top`` keeps the best ones,
    ties by edge id.
    """
    n = topical(graph).where("not is_file and not is_concept").select("id", "source_file", "community_id", "degree")
    side = lambda p, k: n.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("source_file", "community_id", "degree")])
    e = graph.edges.where(~F.col("type").isin(*WIRING))
    both = e.join(side("l", "src"), "src").join(side("r", "dst"), "dst").where("l_source_file != r_source_file")
    first = lambda c: F.split(c, "/")[0]
    confidence = F.coalesce(F.col("confidence") if "confidence" in graph.edges.columns else F.lit(None).cast("string"), F.lit("EXTRACTED"))
    kinds = [_file_category(F.col(f"{p}_source_file")) for p in ("l", "r")]
    families = [_family(F.col(f"{p}_source_file")) for p in ("l", "r")]
    quiet = (confidence == "INFERRED") & F.col("type").isin("CALLS", "USES") & (F.coalesce(families[0] != families[1], F.lit(False)) | ((kinds[0] != kinds[1]) & kinds[0].isin("code", "doc") & kinds[1].isin("code", "doc")))
    points = F.when(confidence == "AMBIGUOUS", 3).when(confidence == "INFERRED", 2).otherwise(1)
    points = points + F.when(kinds[0] != kinds[1], 2).otherwise(0)
    points = points + F.when(first("l_source_file") != first("r_source_file"), 2).otherwise(0)
    points = points + F.when(F.col("l_community_id") != F.col("r_community_id"), 1).otherwise(0)
    score = F.when(quiet, 0).otherwise(points)
    score = F.when(F.col("type") == "SEMANTICALLY_SIMILAR_TO", F.floor(score * 1.5).cast("int")).otherwise(score)
    score = score + F.when((F.least("l_degree", "r_degree") <= 2) & (F.greatest("l_degree", "r_degree") >= 5), 1).otherwise(0)
    out = both.select("eid", "src", "dst", "type", confidence.alias("confidence"), score.alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "eid").limit(top)


def cross_community(graph: PropertyGraph) -> DataFrame:
    """One edge per pair of communities: (left, right, eid, confidence, edges).

    Ambiguous edges come first, then inferred, extracted and others; ties fall to the smaller
    edge id. Wiring and the nodes of files do not count.
    """
    m = topical(graph).where("community_id is not null and not is_file").select("id", F.col("community_id").alias("community"))
    e = graph.edges.where(~F.col("type").isin(*WIRING))
    both = e.join(m.select(F.col("id").alias("src"), F.col("community").alias("x")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("y")), "dst").where("x != y")
    confidence = F.coalesce(F.col("confidence") if "confidence" in graph.edges.columns else F.lit(None).cast("string"), F.lit("EXTRACTED"))
    order = F.when(confidence == "AMBIGUOUS", 0).when(confidence == "INFERRED", 1).when(confidence == "EXTRACTED", 2).otherwise(3)
    per = both.groupBy(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).agg(F.min(F.struct(order.alias("o"), "eid", confidence.alias("confidence"))).alias("m"), F.count(F.lit(1)).alias("edges"))
    return per.select("left", "right", F.col("m.eid").alias("eid"), F.col("m.confidence").alias("confidence"), "edges")


#: Real members and inner links per member that a community needs to have a blind spot; communities a node may lie beside.
GAP_MEMBERS, GAP_CONNECTANCE, GAP_BESIDE = 4, 1.2, 32


def blind_spots(graph: PropertyGraph) -> DataFrame:
    """Pairs of communities that share neighbours but hardly link: (left, right, proximity, direct, score).

    Communities of at least 4 real nodes and 1.2 link ends a node inside are looked at. Each
    real node beside 2 to 32 of them adds 1/sqrt(degree) to each pair of them; score =
    proximity / (1 + direct links). The bound of 32 is part of the definition: it keeps hubs
    from relating everything, and a node from emitting more than 496 pairs.
    """
    work = Workspace(graph.spark, "gaps")
    real = work.stage(topical(graph).where("real").select("id", "degree", F.col("community_id").alias("community")))
    e = simple_edges(PropertyGraph(graph.nodes, graph.edges.where(~F.col("type").isin(*GAP_WIRING))))
    end = lambda k, c: real.select(F.col("id").alias(k), F.col("community").alias(c))
    e = work.stage(e.join(end("a", "x"), "a").join(end("b", "y"), "b"))
    inner = e.where("x = y").groupBy(F.col("x").alias("community")).agg(F.count(F.lit(1)).alias("links"))
    sizes = real.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    dense = F.coalesce("links", F.lit(0)) * 2.0 / F.col("size") >= GAP_CONNECTANCE
    eligible = work.stage(sizes.join(inner, "community", "left").where(dense & (F.col("size") >= GAP_MEMBERS)).select("community"))
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("y").alias("community")), F.struct(F.col("b").alias("id"), F.col("x").alias("community")))).alias("n")).select("n.*")
    beside = work.stage(both.where("community is not null").distinct().join(eligible, "community"))
    few = beside.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= GAP_BESIDE)).select("id")
    near = beside.join(few, "id").groupBy("id").agg(F.sort_array(F.collect_set("community")).alias("cs")).join(real.select("id", "degree"), "id")
    w = 1 / F.sqrt(F.greatest("degree", F.lit(1)))
    pairs = near.select(w.alias("w"), "cs", F.posexplode("cs").alias("i", "left")).select("w", "left", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("right"))
    near_pairs = pairs.groupBy("left", "right").agg(F.sum("w").alias("proximity"))
    direct = e.where("x != y").groupBy(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).agg(F.count(F.lit(1)).alias("direct"))
    d = F.coalesce("direct", F.lit(0))
    return near_pairs.join(direct, ["left", "right"], "left").select("left", "right", F.round("proximity", 6).alias("proximity"), d.alias("direct"), F.round(F.col("proximity") / (1 + d), 6).alias("score"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable without regard to direction.

    Alternating large-star and small-star steps: rounds grow with the logarithm of the size.
    """
    work = Workspace(edges.sparkSession, "components")
    pairs = work.stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    pairs = pairs.where("u != v")
    last = None
    for _ in range(100):
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = work.stage(large)
        # small star: every node links its smaller neighbours and itself to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        pairs, seen = work.stage_counted(small, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if last == seen:
            break
        last = seen
    else:
        raise RuntimeError("the components did not settle")
    return ids.join(pairs.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def disconnected(graph: PropertyGraph) -> DataFrame:
    """Components with at least two real nodes (see :func:`topical`): (component, size, real)."""
    loops = graph.nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    c = components(simple_edges(graph).unionByName(loops))
    real = topical(graph).select("id", F.col("real").cast("int").alias("real"))
    per = c.join(real, "id").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("real").alias("real"))
    return per.where("real >= 2").select(F.concat(F.lit("component:"), "component").alias("component"), "size", "real")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, component): edges inside a strongly connected component, self-loops included.

    Nodes without incoming or without outgoing edges are trimmed until none is left. Then
    every node takes the smallest id that reaches it as its colour; the nodes of a colour
    that reach its root without leaving the colour form a component, named by the root. The
    components of all colours are found at once, and the search goes on among the rest.
    """
    work = Workspace(edges.sparkSession, "cycles")
    rest, size = work.stage_counted(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), n=F.count(F.lit(1)))
    found = [rest.where("src = dst").select("src", "dst", F.col("src").alias("component"))]
    rest, left = rest.where("src != dst"), size["n"]
    for _ in range(1000):
        while left:
            inner = rest.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            before = left
            rest, n = work.stage_counted(inner.select("src", "dst"), n=F.count(F.lit(1)))
            left = n["n"]
            if left == before:
                break
        if not left:
            break
        colour = _spread(work, rest, "src", "dst")
        ends = lambda k, c: colour.select(F.col("id").alias(k), F.col("m").alias(c))  # noqa: B023, E731
        inside = work.stage(rest.join(ends("src", "m"), "src").join(ends("dst", "m2"), "dst").where("m = m2").select("src", "dst", "m"))
        level = work.stage(colour.where("id = m"))
        reach = level
        while True:
            step = inside.join(level.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "m").distinct().join(reach.select("id"), "id", "left_anti")
            level, n = work.stage_counted(step, n=F.count(F.lit(1)))
            if not n["n"]:
                break
            reach = reach.unionByName(level)
        done = work.stage(reach.select("id"))
        gone = lambda k: done.select(F.col("id").alias(k))  # noqa: B023, E731
        found.append(work.stage(inside.join(gone("src"), "src", "left_semi").join(gone("dst"), "dst", "left_semi").select("src", "dst", F.col("m").alias("component"))))
        rest, n = work.stage_counted(rest.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"), n=F.count(F.lit(1)))
        left = n["n"]
    else:
        raise RuntimeError("the search for cycles did not end")
    return reduce(DataFrame.unionByName, found).distinct()


def _spread(work: Workspace, edges: DataFrame, here: str, there: str) -> DataFrame:
    """The smallest id from which each node is reachable along here -> there: (id, m)."""
    m = work.stage(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("m")))
    while True:
        told = edges.join(m.withColumnRenamed("id", here), here).groupBy(F.col(there).alias("id")).agg(F.min("m").alias("t"))
        nxt, seen = work.stage_counted(m.join(told, "id", "left").select("id", F.least("m", "t").alias("m"), (F.col("t") < F.col("m")).alias("moved")), n=F.count_if(F.col("moved")))
        m = nxt.select("id", "m")
        if not seen["n"]:
            return m


def import_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """Simple cycles of a file graph up to ``longest`` files, 5 as in the reference's report: (cycle, length), smallest file first.

    Only edges inside strongly connected components are searched; each cycle is grown from
    its smallest file, so it is found once.
    """
    e = cycle_edges(edges).select("src", "dst").distinct()
    out = e.where("src = dst").select(F.array("src").alias("c"))
    e = e.where("src != dst")
    walk = e.where("src < dst").select(F.array("src", "dst").alias("c"))
    step = e.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    for n in range(2, longest + 1):
        grown = walk.withColumn("at", F.element_at("c", -1)).join(step, "at")
        out = out.unionByName(grown.where(F.col("to") == F.col("c")[0]).select("c"))
        walk = grown.where((F.col("to") > F.col("c")[0]) & ~F.array_contains("c", F.col("to"))).select(F.concat("c", F.array("to")).alias("c"))
    return out.select(F.array_join("c", " -> ").alias("cycle"), F.size("c").alias("length")).distinct()


#: Fixed value: from how many links on shortest paths are followed by joins, as a task cannot hold the graph.
HELD_LINKS = 1 << 23


def edge_betweenness(edges: DataFrame, block: int = 512, held: int = HELD_LINKS) -> DataFrame:
    """(a, b, score) over shortest paths from all n nodes, divided by n (n - 1).

    Up to ``held`` links every task holds the graph and follows its share of the sources;
    beyond, joins follow about ``block`` sources at once.
    """
    work = Workspace(edges.sparkSession, "edge-betweenness")
    numbers, links, n, m = _numbered(work, edges)
    sources = numbers.select("x")
    if m <= held:
        total = _carried(links, sources, n, True).where("b is not null").groupBy("a", "b").agg(F.sum("d").alias("f"))
        total = links.join(total, ["a", "b"], "left").select("a", "b", F.coalesce("f", F.lit(0.0)).alias("f"))
    else:
        zero = links.select("a", "b", F.lit(0.0).alias("f"))
        share = lambda _, links: [f.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "f") for f in links]
        total = _in_blocks(work, links, sources, -(-n // block), zero, share, "a", "b")
    end = lambda k, name: numbers.select(F.col("x").alias(k), F.col("id").alias(name))
    named = total.join(end("a", "l"), "a").join(end("b", "r"), "b")
    return named.select(F.col("l").alias("a"), F.col("r").alias("b"), F.round(F.col("f") / max(1, n * (n - 1)), 12).alias("score"))


#: From how many nodes on betweenness is estimated, and from how many sources; rows of paths kept at once.
EXACT_NODES, SOURCES, PATH_ROWS = 1000, 100, 50_000_000


def node_betweenness(edges: DataFrame, exact: int = EXACT_NODES, sources: int = SOURCES, held: int = HELD_LINKS, rows: int = PATH_ROWS) -> DataFrame:
    """(id, score) of every node of (a, b) edges: its share of the shortest paths between others.

    Up to ``exact`` nodes every node is a source and scores are divided by (n - 1)(n - 2).
    Beyond, ``sources`` nodes, drawn from all by a hash of their id, stand for all; a score is
    divided by n - 2 and by the number of sources that the node itself is not. No path is cut
    by its length. Up to ``held`` links every task holds the graph and follows its share of
    the sources; beyond, joins follow as many at once as have about ``rows`` rows.
    """
    work = Workspace(edges.sparkSession, "betweenness")
    ids, links, n, m = _numbered(work, edges)
    few = ids if n <= exact else work.stage(ids.orderBy(F.xxhash64("id"), "id").limit(sources))
    s = n if n <= exact else sources
    if m <= held:
        score = _carried(links, few.select("x"), n, False).groupBy(F.col("a").alias("x")).agg(F.sum("d").alias("score"))
    else:
        zero = ids.select("x", F.lit(0.0).alias("f"))
        share = lambda nodes, _: [d.where("s != x").select("x", F.col("d").alias("f")) for d in nodes]
        score = _in_blocks(work, links, few.select("x"), min(s, -(-s * n // rows)), zero, share, "x").withColumnRenamed("f", "score")
    own = F.when(F.col("source"), s - 1).otherwise(s)
    share = F.when((own > 0) & (n > 2), F.coalesce("score", F.lit(0.0)) / (own * (n - 2))).otherwise(0.0)
    return ids.join(score, "x", "left").join(few.select("x", F.lit(True).alias("source")), "x", "left").withColumn("source", F.coalesce("source", F.lit(False))).select("id", F.round(share, 12).alias("score"))


def _numbered(work: Workspace, edges: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Nodes (id, x), links (a, b) of numbers x from 0 on, and how many there are of both."""
    ids = with_index(ends(edges), "id", name="x")
    end = lambda k, name: ids.select(F.col("id").alias(k), F.col("x").alias(name))
    links, seen = work.stage_counted(edges.join(end("a", "l"), "a").join(end("b", "r"), "b").select(F.col("l").alias("a"), F.col("r").alias("b")).where("a != b").distinct(), n=F.count(F.lit(1)))
    return ids, links, ids.count(), seen["n"]


def _carried(links: DataFrame, sources: DataFrame, n: int, of_links: bool) -> DataFrame:
    """Rows (a, b, d): what node a (b null) or link a-b carries of the paths from the sources that one task followed."""
    tasks = links.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        got = [[np.zeros(0, np.int32)] for _ in "abs"]
        for t in batches:
            a, b = t["a"].to_numpy(), t["b"].to_numpy()
            for to, x in zip(got, (a[b >= 0], b[b >= 0], a[b < 0]), strict=True):
                to.append(x)
        a, b, own = (np.concatenate(x) for x in got)
        del got
        if not len(own):
            return
        paths = arrays.Paths(a, b, n, of_links)
        for s in np.sort(own):
            paths.add(int(s))
        if of_links:
            at = np.flatnonzero(paths.links)
            x, y, d = paths.at[at], paths.to[at], paths.links[at]
            a, b = np.minimum(x, y), np.maximum(x, y)
        else:
            at = np.flatnonzero(paths.nodes)
            a, b, d = at, np.full(len(at), -1), paths.nodes[at]
        for k in range(0, len(a), 1 << 16):
            z = slice(k, k + (1 << 16))
            yield pa.record_batch({"a": pa.array(a[z], pa.int64()), "b": pa.array(b[z], pa.int64(), mask=b[z] < 0), "d": pa.array(d[z])})

    whole = links.select(F.col("a").cast("int"), F.col("b").cast("int"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    parts = sources.select(F.col("x").cast("int").alias("a"), F.lit(-1).alias("b"), F.pmod(F.xxhash64("x"), F.lit(tasks)).cast("int").alias("task"))
    return whole.unionByName(parts).repartitionById(tasks, "task").mapInArrow(run, "a bigint, b bigint, d double")


def _in_blocks(work: Workspace, links: DataFrame, sources: DataFrame, blocks: int, zero: DataFrame, share, *by: str) -> DataFrame:
    """The sums of f by ``by`` over blocks of sources, whose tables are removed one after the other."""
    total = work.stage(zero)
    for k in range(blocks):
        inner = Workspace(work.spark, "betweenness")
        found = _dependencies(inner, links, sources.where(F.pmod(F.xxhash64("x"), F.lit(blocks)) == k).withColumnRenamed("x", "id"))
        after = work.stage(reduce(DataFrame.unionByName, share(*found), total).groupBy(*by).agg(F.sum("f").alias("f")))
        inner.clear()
        work.drop(total)
        total = after
    return total


def ends(edges: DataFrame) -> DataFrame:
    """(id): the nodes of (a, b) edges."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def betweenness(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge betweenness over shortest paths from ``sources`` (id), undirected.

    Level-synchronous for all sources at once: path counts are summed forwards level by
    level, dependencies backwards. Returns (id, score) and (a, b, score), not normalised.
    """
    nodes, links = _dependencies(Workspace(edges.sparkSession, "betweenness"), edges, sources, max_depth)
    node = reduce(DataFrame.unionByName, nodes).where("s != x").groupBy(F.col("x").alias("id")).agg(F.round(F.sum("d"), 6).alias("score"))
    if not links:
        return node, edges.select("a", "b", F.lit(0.0).alias("score")).limit(0)
    edge = reduce(DataFrame.unionByName, links).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.round(F.sum("f"), 6).alias("score"))
    return node, edge


def _dependencies(work: Workspace, edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of (s, x, d) and of (s, x, y, f), one a level: what node x and link x-y carry of the paths from s."""
    both = work.stage(edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*").distinct())
    level = work.stage(sources.select(F.col("id").alias("s"), F.col("id").alias("x"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "x")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = level.join(both, "x").groupBy("s", F.col("y").alias("x")).agg(F.sum("paths").alias("paths")).join(seen, ["s", "x"], "left_anti")
        level, n = work.stage_counted(new, n=F.count(F.lit(1)))
        if not n["n"]:
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "x"))
        if depth % 16 == 0:
            seen = work.stage(seen)  # a plan must not hold a table for every level
    credit = levels[-1].select("s", "x", "paths", F.lit(0.0).alias("d"))
    nodes, links = [credit.select("s", "x", "d")], []
    for upper in reversed(levels[:-1]):
        flow = upper.join(both, "x").join(credit.select("s", F.col("x").alias("y"), F.col("paths").alias("p2"), "d"), ["s", "y"]).select("s", "x", "y", (F.col("paths") / F.col("p2") * (1 + F.col("d"))).alias("f"))
        flow = work.stage(flow)
        links.append(flow)
        credit = work.stage(upper.join(flow.groupBy("s", "x").agg(F.sum("f").alias("d")), ["s", "x"], "left").select("s", "x", "paths", F.coalesce("d", F.lit(0.0)).alias("d")))
        nodes.append(credit.select("s", "x", "d"))
    return nodes, links


#: Fixed value: from how many link ends on a graph is shared among tasks.
HELD_ENDS = 1 << 24


def louvain(edges: DataFrame, resolution: float = 1.0, held: int = HELD_ENDS) -> DataFrame:
    """Communities by local moves and aggregation: (id, community), community being a member id.

    Ids are texts, or numbers of at least 0. A graph of at most ``held`` link ends is clustered
    by one task (``arrays.communities_of``), level by level until a level gains no more. A
    larger one is first divided into blocks by number, which is by id: nodes move among those
    of their block, each block in one task, and communities become nodes until a task holds
    the rest. As such moves see one block only, sweeps over the whole graph follow and, where
    they gain, the levels above them again.
    """
    work = Workspace(edges.sparkSession, "louvain")
    if dict(edges.dtypes)["a"] == "bigint":
        links, seen = work.stage_counted(edges.select("a", "b"), n=F.count(F.lit(1)))
        return _clusters(work, links, seen["n"], resolution, held).select(F.col("x").alias("id"), F.col("c").alias("community"))
    ids = work.stage(with_index(ends(edges), "id", name="x"))
    end = lambda k, name: ids.select(F.col("id").alias(k), F.col("x").alias(name))
    links, seen = work.stage_counted(edges.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), n=F.count(F.lit(1)))
    return _clusters(work, links, seen["n"], resolution, held).join(end("id", "x"), "x").join(end("community", "c"), "c").select("id", "community")


def _clusters(work: Workspace, links: DataFrame, n: int, resolution: float, held: int) -> DataFrame:
    """Communities (x, c), named by their least member, of n links (a, b) between numbers."""
    if 2 * n <= held:
        # numbers in order compress so well that files look small enough to broadcast what is large in memory
        return work.stage(links.repartition(1).mapInArrow(_whole_clusterer(resolution), "x bigint, c bigint")).hint("merge")
    half = links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("w"))
    whole, seen = work.stage_counted(half.unionByName(half.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")).groupBy("x", "y").agg(F.sum("w").alias("w")), n=F.count(F.lit(1)), w=F.sum("w"))
    total = seen["w"] or 1.0
    names, blocks = _levels(work, whole, seen["n"], total, resolution, held)
    while blocks:
        label, gain = _sweeps(work, whole, total, whole.where("x = y").agg(F.sum("w")).first()[0] or 0.0, resolution, names)
        names = work.stage(label.select("x", "c"))
        if gain is None or gain <= LEVEL_GAIN:
            break
        g, seen = work.stage_counted(_merged(whole, names), n=F.count(F.lit(1)))
        above, _ = _levels(work, g, seen["n"], total, resolution, held)
        names = work.stage(names.join(above.withColumnsRenamed({"c": "to", "x": "c"}), "c").select("x", F.col("to").alias("c")))
    least = names.groupBy("c").agg(F.min("x").alias("least"))
    return names.join(least, "c").select("x", F.col("least").alias("c"))


def _whole_clusterer(resolution: float):
    def run(batches):
        parts = [[np.zeros(0, np.int64)] for _ in "ab"]
        for t in batches:
            for to, k in zip(parts, "ab", strict=True):
                to.append(t[k].to_numpy())
        a, b = (np.concatenate(p) for p in parts)
        del parts
        if not len(a):
            return
        x, c = arrays.communities_of(a, b, resolution)
        for k in range(0, len(x), 1 << 16):
            yield pa.record_batch({"x": x[k : k + (1 << 16)], "c": c[k : k + (1 << 16)]})

    return run


def _merged(g: DataFrame, label: DataFrame) -> DataFrame:
    """The links (x, y, w) between communities (x, c)."""
    return g.join(label.select("x", F.col("c").alias("cx")), "x").join(label.select(F.col("x").alias("y"), F.col("c").alias("cy")), "y").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w"))


def _levels(work: Workspace, g: DataFrame, n: int, total: float, resolution: float, held: int) -> tuple[DataFrame, bool]:
    """Communities (x, c) of the links (x, y, w), of which there are n, and whether some were found in blocks."""
    nodes, seen = work.stage_counted(g.groupBy("x").agg(F.sum("w").alias("k")), n=F.count(F.lit(1)))
    names, size, blocks = nodes.select("x", F.col("x").alias("c")), seen["n"], False
    while n > held:
        blocks = True
        tasks = max(-(-2 * n // held), 2 * work.spark.sparkContext.defaultParallelism)
        cuts = sorted(set(g.approxQuantile("x", [i / tasks for i in range(1, tasks)], 0.1 / tasks)))
        block = lambda c: reduce(lambda p, q: p + q, [(F.col(c) >= int(q)).cast("int") for q in cuts], F.lit(0))  # noqa: B023, E731
        inside = g.withColumn("block", block("x")).where(F.col("block") == block("y")).join(nodes, "x")
        label = work.stage(inside.groupBy("block").applyInArrow(_clusterer(total, resolution, 1), "x bigint, c bigint"))
        label = nodes.select("x").join(label, "x", "left").select("x", F.coalesce("c", "x").alias("c"))
        g_now, seen = work.stage_counted(_merged(g, label), n=F.count(F.lit(1)))
        nodes_now, fewer = work.stage_counted(g_now.groupBy("x").agg(F.sum("w").alias("k")), n=F.count(F.lit(1)))
        if fewer["n"] > 0.9 * size:  # blocks part what belongs together
            loops = g_now.where("x = y").agg(F.sum("w")).first()[0] or 0.0
            wide, gain = _sweeps(work, g_now, total, loops, resolution)
            label = label.withColumnRenamed("c", "m").join(wide.select(F.col("x").alias("m"), "c"), "m").select("x", "c")
            g_now, seen = work.stage_counted(_merged(g_now, wide), n=F.count(F.lit(1)))
            nodes_now, fewer = work.stage_counted(g_now.groupBy("x").agg(F.sum("w").alias("k")), n=F.count(F.lit(1)))
            if gain is None or gain <= LEVEL_GAIN:
                return work.stage(names.withColumnRenamed("c", "m").join(label.withColumnRenamed("x", "m"), "m").select("x", "c")), blocks
        names = work.stage(names.withColumnRenamed("c", "m").join(label.withColumnRenamed("x", "m"), "m").select("x", "c"))
        g, n, nodes, size = g_now, seen["n"], nodes_now, fewer["n"]
    rest = g.join(nodes, "x").withColumn("block", F.lit(0)).groupBy("block").applyInArrow(_clusterer(total, resolution, None), "x bigint, c bigint")
    return work.stage(names.withColumnRenamed("c", "m").join(rest.withColumnRenamed("x", "m"), "m").select("x", "c")), blocks


def _clusterer(total: float, resolution: float, levels: int | None):
    def run(links: pa.Table) -> pa.Table:
        links = links.sort_by([("x", "ascending"), ("y", "ascending")])  # draws depend on places
        x, c = arrays.communities(*[links[k].to_numpy() for k in ("x", "y", "w", "k")], total, resolution, levels)
        return pa.table({"x": x, "c": c})

    return run


def _sweeps(work: Workspace, g: DataFrame, total: float, loops: float, resolution: float, names: DataFrame | None = None) -> tuple[DataFrame, float | None]:
    """The labels (x, k, c) of one level, and their gain in modularity over ``names`` (x, c) or one label a node; None if no node moves.

    In a sweep half of the nodes (by a hash that changes each sweep) may move to the
    neighbouring community of the largest modularity gain, so that neighbours do not swap
    forever. Sweeps go on until no node would move or four of them gain next to nothing, as
    parallel moves may still undo each other; the best labels seen count.
    """
    label = g.groupBy("x").agg(F.sum("w").alias("k"))
    label = work.stage(label.select("x", "k", F.col("x").alias("c")) if names is None else label.join(names, "x").select("x", "k", "c"))
    scores, best = [], (None, label)
    for sweep in range(10_000):
        size = label.groupBy("c").agg(F.sum("k").alias("tot"))
        links = g.where("x != y").join(label.select(F.col("x").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("w").alias("into"))
        own = label.join(size, "c").select("x", "k", F.col("c").alias("own"), F.col("tot").alias("own_tot"))
        options = own.join(links, "x").join(size, "c")
        at_home = F.col("c") == F.col("own")
        tot = F.col("tot") - F.when(at_home, F.col("k")).otherwise(0.0)
        gain = F.round(F.col("into") - resolution * F.col("k") * tot / total, 9)
        choice = options.withColumn("gain", gain).groupBy("x").agg(F.min(F.struct((-F.col("gain")).alias("loss"), F.col("c").alias("c"))).alias("m"), F.max(F.when(at_home, F.col("into"))).alias("inner"))
        stay = F.coalesce("inner", F.lit(0.0)) - resolution * F.col("k") * (F.col("own_tot") - F.col("k")) / total
        would = F.coalesce((-F.col("m.loss") > stay + 1e-8) & (F.col("m.c") != F.col("own")), F.lit(False))
        may = F.pmod(F.xxhash64("x", F.lit(sweep)), F.lit(2)) == 0
        step = own.join(choice, "x", "left").select("x", "k", F.when(would & may, F.col("m.c")).otherwise(F.col("own")).alias("c"), would.alias("would"), (F.col("k") * F.col("own_tot")).alias("square"), F.coalesce("inner", F.lit(0.0)).alias("inner"))
        after, seen = work.stage_counted(step, would=F.count_if(F.col("would")), square=F.sum("square"), inner=F.sum("inner"))
        # the sums tell the modularity of the labels before this sweep
        scores.append(((seen["inner"] or 0.0) + loops) / total - resolution * (seen["square"] or 0.0) / total**2)
        if best[0] is None or scores[-1] > best[0]:
            if best[1] is not label:
                work.drop(best[1])
            best = (scores[-1], label)
        elif best[1] is not label:
            work.drop(label)
        if not seen["would"] or (sweep >= 4 and max(scores[-4:]) - max(scores[:-4]) <= SWEEPS_GAIN):
            work.drop(after)
            return best[1], (best[0] - scores[0] if sweep else None)
        label = after.select("x", "k", "c")
        label._staged_path = after._staged_path
    raise RuntimeError("Louvain did not converge in 10,000 sweeps")


#: How many nodes, and which share of all, may be clustered anew before everything is.
ANEW_NODES, ANEW_SHARE = 4096, 0.25


def recluster(graph: PropertyGraph, members: DataFrame, changed: DataFrame, most: int = ANEW_NODES, share: float = ANEW_SHARE) -> DataFrame:
    """(id, community): communities of changed nodes are found again by their inner links; the rest stay.

    Where they hold more than ``most`` nodes or more than ``share`` of all, all communities
    are found again. ``community`` is a string; a new community is named by its smallest
    member, and a node without links is one of its own.
    """
    return anew(simple_edges(graph), members, changed, most, share).select("id", F.coalesce("fresh", "community").alias("community"))


def anew(edges: DataFrame, members: DataFrame, changed: DataFrame, most: int = ANEW_NODES, share: float = ANEW_SHARE) -> DataFrame:
    """:func:`recluster` over (a, b) edges: (id, community, fresh), ``fresh`` being the smallest member's id, or null where the community stays."""
    work = Workspace(members.sparkSession, "recluster")
    touched = members.join(changed.select("id"), "id", "left_semi").select("community").distinct()
    inside, n = work.stage_counted(members.join(touched, "community", "left_semi"), n=F.count(F.lit(1)))
    if n["n"] > most or n["n"] > share * members.count():
        inside = members
    end = lambda k: inside.select(F.col("id").alias(k))
    again = louvain(edges.join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi").select("a", "b")).withColumnRenamed("community", "fresh")
    if inside is members:
        return members.join(again, "id", "left").select("id", "community", F.coalesce("fresh", "id").alias("fresh"))
    return members.join(inside.select("id", F.lit(True).alias("again")), "id", "left").join(again, "id", "left").select("id", "community", F.when(F.col("again"), F.coalesce("fresh", "id")).alias("fresh"))
