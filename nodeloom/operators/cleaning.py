"""Graph construction: duplicate records, endpoint remaps, reference resolution, entity merges."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph
from ..runtime import Workspace
from ..text import tokens as tk
from .analytics import components

#: Thresholds and sizes of the entity merge.
ENTROPY, MERGE, BANDS, ROWS = 2.5, 92.0, 14, 9
PRIME, MASK = (1 << 61) - 1, (1 << 32) - 1


def dedupe_nodes(nodes: DataFrame, key: str = "id", order: str = "ingested_at") -> DataFrame:
    """The last delivery of each key, whole; ties fall to the larger record."""
    rest = [c for c in nodes.columns if c != key]
    return nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*").select(*nodes.columns)


def dedupe_edges(edges: DataFrame, keys: tuple[str, ...] = ("source", "target", "kind"), order: str = "ingested_at", ident: str = "id") -> DataFrame:
    """The first delivery of each (source, target, relation); ``merged`` counts what it stands for."""
    return edges.groupBy(*keys).agg(F.min(F.struct(order, ident)).alias("r"), F.count(F.lit(1)).alias("merged")).select(*keys, F.col(f"r.{ident}").alias(ident), "merged")


def occurrence_key(*cols: str) -> F.Column:
    """Identity of a parallel edge: digest of its ends, relation, place and rule, nulls kept apart."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)


def merge_evidence(edges: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Distinct evidence of colliding edges with how often it was given, a row each."""
    return edges.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def rewire(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``remap(id, winner)``; new self-loops go, but for recursive calls."""
    r = lambda c, w: remap.select(F.col("id").alias(c), F.col("winner").alias(w))
    both = edges.join(r("src", "ws"), "src", "left").join(r("dst", "wd"), "dst", "left")
    a, b = F.coalesce("ws", "src"), F.coalesce("wd", "dst")
    fine = (a != b) | (F.col("src") == F.col("dst")) | (F.col("type") == "CALLS")
    return both.where(fine).select("eid", a.alias("src"), b.alias("dst"), "type")


def prune_orphans(nodes: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ("File",)) -> DataFrame:
    """Nodes that some edge touches, and those with a kept label."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("hit", F.lit(True))
    return nodes.join(ends, "id", "left").where(F.col("hit") | F.col("label").isin(*keep)).drop("hit")


#: Levels of inference, each admitting what those before it admit.
LEVELS = ("low", "medium", "high", "max")


def inference_level(graph: PropertyGraph, level: str) -> PropertyGraph:
    """The part of a graph that a level of inference admits; needs ``confidence`` on nodes and edges.

    Edges with exact evidence are always admitted. Inferred ones need a source file at both
    ends from ``medium`` on, or from ``high`` on a qualified external name in their evidence;
    ``max`` admits all edges, ambiguous ones and ones without evidence too. Nodes stay if an
    admitted edge ends at them, if their own evidence is exact, or from ``medium`` on if it
    is inferred and they have a source file; ``max`` keeps all.
    """
    at = LEVELS.index(level)
    if level == "max":
        return graph
    backed = graph.nodes.where("source_file is not null").select("id")
    end = lambda k: backed.select(F.col("id").alias(k), F.lit(True).alias(f"_{k}"))
    known = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    inferred = {"low": F.lit(False), "medium": known, "high": known | F.col("qualified_external")}[level]
    edges = graph.edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left").where((F.col("confidence") == "EXTRACTED") | ((F.col("confidence") == "INFERRED") & inferred)).select(*graph.edges.columns)
    hit = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_hit", F.lit(True))
    alone = (F.col("confidence") == "EXTRACTED") | ((F.col("confidence") == "INFERRED") & F.lit(at >= 1) & F.col("source_file").isNotNull())
    nodes = graph.nodes.join(hit, "id", "left").where(F.col("_hit") | F.coalesce(alone, F.lit(False))).select(*graph.nodes.columns)
    return PropertyGraph(nodes, edges, graph.closed)


def backfill_source(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_file`` of nodes without one from the smallest file of a container."""
    holder = edges.where("type = 'CONTAINS'").select(F.col("src").alias("holder"), F.col("dst").alias("id")).join(nodes.select(F.col("id").alias("holder"), F.col("source_file").alias("f")).where("f is not null"), "holder").groupBy("id").agg(F.min("f").alias("f"))
    return nodes.join(holder, "id", "left").select("id", F.regexp_replace(F.coalesce("source_file", "f"), r"\\", "/").alias("source_file"))


def _folders(c: str) -> F.Column:
    """Every directory above a file, with its depth, from the root (the empty path) down."""
    parts = F.split(F.col(c), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))


def resolve_names(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(call_id, target, how) for ``calls(call_id, name, scope, file)`` against ``defs(id, name, scope, file)``.

    A name with one definition in its scope is taken; of several, the only one outside tests,
    the only one in the caller's file, or the only one below the deepest directory shared
    with the caller; otherwise the call stays unresolved. Definitions are only ever counted
    per name, per file and per directory, so a name that everything defines is no burden.
    """
    test = F.coalesce(F.col("file").rlike("(^|/)tests?/|_test\\.|test_"), F.lit(False))
    known = defs.where("name is not null").select("name", "scope", "id", "file", test.alias("test")).distinct()
    names = known.groupBy("name", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"), F.count_if(~F.col("test")).alias("n_plain"), F.min(F.when(~F.col("test"), F.col("id"))).alias("plain"))
    files = known.groupBy("name", "scope", "file").agg(F.count(F.lit(1)).alias("n_file"), F.min("id").alias("same"))
    both = calls.join(names, ["name", "scope"], "left")
    clear = F.coalesce((F.col("n") == 1) | (F.col("n_plain") == 1), F.lit(True))
    hard = both.where(~clear).join(files, ["name", "scope", "file"], "left")
    folders = known.where("file is not null").select("name", "scope", "id", F.explode(_folders("file")).alias("f")).groupBy("name", "scope", F.col("f.folder").alias("folder")).agg(F.count(F.lit(1)).alias("n_near"), F.min("id").alias("near"))
    asked = hard.where("file is not null").select("call_id", "name", "scope", F.explode(_folders("file")).alias("f")).select("call_id", "name", "scope", "f.*")
    near = asked.join(folders, ["name", "scope", "folder"]).groupBy("call_id").agg(F.max(F.struct("depth", "n_near", "near")).alias("d"))
    hard = hard.join(near, "call_id", "left")
    same, close = F.when(F.col("n_file") == 1, F.col("same")), F.when(F.col("d.n_near") == 1, F.col("d.near"))
    how = F.when(same.isNotNull(), "same_file").when(close.isNotNull(), "nearest").otherwise("ambiguous")
    easy = F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("plain"))
    easy_how = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "unique").otherwise("not_test")
    return both.where(clear).select("call_id", easy.alias("target"), easy_how.alias("how")).unionByName(hard.select("call_id", F.coalesce(same, close).alias("target"), how.alias("how")))


def exact_merges(nodes: DataFrame) -> DataFrame:
    """(id, winner): nodes of one file with equal normalised names; the winner has no chunk suffix, then the shortest id."""
    name = tk.normalize_label(F.col("node_label"))
    rank = F.struct(F.col("id").rlike(r"_c\d+$").alias("chunk"), F.length("id").alias("n"), F.col("id").alias("id"))
    known = nodes.where("source_file is not null").select("id", "source_file", name.alias("name")).where("name != ''")
    w = known.withColumn("rank", rank).groupBy("source_file", "name").agg(F.min("rank").alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(w, ["source_file", "name"]).select("id", F.col("w.id").alias("winner"))


_MIX = np.random.default_rng(1)
#: Multipliers below 2^29 keep the products of 32-bit hashes within 64 bits.
_A, _C = _MIX.integers(1, 1 << 29, BANDS * ROWS, dtype=np.uint64), _MIX.integers(0, PRIME, BANDS * ROWS, dtype=np.uint64)


def _bands(name: str) -> list[str]:
    grams = {name[i : i + 3] for i in range(max(1, len(name) - 2))}
    h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], np.uint64)
    sketch = (((_A[:, None] * h + _C[:, None]) % np.uint64(PRIME)) & np.uint64(MASK)).min(axis=1)
    return [f"{b}:" + hashlib.blake2b(sketch[b * ROWS : (b + 1) * ROWS].tobytes(), digest_size=8).hexdigest() for b in range(BANDS)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def band_keys(names: pd.Series) -> pd.Series:
    seen: dict = {}
    return names.map(lambda n: seen[n] if n in seen else seen.setdefault(n, _bands(n)))


def fuzzy_names(nodes: DataFrame) -> DataFrame:
    """(name, class_name): distinct normalised names grouped by similarity of at least 92.

    One row per distinct name of sufficient entropy; equal names were made one before, so
    copies never multiply. Names are compared where they share a band of their signatures
    and hold the same numbers (names that differ in a number never merge, so numbered series
    do not fill a bucket); chains of similar names form a class, named by its smallest name.
    """
    work = Workspace(nodes.sparkSession, "names")
    name = tk.normalize_label(F.col("node_label"))
    names = work.stage(nodes.select(name.alias("name")).where("name != ''").distinct().where(tk.entropy(F.col("name")) >= ENTROPY))
    digits = F.array_join(F.regexp_extract_all("name", F.lit(r"(\d+)"), F.lit(1)), " ")
    banded = work.stage(names.select("name", digits.alias("digits"), F.explode(band_keys("name")).alias("band")))
    pairs = banded.join(banded.withColumnRenamed("name", "other"), ["band", "digits"]).where("name < other").select("name", "other").distinct()
    long = F.greatest(F.length("name"), F.length("other")) >= 12
    scored = pairs.where(~F.startswith("other", "name")).withColumn("score", tk.jaro_winkler_score("name", "other"))
    close = scored.where((F.col("score") >= MERGE) & (long | ((F.col("score") >= 97) & (F.length("name") == F.length("other")) & (F.levenshtein("name", "other") <= 2))))
    linked = components(close.select(F.col("name").alias("a"), F.col("other").alias("b")))
    return names.join(linked.withColumnsRenamed({"id": "name", "component": "class_name"}), "name", "left").select("name", F.coalesce("class_name", "name").alias("class_name"))


def merge_tagged(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs as one: ids become ``tag::id``; nodes without a tag are shared and keep their ids.

    ``nodes(id, tag, ...)`` keep their other columns, each merged id once; ``edges(src, dst,
    type, tag, ...)`` are those of the graph ``tag``, so an end that is not shared belongs to
    it. Of edges that coincide one is kept, with the other columns of the first by ``eid``
    where there is one.
    """
    pre = lambda c, tag: F.when(tag.isNull(), F.col(c)).otherwise(F.concat_ws("::", tag, c))
    rest = [c for c in nodes.columns if c not in ("id", "tag")]
    whole = nodes.withColumn("id", pre("id", F.col("tag")))
    merged = whole.groupBy("id").agg(F.min_by(F.struct("tag", *rest), F.coalesce("tag", F.lit(""))).alias("r")).select("id", "r.*")
    shared = nodes.where("tag is null").select(F.col("id").alias("_id"), F.lit(True).alias("_shared")).distinct()
    for end in ("src", "dst"):
        marked = edges.join(shared.withColumnRenamed("_id", end), end, "left")
        edges = marked.withColumn(end, F.when(F.col("_shared"), F.col(end)).otherwise(F.concat_ws("::", "tag", end))).drop("_shared")
    more = [c for c in edges.columns if c not in ("src", "dst", "type")]
    order = F.col("eid") if "eid" in more else F.lit(0)
    links = edges.groupBy("src", "dst", "type").agg(F.min_by(F.struct(*more), order).alias("r")).select("src", "dst", "type", "r.*")
    return merged, links


def best_of(df: DataFrame, by: list[str], order: list, take: int = 1) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= take).drop("_k")
