"""Sources: graph artifacts, store scans, file discovery and text extractors, as DataFrames."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph, node_label, relation_type

NODE = "struct<id:string,label:string,kind:string,file_type:string,source_file:string,community:bigint>"
LINK = "struct<id:string,source:string,target:string,relation:string,kind:string,confidence:string,context:string,weight:double>"
GRAPH_SCHEMA = f"directed boolean, multigraph boolean, nodes array<{NODE}>, links array<{LINK}>"


def read_graph_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A node-link graph document, one JSON object per file, as nodes and edges.

    The kind falls back to the file type for nodes and the relation for links; links without
    an id get one from their place; confidence is EXTRACTED where none is told.
    """
    doc = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*").where("id is not null")
    kind = F.coalesce("kind", "file_type")
    nodes = nodes.select("id", node_label(F.coalesce(kind, F.lit(""))).alias("label"), F.col("label").alias("node_label"), kind.alias("kind"), "source_file", F.col("community").alias("community_id"))
    links = doc.select(F.posexplode("links").alias("k", "e")).select("k", "e.*").where("source is not null and target is not null")
    edges = links.select(F.coalesce("id", F.concat(F.lit("e"), F.lpad(F.col("k").cast("string"), 10, "0"))).alias("eid"), F.col("source").alias("src"), F.col("target").alias("dst"), relation_type(F.coalesce("relation", "kind", F.lit(""))).alias("type"), F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), "context", "weight")
    return PropertyGraph(nodes, edges).drop_dangling()


#: Bytes of a graph document that are read at most, by default.
MOST_BYTES = 1 << 30


def graph_artifact(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> tuple[PropertyGraph, DataFrame]:
    """A graph document of bounded size, and (path, bytes, digest) of its files.

    Sizes are asked of the file system before anything is read, and a larger document is an
    error; the SHA-256 digests are computed where the bytes are.
    """
    files = spark.read.format("binaryFile").load(path)
    over = files.where(F.col("length") > most_bytes).select("path", "length").first()
    if over:
        raise ValueError(f"{over.path} has {over.length} bytes, more than {most_bytes}")
    return read_graph_json(spark, path), files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def open_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from a JSON document, or from a folder with ``nodes`` and ``edges`` tables."""
    if path.endswith(".json"):
        return read_graph_json(spark, path)
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), closed=True)


def page(df: DataFrame, key: str, after: str | None = None, limit: int = 100, prefix: str | None = None) -> DataFrame:
    """A bounded scan in key order: rows after a cursor, within a prefix."""
    if after is not None:
        df = df.where(F.col(key) > after)
    if prefix is not None:
        df = df.where(F.startswith(key, F.lit(prefix)))
    return df.orderBy(key).limit(limit)


#: Languages by file ending.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "rb": "ruby", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "scala": "scala", "lua": "lua",
    "sql": "sql", "sh": "bash", "tf": "terraform", "json": "json", "md": "markdown", "html": "html", "vue": "vue", "svelte": "svelte", "dart": "dart", "zig": "zig",
}


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def in_scope(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a path matches an include glob (none: all) and no exclude glob."""
    hit = lambda globs: F.coalesce(*[F.when(path.rlike(fnmatch.translate(g).replace("(?s:", "(?s)(").replace("\\Z", "$")), True) for g in globs], F.lit(False))
    yes = hit(include) if include else F.lit(True)
    return yes & ~hit(exclude) if exclude else yes


def discover_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, digest, lang) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), language_of(F.col("path")).alias("lang"))


def manifest_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): new, changed and removed files by digest."""
    both = before.select("path", F.col("digest").alias("old")).join(after.select("path", F.col("digest").alias("new")), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content has not been extracted before."""
    return files.join(cache.select("path", "digest"), ["path", "digest"], "left_anti")


def markdown_parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, pos, value): headings with their level, links, and fenced code languages, in order."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    found = lambda rx, g=0: F.regexp_extract_all(t, F.lit(rx), F.lit(g))
    parts = {"heading": found(r"(?md)^#{1,6} +\S.*$"), "link": found(r"\[[^\]\n]*\]\(([^)\s]+)\)", 1), "code": found(r"(?md)^```([A-Za-z0-9_+-]+)", 1), "symbol": found(r"`([A-Za-z_][A-Za-z0-9_]*)`", 1)}

    def tagged(kind):
        return lambda v, i: F.struct(F.lit(kind).alias("part"), i.cast("bigint").alias("pos"), v.alias("value"))

    each = F.flatten(F.array(*[F.transform(a, tagged(k)) for k, a in parts.items()]))
    return docs.select(F.col(key), F.explode(each).alias("p")).select(key, "p.*")


def sql_objects(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name) of the objects that CREATE statements define."""
    rx = r"(?is)\bcreate\s+(?:or\s+replace\s+)?(?:unique\s+|temporary\s+|materialized\s+)*(table|view|index|function|procedure|trigger|schema)\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([A-Za-z_][A-Za-z0-9_.]*)"
    kinds, names = (F.regexp_extract_all(text, F.lit(rx), F.lit(g)) for g in (1, 2))
    return docs.select(F.col(key), F.explode(F.arrays_zip(F.transform(kinds, F.lower).alias("kind"), names.alias("name"))).alias("o")).select(key, F.concat(F.lit("database_"), F.col("o.kind")).alias("kind"), F.col("o.name").alias("name"))


def html_links(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href): targets of anchors in order."""
    return docs.select(F.col(key), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("pos", "href"))


def url_kind(url: Column) -> Column:
    """What a link leads to, by host and ending."""
    host, path = F.lower(F.coalesce(F.call_function("try_parse_url", url, F.lit("HOST")), F.lit(""))), F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return (
        F.when(~F.lower(url).rlike("^https?://"), "invalid").when(host.isin("twitter.com", "x.com", "www.twitter.com", "www.x.com"), "tweet").when(host.rlike(r"(^|\.)arxiv\.org$"), "arxiv")
        .when(host.rlike(r"(^|\.)github\.com$"), "github").when(host.rlike(r"(^|\.)(youtube\.com|youtu\.be)$"), "youtube").when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.(png|jpe?g|gif|webp)$"), "image").otherwise("web")
    )


def jsonc(c: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    bare = F.regexp_replace(c, r'(?s)("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', "$1")
    return F.regexp_replace(bare, r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', "$1$2")


PYTHON_FACTS = "path string, kind string, name string, line int, parent string"


def python_facts(files: DataFrame) -> DataFrame:
    """(path, kind, name, line, parent): modules, classes, functions, imports and calls of Python files.

    ``files(path, text)``; files that do not parse give one row of kind ``error``.
    """
    import ast

    import pandas as pd

    def facts(path, text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return [(path, "error", None, None, None)]
        out, todo = [(path, "module", path, 1, None)], [(tree, None)]
        while todo:
            node, parent = todo.pop()
            inner = parent
            if isinstance(node, ast.ClassDef):
                out.append((path, "class", node.name, node.lineno, parent))
                inner = node.name
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((path, "function", node.name, node.lineno, parent))
                inner = node.name
            elif isinstance(node, ast.Import):
                out += [(path, "import", a.name, node.lineno, parent) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out.append((path, "import", node.module, node.lineno, parent))
            elif isinstance(node, ast.Call):
                f = node.func
                out.append((path, "call", f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None, node.lineno, parent))
            todo.extend((c, inner) for c in ast.iter_child_nodes(node))
        return out

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) for r in facts(p, t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "parent"]).astype({"line": "Int32"})

    return files.select("path", "text").mapInPandas(run, PYTHON_FACTS)


def read_table(spark: SparkSession, url: str, **options) -> DataFrame:
    """A database catalogue over JDBC, by default the columns of PostgreSQL's tables."""
    query = options.pop("query", "select table_schema, table_name, column_name, data_type, is_nullable from information_schema.columns")
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def token_batches(items: DataFrame, budget: int, order: str, tokens: str, by: str) -> DataFrame:
    """Greedy batches within a group (a directory): no batch of several items exceeds the budget."""
    from ..operators.traverse import greedy_cuts

    return greedy_cuts(items, budget, by, order, tokens, name="batch")
