"""Readers of build manifests, infrastructure code and symbol indexes, as tables of facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections of a package manifest that name dependencies.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def package_dependencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, package, section, name, version) of JSON package manifests; unreadable ones give nothing."""

    def section(name):
        named = F.map_entries(F.coalesce(F.from_json(F.get_json_object(text, f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>")))
        return F.transform(named, lambda e: F.struct(F.lit(name).alias("section"), e["key"].alias("name"), e["value"].alias("version")))

    entries = F.flatten(F.array(*map(section, SECTIONS)))
    return docs.select(F.col(key), F.get_json_object(text, "$.name").alias("package"), F.explode(entries).alias("e")).select(key, "package", "e.*")


def mcp_servers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, server, command, url, n_args) of configurations that name tool servers; values of environment variables are never read."""
    servers = F.from_json(F.get_json_object(text, "$.mcpServers"), "map<string,struct<command:string,url:string,args:array<string>>>")
    each = docs.select(F.col(key), F.explode(F.map_entries(servers)).alias("e"))
    return each.select(key, F.col("e.key").alias("server"), F.col("e.value.command").alias("command"), F.col("e.value.url").alias("url"), F.coalesce(F.size("e.value.args"), F.lit(0)).alias("n_args"))


def dotnet_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, version) of package and project references in .NET project files."""
    tags = F.regexp_extract_all(text, F.lit(r"(?is)(<(?:PackageReference|ProjectReference)\b[^>]*>)"), F.lit(1))
    each = docs.select(F.col(key), F.explode(tags).alias("t"))
    attribute = lambda n: F.nullif(F.regexp_extract("t", rf'(?is)\b{n}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return each.select(key, F.when(F.lower("t").startswith("<package"), "package").otherwise("project").alias("kind"), attribute("Include").alias("name"), attribute("Version").alias("version")).where("name is not null")


TERRAFORM = r'(?m)^[ \t]*(resource|data|module|variable|output|provider)[ \t]+"([^"]+)"(?:[ \t]+"([^"]+)")?[ \t]*\{'


def terraform_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, type, name): blocks of infrastructure code in order; one label is a name, two are type and name. Comments are left out."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)^[ \t]*(#|//).*$", "")
    parts = [F.regexp_extract_all(plain, F.lit(TERRAFORM), F.lit(g)) for g in (1, 2, 3)]
    each = docs.select(F.col(key), F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "a", "b"))])).alias("pos", "x"))
    two = F.coalesce(F.col("x.b"), F.lit("")) != ""
    return each.select(key, "pos", F.col("x.kind").alias("kind"), F.when(two, F.col("x.a")).alias("type"), F.when(two, F.col("x.b")).otherwise(F.col("x.a")).alias("name"))


def terraform_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name): variables, locals, modules and data sources that infrastructure code refers to, each once."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:var|local|module)\.[A-Za-z_][A-Za-z0-9_-]*|data\.[A-Za-z0-9_]+\.[A-Za-z_][A-Za-z0-9_-]*)"), F.lit(1))
    each = docs.select(F.col(key), F.explode(F.array_distinct(found)).alias("r"))
    return each.select(key, F.substring_index("r", ".", 1).alias("kind"), F.expr("substring(r, instr(r, '.') + 1)").alias("name"))


SCIP = "documents array<struct<relative_path:string,relativePath:string,occurrences:array<struct<range:array<int>,symbol:string,symbol_roles:int,symbolRoles:int>>>>"


def scip_occurrences(docs: DataFrame, text: str) -> DataFrame:
    """(file, symbol, role, start_line, start_column, end_line, end_column) of symbol indexes in JSON.

    Role is ``definition`` where the first bit of the roles is set, else ``reference``; a range
    of three numbers ends on its first line.
    """
    found = docs.select(F.explode(F.from_json(text, SCIP)["documents"]).alias("d")).select(F.coalesce("d.relative_path", "d.relativePath").alias("file"), F.explode("d.occurrences").alias("o"))
    at = lambda i: F.col("o.range")[i]
    short = F.size("o.range") == 3
    role = F.coalesce("o.symbol_roles", "o.symbolRoles", F.lit(0)).bitwiseAND(1) == 1
    return found.where(F.size("o.range").isin(3, 4)).select("file", F.col("o.symbol").alias("symbol"), F.when(role, "definition").otherwise("reference").alias("role"), at(0).alias("start_line"), at(1).alias("start_column"), F.when(short, at(0)).otherwise(at(3 - 1)).alias("end_line"), F.when(short, at(2)).otherwise(F.try_element_at("o.range", F.lit(4))).alias("end_column"))


def cargo_workspace(manifests: DataFrame) -> DataFrame:
    """(crate, dependency, kind) among the crates of a workspace, from ``manifests(path, text)`` in TOML.

    A dependency counts if a manifest declares a crate of that name (or of the name it is
    renamed from); files that do not parse or declare no crate give nothing.
    """
    import tomllib

    kinds = {"dependencies": "normal", "dev-dependencies": "dev", "build-dependencies": "build"}

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                try:
                    doc = tomllib.loads(text or "")
                except (tomllib.TOMLDecodeError, RecursionError):
                    continue
                name = (doc.get("package") or {}).get("name")
                if not isinstance(name, str):
                    continue
                rows.append((name, None, None))
                for section, kind in kinds.items():
                    for k, v in (doc.get(section) or {}).items():
                        rows.append((name, v.get("package", k) if isinstance(v, dict) else k, kind))
            yield pd.DataFrame(rows, columns=["crate", "dependency", "kind"])

    found = manifests.select("path", "text").mapInPandas(run, "crate string, dependency string, kind string").distinct()
    return found.where("dependency is not null").join(found.select(F.col("crate").alias("dependency")).distinct(), "dependency", "left_semi").select("crate", "dependency", "kind")


def git_log(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(commit, parent, author, at, subject, path) of ``git log --name-only --format=%H|%P|%an|%ct|%s`` output, one text per history.

    A commit without files has a null path; of several parents the first counts.
    """
    blocks = F.split(F.col(text), r"(?m)(?=^[0-9a-f]{40}\|)")
    each = lines.select(F.col(key), F.explode(F.filter(blocks, lambda b: b.rlike(r"^[0-9a-f]{40}\|"))).alias("b"))
    head = F.split(F.substring_index("b", "\n", 1), r"\|", 5)
    paths = F.filter(F.slice(F.split("b", r"\r?\n"), 2, 1 << 20), lambda p: F.trim(p) != "")
    c = each.select(key, head.alias("h"), F.explode_outer(paths).alias("path"))
    return c.select(key, F.col("h")[0].alias("commit"), F.nullif(F.substring_index(F.col("h")[1], " ", 1), F.lit("")).alias("parent"), F.col("h")[2].alias("author"), F.expr("try_cast(h[3] as bigint)").alias("at"), F.col("h")[4].alias("subject"), "path")
