"""Semantic comparison of two versions of a program: findings per symbol, with who is affected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.traverse import closure
from . import PRIORITY, contract_changes


def operation_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol_id, kind, path, change): operations gained and lost, of ``(symbol_id, kind, path)``.

    Both sides meet in one aggregation by the whole row, so a symbol with any number of
    operations is spread over them; repeats count once.
    """
    mark = lambda df, m: df.select("symbol_id", "kind", "path").distinct().withColumn("mark", F.lit(m))
    both = mark(old, -1).unionByName(mark(new, 1)).groupBy("symbol_id", "kind", "path").agg(F.sum("mark").alias("d"))
    return both.where("d != 0").select("symbol_id", "kind", "path", F.when(F.col("d") > 0, "gained").otherwise("lost").alias("change"))


def behavior(old: DataFrame, new: DataFrame, old_operations: DataFrame, new_operations: DataFrame) -> DataFrame:
    """(symbol_id, verdict, gained, lost) of symbols in both versions whose bodies differ.

    ``changed`` where operations differ, by how many; ``indeterminate`` where they are the
    same or one side has none on record.
    """
    both = old.select("symbol_id", F.col("body_digest").alias("o")).join(new.select("symbol_id", F.col("body_digest").alias("n")), "symbol_id").where(~F.col("o").eqNullSafe(F.col("n"))).select("symbol_id")
    has = lambda df, c: df.select("symbol_id").distinct().withColumn(c, F.lit(True))
    delta = operation_changes(old_operations, new_operations).groupBy("symbol_id").agg(F.count_if(F.col("change") == "gained").alias("gained"), F.count_if(F.col("change") == "lost").alias("lost"))
    all_ = both.join(delta, "symbol_id", "left").join(has(old_operations, "x"), "symbol_id", "left").join(has(new_operations, "y"), "symbol_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    told = F.col("x").isNotNull() & F.col("y").isNotNull() & (z("gained") + z("lost") > 0)
    return all_.select("symbol_id", F.when(told, "changed").otherwise("indeterminate").alias("verdict"), z("gained").alias("gained"), z("lost").alias("lost"))


def compare(old: DataFrame, new: DataFrame, old_operations: DataFrame, new_operations: DataFrame, tests: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(symbol_id, finding, compatibility, consumers, tested, priority), a row per finding.

    ``old`` and ``new`` are contracts (``symbol_id, language, visibility, execution_mode,
    return_type, complete, body_digest, parameters``), the operations ``(symbol_id, kind,
    path)``, ``tests(symbol_id)`` the symbols that a test covers. A new symbol is a structural
    finding, a lost one a contract finding that breaks what was public; then come changed
    contracts, changed behaviour and dependencies (other modules read or imported) gained or
    lost. ``consumers`` are the transitive callers in either version. A finding no test covers
    brings a verification gap.
    """
    fresh = new.join(old.select("symbol_id"), "symbol_id", "left_anti").select("symbol_id", F.lit("structural").alias("finding"), F.lit("compatible").alias("compatibility"))
    gone = old.join(new.select("symbol_id"), "symbol_id", "left_anti").select("symbol_id", F.lit("contract").alias("finding"), F.when(F.col("visibility") == "public", "proven_break").otherwise("possible_break").alias("compatibility"))
    contracts = contract_changes(old, new).select("symbol_id", F.lit("contract").alias("finding"), "compatibility")
    acts = behavior(old, new, old_operations, new_operations).select("symbol_id", F.lit("behavior").alias("finding"), F.when(F.col("verdict") == "changed", "behavioral").otherwise("indeterminate").alias("compatibility"))
    needs = operation_changes(old_operations, new_operations).where("kind = 'dependency'").select("symbol_id", F.lit("dependency").alias("finding"), F.when(F.col("change") == "gained", "compatible").otherwise("possible_break").alias("compatibility")).distinct()
    findings = fresh.unionByName(gone).unionByName(contracts).unionByName(acts).unionByName(needs)
    calls = old_operations.unionByName(new_operations).where("kind = 'call'").select(F.col("path").alias("here"), F.col("symbol_id").alias("there"), F.lit("").alias("eid"), F.lit("CALLS").alias("type")).distinct()
    reach = closure(calls, findings.select(F.col("symbol_id").alias("root"), F.col("symbol_id").alias("node")).distinct(), max_depth)
    consumers = reach.where("depth > 0").groupBy(F.col("root").alias("symbol_id")).agg(F.count(F.lit(1)).alias("consumers"))
    covered = tests.select("symbol_id").distinct().withColumn("tested", F.lit(True))
    known = findings.join(consumers, "symbol_id", "left").join(covered, "symbol_id", "left").select("symbol_id", "finding", "compatibility", F.coalesce("consumers", F.lit(0)).alias("consumers"), F.coalesce("tested", F.lit(False)).alias("tested"))
    gaps = known.where("not tested").select("symbol_id", F.lit("verification_gap").alias("finding"), F.lit("not_applicable").alias("compatibility"), "consumers", "tested").distinct()
    base = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("finding"))
    return known.unionByName(gaps).select("*", (base + F.least(F.col("consumers"), F.lit(100))).alias("priority"))


def sarif(findings: DataFrame, places: DataFrame) -> DataFrame:
    """(ord, key, line): a SARIF log, a result a line; ``places(symbol_id, source_file, start_line)`` say where.

    Lines joined in order are one JSON document. Breaks are errors, possible ones warnings,
    the rest notes.
    """
    from ..graph import with_index

    spark = findings.sparkSession
    level = F.when(F.col("compatibility") == "proven_break", "error").when(F.col("compatibility").isin("possible_break", "behavioral"), "warning").otherwise("note")
    uri = F.struct(F.struct(F.col("source_file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region"))
    where = F.when(F.col("source_file").isNotNull(), F.array(F.struct(uri.alias("physicalLocation"))))
    result = F.to_json(F.struct(F.col("finding").alias("ruleId"), level.alias("level"), F.struct(F.concat("symbol_id", F.lit(": "), "finding", F.lit(", "), "compatibility").alias("text")).alias("message"), where.alias("locations")))
    each = with_index(findings.join(places.dropDuplicates(["symbol_id"]), "symbol_id", "left").select(F.concat_ws("|", "symbol_id", "finding", "compatibility").alias("key"), result.alias("line")), "key", "line", name="k")
    lines = each.select(F.lit(1).alias("ord"), F.format_string("%020d", "k").alias("key"), F.concat(F.when(F.col("k") > 0, ",").otherwise(""), "line").alias("line"))
    rules = ",".join(f'{{"id":"{x}"}}' for x in PRIORITY)
    frame = spark.createDataFrame([(0, "", '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"nodeloom","rules":[' + rules + ']}},"results":['), (2, "", "]}]}")], "ord int, key string, line string")
    return frame.unionByName(lines)


def review_lines(findings: DataFrame, markdown: bool = False) -> DataFrame:
    """(ord, key, line): a review as plain text or Markdown, worst findings first, counts per kind on top."""
    counts = findings.groupBy("finding").agg(F.count(F.lit(1)).alias("n"))
    head = counts.select(F.lit(0).alias("ord"), F.col("finding").alias("key"), F.concat(F.lit("- " if markdown else ""), "finding", F.lit(": "), "n").alias("line"))
    key = F.concat(F.format_string("%05d", 99999 - F.col("priority")), F.lit("|"), "symbol_id", F.lit("|"), "finding")
    name = F.concat(F.lit("`"), "symbol_id", F.lit("`")) if markdown else F.col("symbol_id")
    row = F.concat(F.lit("- " if markdown else "  "), name, F.lit(" "), "finding", F.lit(" ("), "compatibility", F.lit(", "), "consumers", F.lit(" consumers"), F.when(F.col("tested"), "").otherwise(", untested"), F.lit(")"))
    return head.unionByName(findings.select(F.lit(1).alias("ord"), key.alias("key"), row.alias("line")))
