"""Registered queries of the text and consolidation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import Workspace, table
from ..text import tokens as tk
from . import consolidate, leakage, packing, repetition, words


def _groups(spark, d):
    return consolidate.connected_groups(consolidate.matched_pairs(table(spark, d, "ambiguous_pairs")))


def p5_found(spark, d):
    return _groups(spark, d)


def p5_merges(spark, d):
    return consolidate.fuzzy_merges(_groups(spark, d))


def p5_merges_per_run(spark, d):
    """Records a run judged that are merged away, next to the count the run reported."""
    groups = _groups(spark, d)
    pairs = table(spark, d, "ambiguous_pairs").where("score >= 92 and left_id != right_id")
    judged = pairs.select("run_id", F.explode(F.array("left_id", "right_id")).alias("record_id")).distinct()
    per = judged.join(groups, "record_id").groupBy("run_id").agg((F.count(F.lit(1)) - F.countDistinct("group_id")).alias("fuzzy_merges"))
    runs = table(spark, d, "dedup_runs").select("run_id", F.col("fuzzy_merges").alias("reported"))
    return runs.join(per, "run_id", "left").select("run_id", F.coalesce("fuzzy_merges", F.lit(0)).alias("merges"), "reported")


def p7_windows(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p7_fill(spark, d):
    return packing.window_fill(p7_windows(spark, d))


def p7_invariants(spark, d):
    return packing.invariants(Workspace(spark, "packed").stage(p7_windows(spark, d)))


def p8_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_paraphrases(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), leakage.PARAPHRASE).select("doc_id", "item_id", F.round("score", 4).alias("score"))


def _ledger(spark, d):
    """The ledger of all documents, evaluated by every rule and stored once."""
    return repetition.store(repetition.ledger(table(spark, d, "documents")), Workspace(spark, "ledger").root)


def p9_found(spark, d):
    return repetition.rejected(_ledger(spark, d), "runs/1").select("doc_id")


def p9_ledger(spark, d):
    return _ledger(spark, d).select("doc_id", "n_words", "repeated", *[F.round(r.name, 6).alias(r.name) for r in repetition.RULES], "failed")


def p9_ablations(spark, d):
    return repetition.ablations(_ledger(spark, d), "full/1")


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_merges, p5_merges_per_run, p7_windows, p7_fill, p7_invariants, p8_found, p8_paraphrases, p9_found, p9_ledger, p9_ablations)}


_GROUPS = """
WITH RECURSIVE p AS (SELECT DISTINCT left_id a, right_id b FROM ambiguous_pairs WHERE score >= 92 AND left_id <> right_id),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT min(b) AS group_id, a AS record_id FROM r GROUP BY a)
"""


def _words_sql(table_name: str, key: str) -> str:
    """CTE (key, ws): the words of each text. Compatible characters are unified one by one, which leaves out only those that stand for several letters."""
    old, new = (x.replace("'", "''") for x in tk._COMPATIBLE)
    removed = "".join(map(chr, words.REMOVED))
    return f"SELECT {key}, regexp_extract_all(lower(regexp_replace(translate(text, '{old}', '{new}'), '[{removed}]', '', 'g')), '\\p{{L}}+') AS ws FROM {table_name} WHERE text IS NOT NULL"


def _grams_sql(rel: str, key: str, n: int) -> str:
    return f"SELECT {key}, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, greatest(len(ws) - {n - 2}, 1)::BIGINT)) AS i FROM {rel})"


def oracle_sql() -> dict[str, str]:
    return {
        "p7_invariants": "SELECT budget_id, capacity::BIGINT AS capacity, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS bad_windows, 0::BIGINT AS bad_splits, true AS tight FROM token_budgets",
        "p8_found": f"WITH d AS ({_words_sql('documents', 'doc_id')}), e AS ({_words_sql('eval_items', 'item_id')}), dg AS ({_grams_sql('d', 'doc_id', 10)}), eg AS ({_grams_sql('e', 'item_id', 10)}) SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)",
        "p9_found": f"WITH w AS ({_words_sql('documents', 'doc_id')}), g AS ({_grams_sql('w', 'doc_id', 6)}), a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS again FROM g), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 6)) AS k FROM a WHERE again), n AS (SELECT doc_id, count(*) AS k FROM c GROUP BY doc_id) SELECT doc_id FROM n JOIN w USING (doc_id) WHERE n.k * 10 >= len(ws) * 3",
        "p5_found": _GROUPS + "SELECT group_id, record_id FROM g",
        "p5_merges": _GROUPS + 'SELECT count(DISTINCT group_id) AS "groups", count(*) AS records, count(*) - count(DISTINCT group_id) AS merges FROM g',
        "p5_merges_per_run": _GROUPS
        + """, j AS (SELECT DISTINCT run_id, x AS record_id FROM (SELECT run_id, unnest([left_id, right_id]) AS x FROM ambiguous_pairs WHERE score >= 92 AND left_id <> right_id)),
        m AS (SELECT run_id, count(*) - count(DISTINCT group_id) AS merges FROM j JOIN g USING (record_id) GROUP BY run_id)
        SELECT run_id, coalesce(merges, 0) AS merges, fuzzy_merges AS reported FROM dedup_runs LEFT JOIN m USING (run_id)""",
    }
