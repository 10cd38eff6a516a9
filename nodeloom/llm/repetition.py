"""Repetition inside single documents: a ledger of rule measurements and failure bits.

Every rule is measured once per document. The ledger keeps the measurements and one bitmask
of the rules that fail at their thresholds; policies are versioned sets of rules applied to
the mask alone, and ablations are aggregations of masks. A ledger is stored once under the
version of its rules (``store``); policies and ablations run on the stored rows, so no text
is read again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import words

#: Length of the word runs whose repetition counts.
RUN = 6


@dataclass(frozen=True)
class Rule:
    """A measurement and the share from which on a document fails."""

    name: str
    threshold: float
    inclusive: bool = False


#: In bit order; new rules are only ever appended, so that stored masks keep their meaning.
RULES = (
    Rule("repeated_words", 0.30, inclusive=True),
    Rule("duplicate_lines", 0.30),
    Rule("duplicate_line_chars", 0.20),
    Rule("duplicate_paragraphs", 0.30),
    Rule("duplicate_sentences", 0.30),
    Rule("top_bigram", 0.20),
    Rule("top_trigram", 0.18),
    Rule("top_fourgram", 0.16),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Version of the rules; raised whenever a rule, a threshold or the way of measuring changes.
RULES_VERSION = 2

#: Policy versions: a document is rejected if a rule of the policy fails.
POLICIES = {
    "runs/1": ("repeated_words",),
    "lines/1": ("duplicate_lines", "duplicate_line_chars", "duplicate_paragraphs"),
    "full/1": tuple(r.name for r in RULES),
}


def repeated_share(tokens: list[str], run: int = RUN) -> tuple[int, int]:
    """Number of words, and of words that lie in a run that also starts earlier.

    Long documents cost linear time and memory: runs are compared exactly, as pairs of
    integers that hold three word numbers each.
    """
    n = len(tokens)
    if n <= run:
        return n, 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, n)
    m = n - run + 1
    span = len(numbers) + 1
    keys = ids[:m]
    width = span
    for j in range(1, run):
        if width > (1 << 62) // span:  # renumber before the key could overflow
            _, keys = np.unique(keys, return_inverse=True)
            width = int(keys.max()) + 1
        keys = keys * span + ids[j : j + m]
        width *= span
    order = np.argsort(keys, kind="stable")
    again = np.empty(m, bool)
    again[order[:1]] = False
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    if not again.any():
        return n, 0
    cover = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    return n, int((np.cumsum(cover[:-1]) > 0).sum())


def _duplicates(parts: list[str]) -> tuple[float, float]:
    """Shares of parts, and of their characters, that repeat an earlier part."""
    if len(parts) < 2:
        return 0.0, 0.0
    counts = Counter(parts)
    if len(counts) == len(parts):
        return 0.0, 0.0
    chars = sum(map(len, parts))
    return 1 - len(counts) / len(parts), sum((c - 1) * len(p) for p, c in counts.items()) / chars


def _top(tokens: list[str], chars: int, n: int) -> float | None:
    """Share of the words' characters in occurrences of the most frequent n-gram; None if none is seen twice.

    Of several n-grams that are the most frequent, the first in the text counts.
    """
    if len(tokens) <= n:
        return None
    counts = Counter(zip(*(tokens[i:] for i in range(n))))
    if len(counts) == len(tokens) - n + 1:
        return None
    gram, count = max(counts.items(), key=itemgetter(1))
    return min(1.0, count * sum(map(len, gram)) / chars)


def measure(text: str | None) -> list[float]:
    """The numbers of words and of repeated words, and each rule's measurement."""
    text = text or ""
    tokens = words(text)
    n, repeated = repeated_share(tokens)
    lines = [x for x in (y.strip() for y in text.splitlines()) if x]
    paragraphs = text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")
    sentences = text.replace("!", ".").replace("?", ".").replace("\n", " ").split(". ")
    same_lines, same_line_chars = _duplicates(lines)
    same_paragraphs, _ = _duplicates([x for x in (y.strip() for y in paragraphs) if x])
    same_sentences, _ = _duplicates([x for x in (y.strip(" .") for y in sentences) if x])
    out = [n, repeated, repeated / n if n else 0.0, same_lines, same_line_chars, same_paragraphs, same_sentences]
    chars = sum(map(len, tokens))
    share: float | None = 0.0
    for k in (2, 3, 4):
        # where no n-gram is seen twice, no longer one is
        share = None if share is None else _top(tokens, chars, k)
        out.append(share or 0.0)
    return out


LEDGER_SCHEMA = "doc_id bigint, n_words bigint, repeated bigint, " + ", ".join(f"{r.name} double" for r in RULES)


def ledger(documents: DataFrame) -> DataFrame:
    """One row per document: word counts, each rule's measurement, and ``failed``, the bitmask.

    One narrow pass without a shuffle, in which every rule is evaluated.

    Defined results: null and empty texts have no words, share 0 and no failures; documents
    delivered repeatedly have a row each; nulls in other columns do not matter.
    """
    types = [pa.int64()] * 3 + [pa.float64()] * len(RULES)
    names = ["doc_id", "n_words", "repeated", *(r.name for r in RULES)]

    def run(batches):
        for batch in batches:
            got = [measure(t.as_py()) for t in batch.column(1)]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*got), types[1:]))], names=names)

    measured = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, LEDGER_SCHEMA)
    mask: Column = F.lit(0)
    for r in RULES:
        c = F.col(r.name)
        # exact at the threshold: shares of words are compared as integers
        fails = (F.col("repeated") * 100 >= F.col("n_words") * round(r.threshold * 100)) & (F.col("n_words") > 0) if r.name == "repeated_words" else (c >= r.threshold if r.inclusive else c > r.threshold)
        mask = mask.bitwiseOR(F.when(fails, F.lit(BIT[r.name])).otherwise(F.lit(0)))
    return measured.withColumn("failed", mask)


def store(marked: DataFrame, folder: str) -> DataFrame:
    """Write a ledger under the version of its rules, once, and return it as read back.

    A version that is already there is an error: measurements of one version never change.
    """
    marked.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/rules={RULES_VERSION}")
    return stored(marked.sparkSession, folder)


def stored(spark: SparkSession, folder: str, version: int = RULES_VERSION) -> DataFrame:
    """A stored ledger; policies and ablations run on its masks."""
    return spark.read.schema(LEDGER_SCHEMA + ", failed int").parquet(f"{folder}/rules={version}")


def policy_mask(policy: str) -> int:
    return sum(BIT[x] for x in POLICIES[policy])


def rejected(marked: DataFrame, policy: str) -> DataFrame:
    """The ledger rows that a policy version rejects, decided by the masks alone."""
    return marked.where(F.col("failed").bitwiseAND(policy_mask(policy)) != 0)


def ablations(marked: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it fails, fails alone, and would be rejected without it.

    Masks are grouped first (at most 2^rules groups), so the corpus is aggregated once.
    """
    full = policy_mask(policy)
    masks = marked.groupBy(F.col("failed").bitwiseAND(full).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    total = {}
    for name in POLICIES[policy]:
        bit = BIT[name]
        has = F.col("m").bitwiseAND(bit) != 0
        rest = F.col("m").bitwiseAND(full & ~bit) != 0
        total[name] = F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("fails"), F.coalesce(F.sum(F.when(has & ~rest, F.col("n"))), F.lit(0)).alias("fails_alone"), F.coalesce(F.sum(F.when(rest, F.col("n"))), F.lit(0)).alias("rejected_without"))
    return masks.agg(F.array(*total.values()).alias("rules")).select(F.explode("rules").alias("r")).select("r.*")
