"""Natural questions to typed graph queries: intent, direction, seeds and bounded answers.

What a question asks is told by tables of forms and signals; one matcher reads them all.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import traverse as tr
from ..text import rank as rk

#: Confidence from which a question goes straight to a typed query.
ROUTED = 90


class Form(NamedTuple):
    """A way to ask: an opening, the operands, what stands between them or ends the question."""

    intent: str
    confidence: int
    openings: tuple[str, ...]
    between: str = ""
    endings: tuple[str, ...] = ("",)
    drops: tuple[str, ...] = ()  # what is cut off the end of the operand
    vague: int | None = None  # confidence where nothing was cut off and the operand is no single word


class Signal(NamedTuple):
    """Words that tell a direction, unless they are part of other words."""

    words: str
    way: str
    unless: str = ""


#: Forms that name a structure, in the order they are tried.
STRUCTURAL = (
    Form("trail", 100, ("shortest path from ", "path from ", "route from ", "connection from "), between=" to "),
    Form("trail", 100, ("how does ", "how can "), between=" reach "),
    Form("trail", 100, ("how is ",), between=" connected to "),
    Form("callers", 100, ("find callers of ", "show callers of ", "callers of ", "who calls ", "what calls ", "what functions call ", "what methods call ", "which functions call ", "which methods call ")),
    Form("callers", 95, ("where is ",), endings=(" called",)),
    Form("callees", 100, ("find callees of ", "show callees of ", "callees of ", "calls made by ")),
    Form("callees", 100, ("what does ", "what functions does ", "what methods does "), endings=(" call", " calls", " invoke", " invokes")),
)
#: A question with a word of both sides contradicts itself and falls back to search.
CONTRADICTIONS = ((("caller", "callers"), ("callee", "callees")), (("incoming",), ("outgoing",)))
#: Forms tried after that.
LOOSE = (
    Form("impact", 100, ("what is impacted by ", "what depends on ", "who depends on ", "what breaks if ", "what changes if ", "dependents of ", "impact of ", "what is the impact of ", "what would break if "), drops=(" changes", " changed")),
    Form("impact", 95, ("if ",), endings=(" changes, what breaks", " changes what breaks")),
    Form("search", 90, ("find definition of ", "definition of ", "search for "), drops=(" defined",)),
    Form("search", 90, ("show me ", "where is ", "where are ", "find ", "search ", "show "), drops=(" defined",), vague=60),
)
#: Words that tell a direction; the first two tables speak of the symbol, the third of its surroundings.
INCOMING = tuple(Signal(w, "in") for w in ("caller", "called by", "used by", "registered by", "enforced at", "affected by", "referenced by", "depends on this"))
OUTGOING = (*(Signal(w, "out") for w in (" calls ", " invokes ", " uses ", "implementation flow", "writes to", "calls from")), Signal("depends on", "out", "depends on this"))
AROUND = (*(Signal(w, "both") for w in ("architecture", "related", "connected", "coupling")), Signal("flow", "both", "implementation flow"))
OPENING = "how does "
#: Directions that typed intents look in.
LOOKS = {"callers": "in", "impact": "in", "callees": "out", "trail": "out"}

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Plan(NamedTuple):
    intent: str
    confidence: int
    operands: tuple[str, ...]

    @property
    def routed(self) -> bool:
        return self.confidence >= ROUTED and self.intent != "fallback"


def _bare(text: str) -> str:
    return text.strip().strip("\"'`").strip()


def _readings(form: Form, text: str) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(confidence, operands) of each way in which a text has a form."""
    low = text.translate(_LOWER)
    for opening in form.openings:
        if not low.startswith(opening):
            continue
        for ending in form.endings:
            if not low.endswith(ending) or len(text) - len(ending) <= len(opening):
                continue
            inner = text[len(opening) : len(text) - len(ending)]
            if form.between:
                at = inner.translate(_LOWER).find(form.between)
                yield form.confidence, () if at < 0 else (_bare(inner[:at]), _bare(inner[at + len(form.between) :]))
                continue
            operand = _bare(inner)
            for drop in form.drops:
                operand = _bare(operand[: -len(drop)]) if operand.translate(_LOWER).endswith(drop) else operand
            plain = form.vague is not None and operand == _bare(inner) and any(map(str.isspace, operand))
            yield form.vague if plain else form.confidence, (operand,)


def plan(question: str) -> Plan:
    """The typed query a question asks for; contradictory questions fall back to search."""
    text = question.strip().rstrip("?!.").strip()
    said = set(re.findall(r"[^\W_]+", text.translate(_LOWER)))
    torn = any(all(said.intersection(side) for side in sides) for sides in CONTRADICTIONS)
    for form in STRUCTURAL if torn else STRUCTURAL + LOOSE:
        for confidence, operands in _readings(form, text):
            if operands and all(operands):
                return Plan(form.intent, confidence, operands)
    return Plan("fallback", 0, (text,))


def _told(signals: tuple[Signal, ...], words: str) -> set[str]:
    return {s.way for s in signals if s.words in words and not (s.unless and s.unless in words)}


def direction(question: str) -> str:
    """in, out or both.

    Four ballots are held, and the first with a vote decides, unanimously or for both: signals
    of the symbol that contradict each other, the typed intent, signals of the surroundings,
    and the signals of the symbol with the question's opening.
    """
    words = f" {' '.join(re.findall(r'[^\W_]+', question.translate(_LOWER)))} "
    spoken = _told(INCOMING + OUTGOING, words)
    asked = plan(question)
    ballots = (
        spoken if len(spoken) > 1 else set(),
        {LOOKS[asked.intent]} if asked.routed and asked.intent in LOOKS else set(),
        _told(AROUND, words),
        spoken | ({"out"} if words.lstrip().startswith(OPENING) else set()),
    )
    votes = next(filter(None, ballots), {"both"})
    return votes.pop() if len(votes) == 1 else "both"


def routes(questions: DataFrame, text: str = "question") -> DataFrame:
    """``questions`` with intent, confidence, operands and direction of each text, in Arrow batches.

    A null text is asked like an empty one: fallback, and both directions.
    """

    @F.pandas_udf("intent string, confidence int, operands array<string>, direction string")
    def route(texts: pd.Series) -> pd.DataFrame:
        plans = [(plan(t or ""), direction(t or "")) for t in texts]
        return pd.DataFrame([(p.intent, p.confidence, list(p.operands), way) for p, way in plans], columns=["intent", "confidence", "operands", "direction"])

    return questions.withColumn("_route", route(F.col(text))).select(*questions.columns, "_route.*")


def scoped(graph: PropertyGraph, *, community: int | None = None, source: str | None = None, package: str | None = None, node: str | None = None) -> PropertyGraph:
    """The graph within a community, a file, a directory or around a node."""
    n = graph.nodes
    if community is not None:
        n = n.where(F.col("community_id") == community)
    if source is not None:
        n = n.where(F.col("source_file") == source)
    if package is not None:
        n = n.where(F.startswith("source_file", F.lit(package.rstrip("/") + "/")))
    if node is not None:
        near = tr.directed(graph, None, "both").where(F.col("here") == node).select(F.col("there").alias("id")).unionByName(graph.nodes.where(F.col("id") == node).select("id")).distinct()
        n = n.join(near, "id", "left_semi")
    return PropertyGraph(n, graph.edges).drop_dangling()


def answer(graph: PropertyGraph, question: str, max_nodes: int = 64) -> DataFrame:
    """(node, depth, role): the nodes that answer a question.

    A routed question runs its typed query; others take up to three best-ranked nodes as
    seeds and return their bounded neighbourhood in the question's direction.
    """
    p = plan(question)
    spark = graph.spark
    if p.routed and p.intent != "search":
        wanted = spark.createDataFrame([(o,) for o in p.operands], "symbol string")
        ids = {r.symbol: r.id for r in tr.resolve_symbol(graph.nodes, wanted).collect()}
        known = [ids.get(o) for o in p.operands]
        if all(known):
            if p.intent == "trail":
                t = tr.trails(graph, spark.createDataFrame([tuple(known)], "a string, b string"))
                return t.select(F.posexplode("path").alias("depth", "node")).select("node", "depth", F.lit("trail").alias("role"))
            seeds = spark.createDataFrame([(known[0], known[0])], "root string, node string")
            if p.intent == "impact":
                reach = tr.impact(graph, seeds)
            else:
                types, way = (tr.CALLER_TYPES, "in") if p.intent == "callers" else (tr.CALLEE_TYPES, "out")
                reach = tr.closure(tr.directed(graph, types, way), seeds, 1)
            return reach.where("depth > 0").select("node", "depth", F.lit(p.intent).alias("role")).orderBy("depth", "node").limit(max_nodes)
    asked = spark.createDataFrame([(1, question)], "query_id int, text string")
    best = rk.bm25(graph.nodes, asked, 3).select(F.col("id").alias("root"), F.col("id").alias("node"))
    nodes, _ = tr.discover(graph, best, direction(question), max_nodes=max_nodes)
    return nodes.groupBy("node").agg(F.min("depth").alias("depth")).withColumn("role", F.when(F.col("depth") == 0, "seed").otherwise("neighbour")).orderBy("depth", "node").limit(max_nodes)
