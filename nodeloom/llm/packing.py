"""Documents into fixed-capacity windows by planning over the histogram of lengths.

Best-fit decreasing runs on counts, not on documents: windows with equal contents are one
entry with a multiplicity, so the planner's work depends on the capacity alone. Documents
then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace

#: Ranks are counted inside hash buckets of about this many documents of one length.
BUCKET_ROWS = 500_000
#: Slots and documents of one length meet by blocks of this many ranks.
BLOCK_RANKS = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Pieces(dict):
    """Number of tokens of each piece of text, remembered for short pieces."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # texts come here in pieces already, so that a piece, however long, is merged as a whole
        self.encode = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[piece] = n
        return n


_loaded: dict[str, _Pieces] = {}


def count_tokens(path: str, text: str | None) -> int:
    """Tokens of a whole text: the tokenizer's pattern splits it, its ranks merge each piece."""
    if not text:
        return 0
    if path not in _loaded:
        _loaded[path] = _Pieces(path)
    pieces = _loaded[path]
    return sum(map(pieces.__getitem__, pieces.split(text)))


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each whole text; null and empty texts have 0 tokens."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            counts = [count_tokens(path, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


@dataclass(frozen=True)
class Slots:
    """Ranks ``start`` and up of one length go to window ``first`` and up, ``each`` to a window."""

    length: int
    start: int
    first: int
    each: int
    offset: int


def plan_windows(histogram: dict[int, int], capacity: int, first_window: int = 0) -> tuple[list[Slots], int]:
    """Best-fit decreasing over (length -> count); returns the slots and the number of windows.

    Lengths must be in 1..capacity. Open windows are kept by the room they have left, as
    runs of equal windows; a length takes the runs with the least sufficient room first and
    splits at most one run in two kinds, so the plan has O(distinct lengths) entries a length.
    """
    slots: list[Slots] = []
    taken: dict[int, int] = {}
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first window, count)
    sizes: list[int] = []  # the rooms in use, ascending
    windows = first_window

    def open_run(left: int, first: int, count: int) -> None:
        if left > 0 and count:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((first, count))

    def fill(length: int, left: int, first: int, count: int, todo: int) -> int:
        """Put up to ``todo`` items into ``count`` equal windows; returns how many went in."""
        each = left // length
        full = min(count, todo // each)
        for n, k in ((full, each), (1 if full < count and todo - full * each else 0, todo - full * each)):
            if n and k:
                slots.append(Slots(length, taken.get(length, 0), first, k, capacity - left))
                taken[length] = taken.get(length, 0) + n * k
                open_run(left - k * length, first, n)
                first, count, todo = first + n, count - n, todo - n * k
        open_run(left, first, count)
        return todo

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        while todo and (at := bisect_left(sizes, length)) < len(sizes):
            left = sizes.pop(at)
            runs = room.pop(left)
            while runs and todo:
                first, count = runs.pop()
                todo = fill(length, left, first, count, todo)
            for first, count in runs:
                open_run(left, first, count)
        if todo:
            count = math.ceil(todo / (capacity // length))
            fill(length, capacity, windows, count, todo)
            windows += count
    return slots, windows - first_window


def pack(documents: DataFrame, budgets: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """``(budget_id, capacity, window_id, doc_id, piece_no, first_token, n_tokens, window_offset)``.

    One row for each piece of each text and budget: tokens ``first_token`` up to
    ``first_token + n_tokens`` of the text lie in that window from ``window_offset`` on. A
    text within the capacity is one piece; a longer one is cut into full windows and one
    rest, which is packed like a short text.

    The budgets are configuration: a handful of rows read to the driver, as are the length
    histograms, which have at most ``capacity`` rows each. The slots of a plan are written
    as a table and meet the documents in a range join: by length and block of ranks, then by
    rank. A length that many documents share is spread over its blocks, and Catalyst may
    broadcast the slots only where their written size allows it.

    Defined results: texts without tokens (null and empty ones too) are placed with 0 tokens,
    spread over the windows; budgets with a null or non-positive capacity are ignored; equal
    texts are placed separately; a null ``doc_id`` is placed like any other; no documents
    give no rows.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "packing")
    wanted = [(r.budget_id, r.capacity) for r in budgets.select("budget_id", "capacity").distinct().collect() if r.capacity and r.capacity > 0]
    counted, seen = work.stage_counted(token_counts(documents, tokenizer), n=F.count(F.lit(1)))
    budget = F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in wanted])) if wanted else F.explode(F.array().cast("array<struct<budget_id:bigint,capacity:bigint>>"))
    asked = counted.select("doc_id", "n_tokens", budget.alias("b")).select("doc_id", "n_tokens", "b.*")
    whole = F.expr("n_tokens div capacity")
    rest = F.when(F.col("n_tokens") <= F.col("capacity"), F.col("n_tokens")).otherwise(F.col("n_tokens") % F.col("capacity"))
    over = F.when(F.col("n_tokens") > F.col("capacity"), whole).otherwise(F.lit(0).cast("bigint"))
    pieces = asked.select("budget_id", "capacity", "doc_id", "n_tokens", rest.alias("len"), over.alias("full"))

    buckets = max(1, math.ceil(seen["n"] / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(buckets))
    short = pieces.where("len > 0 or n_tokens = 0").withColumn("bucket", bucket)
    counts = work.stage(short.groupBy("budget_id", "len", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("budget_id", "len").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault(r.budget_id, {})[r.len] = r.n
    plan, totals = [], {}
    for b, c in wanted:
        of_length = histogram.get(b, {})
        lengths = {k: n for k, n in of_length.items() if k > 0}
        slots, n = plan_windows(lengths, c)
        if of_length and not n:
            n = 1
        totals[b] = n
        ends: dict[int, int] = {}  # slots of a length follow each other, so each ends where the next starts
        for s in reversed(slots):
            plan.append((b, s.length, s.start, ends.get(s.length, of_length[s.length]), s.first, s.each, s.offset))
            ends[s.length] = s.start
        if 0 in of_length:
            plan.append((b, 0, 0, of_length[0], 0, math.ceil(of_length[0] / n), 0))

    steps = work.stage(spark.createDataFrame(plan, "budget_id bigint, len bigint, start bigint, upto bigint, first bigint, each bigint, offset bigint"))
    block = lambda c: F.expr(f"({c}) div {BLOCK_RANKS}")
    steps = steps.withColumn("block", F.explode(F.sequence(block("start"), block("upto - 1"))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("budget_id", "len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = short.withColumn("k", F.row_number().over(Window.partitionBy("budget_id", "len", "bucket").orderBy("doc_id")) - 1)
    ranked = ranked.join(counts.select("budget_id", "len", "bucket", before.alias("before")), ["budget_id", "len", "bucket"])
    ranked = ranked.withColumn("rank", F.col("k") + F.col("before")).withColumn("block", block("rank"))
    placed = ranked.join(steps, ["budget_id", "len", "block"]).where("start <= rank and rank < upto")
    into = (F.col("rank") - F.col("start")) % F.col("each")
    of_short = placed.select(
        "budget_id",
        "capacity",
        (F.col("first") + F.expr("(rank - start) div each")).alias("window_id"),
        "doc_id",
        F.col("full").alias("piece_no"),
        (F.col("full") * F.col("capacity")).alias("first_token"),
        F.col("len").alias("n_tokens"),
        (F.col("offset") + into * F.col("len")).alias("window_offset"),
    )

    # full windows of long texts are numbered after the planned ones, by position in the same order of ranks
    long = pieces.where("full > 0").withColumn("bucket", bucket)
    sums = work.stage(long.groupBy("budget_id", "bucket").agg(F.sum("full").alias("n")))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("budget_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("full").over(Window.partitionBy("budget_id", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.coalesce(*[F.when(F.col("budget_id") == b, F.lit(n)) for b, n in totals.items()], F.lit(0)) if totals else F.lit(0)
    of_long = (
        long.withColumn("inside", inside)
        .join(sums.select("budget_id", "bucket", ahead.alias("ahead")), ["budget_id", "bucket"])
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
        .select("budget_id", "capacity", (base + F.col("ahead") + F.col("inside") + F.col("piece_no")).alias("window_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"), F.lit(0).cast("bigint").alias("window_offset"))
    )
    return of_short.unionByName(of_long)


def window_fill(packed: DataFrame) -> DataFrame:
    """Per budget: windows, tokens placed, and the share of unused space."""
    by = packed.groupBy("budget_id", "capacity").agg(F.countDistinct("window_id").alias("windows"), F.sum("n_tokens").alias("tokens"))
    return by.select("*", F.round(1 - F.col("tokens") / (F.col("windows") * F.col("capacity")), 6).alias("unused"))


def invariants(packed: DataFrame, least_use: float = 0.99) -> DataFrame:
    """Per budget: documents placed, windows overfull or with gaps, documents split in vain, and whether ``least_use`` of the space is used.

    A placement by the rules has all documents, 0, 0 and true. One window may be left over
    beyond that share.
    """
    windows = packed.groupBy("budget_id", "capacity", "window_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("window_offset") + F.col("n_tokens")).alias("end"))
    w = windows.groupBy("budget_id", "capacity").agg(F.count_if((F.col("n") > F.col("capacity")) | (F.col("n") != F.col("end"))).alias("bad_windows"), (F.sum("n") >= (F.count(F.lit(1)) - 1) * F.col("capacity") * least_use).alias("tight"))
    docs = packed.groupBy("budget_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    fair = F.when(F.col("n") <= F.col("capacity"), 1).otherwise(F.ceil(F.col("n") / F.col("capacity")))
    d = docs.groupBy("budget_id", "capacity").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") != fair).alias("bad_splits"))
    return d.join(w, ["budget_id", "capacity"]).select("budget_id", "capacity", "documents", "bad_windows", "bad_splits", "tight")
