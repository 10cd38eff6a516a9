"""Evaluation texts leaking into a corpus, by latent semantic retrieval.

1. Every text is turned once into word codes, staged as packed integers.
2. Document frequencies over all documents give TF-IDF weights on hashed features, and one
   distributed sketch ``Y = A'(A Omega)`` of the passage matrix A gives its leading right
   singular vectors (randomised SVD of the Gram matrix, Nystrom form, finished on the driver
   with matrices of FEATURES x SKETCH, whose size is fixed).
3. A window of words lies in the latent space at the sum of its word vectors. Windows of the
   test items are bucketed by the signs of their coordinates, windows of all documents look
   up their buckets, and pairs of sufficient cosine go on.
4. The pairs are checked: the longest common subsequence of their words must be as long as
   asked (for verbatim passages the whole window), and the share of the item's answer that
   the document holds is measured and may be demanded.

A window that holds the same words in the same order has bit for bit the same coordinates,
as sums are taken in a fixed order, so the bucket search loses no verbatim passage.

Paraphrase search asks for a long common subsequence and for the item's answer in the document.
A latent search loses some, so it is not left to it: every document window is compared with
every item window, behind bounds that no passing pair can fall below (``Search.latent``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace
from .words import words

#: Hashed features of the term space and its sketch; both bound what the driver and each task hold.
FEATURES, SKETCH, RANK = 1 << 14, 28, 20
#: Words in a passage of the TF-IDF matrix.
PASSAGE = 40
#: Positions handled at once, which bounds a task's memory however long a text is.
CHUNK = 1 << 17
#: Item windows searched in one pass over the corpus; more are taken in further passes.
BLOCK_WINDOWS = 1 << 18
#: Masks (segments x distinct words) of the items in one pass of the paraphrase search.
BLOCK_MASKS = 1 << 22
SEED = 20


def encode(texts: DataFrame, key: str) -> DataFrame:
    """(key, codes): each text's words as packed 32-bit hashes; null and empty texts have none."""

    def run(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = words(text.as_py())
                for w in found:
                    if w not in memo:
                        memo[w] = xxhash.xxh32_intdigest(w)
                out.append(np.fromiter(map(memo.__getitem__, found), np.uint32, len(found)).tobytes())
                if len(memo) > 1_000_000:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "codes"])

    return texts.select(F.col(key).cast("bigint").alias(key), "text").mapInArrow(run, f"{key} bigint, codes binary")


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch as one array, and each row's number of words."""
    rows = batch.column(1).to_pylist()
    sizes = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
    return np.frombuffer(b"".join(rows), np.uint32), sizes


def _pieces(n: int, overlap: int):
    """Ranges of at most CHUNK positions, each reaching ``overlap`` into the next."""
    for lo in range(0, n, CHUNK):
        yield lo, min(n, lo + CHUNK + overlap)


@dataclass(frozen=True)
class LatentSpace:
    """Word vectors: TF-IDF weighted right singular vectors, one row for each hashed feature."""

    vectors: np.ndarray = field(repr=False)

    def windows(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Coordinates (RANK x windows) of every run of ``width`` words, summed in a fixed order."""
        one = np.ascontiguousarray(self.vectors[codes & (FEATURES - 1)].T)
        total, at, run, span = None, 0, one, 1
        left = width
        while left:
            if left & 1:
                part = run[:, at:]
                total = part.copy() if total is None else total[:, : part.shape[1]] + part[:, : total.shape[1]]
                at += span
            left >>= 1
            if left:
                run = run[:, :-span] + run[:, span:]
                span *= 2
        return total[:, : max(0, len(codes) - width + 1)]


def fit(encoded: DataFrame) -> LatentSpace:
    """Fit the latent space over all documents: one pass for document frequencies, one for the sketch."""

    def frequencies(batches):
        total, docs = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            codes, sizes = _unpack(batch)
            docs += len(sizes)
            feature = (codes & (FEATURES - 1)).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pairs = np.unique(owner * FEATURES + feature)
            total += np.bincount(pairs & (FEATURES - 1), minlength=FEATURES)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], docs))], names=["f", "n"])

    counts = encoded.mapInArrow(frequencies, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df, docs = np.zeros(FEATURES), 0
    for f, n in counts:
        if f < 0:
            docs = n
        else:
            df[f] = n
    idf = np.log((1 + docs) / (1 + df)) + 1
    omega = np.random.default_rng(SEED).standard_normal((FEATURES, SKETCH))
    weighted = (omega * idf[:, None]).astype(np.float32)

    def sketch(batches):
        total = np.zeros((SKETCH, FEATURES))
        for batch in batches:
            codes, sizes = _unpack(batch)
            ends = np.cumsum(sizes)
            for lo, hi in _pieces(len(codes), 0):
                feature = (codes[lo:hi] & (FEATURES - 1)).astype(np.int64)
                at = np.arange(lo, hi)
                row = np.searchsorted(ends, at, side="right")
                first = ends[row] - sizes[row]
                passage = (at - first) // PASSAGE
                new = np.empty(hi - lo, bool)
                new[0] = True
                new[1:] = (np.diff(row) != 0) | (np.diff(passage) != 0)
                starts = np.flatnonzero(new)
                number = np.cumsum(new) - 1
                projected = np.add.reduceat(weighted[feature], starts, axis=0)
                w = idf[feature]
                for j in range(SKETCH):
                    total[j] += np.bincount(feature, weights=w * projected[number, j], minlength=FEATURES)
        hit = np.flatnonzero(np.abs(total).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(hit), *(pa.array(total[j, hit]) for j in range(SKETCH))], names=["f", *(f"y{j}" for j in range(SKETCH))])

    ys = [f"y{j}" for j in range(SKETCH)]
    parts = encoded.mapInArrow(sketch, "f bigint, " + ", ".join(f"{y} double" for y in ys)).groupBy("f").agg(*[F.sum(y).alias(y) for y in ys]).toPandas()
    y = np.zeros((FEATURES, SKETCH))
    if len(parts):
        y[parts["f"].to_numpy()] = parts[ys].to_numpy()
    return LatentSpace((idf[:, None] * _leading(y, omega)).astype(np.float32))


def _leading(y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """RANK right singular vectors of A after the first, from ``Y = A'A Omega`` (Nystrom, shifted for stability)."""
    shift = np.finfo(float).eps * max(np.linalg.norm(y), 1.0)
    y = y + shift * omega
    core = omega.T @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    values = np.maximum(values, values.max() * 1e-12 + 1e-300)
    u, _, _ = np.linalg.svd(y @ (vectors / np.sqrt(values)), full_matrices=False)
    return u[:, 1 : RANK + 1]  # the first direction is what all passages share


@dataclass(frozen=True)
class Search:
    """How windows are compared.

    With ``latent``, ``tables`` sign tables of ``bits`` coordinates each bring the candidates,
    which need ``cosine``; without it all alignments are compared. In both cases a pair of
    windows passes by its common subsequence and a document by the answer it holds.
    """

    width: int = 10
    stride: int = 1
    item_stride: int = 1
    tables: int = 1
    bits: int = RANK
    cosine: float = 0.999
    common: float = 1.0  # share of the item's window in a common subsequence
    answer: float = 0.0  # share of the item's answer words that the document must hold
    latent: bool = True


VERBATIM = Search()
PARAPHRASE = Search(width=24, common=0.6, answer=0.5, latent=False)
#: The same rule behind the latent index alone; what it misses is measured in the tests.
LATENT_PARAPHRASE = Search(width=24, stride=2, tables=24, bits=10, cosine=0.84, common=0.6, answer=0.5)

#: Fixed value: what introduces the answer inside an item's text.
ANSWER = re.compile(r"(?is)\banswer\s*:\s*(.+)$")


class _Index:
    """Windows of the test items in sign buckets; small next to BLOCK_WINDOWS by construction."""

    def __init__(self, space: LatentSpace, items: list[tuple[int, np.ndarray]], how: Search):
        owner, parts, coords = [], [], []
        for k, (_, codes) in enumerate(items):
            if len(codes) < how.width:
                continue
            x = space.windows(codes, how.width)[:, :: how.item_stride]
            owner.append(np.full(x.shape[1], k))
            coords.append(x)
            parts.append(np.lib.stride_tricks.sliding_window_view(codes, how.width)[:: how.item_stride])
        self.empty = not owner
        self.how, self.space = how, space
        if self.empty:
            return
        self.owner = np.concatenate(owner)
        self.x = np.concatenate(coords, axis=1)
        self.words = np.concatenate(parts)
        self.rows = np.ascontiguousarray(self.x.T)
        self.norm = np.linalg.norm(self.x, axis=0)
        self.middle = np.median(self.x, axis=1).astype(np.float32)
        rng = np.random.default_rng(SEED + 1)
        # one table reads the signs of the coordinates themselves, exactly; further ones of random directions
        order = [None] if how.tables == 1 else [rng.standard_normal((how.bits, RANK)).astype(np.float32) for _ in range(how.tables)]
        self.tables = []
        for dims in order:
            code = self._code(self.x, dims)
            rank = np.argsort(code, kind="stable")
            known = np.zeros(1 << how.bits, bool)
            known[code] = True
            self.tables.append((dims, code[rank], rank, known))

    def _code(self, x: np.ndarray, mix: np.ndarray | None) -> np.ndarray:
        code = np.zeros(x.shape[1], np.int64)
        if mix is None:
            for j in range(self.how.bits):
                code |= (x[j] > self.middle[j]).astype(np.int64) << j
        else:
            for j, side in enumerate(mix @ x > 0):
                code |= side.astype(np.int64) << j
        return code

    def candidates(self, x: np.ndarray, at: np.ndarray):
        """(position, item window) pairs of sufficient cosine, each once a portion of bounded size."""
        mine = np.ascontiguousarray(x.T)
        norm = np.sqrt(np.einsum("ij,ij->i", mine, mine))
        span = self.x.shape[1]
        held: list[np.ndarray] = []
        waiting = 0
        for dims, sorted_codes, rank, known in self.tables:
            code = self._code(x, dims)
            hit = np.flatnonzero(known[code])
            lo = np.searchsorted(sorted_codes, code[hit], "left")
            many = np.searchsorted(sorted_codes, code[hit], "right") - lo
            upto = np.cumsum(many)
            begin = 0
            while begin < len(hit):
                done = upto[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, done + (1 << 20), "right")))
                m = many[begin:end]
                pos = np.repeat(hit[begin:end], m)
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                idx = rank[np.repeat(lo[begin:end], m) + within]
                dot = np.einsum("ij,ij->i", mine[pos], self.rows[idx])
                near = dot >= self.how.cosine * norm[pos] * self.norm[idx] - 1e-6
                held.append(pos[near] * span + idx[near])
                waiting += len(held[-1])
                begin = end
                if waiting > 1 << 22:
                    pairs = np.unique(np.concatenate(held))  # several tables bring the same pair
                    held, waiting = [], 0
                    yield at[pairs // span], pairs % span
        if waiting:
            pairs = np.unique(np.concatenate(held))
            yield at[pairs // span], pairs % span


def _common_subsequence(text: np.ndarray, at: np.ndarray, windows: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each text window and item window of at most 64 words, bit-parallel."""
    width = windows.shape[1]
    reach = np.arange(width)
    out = np.empty(len(at), np.int64)
    for lo in range(0, len(at), 4096):
        a, b = text[at[lo : lo + 4096, None] + reach], windows[idx[lo : lo + 4096]]
        equal = a[:, :, None] == b[:, None, :]
        packed = np.zeros((*equal.shape[:2], 8), np.uint8)
        bits = np.packbits(equal, axis=2, bitorder="little")
        packed[:, :, : bits.shape[2]] = bits
        masks = packed.view(np.uint64)[:, :, 0]
        v = np.full(len(equal), np.iinfo(np.uint64).max)
        for i in range(width):
            u = v & masks[:, i]
            v = (v + u) | (v - u)
        out[lo : lo + 4096] = width - np.bitwise_count(v & np.uint64((1 << width) - 1 if width < 64 else (1 << 64) - 1))
    return out


class _Segments:
    """Item words as bit masks over segments of at most 64 words; each item window lies in exactly one segment."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], how: Search):
        self.how, self.step = how, 64 - how.width + 1
        self.vocab = np.unique(np.concatenate([c for _, c, _ in items]))
        spots = [(k, at) for k, (_, c, _) in enumerate(items) if len(c) for at in range(0, max(1, len(c) - how.width + 1), self.step)]
        sizes = np.array([len(c) for _, c, _ in items])
        self.owner = np.array([k for k, _ in spots], np.int64)
        #: Words of a segment's windows (fewer in an item shorter than a window), its windows, and common words they need.
        self.width = np.minimum(how.width, sizes[self.owner])
        self.windows = np.array([min(self.step, max(1, sizes[k] - how.width + 1 - at)) for k, at in spots])
        least = np.array([next(n for n in range(w + 1) if w == 0 or n / w >= how.common) for w in range(how.width + 1)])
        self.need = np.maximum(1, least[self.width])
        self.masks = np.zeros((len(spots), len(self.vocab) + 1), np.uint64)
        for s, (k, at) in enumerate(spots):
            part = items[k][1][at : at + 64]
            np.bitwise_or.at(self.masks[s], np.searchsorted(self.vocab, part), np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        self.present = np.ascontiguousarray(self.masks.T != 0)
        self.answers = np.zeros((len(self.vocab) + 1, len(items)), np.float32)
        for k, (_, _, answer) in enumerate(items):
            self.answers[np.searchsorted(self.vocab, answer), k] = 1
        self.asked = self.answers.sum(0)

    def best(self, codes: np.ndarray, sizes: np.ndarray):
        """(rows, items, scores): the longest common subsequence over all alignments, as a share of the item's window."""
        width = self.how.width
        at = np.minimum(np.searchsorted(self.vocab, codes), len(self.vocab) - 1)
        # each text is followed by a window of words that match nothing
        starts = np.cumsum(sizes + width) - sizes - width
        word = np.full(int(np.sum(sizes + width)) + width, len(self.vocab), np.int32)
        word[np.arange(len(codes)) + np.repeat(width * np.arange(len(sizes)), sizes)] = np.where(self.vocab[at] == codes, at, len(self.vocab))
        for lo in range(0, len(sizes), 256):
            rows = np.arange(lo, min(len(sizes), lo + 256))
            held = np.zeros((len(rows), len(self.vocab) + 1), np.float32)
            own = slice(starts[lo], starts[rows[-1]] + sizes[rows[-1]] + width)
            held[np.repeat(np.arange(len(rows)), sizes[rows] + width), word[own]] = 1
            told = (held @ self.answers >= self.how.answer * self.asked) | (self.asked == 0)
            score = np.zeros(told.shape)
            for r, asked in zip(rows.tolist(), told[:, self.owner]):
                segments = np.flatnonzero(asked)
                for piece in range(0, sizes[r] if len(segments) else 0, 4096):
                    first, n = starts[r] + piece, min(4096, sizes[r] - piece)
                    # bound: words of the window that the segment holds at all
                    seen = np.zeros((n + width, len(segments)), np.int16)
                    np.cumsum(self.present[word[first : first + n + width - 1, None], segments], axis=0, dtype=np.int16, out=seen[1:])
                    pos, which = np.nonzero(seen[width:] - seen[:-width] >= self.need[segments])
                    if len(pos):
                        segment, common = self._common(word, first + pos, segments[which])
                        np.maximum.at(score[r - lo], self.owner[segment], common / self.width[segment])
            r, k = np.nonzero(score)
            yield rows[r], k, score[r, k]

    def _common(self, word: np.ndarray, at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segments, common words) of the text windows that have enough in common with a window of their segment."""
        width = self.how.width
        masks = self.masks[segment, word[at + np.arange(width)[:, None]]]
        # bound: common subsequence with the whole segment
        near = np.flatnonzero(_subsequence(masks) >= self.need[segment])
        masks, segment = masks[:, near], segment[near]
        found, commons = [segment[:0]], [near[:0]]
        shifts = np.arange(self.step, dtype=np.uint64)
        for lo in range(0, len(near), 1 << 13):
            m, s = masks[:, lo : lo + (1 << 13)], segment[lo : lo + (1 << 13)]
            full = (np.uint64(1) << self.width[s].astype(np.uint64)) - np.uint64(1)
            holds = np.bitwise_count((np.bitwise_or.reduce(m, axis=0)[:, None] >> shifts) & full[:, None]) >= self.need[s][:, None]
            n, j = np.nonzero(holds & (shifts < self.windows[s][:, None]))
            for part in range(0, len(n), 1 << 15):
                x, y = n[part : part + (1 << 15)], shifts[j[part : part + (1 << 15)]]
                common = _subsequence((m[:, x] >> y) & full[x])
                good = common >= self.need[s[x]]
                found.append(s[x[good]])
                commons.append(common[good])
        return np.concatenate(found), np.concatenate(commons)


def _subsequence(masks: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence, bit-parallel; ``masks[i]``: where the i-th word of each pair stands."""
    v = np.full(masks.shape[1], np.iinfo(np.uint64).max)
    for m in masks:
        u = v & m
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def align(encoded: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], how: Search) -> DataFrame:
    """(doc_id, item_id, score) of every document and item that pass ``how`` at any alignment."""
    names = np.array([i for i, _, _ in items], np.int64)

    def run(batches):
        index = None
        for batch in batches:
            if not any(len(c) for _, c, _ in items):
                return
            index = index or _Segments(items, how)
            codes, sizes = _unpack(batch)
            for rows, found, score in index.best(codes, sizes):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names[found]), pa.array(score, pa.float64())], names=["doc_id", "item_id", "score"])

    return encoded.mapInArrow(run, "doc_id bigint, item_id bigint, score double").withColumn("answered", F.lit(None).cast("double"))


_FOUND = "doc_id bigint, item_id bigint, score double, answered double"


def search(encoded: DataFrame, space: LatentSpace, items: list[tuple[int, np.ndarray, np.ndarray]], how: Search) -> DataFrame:
    """(doc_id, item_id, score, answered) of every document window that passes ``how``, once per pair and batch."""
    index = _Index(space, [(i, c) for i, c, _ in items], how)
    names = np.array([i for i, _, _ in items], np.int64)
    answers = [a for _, _, a in items]
    need = next(n for n in range(how.width + 1) if n / how.width >= how.common)

    def run(batches):
        for batch in batches:
            if index.empty:
                return
            ids = np.array([-1 if v is None else v for v in batch.column(0).to_pylist()], np.int64)
            absent = np.array([v is None for v in batch.column(0).to_pylist()], bool)
            codes, sizes = _unpack(batch)
            ends = np.cumsum(sizes)
            best: dict[tuple[int, int], int] = {}
            for lo, hi in _pieces(len(codes), how.width - 1):
                part = codes[lo:hi]
                if len(part) < how.width:
                    continue
                x = index.space.windows(part, how.width)
                at = np.arange(x.shape[1])
                row = np.searchsorted(ends, lo + at, side="right")
                inside = lo + at + how.width <= ends[row]
                if how.stride > 1:
                    inside &= ((lo + at - (ends[row] - sizes[row])) % how.stride == 0) | (lo + at + how.width == ends[row])
                keep = np.flatnonzero(inside)
                x = x[:, keep]
                for pos, idx in index.candidates(x, at[keep]):
                    common = _common_subsequence(part, pos, index.words, idx)
                    good = np.flatnonzero(common >= need)
                    # the longest of each document and item comes last and stays
                    good = good[np.argsort(common[good], kind="stable")]
                    longest = dict(zip(zip(row[pos[good]].tolist(), index.owner[idx[good]].tolist()), common[good].tolist()))
                    best.update({k: max(n, best.get(k, 0)) for k, n in longest.items()})
            starts = ends - sizes
            held = {(r, k): float(np.isin(answers[k], codes[starts[r] : ends[r]]).mean()) if len(answers[k]) else None for r, k in best}
            kept = [p for p in best if held[p] is None or held[p] >= how.answer]
            if kept:
                rows = np.array([r for r, _ in kept])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], mask=absent[rows]), pa.array(names[[k for _, k in kept]]), pa.array([best[p] / how.width for p in kept]), pa.array([held[p] for p in kept], pa.float64())], names=["doc_id", "item_id", "score", "answered"])

    return encoded.mapInArrow(run, _FOUND)


def leaks(documents: DataFrame, items: DataFrame, how: Search = VERBATIM) -> DataFrame:
    """``(doc_id, item_id, score, answered)``: the documents that reveal test items.

    ``VERBATIM`` finds every run of at least 10 words that stands in both texts; its score is
    1. ``PARAPHRASE`` finds windows of 24 words of which 60 % stand in a common subsequence, at
    any alignment, in documents that hold half of the words of the item's answer; its score
    is the largest such share. ``answered`` is the share of the answer's words that the
    document holds, null where an item states no answer or (for paraphrases) at all.

    The item texts are a held-out set read to the driver in blocks of BLOCK_WINDOWS windows
    or BLOCK_MASKS masks. A block is a pass over the staged word codes whose result is
    written before the next block is read, so the driver holds one block at a time.

    Defined results: null and empty texts match nothing, nor do texts shorter than a window
    in a verbatim search; in a paraphrase search they are one window, and the share is of the
    item's window. A
    repeated document or item gives its pairs once; a null ``doc_id`` is kept, a null
    ``item_id`` is ignored; empty tables give no rows.
    """
    work = Workspace(documents.sparkSession, "leakage")
    encoded = work.stage(encode(documents, "doc_id"))
    if how.latent:
        space = fit(encoded)
        one_pass = lambda block: search(encoded, space, block, how)
    else:
        one_pass = lambda block: align(encoded, block, how)
    parts, block, size = [], [], 0
    vocabulary: set[int] = set()
    for row in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        answer = ANSWER.search(row.text)
        pack = lambda ws: np.fromiter((xxhash.xxh32_intdigest(w) for w in ws), np.uint32, len(ws))
        codes = pack(words(row.text))
        block.append((row.item_id, codes, np.unique(pack(words(answer[1]))) if answer else np.empty(0, np.uint32)))
        size += len(codes)
        if not how.latent:
            vocabulary.update(codes.tolist())
        if size >= BLOCK_WINDOWS or (size // (65 - how.width) + len(block)) * len(vocabulary) >= BLOCK_MASKS:
            parts.append(work.stage(one_pass(block)))
            block, size = [], 0
            vocabulary.clear()
    parts.append(one_pass(block))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("answered").alias("answered"))
