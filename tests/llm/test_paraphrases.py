import random

import numpy as np

from nodeloom.llm import leakage
from nodeloom.llm.words import words
from nodeloom.runtime import table


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def windows(ws, n=24):
    return [ws[i : i + n] for i in range(max(1, len(ws) - n + 1))]


def brute(documents, items):
    """The rule itself: every window of the item against every window of the document."""
    out = {}
    for d, text in documents:
        dw = words(text)
        for i, item in items:
            iw, answer = words(item), leakage.ANSWER.search(item)
            asked = set(words(answer[1])) if answer else set()
            if not dw or not iw or len(asked & set(dw)) * 2 < len(asked):
                continue
            best = max(common(a, b) / len(b) for a in windows(dw) for b in windows(iw))
            if best >= 0.6:
                out[d, i] = round(best, 9)
    return out


def test_paraphrases_at_every_alignment(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda k: "w" + chr(97 + k // 26) + chr(97 + k % 26)
    fresh = lambda n: [word(rng.randrange(500)) for _ in range(n)]
    items = [(i, fresh(n) + ["answer:"] * (i % 2) + fresh(4)) for i, n in enumerate((20, 21, 27, 40, 41, 60, 61, 83, 84, 100, 5, 9))]
    texts = []
    for i, ws in items:
        for at in (0, 1, 2, 3, 5, len(ws) - 24):
            part = ws[max(0, at) : max(0, at) + 24]
            kept = sorted(rng.sample(range(len(part)), min(len(part), rng.choice((14, 15, 16)))))
            near = [w if k in kept else word(500 + rng.randrange(60)) for k, w in enumerate(part)]
            texts.append(fresh(rng.randrange(7)) + near + ws[-4:] * rng.randrange(2) + fresh(rng.randrange(9)))
    texts += [["w"], [], fresh(300), items[3][1][:18]]
    d = [(k, " ".join(t)) for k, t in enumerate(texts)]
    i = [(k, " ".join(t)) for k, t in items]
    want = brute(d, i)
    docs = spark.createDataFrame(d, "doc_id bigint, text string")
    held_out = spark.createDataFrame(i, "item_id bigint, text string")
    got = lambda: {(r.doc_id, r.item_id): round(r.score, 9) for r in leakage.leaks(docs, held_out, leakage.PARAPHRASE).collect()}
    assert got() == want and len(want) > 30 and {k for _, k in want} >= {0, 10, 11}
    monkeypatch.setattr(leakage, "BLOCK_MASKS", 1)
    assert got() == want


def test_paraphrases_of_long_texts():
    rng = np.random.default_rng(2)
    items = [(7, rng.integers(0, 1 << 30, 90).astype(np.uint32), np.empty(0, np.uint32))]
    sizes = np.array([4096 + 10, 0, 9000])
    codes = rng.integers(1 << 30, 1 << 31, sizes.sum()).astype(np.uint32)
    codes[4090:4106] = items[0][1][37:53]
    codes[-15:] = items[0][1][-15:]
    got = [(r, k, s) for rows, found, score in leakage._Segments(items, leakage.PARAPHRASE).best(codes, sizes) for r, k, s in zip(rows, found, score)]
    assert got == [(0, 0, 16 / 24), (2, 0, 15 / 24)]


def test_paraphrases_of_the_data(spark):
    d, i = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "eval_items"))
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in leakage.leaks(d, i, leakage.PARAPHRASE).collect()}
    texts, items = {r.doc_id: r.text for r in d.collect()}, {r.item_id: r.text for r in i.collect()}
    some = sorted(got)[::100]
    for p in some:
        assert brute([(p[0], texts[p[0]])], [(p[1], items[p[1]])]) == {p: got[p]}
    # the latent index with its strides and cosine found 531 of them
    assert len(got) == 763
