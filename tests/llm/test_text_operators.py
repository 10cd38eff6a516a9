import random

import pytest

from nodeloom.llm import consolidate, leakage, packing, repetition
from nodeloom.llm.words import words
from nodeloom.runtime import table

DOCS = "doc_id bigint, text string, codes string, capacity int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)


def test_words():
    assert words("Ein­fall ﬁne X1y2 É__é") == ["einfall", "fine", "x", "y", "é", "é"]
    assert words(None) == [] and words("123 ​") == []


def groups_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(find(x), x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_groups(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"{rng.randrange(200):03}", f"{rng.randrange(200):03}") for _ in range(120)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("hub", f"h{i}") for i in range(300)] + [(None, "x"), ("y", None), ("z", "z"), ("", "e")]
    df = spark.createDataFrame(pairs + pairs[:30] + [(b, a) for a, b in pairs[:30]], "left_id string, right_id string")
    got = [tuple(r) for r in consolidate.connected_groups(df).collect()]
    assert set(got) == groups_of(pairs) and len(got) == len(set(got))
    assert consolidate.connected_groups(df.limit(0)).count() == 0


def test_matched_pairs(spark):
    rows = [("a", "b", 92.0), ("b", "a", 10.0), ("c", "d", 91.99), ("e", "f", None), ("g", "g", 99.0), (None, "h", 99.0), ("i", "j", float("nan"))]
    df = spark.createDataFrame(rows, "left_id string, right_id string, score double")
    assert [tuple(r) for r in consolidate.matched_pairs(df).collect()] == [("a", "b")]


def share_brute(tokens):
    seen, hit = set(), set()
    for i in range(len(tokens) - 5):
        gram = tuple(tokens[i : i + 6])
        if gram in seen:
            hit |= set(range(i, i + 6))
        seen.add(gram)
    return len(tokens), len(hit)


def test_repeated_share():
    rng = random.Random(1)
    for n in (0, 5, 6, 7, 12, 50, 400):
        for k in (1, 2, 3, 40):
            tokens = [f"w{rng.randrange(k)}" for _ in range(n)]
            assert repetition.repeated_share(tokens) == share_brute(tokens), (n, k)
    many = [f"w{i}" for i in range(30000)]
    assert repetition.repeated_share(many + many[:9]) == (30009, 9)


def test_found_against_brute_force(spark, data):
    d = table(spark, data, "documents")
    want = {r.doc_id for r in d.collect() for n, k in [share_brute(words(r.text))] if n and k * 10 >= n * 3}
    got = [r.doc_id for r in repetition.rejected(repetition.ledger(d), "runs/1").collect()]
    assert sorted(got) == sorted(want) and want


def test_every_rule_is_measured(spark, data):
    from collections import Counter

    def top(tokens, n):
        grams = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
        if len(tokens) <= n or max(Counter(grams).values()) < 2:
            return 0.0
        gram, count = Counter(grams).most_common(1)[0]
        return min(1.0, count * sum(map(len, gram)) / sum(map(len, tokens)))

    for r in table(spark, data, "documents").collect():
        tokens = words(r.text)
        assert repetition.measure(r.text)[-3:] == [top(tokens, n) for n in (2, 3, 4)]
    names = {x.name for x in repetition.RULES}
    p = repetition.ledger(table(spark, data, "documents"))
    assert names < set(p.columns) and p.where(" or ".join(f"{n} is null" for n in names)).count() == 0


def test_ledger_policies_and_ablations(spark, tmp_path):
    spam = "buy this now and get one " * 30
    texts = ["one two three", None, "", spam, "line\nline\nline\nother", "a b c\n\na b c\n\nd"]
    marked = repetition.store(repetition.ledger(docs(spark, texts)), str(tmp_path))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        repetition.store(marked, str(tmp_path))
    assert repetition.stored(spark, str(tmp_path)).dtypes == repetition.ledger(docs(spark, texts)).dtypes
    rows = {r.doc_id: r for r in marked.collect()}
    assert rows[1].failed == rows[2].failed == 0 and rows[1].n_words == 0
    assert rows[3].failed & repetition.BIT["repeated_words"] and rows[4].failed & repetition.BIT["duplicate_lines"]
    out = {r.rule: r for r in repetition.ablations(marked, "full/1").collect()}
    everything = repetition.rejected(marked, "full/1").count()
    for r in out.values():
        assert r.rejected_without + r.fails_alone == everything
    assert repetition.ledger(docs(spark, texts).limit(0)).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(3)
    for capacity in (10, 64, 512):
        histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), min(capacity, 50))}
        slots, windows = packing.plan_windows(histogram, capacity)
        fill, placed = {}, {}
        for s in slots:
            placed.setdefault(s.length, []).append(s)
        for n, parts in placed.items():
            parts.sort(key=lambda s: s.start)
            ends = [s.start for s in parts[1:]] + [histogram[n]]
            for s, end in zip(parts, ends):
                for rank in range(s.start, end):
                    w = s.first + (rank - s.start) // s.each
                    fill[w] = fill.get(w, 0) + n
        assert placed.keys() == histogram.keys() and max(fill.values()) <= capacity and len(fill) == windows == max(fill) + 1
        total = sum(n * c for n, c in histogram.items())
        assert windows <= 11 / 9 * -(-total // capacity) + 1


def pieces_ok(rows, tokens, capacities):
    for c in capacities:
        own = [r for r in rows if r.capacity == c]
        by_window, by_doc = {}, {}
        for r in own:
            by_window.setdefault(r.window_id, []).append(r)
            by_doc.setdefault(r.doc_id, []).append(r)
        for w in by_window.values():
            at = 0
            for r in sorted(w, key=lambda r: (r.window_offset, r.n_tokens)):
                assert r.window_offset == at or r.n_tokens == 0
                at += r.n_tokens
            assert at <= c
        assert by_doc.keys() == tokens.keys()
        for d, parts in by_doc.items():
            parts.sort(key=lambda r: r.piece_no)
            at = 0
            for r in parts:
                assert r.first_token == at
                at += r.n_tokens
            assert at == tokens[d] and (len(parts) == 1 if tokens[d] <= c else len(parts) == -(-tokens[d] // c))


def test_pack(spark, data):
    d = table(spark, data, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 20000)], "doc_id bigint, text string")
    d = d.unionByName(extra)
    budgets = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0)], "budget_id bigint, capacity int")
    tokens = {r.doc_id: r.n_tokens for r in packing.token_counts(d).collect()}
    got = packing.pack(d, budgets).collect()
    assert {r.capacity for r in got} == {64, 512}
    pieces_ok(got, tokens, (64, 512))
    assert packing.pack(d.limit(0), budgets).count() == 0
    only_empty = packing.pack(extra.where("doc_id > -3"), budgets).collect()
    assert len(only_empty) == 4 and {r.window_id for r in only_empty} == {0}


def test_tokens_equal_the_tokenizer(spark, data):
    import base64

    import public_tokenizers
    import tiktoken

    path = packing.default_tokenizer()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a" + " " * n + "b\n\n\n  c" + "\n" * n + "é's  1234" for n in (1, 2, 3, 17, 200)] + ["", " " * 200, "x\t \r\n y", "<|endoftext|> 'll"]
    texts += [r.text for r in table(spark, data, "documents").collect() if r.text and "  " * 100 not in r.text]
    assert [packing.count_tokens(path, t) for t in texts] == [len(plain.encode_ordinary(t)) for t in texts]
    # the tokenizer's own splitter fails on such a text
    assert packing.count_tokens(path, "word" + " " * 1_000_000 + "word") > 1000


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_pack_in_any_blocks_of_ranks(spark, data, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_RANKS", block)
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    d = table(spark, data, "documents").select("doc_id", "text")
    budgets = spark.createDataFrame([(1, 64), (2, 512)], "budget_id bigint, capacity int")
    tokens = {r.doc_id: r.n_tokens for r in packing.token_counts(d).collect()}
    pieces_ok(packing.pack(d, budgets).collect(), tokens, (64, 512))


def test_little_is_left_unused(spark):
    d, budgets = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "token_budgets"))
    fill = {r.capacity: r for r in packing.window_fill(packing.pack(d, budgets)).collect()}
    need = {c: -(-r.tokens // c) for c, r in fill.items()}
    # at most one window in a hundred more than the tokens need at the least
    assert len(fill) == 4 and all(r.windows <= need[c] * 1.01 + 1 for c, r in fill.items())


def leaks_brute(documents, items):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = set()
    for d, t in documents:
        w = words(t)
        for k in range(len(w) - 9):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 10]), ())}
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_leaks_against_brute_force(spark, size):
    d, i = table(spark, f"/root/testdata/{size}", "documents"), table(spark, f"/root/testdata/{size}", "eval_items")
    want = leaks_brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])
    got = [(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_leaks_edges(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    filler = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(600))
    texts = [item, filler + " " + item, item[:40], None, "", "x", item.upper().replace(" ", "​ 1 "), filler * 400 + item]
    d = docs(spark, texts)
    i = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, item), (4, item)], "item_id bigint, text string")
    want = {(a, b) for a in (0, 1, 6, 7) for b in (1, 4)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_WINDOWS", 1)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == want
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_latent_index_recall(spark):
    """Bucketed candidates against all pairs by brute force."""
    import numpy as np

    d, i = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "eval_items"))
    encoded = leakage.encode(d, "doc_id")
    space = leakage.fit(encoded)
    unpack = lambda rows: [np.frombuffer(r.codes, np.uint32) for r in rows]
    items = list(enumerate(unpack(leakage.encode(i.withColumnRenamed("item_id", "k"), "k").collect())))
    how = leakage.LATENT_PARAPHRASE
    index = leakage._Index(space, items, how)
    total = hit = 0
    for codes in unpack(encoded.collect()):
        if len(codes) < how.width:
            continue
        x = space.windows(codes, how.width)[:, :: how.stride]
        near = x.T @ index.x >= how.cosine * np.linalg.norm(x, axis=0)[:, None] * index.norm[None] - 1e-6
        found = np.zeros_like(near)
        for at, k in index.candidates(x, np.arange(x.shape[1])):
            found[at, k] = True
        total, hit = total + near.sum(), hit + (found & near).sum()
    assert total > 100 and hit / total >= 0.9


def test_planted_paraphrases(spark):
    """Items retold with words left out, put in or changed, inside other documents."""
    d, i = (table(spark, "/root/testdata/sf0.01", n).select(k, "text") for n, k in (("documents", "doc_id"), ("eval_items", "item_id")))
    rng = random.Random(8)
    hosts = [r.text for r in d.where("length(text) > 600").orderBy("doc_id").limit(400).collect()]
    planted = []
    for k, r in enumerate(i.orderBy("item_id").collect()):
        retold = []
        for w in r.text.split():
            x = rng.random()
            retold += [] if x < 0.07 and not w.lower().startswith("answer") else ["rather", w] if x < 0.12 else [w]
        host = hosts[k % len(hosts)].split()
        at = rng.randrange(len(host))
        planted.append((-1 - k, " ".join(host[:at] + retold + host[at:]), r.item_id))
    mine = spark.createDataFrame([(a, t) for a, t, _ in planted], "doc_id bigint, text string")
    want = {(a, k) for a, _, k in planted}
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d.unionByName(mine), i, leakage.PARAPHRASE).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_verbatim_search_runs_every_stage(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda Answer: mu nu xi"
    d = docs(spark, [item, item.replace("xi", "pi"), item.split(" Answer")[0]])
    i = spark.createDataFrame([(1, item), (2, item.split(" Answer")[0])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.answered if r.answered is None else round(r.answered, 2)) for r in leakage.leaks(d, i).collect()}
    assert got == {(0, 1): (1.0, 1.0), (1, 1): (1.0, 0.67), (2, 1): (1.0, 0.0), (0, 2): (1.0, None), (1, 2): (1.0, None), (2, 2): (1.0, None)}
    strict = leakage.Search(answer=0.5)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, strict).collect()} == set(got) - {(2, 1)}


def test_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, (50, 24)).astype(np.uint32), rng.integers(0, 5, (50, 24)).astype(np.uint32)

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, e in enumerate(y):
                new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    assert leakage._common_subsequence(a.ravel(), np.arange(50) * 24, b, np.arange(50)).tolist() == [plain(x, y) for x, y in zip(a, b)]


def test_paraphrase_needs_the_answer(spark, data):
    corpus = table(spark, data, "documents").select("doc_id", "text")
    item = table(spark, data, "eval_items").where("lower(text) like '%answer: only%'").orderBy("item_id").first()
    spread = item.text.split()
    near = " ".join(w if k % 10 else "indeed" for k, w in enumerate(spread))
    cut = near.lower().split("answer:")[0] + " nothing else is told here"
    mine = spark.createDataFrame([(-1, near), (-2, cut)], "doc_id bigint, text string")
    got = leakage.leaks(corpus.unionByName(mine), table(spark, data, "eval_items"), leakage.PARAPHRASE)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert (-1, item.item_id) in pairs and (-2, item.item_id) not in pairs
