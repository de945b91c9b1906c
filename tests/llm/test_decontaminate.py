import random

import numpy as np
import pytest

from factline.llm import decontaminate as D


def lcs_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert D.lcs(a, b) == lcs_brute(a, b)


def words(rng, n, k=3000):
    return [f"q{rng.randrange(k)}" if rng.random() < 0.6 else rng.choice(["the", "of", "and", "to", "in"]) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    items = [(k, words(rng, rng.choice([8, 14, 25, 40, 60, 90]))) for k in range(30)]
    docs, true = [], set()
    for d in range(150):
        text = words(rng, rng.randrange(20, 400))
        if d % 3 == 0:
            k, w = rng.choice(items)
            at = rng.randrange(len(text))
            # Every other leak is a paraphrase: one word in seven is another.
            leak = [f"z{rng.randrange(99)}" if d % 2 and rng.random() < 1 / 7 else x for x in w]
            text[at:at] = leak
            true.add((d, k, bool(d % 2)))
        docs.append((d, " ".join(text)))
    return docs, [(k, " ".join(w)) for k, w in items], true


def test_recall_and_precision_against_brute_force(spark, planted):
    docs, items, true = planted
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # Brute force: every window against every item, by the exact checks alone.
    text, want = dict(docs), set()
    df = {x: sum(x in set(t.split()) for t in text.values()) for _, t in items for x in set(t.split())}
    rare = {x for x, n in df.items() if n <= D.COMMON * (len(docs) + D.PRIOR)}
    for d, t in text.items():
        w = t.split()
        for k, item in items:
            i = item.split()
            a = D.answer_of(item).split()
            for at in range(0, max(1, len(w) - len(i) // 2), max(1, len(i) // 4)):
                seen = w[max(0, at - len(i) // 8) : at + len(i) + len(i) // 4]
                share = lcs_brute(i, seen) / len(i)
                own = [x for x in i if x in rare]
                if lcs_brute(own, [x for x in seen if x in rare]) < D.RARE * len(own):
                    continue
                if share >= D.LCS and (share >= D.SURE or lcs_brute(a, seen) >= D.ANSWER * len(a)):
                    want.add((d, k))
    assert {(d, k) for d, k, near in true if not near} <= got
    assert len(want & got) >= 0.9 * len(want)
    assert got <= want | {(d, k) for d, k, _ in true}


def test_edges(spark, planted):
    _, items, _ = planted
    item = items[0][1]
    docs = [(1, None, "x"), (2, "", "x"), (None, item, "x"), (3, item.upper(), "x"), (3, item.upper(), "x"), (4, "word " * 100_000 + item, "x"), (5, item.split()[0], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, Cosine string")
    bench = spark.createDataFrame([(0, item, "y"), (1, None, "y"), (2, "a b", "y"), (3, "", "y"), (0, item, "y")], "item_id long, text string, lcs string")
    got = [(r["doc_id"], r["item_id"], r["lcs"]) for r in D.decontaminate(df, bench).collect()]
    assert {x[0] for x in got} == {None, 3, 4} and all(x[1] == 0 and x[2] == 1.0 for x in got)
    kept = D.remove_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(df, none).collect() == []
    assert D.decontaminate(df.limit(0), bench).collect() == []


def test_a_large_benchmark_goes_in_parts(spark, planted, monkeypatch):
    docs, items, true = planted
    monkeypatch.setattr(D, "ITEM_BYTES", 3000)
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(spark.createDataFrame(docs[:60], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, k) for d, k, near in true if not near and d < 60} <= got


def test_singular_vectors(spark):
    rng = np.random.default_rng(3)
    topic = [[f"t{t}w{k}" for k in range(6)] for t in range(3)]
    docs = [(d, " ".join(rng.choice(topic[d % 3], 60))) for d in range(60)]
    items = D.items_of([(0, " ".join(topic[0] + topic[1] + topic[2]))])
    known = D.known_words(spark.createDataFrame(docs, "doc_id long, text string"), items.vocab, "doc_id", "text")
    _, s = D.randomised_svd(known, np.ones(len(items.vocab)), [], rank=10)
    a = np.zeros((60, len(items.vocab)))
    place = {w: int(k) for w, k in zip(topic[0] + topic[1] + topic[2], items.words[0])}
    for d, t in docs:
        for w in t.split():
            a[d, place[w]] += 1
    assert s[:3] == pytest.approx(np.linalg.svd(a, compute_uv=False)[:3], rel=1e-2)


def test_items_of_common_words_are_found(spark):
    rng = random.Random(5)
    wide, other, plain = words(rng, 30), words(rng, 30), ["it", "was", "one", "of", "the", "few", "that", "he", "had", "in", "it", "of", "the", "was", "he", "that"]
    filler = ["it", "was", "of", "the", "that", "he", "had", "in", "one", "few"]
    docs, want = [], set()
    for d in range(600):
        text = [rng.choice(filler) if rng.random() < 0.3 else x for x in words(rng, 200)]
        for k, item, every in ((0, wide, 5), (1, other, 150), (2, plain, 60)):
            if d % every == k:
                at = rng.randrange(len(text))
                # Copies don't split each other.
                text = text[:at] + item + text[at:] if k == 0 or d % 5 else text + item
                want.add((d, k))
        docs.append((d, " ".join(text)))
    items = [(0, " ".join(wide)), (1, " ".join(other)), (2, " ".join(plain))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sum(k == 0 for _, k in want) == 120 > D.COMMON * (600 + D.PRIOR)
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(df, bench).collect()}
    assert want <= got
    assert {x for x in got if x[1] < 2} == {x for x in want if x[1] < 2}
    assert D.remove_leaks(df, bench).filter("doc_id % 5 = 0").count() == 0


def test_short_items_are_found_word_for_word(spark):
    bench = spark.createDataFrame([(1, "two plus two is"), (2, "zebra"), (3, "red  RED, rose"), (3, "two"), (4, "is two")], "item_id long, text string")
    docs = [(1, "well, two plus two is four"), (2, "two plus one two is"), (3, "a red rose"), (4, "Red red rose. Zebra"), (5, "what is two plus two"), (6, "long " * 60_000 + "zebra"), (7, None)]
    got = sorted((r["doc_id"], r["item_id"]) for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert got == [(1, 1), (1, 3), (2, 3), (4, 2), (4, 3), (5, 3), (5, 4), (6, 2)]


def test_items_at_the_beginning_of_a_document(spark):
    rng = random.Random(21)
    items = [(k, words(rng, 12)) for k in range(12)]
    docs = [(d, " ".join(items[d % 12][1] + words(rng, 300))) for d in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(df, bench).collect()}
    assert {(d, d % 12) for d, _ in docs} <= got


def test_sums_against_a_loop(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 4)
    rng = np.random.default_rng(8)
    value = rng.standard_normal((50, 7))
    assert D.sums(value, np.zeros(0, int), np.zeros(0, int)).shape == (0, 7)
    for sizes in ([1], [3, 1, 2], [4, 5, 1, 300, 2, 17], rng.integers(1, 9, 200)):
        head = np.cumsum(sizes) - sizes
        rows, times = rng.integers(0, 50, sum(sizes)), rng.integers(1, 5, sum(sizes)).astype(float)
        want = [sum(value[rows[k]] * times[k] for k in range(a, a + n)) for a, n in zip(head, sizes)]
        assert np.allclose(D.sums(value, rows, head, times), want)
        assert np.allclose(D.sums(value, rows, head), np.add.reduceat(value[rows], head))


def test_only_windows_that_hold_enough_of_an_items_words_are_put_in_order(spark, planted, monkeypatch):
    docs, texts, true = planted
    items = D.items_of(texts)
    known = D.known_words(spark.createDataFrame(docs, "doc_id long, text string"), items.vocab, "doc_id", "text").toArrow().to_batches()
    n, seen, exact = len(items.vocab), [], D.verdict

    def counted(item, answer, rare, window):
        both = np.minimum(np.bincount(item, minlength=n), np.bincount(window, minlength=n)).sum()
        seen.append(both / len(item))
        return exact(item, answer, rare, window)

    monkeypatch.setattr(D, "verdict", counted)
    got = {(r[0], r[1]) for rows in D._search(items, np.ones(n), np.eye(n), np.ones(n))(known) for r in rows}
    assert {(d, k) for d, k, near in true if not near} <= got
    assert seen and min(seen) >= D.LCS
