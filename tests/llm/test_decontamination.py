import random
from collections import Counter

import pytest

import orrery.llm.decontamination as d


def shingles(text):
    w = [x for x in (text or "").lower().translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, items):
    """A window has the item's shingles, or all of a text that has fewer."""
    out = Counter()
    for i, text, *_ in rows:
        s = shingles(text)
        for item, other in items:
            t = Counter(shingles(other))
            n = sum(t.values())
            w = min(n, len(s))
            best = None
            for a in range(len(s) - w + 1) if w else ():
                c = sum((t & Counter(s[a : a + w])).values())
                x = c / (n + w - c)
                if x >= 0.8 and (best is None or x > best[0] + 1e-12):
                    best = (x, a)
            if best:
                out[i, item, round(best[0], 9), w + 4] += 1
    return out


@pytest.fixture(scope="module")
def cases():
    r = random.Random(9)
    words = lambda n: [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()) + r.choice("xyz") for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([5, 9, 20, 33, 47, 60, 4, 0])] + [(8, None), (9, "na na na na na na na na na na")]
    rows = []
    for k in range(60):
        body = words(r.randint(0, 200))
        text = items[k % 6][1].split()
        kind = k % 5
        if kind == 1:  # whole
            body[len(body) // 2 : len(body) // 2] = text
        elif kind == 2:  # cut at the end
            body += text[: len(text) - 2]
        elif kind == 3:  # one word changed near the edge, or in the middle
            text[r.choice([0, len(text) // 2])] = "changed"
            body = text + body
        rows.append((k, " ".join(body).replace(" ", r.choice([" ", "\n", "  "]))))
    rows += [(100, None), (101, ""), (None, items[3][1].upper()), (102, items[2][1]), (102, items[2][1]), (103, " ".join(words(20_000)) + " " + items[4][1]), (104, "na " * 300), (105, items[5][1] + " " + items[5][1])]
    return rows, items


def test_against_brute_force(spark, docs, cases):
    rows, items = cases
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.n_words) for r in d.contaminated(docs(rows), benchmark).collect())
    want = brute(rows, items)
    assert sum(want.values()) > 20
    assert got == want


def test_several_passes(spark, docs, cases, monkeypatch):
    monkeypatch.setattr(d, "PASS", 60)
    rows, items = cases
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.n_words) for r in d.contaminated(docs(rows[:40]), benchmark).collect())
    assert got == brute(rows[:40], items)


def test_filter_keeps_the_clean(spark, docs, cases):
    rows, items = cases
    frame = docs(rows)
    kept = d.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    bad = {i for i, *_ in brute(rows, items)}
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows if i not in bad)


def test_empty_tables(spark, docs, cases):
    benchmark = spark.createDataFrame(cases[1], "item_id long, text string")
    assert d.contaminated(docs([]).filter("false"), benchmark).collect() == []
    assert d.contaminated(docs(cases[0]), benchmark.filter("false")).collect() == []


def test_blocks_guarantee_the_radius(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for j in r.sample(range(64), r.randint(0, 20)):
            b ^= 1 << j
        pairs.append(tuple(x - (1 << 64) * (x >> 63) for x in (a, b)))
    frame = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    shared = F.size(F.array_intersect(d.blocks("a", 20), d.blocks("b", 20)))
    assert frame.select(F.min(shared)).first()[0] >= 1


def found(spark, docs, rows, items):
    return Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.n_words) for r in d.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect())


def test_documents_shorter_than_the_item(spark, docs):
    w = [f"w{i}" for i in range(50)]
    items = [(1, " ".join(w)), (2, " ".join(["na"] * 30))]
    rows = [(k, " ".join(w[:-k])) for k in (1, 5, 9, 10, 20)] + [(100 + k, " ".join(w[k:])) for k in (1, 9, 10)] + [(200, " ".join(w[3:-3])), (201, "x " + " ".join(w[4:-4])), (202, "na " * 28), (203, "na " * 20), (204, "na")]
    got = found(spark, docs, rows, items)
    assert got == brute(rows, items)
    assert {i for i, *_ in got} == {1, 5, 9, 101, 109, 200, 201, 202}
    kept = d.decontaminate(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {10, 20, 110, 203, 204}


def test_items_beyond_a_counter(spark, docs):
    w = [f"w{i}" for i in range(33_000)]
    changed = w[:]
    changed[100] = changed[20_000] = "other"
    rows = [(1, "before " + " ".join(w) + " after"), (2, " ".join(changed)), (3, " ".join(w[:32_000])), (4, " ".join(w[:20_000]))]
    got = found(spark, docs, rows, [(1, " ".join(w))])
    n = 33_000 - 4
    assert got == Counter({(1, 1, 1.0, n + 4): 1, (2, 1, round((n - 10) / (n + 10), 9), n + 4): 1, (3, 1, round(31_996 / n, 9), 32_000): 1})


def test_repeated_shingles(spark, docs):
    item = lambda k: " ".join(f"i{k}w{j}" for j in range(116))
    items = [(k, item(k) + " _" * 14) for k in range(12)] + [(k, item(k)) for k in range(12, 16)]
    rows = [(k, "before it " + item(k) + " ." * 14) for k in range(12)] + [(k, item(k)[: -len(f" i{k}w115") * 10] + " -" * 12) for k in range(12, 16)]
    got = found(spark, docs, rows, items)
    assert got == brute(rows, items) and {i for i, *_ in got} >= set(range(12))


@pytest.mark.parametrize("n", [2_000, 30_000])
def test_long_items_take_seconds(spark, docs, n):
    """An item of n words word for word in three times as many, with a word changed, and with a fifth of it gone."""
    import time

    w = [f"w{i}" for i in range(3 * n)]
    changed = w[:]
    changed[n + n // 2] = "other"
    rows = [(1, " ".join(w)), (2, " ".join(changed)), (3, " ".join(w[: n + 2 * n // 3] + w[n + n // 2 + 2 * n // 3 :]))]
    before = time.time()
    got = found(spark, docs, rows, [(1, " ".join(w[n : 2 * n]))])
    assert time.time() - before < 60
    m = n - 4
    assert got == Counter({(1, 1, 1.0, n): 1, (2, 1, round((m - 5) / (m + 5), 9), n): 1})
