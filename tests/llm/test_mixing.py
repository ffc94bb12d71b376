import re
from collections import Counter

import pytest

from orrery.llm.mixing import mix, mixed


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """The rule as stated, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_sizes(docs, corpus):
    got = mix(docs(corpus)).collect()
    sizes = Counter()
    for _, t, _, s in corpus:
        sizes[s] += words(t)
    want = targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, *_ in corpus)
    source = {(r[0], words(r[1])): r[3] for r in corpus}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]


def test_near_target_for_even_sizes(docs):
    rows = [(i, "w " * (10 + i % 20), "en", f"s{i % 11 if i % 3 else 0}") for i in range(3000)]
    taken, target = Counter(), {}
    for r in mix(docs(rows)).collect():
        s = rows[r.doc_id][3]
        taken[s] += r.taken
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 40 for s in target)


def test_reruns_and_empty(docs, corpus):
    one, two = (Counter(tuple(r) for r in mix(docs(corpus)).collect()) for _ in range(2))
    assert one == two
    assert mix(docs([]).filter("false")).collect() == []
    assert [r.taken for r in mix(docs([(1, None, None, "s"), (2, "", None, None)])).collect()] == [0, 0]


def test_mixed_rows(docs, corpus):
    d = docs(corpus)
    out = mixed(d)
    assert out.columns == d.columns
    copies = Counter()
    for r in mix(d).collect():
        copies[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, words(r.text)) for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
