import random
from collections import Counter

import numpy as np
import xxhash

from orrery.llm.simhash_dedup import Forest, grow, half, keep_one, link_shard, near_duplicates, route


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    f = [brute_fingerprint(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row[0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((row[0], f"{f[i]:016x}", first[root(i)]) for i, row in enumerate(rows))


def test_against_brute_force(docs, corpus):
    got = near_duplicates(docs(corpus)).collect()
    assert Counter(tuple(r) for r in got) == brute(corpus)


def test_empty_table(docs):
    assert near_duplicates(docs([]).filter("false")).collect() == []


def test_only_null_ids(docs):
    got = near_duplicates(docs([(None, "a b c"), (None, "a b c")])).collect()
    assert [r.component_id for r in got] == [None, None]


def test_keep_one(docs, corpus):
    d = docs(corpus)
    kept = keep_one(d)
    assert kept.columns == d.columns
    expected = {c for _, _, c in brute(corpus)}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(x for x in expected if x is not None)


def test_shards_find_every_link():
    r = np.random.default_rng(1)
    base = r.integers(-(2**63), 2**63 - 1, 1500, dtype=np.int64)

    def flipped(x, most):
        return x ^ np.uint64(sum(1 << int(j) for j in r.choice(64, r.integers(1, most), replace=False))).astype(np.int64)

    near = [flipped(b, 6) for b in np.repeat(base[:200], 3)]
    dense = [flipped(base[0], 5) for _ in range(900)]
    u = np.unique(np.concatenate([base, near, dense]))

    def roots(edges):
        f = Forest(len(u))
        for a, b in edges:
            f.link(a, b)
        return f.roots(np.arange(len(u)))

    d = np.bitwise_count((u[:, None] ^ u[None, :]).view(np.uint64))
    expected = roots([np.nonzero(d <= 3)])
    found = []
    for tree in (0, 1):
        nodes = grow(half(r.choice(u, 150, replace=False), tree), 9)
        row, leaf, home = route(nodes, half(u, tree), 1)
        assert sorted(row[home]) == list(range(len(u)))
        for x in np.unique(leaf):
            a, b = link_shard(u[row[(leaf == x) & home]], u[row[(leaf == x) & ~home]], 3, tree)
            found.append((np.searchsorted(u, a), np.searchsorted(u, b)))
    assert (roots(found) == expected).all()
    assert sum(len(a) for a, _ in found) < 4 * len(u)  # a forest, not all pairs


def test_sharded_tables(spark, docs, monkeypatch):
    import orrery.llm.simhash_dedup as m

    monkeypatch.setattr(m, "SHARD", 64)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([4, 60, 300])))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " q") for i in range(0, 400, 3)]
    assert Counter(tuple(x) for x in near_duplicates(docs(rows)).collect()) == brute(rows)
