"""Strong components and levels by rounds, against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import layers


def frames(spark, nodes, pairs):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(pairs, "source string, target string")


def plain(nodes, pairs):
    """({id: component}, {id: level}) by closure and by longest paths."""
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in reach and b in reach and not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    part = {a: min(b for b in reach[a] if a in reach[b]) for a in nodes}
    level = dict.fromkeys(part.values(), 0)
    for _ in level:
        for a, b in pairs:
            if a in part and b in part and part[a] != part[b]:
                level[part[b]] = max(level[part[b]], level[part[a]] + 1)
    return part, {n: level[part[n]] for n in nodes}


def check(spark, nodes, pairs):
    n, e = frames(spark, nodes, pairs)
    parts = layers.strongly_connected(n, e)
    want, level = plain(nodes, pairs)
    rows = parts.collect()
    assert {r.id: r.component for r in rows} == want and len(rows) == len(nodes)
    assert all(r["size"] == sum(c == r.component for c in want.values()) for r in rows)
    assert {r.id: r.level for r in layers.levels(parts, e).collect()} == level


@pytest.mark.parametrize(("n", "m", "seed"), [(60, 50, 2), (12, 60, 3), (80, 120, 4)])
def test_random_graphs(spark, n, m, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    check(spark, names, [(r.choice(names), r.choice(names)) for _ in range(m)] + [("n1", "ghost"), ("ghost", "n2")])


def test_shapes(spark):
    ring = lambda p, k: [(f"{p}{i}", f"{p}{(i + 1) % k}") for i in range(k)]
    line = lambda p, k: [(f"{p}{i}", f"{p}{i + 1}") for i in range(k)]
    pairs = ring("c", 9) + ring("t", 2) + line("l", 12) + [("l3", "l9"), ("l5", "t0"), ("t1", "l11")]
    pairs += ring("e", 6) + [("e1", "x"), ("x", "y"), ("y", "e4"), ("e2", "z"), ("z", "c0")] + [("c3", "c3"), ("s", "d1"), ("s", "d2"), ("d1", "d"), ("d2", "d")]
    check(spark, sorted({x for p in pairs for x in p} | {"alone"}), pairs)


def test_a_grid_of_ways(spark):
    """Nothing is a chain here: nodes have two ways in and out."""
    name = lambda i, j: f"{i:02}-{j:02}"
    pairs = [(name(i, j), name(i + 1, k)) for i in range(7) for j in range(2) for k in range(2)]
    check(spark, sorted({x for p in pairs for x in p}), pairs)


def test_empty(spark):
    n, e = frames(spark, ["a"], [("a", "b")])
    assert layers.strongly_connected(n.limit(0), e).collect() == []
    parts = layers.strongly_connected(n, e.limit(0))
    assert [tuple(r) for r in layers.levels(parts, e).collect()] == [("a", 0)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """100,000 edges in a row, and as many in a ring: jumps, not steps."""
    jumps, n = [], 100_000
    monkeypatch.setattr(layers, "jump", lambda at, f=layers.jump: jumps.append(1) or f(at))
    at = lambda c: F.format_string("%06d", c)
    nodes = spark.range(n + 1).select(at(F.col("id")).alias("id"))
    chain = spark.range(n).select(at(F.col("id")).alias("source"), at(F.col("id") + 1).alias("target"))
    parts = layers.strongly_connected(nodes, chain)
    assert parts.select("component").distinct().count() == n + 1 and len(jumps) < 20
    jumps.clear()
    assert layers.levels(parts, chain).agg(F.max("level"), F.sum("level")).first()[:] == (n, n * (n + 1) // 2) and len(jumps) < 20
    ring = chain.unionByName(spark.createDataFrame([(f"{n:06d}", "000000")], chain.schema))
    jumps.clear()
    assert layers.strongly_connected(nodes, ring).select("component", "size").distinct().collect() == [("000000", n + 1)] and len(jumps) < 22
