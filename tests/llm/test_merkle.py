import zlib
from hashlib import sha256

import pytest

from orrery.llm.queries import op13_merkle_manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(root, [[(left, right) of each level] of each node]) by pairs of lists, one level at a time."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            s = at[i] // 3 * 3
            p.append(("".join(nodes[s : at[i]]), "".join(nodes[at[i] + 1 : s + 3])))
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        i, source, lang, n, text = row
        hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        now = leaf(i, source, lang, n, text.replace("\n", "") if hit and text is not None else text)
        groups.setdefault(source, []).append((i is not None, i or 0, leaf(*row), now, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])]) for s in order]
    root, tops = climb([t[0] for t in trees]) if trees else (None, [])
    out = []
    for s, (sub, paths), top in zip(order, trees, tops, strict=True):
        for (_, _, mine, now, i), path in zip(sorted(groups[s]), paths, strict=True):
            for left, right in path + top:
                now = h(left, now, right)
            out.append((i, mine, sub, root, h(*[a + b for a, b in path + top]), now, now == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def ask(spark, tmp_path):
    def run(rows, **more):
        frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, group string, digest string")
        frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        return order(op13_merkle_manifest(spark, str(tmp_path), **more).collect())

    return run


def table(corpus):
    return [(i, src, lang, len(t) if t is not None and i != 3 else None, t if i is None or i % 3 else (t or "").replace(" ", "\n")) for i, t, lang, src in corpus]


def test_odd_rows(ask, corpus):
    rows = table(corpus)
    got = ask(rows)
    assert got == order(brute(rows)) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tiers(ask, depth):
    """Blocks of 3, 9 and 27 nodes: several tiers, within sources and over them, with full and partial last blocks."""
    sizes = [1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 82] + [1] * 20
    rows = [(100 * s + i, f"é{s}" if s % 2 else f"z{s}", "en", i, f"a\n{i}" if i % 2 else "") for s, n in enumerate(sizes) for i in range(n)]
    assert ask(rows, depth=depth) == order(brute(rows))


def test_small(ask):
    assert ask([]) == []
    one = [(None, None, None, None, None)]
    assert ask(one) == order(brute(one)) and ask(one)[0][4] == h()
    two = [(5, "s", "en", 3, "a\nb"), (5, "s", "en", 3, "a\nb")]
    assert ask(two) == order(brute(two))


def test_whole_blocks(ask):
    rows = [(i, "hot" if i < 730 else "full", None, 1, "t\n") for i in range(730 + 729)]
    assert ask(rows) == order(brute(rows))
