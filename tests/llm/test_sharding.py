import zlib

from orrery.llm.sharding import shard


def size(text):
    return len((text or "").encode()) + 8


def test_law(docs, corpus):
    got = shard(docs(corpus), 24).collect()
    assert sorted(r.size for r in got) == sorted(size(t) for _, t, *_ in corpus)
    texts = {}
    for i, t, *_ in corpus:
        texts.setdefault(i, set()).add(None if t is None else zlib.crc32(t.encode()))
    assert all(r.text_crc32 in texts[r.doc_id] for r in got)
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        by.setdefault(r.shard, []).append(r)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    at = 0
    for s in sorted(by):
        rows = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        for r in rows:  # contiguous, and each row in the shard of its middle byte
            assert r.position == at and s == min(23, (2 * at + r.size) * 24 // (2 * total))
            at += r.size
        assert sum(r.size for r in rows) <= total / 24 + 2 * largest
    assert at == total


def test_copies_stand_together(docs):
    got = shard(docs([(i, f"text {i % 5}" * 20) for i in range(200)]), 10).collect()
    runs = {}
    for r in got:
        runs.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(max(s) - min(s) == len(s) - 1 and len(s) <= 3 for s in runs.values())


def test_reruns_agree(docs, corpus):
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.shard, r.slot)
    assert sorted(shard(docs(corpus)).collect(), key=key) == sorted(shard(docs(corpus)).collect(), key=key)


def test_small_and_empty(docs):
    assert shard(docs([]).filter("false")).collect() == []
    (row,) = shard(docs([(1, None)])).collect()
    assert (row.size, row.text_crc32, row.slot) == (8, None, 0)
