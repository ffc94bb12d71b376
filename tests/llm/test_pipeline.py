from collections import Counter

import pytest

import corpus_pipeline as p


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, corpus):
    import random

    r = random.Random(12)
    item = " ".join(r.choice("kappa lambda sigma omega theta delta".split()) + str(r.randint(0, 99)) for _ in range(30))
    rows = [(i, t, "en", s) for i, t, _, s in ((*x, None, None)[:4] for x in corpus)]
    rows += [(300 + i, f"clean words {i} " * 6 + ("bad vilwort here. " * 3 if i % 3 == 0 else ""), "en", f"src{i % 4}") for i in range(240)]
    rows += [(600, "before it " + item + " after it", "en", "src1"), (601, item, "en", "src2")]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    labels = [(300 + i, 1, int(i % 3 == 0)) for i in range(240)] + [(i, 1, 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, at)
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if name != "sharding":
            assert docs.columns == columns
        seen[name] = Counter(r.doc_id for r in docs.collect())
    toxic = {i for i, t, *_ in rows if t and "vilwort" in t}
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) >= len({r[0] for r in rows}) - len(toxic) - 3
    assert max(seen["near_duplicates"].values()) == 1 and 207 in seen["near_duplicates"]
    assert not {600, 601} & set(seen["decontamination"])
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) <= {600, 601}
    assert max(seen["mixing"].values()) <= 2 and set(seen["mixing"]) <= set(seen["decontamination"])
    assert seen["sharding"] == seen["mixing"]


def test_run(spark, folder):
    at, _ = folder
    got = p.run(spark, at).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{at}/sharding").collect())


def plain(spark, at, rows):
    """run() in plain Python, with the trained model: (doc_id, shard) of every row."""
    import hashlib

    from orrery.llm.simhash_dedup import fingerprint
    from orrery.llm.toxicity import fit

    from test_decontamination import brute
    from test_mixing import targets, words

    read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
    model = fit(read("documents"), read("labels"))
    rows = [r for r in rows if model.score(r[1])[0] < 0.7]
    fps = [fingerprint(None if t is None else t.encode()) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if root(i) not in least or key < least[root(i)][0]:
            least[root(i)] = (key, r)
    rows = [r for _, r in least.values()]
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    bad = {i for i, *_ in brute([(k, r[1]) for k, r in enumerate(rows)], items)}
    rows = [r for k, r in enumerate(rows) if k not in bad]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    target, out = targets(sizes), []
    for s in sizes:
        start = int(hashlib.md5(f"mix|{s or ''}".encode()).hexdigest()[:6], 16)
        step = int(target[s] / sizes[s] * (1 << 24)) if sizes[s] else 0
        of = sorted((r for r in rows if r[3] == s), key=lambda r: (words(r[1]), r[0] is not None, r[0] or 0))
        for i, r in enumerate(of):
            out += [r] * ((start + (i + 1) * step) // (1 << 24) - (start + i * step) // (1 << 24))
    out.sort(key=lambda r: ("" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest(), r[0] is not None, r[0] or 0))
    size = lambda r: len((r[1] or "").encode()) + 8
    total, before, got = sum(map(size, out)), 0, Counter()
    for r in out:
        got[r[0], min(23, (2 * before + size(r)) * 24 // (2 * total))] += 1
        before += size(r)
    return got


def test_run_against_plain_python(spark, folder):
    at, rows = folder
    assert Counter((r.doc_id, r.shard) for r in p.run(spark, at).collect()) == plain(spark, at, rows)


def test_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
