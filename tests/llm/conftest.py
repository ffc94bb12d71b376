import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, fingerprint string, host string, _key string, _tox string, _copies int, n int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text[, lang[, source]]), with extra columns whose names clash with results and helpers."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, "x", "y", "z", "f", "h", "k", "t", 9, 8) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Rows of a small corpus: copies, near copies, nulls, empty and long texts, repeated rows, a hot source."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(120):
        rows.append((i, text(r.randint(1, 80)), "en", f"src{min(i % 7, 3)}"))
    base = text(400)
    for i in range(120, 150):
        rows.append((i, base if i % 2 else base + f" tail{i}", "en", "src3"))
    rows += [(200, None, None, None), (201, "", "en", None), (202, "   \n\t ", "en", "src1"), (203, text(30_000), "en", "src2"), (None, "a lonely text", "en", "src1"), (None, None, None, None)]
    rows += [(204, "one", "en", ""), (205, "one two", "en", "src1"), (206, "ONE  two", "en", "src1"), (207, "twice the same row", "en", "src0"), (207, "twice the same row", "en", "src0")]
    return rows
