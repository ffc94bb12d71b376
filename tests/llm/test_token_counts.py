import random

import public_tokenizers
import pytest

from orrery.llm.token_counts import Counter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return Counter(MODEL)


def test_every_way_agrees(counter):
    assert counter.proven
    r = random.Random(3)
    bits = [" ", "  ", "▁", "\n", "\n\n", "a", "the", "é", "ß", "日本", "\t", "　", "x" * 50, "<s>", "</s>", "<0x0A>", "\xa0", "́", " .", "1", "\r", "😀", "\x00"]
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 30)))
        n = counter.whole(text)
        assert counter.stretches(text) == n, repr(text)
        assert counter.spliced(text, 20, 3) == n, repr(text)


def test_huge_texts(counter):
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(30_000))
    assert counter.count(text) == counter.whole(text)
    assert counter.spliced("y" * 70_000) == counter.whole("y" * 70_000)  # no boundary at all


def test_table(docs, corpus, counter):
    got = token_counts(docs(corpus), MODEL).collect()
    want = sorted((str(i), len((t or "").encode()), counter.whole(t) if t else 0) for i, t, *_ in corpus)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts(docs([]).filter("false"), MODEL).collect() == []
