import random
import sys
import unicodedata
from hashlib import sha256

import public_tokenizers
import pytest

from orrery.llm.word_bpe import SCANNED, WordBpe, decoded, encoded, round_trips

MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return WordBpe(MODEL)


def ids(coder, text):
    return coder.library.encode(text, add_special_tokens=False).ids


def same(coder, text):
    want = ids(coder, text)
    assert coder.encode(text) == want, repr(text)
    back = coder.library.decode(want, skip_special_tokens=False)
    assert coder.decode(want) == back, repr(text)
    assert coder.digests(text) == (len(want), *(sha256(x.encode()).hexdigest() for x in (" ".join(map(str, want)), back)))


def test_every_character(coder):
    """Each character alone, after a letter, a mark and a quote: classes, lower case and composition are the library's."""
    chars = [chr(c) for c in [*range(0x3500), *range(0xA000, 0xB000), *range(0xF900, 0x10000), *range(0x1E000, 0x20000)] if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 16):
        block = chars[i : i + 16]
        for text in ("\n".join(block), "\n".join("a" + c + "b" for c in block), "\n".join("!" + c + "7" for c in block), "\n".join("'" + c for c in block)):
            assert coder.encode(text) == ids(coder, text), [hex(ord(c)) for c in block]


def test_mixed_texts(coder):
    r = random.Random(3)
    bits = [" ", "  ", "\n", "'s", "'LL", "'", "''re", "a", "The", "É", "ß", "İ", "Σ", "日本", "\t", "　", "x" * 50, "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\xa0", "\x85", "\x1c", "́", "e", "A", "̊", "¹", "½", "Ⅷ", "१", " .", "12", "\r", "😀", "\x00", "-", "…", "“", "ﬁ", "가", "ᄀ", "ᅡ", "‍", "﻿", "ɐ", "K"]
    for _ in range(4000):
        same(coder, "".join(r.choice(bits) for _ in range(r.randint(0, 30))))


def test_merges_of_short_and_long_words(coder):
    r = random.Random(4)
    for n in [1, 2, 3, 10, SCANNED - 1, SCANNED, SCANNED + 1, 500, 3000]:
        for alphabet in ("a", "ab", "thein", "lo!ng"[:2], "éèa"):
            word = "".join(r.choice(alphabet) for _ in range(n))
            same(coder, word)
            parts = [coder.inner[b] for b in word.encode()[:-1]] + [coder.last[word.encode()[-1]]]
            assert coder.scanned(list(parts)) == coder.heaped(list(parts))


def test_memory_is_bounded(coder, monkeypatch):
    monkeypatch.setattr("orrery.llm.word_bpe.MEMORY", 5)
    for text in ("one two three four five six seven eight nine one two", "one eleven", "twelve one"):
        same(coder, text)
    assert len(coder.seen) <= 5


def test_plain_characters_are_plain(coder):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if coder.plain.fullmatch(chr(c))]
    for c in chars:
        assert unicodedata.is_normalized("NFC", "e" + c) and coder.library.normalizer.normalize_str("e" + c) == ("e" + (" " if coder.kind(c) == " " else c)).lower()


def test_table(spark, docs, corpus, coder):
    rows = [*corpus, (300, "y" * 200_000), (301, "<|endoftext|>" * 3), (302, "don't " * 50_000 + "Ω")]
    frame = docs(rows)
    got = sorted(map(tuple, round_trips(frame, MODEL).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        w = ids(coder, t or "")
        want.append((i, len(w), *(sha256(x.encode()).hexdigest() for x in (" ".join(map(str, w)), coder.library.decode(w, skip_special_tokens=False)))))
    assert got == sorted(want, key=repr)
    assert round_trips(docs([]).filter("false"), MODEL).collect() == []
    back = decoded(encoded(frame, MODEL), MODEL)
    assert back.columns == [*frame.columns, "token_ids", "decoded"]
    for r in back.collect():
        assert (r.token_ids is None and r.decoded is None) if r.text is None else (list(r.token_ids) == ids(coder, r.text) and r.decoded == coder.decode(r.token_ids))
