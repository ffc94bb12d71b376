"""Encoding and decoding with a word-level BPE vocabulary, as the tokenizers library does, by contiguous rank arrays.

A word starts as the ids of its bytes, the last one marked as the end of a word. One array holds its parts and another
the rank of merging each part with the next; the leftmost smallest rank is merged: its boundary goes, and the ranks on
both sides are looked up again. Long words do the same with a heap, since a scan for each merge takes the square of
their length. Words repeat, so a task remembers what a bounded number of short ones became.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts up to which a word is scanned, words remembered at once, and their greatest length.
SCANNED, MEMORY, REMEMBERED = 128, 300_000, 48
NEVER = 1 << 60
#: The file's end of a word, the space it writes for white space, and its contractions.
END, SPACE = "</w>", " "
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters of which each is its own composed form, next to any other of them, and is lowered by itself.
PLAIN = r"\x00-ɏ‐-‧‰-⁞₠-₿"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_characters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + END] for c in letters]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.kinds: dict[str, str] = {}
        self.plain = re.compile(f"[{PLAIN}]*")
        chars = sorted({x for c in range(0x2100) if self.plain.fullmatch(chr(c)) for x in chr(c) + chr(c).lower()})
        of = {k: "".join(re.escape(c) for c in chars if self.kind(c) == k) for k in "L0 "}
        self.blank = re.compile(f"[{of[' ']}]+")
        self.words = re.compile(f"{CONTRACTIONS}|[{of['L']}]+|[{of['0']}]|[^{of['L']}{of['0']}{of[' ']}]+")
        self.shadow = re.compile(f"{CONTRACTIONS}|[a-zL]+|0|[^a-zL0 ]+")
        self.seen: dict[str, tuple[int, str, str]] = {}

    def kind(self, c: str) -> str:
        """L letter, 0 number, blank or ! anything else, as the library's own pattern takes the character."""
        if c not in self.kinds:
            joined = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s)) == 1
            if not self.library.pre_tokenizer.pre_tokenize_str(c):
                self.kinds[c] = " "
            else:
                self.kinds[c] = "L" if joined("a" + c) else "!" if joined("!" + c) else "0"
        return self.kinds[c]

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.plain.fullmatch(text):
            return self.words.findall(self.blank.sub(SPACE, text).lower())
        text = self.library.normalizer.normalize_str(text)
        of = {ord(c): c if c.isascii() and c.isalpha() or c == "'" else self.kind(c) for c in set(text)}
        return [text[m.start() : m.end()] for m in self.shadow.finditer(text.translate(of))]

    def merged(self, word: str) -> list[int]:
        """The ids of a word."""
        data = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self.scanned(parts) if len(parts) <= SCANNED else self.heaped(parts)

    def scanned(self, parts: list[int]) -> list[int]:
        look = self.ranks.get
        none = (NEVER, -1)
        ranks = [look(pair, none)[0] for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)  # the leftmost of equal ranks
            parts[i] = self.ranks[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look((parts[i - 1], parts[i]), none)[0]
            if i < len(ranks):
                ranks[i] = look((parts[i], parts[i + 1]), none)[0]
        return parts

    def heaped(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n:
                continue
            now, new = self.ranks.get((parts[i], parts[j]), (NEVER, -1))
            if now != rank:  # what stood here when this was pushed is gone
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (parts[a], parts[b]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[parts[a], parts[b]][0], a))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids, decoded tokens) of a word, both joined by spaces."""
        ids = self.merged(word)
        out = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(word) <= REMEMBERED:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            self.seen[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return [int(i) for f in self.found(text) for i in f[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        found = self.found(text or "")
        sums = [sha256(" ".join([f[k] for f in found]).encode()).hexdigest() for k in (1, 2)]
        return sum([f[0] for f in found]), *sums

    def found(self, text: str) -> list[tuple[int, str, str]]:
        """What each special token and word of a whole text became, in order."""
        found: list[tuple[int, str, str]] = []
        for part in self.split.split(text):
            if part in self.special:
                found.append((1, str(self.special[part]), part))
                continue
            pieces = self.pieces(part)
            try:
                found += [self.seen[w] for w in pieces]
            except KeyError:
                found += [self.seen.get(w) or self.word(w) for w in pieces]
        return found


@lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: the ids of the whole text, decimal and joined by spaces,
    and the text they decode to, as the tokenizers library gives both without added special tokens.

    Null and empty texts have no ids, whose digest is that of an empty text; a special token's own string in a text is
    that token. Null ids and repeated rows are kept; an empty table gives no rows; other columns are not looked at. A text
    is never cut: a word of any length takes n log n steps. ``model`` is a path on every executor.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for batch in texts:
            yield pd.DataFrame([c.digests(t) for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), each(F.col(text_col)).alias("x")).select("doc_id", "x.*")


def encoded(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an array; null texts have none (null)."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(model)
        for batch in texts:
            yield pd.Series([None if t is None else c.encode(t) for t in batch])

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decoded(docs: DataFrame, model: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of ids; null arrays have none (null), ids that the vocabulary lacks no text."""

    @F.pandas_udf("string")
    def texts(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(model)
        for batch in rows:
            yield pd.Series([None if r is None else c.decode(r) for r in batch])

    return docs.withColumn(text_col, texts(F.col(ids_col)))
