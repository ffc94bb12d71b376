"""Token counts of whole texts, with huge texts encoded in overlapping chunks that are spliced where they agree.

A boundary is proven stable by the vocabulary: if no piece holds a space mark after another character, no merge ever
crosses the place where a run of spaces starts, and if no piece holds a line feed none crosses it either; what stands
on both sides is then encoded independently. The same fact lets short texts be counted stretch by stretch between such
boundaries with a memory of the stretches seen. Where the vocabulary doesn't prove it, texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Bytes of a chunk and of a first overlap; a text of more than a chunk is huge. Stretches remembered at once.
CHUNK, OVERLAP, MEMORY = 32_768, 256, 300_000
STRETCH = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i))]
        probe = "a  b " + MARK + " c　ﬁ \n\t́"
        same = "".join(self.sp.encode(probe, out_type=str)).startswith(MARK + "a" + MARK * 2 + "b" + MARK * 2 + " ")
        self.proven = same and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
        self.seen: dict[str, int] = {}
        self.alone = len(self.sp.encode("a ")) - len(self.sp.encode("a"))  # one space mark before a line feed or the end

    def whole(self, text: str) -> int:
        return len(self.sp.encode(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.proven:
            return self.whole(text)
        return self.stretches(text) if len(text) <= CHUNK else self.spliced(text)

    def stretches(self, text: str) -> int:
        """The sum over stretches; a space that starts one stands for the mark that the library puts first."""
        if "  " in text or " \n" in text or MARK in text or text[0] == " " or text[-1] == " ":
            parts = [p[1:] if p[0] == " " else p for p in STRETCH.findall(" " + text.replace(MARK, " "))]
        else:
            parts = text.replace("\n", " \n").split(" ")
        try:
            return sum(map(self.seen.__getitem__, parts))
        except KeyError:
            pass
        if len(self.seen) > MEMORY:
            self.seen.clear()
        new = [p for p in set(parts) if p not in self.seen]
        got = self.sp.encode(new, num_threads=1)
        here = {p: len(ids) - self.alone if p[:1] == "\n" else len(ids) if p else self.alone for p, ids in zip(new, got, strict=True)}
        self.seen.update((p, n) for p, n in here.items() if len(p) <= 64)
        return sum(here[p] if p in here else self.seen[p] for p in parts)

    def starts(self, data: bytes, a: int, b: int) -> list[int]:
        """Where the pieces of data[a:b] start in ``data``, in bytes."""
        return [a + p.begin for p in self.sp.encode(data[a:b].decode(), return_type="proto").pieces]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Chunks overlap; two neighbours are spliced at a stable boundary at which pieces of both start.

        Where no such boundary is in the overlap it is widened, at last to the whole chunk, which then grows.
        """
        data = text.encode()
        a, b, total, done = 0, edge(data, chunk), 0, -1  # data[a:b] is encoded; pieces that start before done are counted
        left = self.starts(data, a, b)
        while b < len(data):
            wide, end = overlap, edge(data, b + chunk)
            while True:
                start = edge(data, b - wide)
                if start <= max(done, a):
                    start, right = a, self.starts(data, a, end)
                    break
                right = self.starts(data, start, end)
                both = set(left).intersection(right)
                at = max((p for p in both if start < p < b and stable(data, p)), default=None)
                if at is not None:
                    total += sum(done <= p < at for p in left)
                    done = at
                    break
                wide *= 2
            a, b, left = start, end, right
        return total + sum(p >= done for p in left)


def edge(data: bytes, i: int) -> int:
    """The next start of a character at or after i."""
    i = min(max(i, 0), len(data))
    while i < len(data) and data[i] & 0xC0 == 0x80:
        i += 1
    return i


def stable(data: bytes, p: int) -> bool:
    return data[p] == 10 or data[p] == 32 and data[p - 1] != 32 and data[p - 3 : p] != MARK.encode()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the sentencepiece library encodes the whole text.

    Null and empty texts have no bytes and no tokens. Null ids and repeated rows are kept; an empty table gives no
    rows; other columns are not looked at. ``model`` is a path on every executor.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model)
        for batch in texts:
            yield pd.Series([c.count(t) for t in batch], dtype="int64")

    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), count(F.col(text_col)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
