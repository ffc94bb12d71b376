"""Language identification by language-bitmask n-gram filters.

Training counts in how many documents of a language each character n-gram stands, and keeps a language's frequent
ones. A bit-sliced Bloom filter holds them all: every slot is a bitmask of languages, an n-gram sets its language's
bit in HASHES slots, and the AND of its slots gives at once all languages that (may) contain it. For a text the
popcounts of each language's bit over its n-grams, corrected for the language's false-positive rate, are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: n of the n-grams, hash functions and slots (a power of two) of the filter, and the least share of a language's
#: training documents that must contain an n-gram; about SAMPLE documents of a language (by hash of id and text, from
#: all partitions) train it, each with its whole text.
GRAM, HASHES, SLOTS, SHARE, SAMPLE = 3, 3, 1 << 20, 0.02, 1000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams of the lower-cased letters, with other runs as one space; a text without letters: none."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return coded(c)


_LETTER = None


def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def coded(c: np.ndarray) -> np.ndarray:
    ok = letters()[c]
    if not ok.any():
        return np.zeros(0, np.uint64)
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first non-letter after a letter stands for its run
    c = np.where(ok, c, 32)[keep].astype(np.uint64)
    c = np.concatenate([np.array([32], np.uint64), c, np.array([32], np.uint64)])
    if c[-2] == 32:
        c = c[:-1]
    code = c[: len(c) - GRAM + 1].copy()
    for i in range(1, GRAM):
        code = (code << np.uint64(21)) | c[i : len(c) - GRAM + 1 + i]
    return code


def slots(codes: np.ndarray) -> Iterator[np.ndarray]:
    for m in _MIX:
        h = (codes ^ (codes >> np.uint64(29))) * m
        yield (h ^ (h >> np.uint64(32))) & np.uint64(SLOTS - 1)


@dataclass
class Filters:
    languages: list[str]
    tables: list[np.ndarray]  # a bitmask of languages for each slot, in as many words as there are languages for
    rates: np.ndarray  # false-positive rate of each language

    @property
    def table(self) -> np.ndarray:
        return self.tables[0]

    def score(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text else np.zeros(0, np.uint64)
        if not len(codes) or not self.languages:
            return "und", 0.0
        found, places = [], list(slots(codes))
        for table in self.tables:
            masks = table[places[0]]
            for at in places[1:]:
                masks = masks & table[at]
            if masks.dtype == np.uint16:
                kinds = np.bincount(masks, minlength=1)  # how many n-grams have each set of languages
                sets = np.nonzero(kinds)[0]
                kinds = kinds[sets]
            else:
                sets, kinds = np.unique(masks, return_counts=True)
            found += [kinds[(sets >> i) & 1 == 1].sum() for i in range(min(8 * masks.itemsize, len(self.languages) - len(found)))]
        n = np.array(found) / len(codes)
        share = np.clip((n - self.rates) / (1 - self.rates), 0, None)
        best = int(share.argmax())
        rest = np.delete(share, best)
        other = float(rest.max()) if len(rest) else 0.0
        top = float(share[best])
        return self.languages[best], float(np.clip(top * top / (top * top + other * other), 0, 1)) if top > 0 else 0.0


def train(rows: list[tuple[str, str]]) -> Filters:
    """Filters from (language, text), in memory."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text)
    kept = {}
    for lang, of in texts.items():
        codes, n = np.unique(np.concatenate([np.unique(grams(t)) for t in of]), return_counts=True)
        kept[lang] = codes[n >= max(1, SHARE * len(of))]
    return filters(kept)


def filters(kept: dict[str, np.ndarray]) -> Filters:
    """Filters from each language's frequent n-grams: a bit of a slot for each language, in words of 16 bits if that is enough, else 64."""
    languages = sorted(kept)
    word = np.uint16 if len(languages) <= 16 else np.uint64
    bits = 8 * word().itemsize
    tables = [np.zeros(SLOTS, word) for _ in range(max(1, -(-len(languages) // bits)))]
    for i, lang in enumerate(languages):
        for at in slots(kept[lang]):
            tables[i // bits][at] |= word(1 << i % bits)
    rates = np.array([(((tables[i // bits] >> i % bits) & 1).mean()) ** HASHES for i in range(len(languages))])
    return Filters(languages, tables, rates)


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(l, code, n): in how many texts of a batch (l, t) of a language each n-gram stands; code -1 counts the texts."""
    for b in batches:
        for lang, texts in b.groupby("l")["t"]:
            codes, n = np.unique(np.concatenate([np.unique(grams(t)) for t in texts]), return_counts=True)
            yield pd.DataFrame({"l": lang, "code": np.append(codes.astype(np.int64), -1), "n": np.append(n, len(texts))})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from a bounded sample of labelled rows: about SAMPLE documents of each language, read whole by the executors.

    A row is drawn by the hash of its id and text, and rows that repeat both count once. The driver gets a language's
    frequent n-grams only: at most the mean number of a document's n-grams over SHARE.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    known = known.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), h.alias("h"), (F.pmod(h, F.lit(1 << 20)) / float(1 << 20)).alias("draw"))
    langs = known.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first")).collect()  # a row for each language
    if not langs:
        return filters({})
    # the first draw of a language always goes in, so none is without a document
    shares = docs.sparkSession.createDataFrame([(x, max(SAMPLE / n, first + 0.5 / (1 << 20))) for x, n, first in langs], "l string, share double")
    picked = known.join(F.broadcast(shares), "l").filter("draw < share").dropDuplicates(["l", "h"]).select("l", "t")
    small_batches(docs.sparkSession)
    grouped = picked.mapInPandas(counted, "l string, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n"))
    grouped = materialize(grouped, "grams")
    texts = grouped.filter("code = -1").select("l", F.col("n").alias("texts"))
    often = grouped.filter("code >= 0").join(F.broadcast(texts), "l").filter(F.col("n") >= F.greatest(F.lit(1.0), F.col("texts") * SHARE))
    kept = {x.l: np.zeros(0, np.uint64) for x in langs}
    for lang, codes in often.select("l", "code").toPandas().groupby("l")["code"]:
        kept[lang] = codes.to_numpy().astype(np.uint64)
    return filters(kept)


def identify(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; whole texts. ``und`` and 0 for null text and text without letters."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB up to 16 languages, then 8 MB for every 64

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in texts:
            yield pd.DataFrame([m.score(t) for t in batch], columns=["lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows with crc32(id as text) mod 4 = 2 never train.

    A null id is not held out. Null languages train nothing; without any labelled text every prediction is ``und``.
    Repeated rows are kept; an empty table gives no rows; columns other than id, text and language are not looked at.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    model = fit(base.filter("NOT held_out"), "doc_id", "text", "lang")
    out = identify(base.withColumn("_row", F.struct("doc_id", "held_out")), model, "_row", "text")
    return out.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")
