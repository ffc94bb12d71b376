"""Vectors as short codes: integer codebooks of their parts by Lloyd's rounds with Hamerly's two bounds.

Every part of a vector keeps its entry, an upper bound of the distance to it and a lower bound of the distance to the
second nearest. After entries have moved, the bounds widen by what they moved; a part whose upper bound is still strictly
below the lower one (or below half the way from its entry to the next) can't have another nearest entry, nor a tie. Else
the upper bound is made exact, and where that fails too all entries are scanned, in whole numbers, ties to the lower
index. Bounds are rounded outward, so codes are those of full scans. They are written with the vectors after each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components up to this size are whole numbers of 64 bits, as are their squared distances; larger ones are Python's.
FITS, BLOCK = 1 << 26, 2048
#: Sums are shipped in signed limbs of so many bits, since those of large components have no SQL type.
LIMB = 40


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, exactly."""
    if not x.size or np.abs(x).max() < FITS / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [math.floor(v * SCALE) if abs(v) < 2.0**60 else int(v) * SCALE for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def cuts(d: int) -> list[tuple[int, int]]:
    """Where PARTS consecutive parts of d components start and end; equal where PARTS divides d."""
    return [(i * d // PARTS, (i + 1) * d // PARTS) for i in range(PARTS)]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and all rows of c."""
    out = np.zeros((len(x), len(c)), np.int64 if x.dtype == c.dtype == np.int64 else object)
    for j in range(x.shape[1]):
        step = x[:, j, None] - c[None, :, j]
        out += step * step
    return out


def own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x and the same row of c."""
    out = np.zeros(len(x), np.int64 if x.dtype == c.dtype == np.int64 else object)
    for j in range(x.shape[1]):
        step = x[:, j] - c[:, j]
        out += step * step
    return out


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, float).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, float).astype(np.float32), np.float32(-np.inf))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, upper bound, lower bound of the second nearest) by distances to all entries."""
    at, near, far = np.zeros(len(x), np.uint8), np.zeros(len(x), np.float32), np.full(len(x), np.inf, np.float32)
    for i in range(0, len(x), BLOCK):
        d = distances(x[i : i + BLOCK], book)
        best = d.argmin(1)
        rows = np.arange(len(d))
        at[i : i + BLOCK], near[i : i + BLOCK] = best, up(np.sqrt(d[rows, best].astype(float)))
        if len(book) > 1:
            d[rows, best] = d.max() + 1
            far[i : i + BLOCK] = down(np.sqrt(d.min(1).astype(float)))
    return at, near, far


class Books:
    """A codebook for each part, and how far its entries are from the last ones and from each other."""

    def __init__(self, books: list[np.ndarray], last: list[np.ndarray] | None = None):
        self.books, self.moved, self.others, self.half = books, [], [], []
        for p, book in enumerate(books):
            moved = np.sqrt(np.zeros(len(book)) if last is None else own(book, last[p]).astype(float)) * (1 + 1e-12)
            most = np.argsort(-moved)[:2]
            others = np.full(len(book), moved[most[0]])  # the greatest move of any entry but this one
            others[most[0]] = moved[most[1]] if len(book) > 1 else 0
            gaps = distances(book, book).astype(float)
            np.fill_diagonal(gaps, np.inf)
            self.moved.append(moved)
            self.others.append(others)
            self.half.append(np.sqrt(gaps.min(1)) / 2 * (1 - 1e-12))

    def refine(self, p: int, x: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, upper, lower) of a part of all rows after the entries have moved, and how many rows were scanned."""
        book = self.books[p]
        at, near, far = at.copy(), up(near + self.moved[p][at]), down(far - self.others[p][at])
        line = np.maximum(far, down(self.half[p])[at])
        loose = np.flatnonzero(~(near < line))
        near[loose] = up(np.sqrt(own(x[loose], book[at[loose]]).astype(float)))
        loose = loose[~(near[loose] < line[loose])]
        at[loose], near[loose], far[loose] = scan(x[loose], book)
        return at, near, far, len(loose)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d))


def packed(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of PARTS numbers from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, PARTS)


def rows_of(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def assigned(rows: DataFrame, d: int, books: Books) -> DataFrame:
    """``rows`` with the entry and both bounds of every part: scanned if they have none, else refined."""
    old = "at" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], d)
            at, near, far = (packed(b[c], k).copy() if old else np.zeros((len(x), PARTS), k) for c, k in (("at", np.uint8), ("near", np.float32), ("far", np.float32)))
            for p, (i, j) in enumerate(cuts(d)):
                if old:
                    at[:, p], near[:, p], far[:, p], _ = books.refine(p, x[:, i:j], at[:, p], near[:, p], far[:, p])
                else:
                    at[:, p], near[:, p], far[:, p] = scan(x[:, i:j], books.books[p])
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["v"], rows_of(at), rows_of(near), rows_of(far)], names)

    base = rows.select("id", "label", "v", *(("at", "near", "far") if old else ()))
    names = ["id", "label", "v", "at", "near", "far"]
    types = dict(rows.dtypes)
    return base.mapInArrow(run, f"id {types['id']}, label string, v {types['v']}, at binary, near binary, far binary")


def moved(rows: DataFrame, d: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks: of each entry the floor of its parts' mean; unused entries stay.

    Every task adds up its own rows, so what is shuffled is some rows for each entry and task, and what the driver gets is
    some rows for each entry."""
    places, wide = cuts(d), max(1, -(-d // PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, ENTRIES), np.int64)
        sums = np.zeros((PARTS, ENTRIES, wide), object)
        for b in batches:
            x, at = matrix(b["v"], d), packed(b["at"], np.uint8)
            for p, (i, j) in enumerate(places):
                count[p] += np.bincount(at[:, p], minlength=ENTRIES)
                here = np.zeros((ENTRIES, wide), x.dtype)
                np.add.at(here[:, : j - i], at[:, p], x[:, i:j])
                sums[p] += here
        out, limb = [], 0
        rest = [(p, e, int(count[p, e]), [int(v) for v in sums[p, e]]) for p, e in zip(*np.nonzero(count), strict=True)]
        while rest:
            out += [(int(p), int(e), limb, n, [(abs(v) & ((1 << LIMB) - 1)) * (-1 if v < 0 else 1) for v in s]) for p, e, n, s in rest]
            rest = [(p, e, 0, [(abs(v) >> LIMB) * (-1 if v < 0 else 1) for v in s]) for p, e, _, s in rest if any(abs(v) >> LIMB for v in s)]
            limb += 1
        yield pa.RecordBatch.from_pylist([dict(zip(("p", "e", "k", "n", "s"), r, strict=True)) for r in out], pa.schema({"p": pa.int32(), "e": pa.int32(), "k": pa.int32(), "n": pa.int64(), "s": pa.list_(pa.int64())}))

    totals = rows.select("v", "at").mapInArrow(run, "p int, e int, k int, n long, s array<long>").groupBy("p", "e", "k").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(wide)])
    n: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int], list[int]] = {}
    for r in totals.collect():  # PARTS x ENTRIES, times the limbs that there are
        n[r.p, r.e] = n.get((r.p, r.e), 0) + r.n
        total[r.p, r.e] = [a + (r[f"s{j}"] << (LIMB * r.k)) for j, a in enumerate(total.get((r.p, r.e), [0] * wide))]
    out = []
    for p, (i, j) in enumerate(places):
        book = [[total[p, e][c] // n[p, e] for c in range(j - i)] if (p, e) in n else list(row) for e, row in enumerate(books[p])]
        out.append(entries(book, j - i))
    return out


def entries(rows: list[list[int]], d: int) -> np.ndarray:
    fits = all(abs(v) <= FITS for r in rows for v in r)
    out = np.empty((len(rows), d), np.int64 if fits else object)
    for i, r in enumerate(rows):
        out[i] = [int(v) for v in r]
    return out


def coded(rows: DataFrame, d: int) -> DataFrame:
    """(id, label, code, error, books) of vectors (id, label, v) of length d."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    x = whole(np.array([r.v for r in first], float).reshape(len(first), d))
    books = [entries(x[:, i:j].tolist(), j - i) for i, j in cuts(d)]
    state = materialize(assigned(rows, d, Books(books)), "codes")
    for _ in range(ROUNDS - 1):
        books, last = moved(state, d, books), books
        before, state = state, materialize(assigned(state, d, Books(books, last)), "codes")
        discard(before)
    books, last = moved(state, d, books), books
    final = Books(books, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], d)
            old = [packed(b[c], k) for c, k in (("at", np.uint8), ("near", np.float32), ("far", np.float32))]
            at, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), object)
            for p, (i, j) in enumerate(cuts(d)):
                at[:, p] = final.refine(p, x[:, i:j], *[o[:, p] for o in old])[0]
                error += own(x[:, i:j], final.books[p][at[:, p]])
            sums = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array([r.tobytes().hex() for r in at]), sums], ["id", "label", "code", "error"])

    out = state.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, label string, code string, error long")
    return out.withColumn("books", F.lit(sha256(",".join(str(v) for b in books for r in b for v in r).encode()).hexdigest()))


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector is neither null nor holds null or
    non-finite components.

    Components become whole numbers, floor(256 x). The codebooks of the PARTS parts start with the ENTRIES rows of the
    smallest ids (equal ids by vector, null ids last), or with all rows if there are fewer, and move in ROUNDS rounds.
    Vectors of another length are a table of their own, with codebooks of their own, a few jobs each; a length that PARTS
    doesn't divide is cut as equally as can be, and empty vectors have parts without components. Null ids and repeated
    rows are kept; an empty table gives no rows; other columns are not looked at. Components of any size are exact; an
    error (or sum of errors) beyond a long is null.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    kept = rows.filter(sound).select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v"))
    lengths = sorted(r[0] for r in kept.groupBy(F.size("v").alias("d")).count().collect())
    parts = [coded(kept.filter(F.size("v") == d), d) for d in lengths]
    if not parts:
        return kept.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = materialize(out, "errors")
    sums = out.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("error").alias("n"), F.count(F.lit(1)).alias("w"))
    sums = materialize(sums.select("label", F.when(F.col("n") == F.col("w"), F.col("label_error")).alias("label_error"), "w"), "labels")
    return lookup(out, sums, "label", "w").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.col("books").alias("codebooks_sha256"))
