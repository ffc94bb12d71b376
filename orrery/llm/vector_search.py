"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals.

Unit vectors are assigned to the nearest of K coarse centroids; what remains is coded by one of 256 codewords in each
of M slices. A query visits the lists of its nearest centroids; asymmetric tables of its inner products with all
codewords give an estimate of every member's cosine, and members whose estimate may still reach the list's best are
reranked by the exact cosine of the original vectors in the same task, which holds them. Centroids, codewords, the
number of lists to visit and the error bound of estimates are fitted on a bounded sample; all vectors are indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: At most LISTS centroids and PER_LIST sampled vectors for each; PROBES sampled queries choose the number of lists
#: that finds RECALL of their neighbours in the sample. A task compares BLOCK vectors with about CHUNK queries.
#: SPREAD: see ``ceiling``.
LISTS, PER_LIST, PROBES, RECALL, BLOCK, CHUNK, SPREAD = 1024, 40, 256, 0.975, 4096, 8192, 1.0


def kmeans(x: np.ndarray, k: int, rounds: int = 10, unit: bool = False) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest rows of c for each row of x, nearest first."""
    out = []
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ c.T - half
        out.append(s.argmax(1)[:, None] if n == 1 else np.argsort(-s, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


@dataclass
class Index:
    centroids: np.ndarray  # K x dim
    codewords: np.ndarray  # M x up to 256 x dim / M
    probes: int
    margin: float

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(unit, self.centroids, 1)[:, 0]
        rest = unit - self.centroids[at]
        m, _, w = self.codewords.shape
        return at, np.stack([nearest(rest[:, i * w : (i + 1) * w], self.codewords[i], 1)[:, 0] for i in range(m)], axis=1).astype(np.uint8)

    def estimate(self, unit: np.ndarray, base: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cosines, queries x members: inner product with the list's centroid plus table look-ups."""
        m, _, w = self.codewords.shape
        out = np.repeat(base[:, None], len(codes), axis=1)
        for i in range(m):
            table = unit[:, i * w : (i + 1) * w] @ self.codewords[i].T
            out += table[:, codes[:, i]]
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their greatest component to 0.5 up to 1: cosines stay, squares can't overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def matrix(vecs) -> np.ndarray:
    return scaled(np.array([np.asarray(v, np.float64) for v in vecs]))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, k: int, lists: int) -> Index:
    unit = units(sample)
    dim = unit.shape[1]
    centroids = kmeans(unit, min(lists, len(unit)), unit=True)
    at = nearest(unit, centroids, 1)[:, 0]
    slices = next(m for m in range(min(16, dim), 0, -1) if dim % m == 0)
    w = dim // slices
    rest = (unit - centroids[at])[:20_000]
    words = np.stack([kmeans(rest[:, i * w : (i + 1) * w], min(256, len(rest)), 6) for i in range(slices)])
    index = Index(centroids, words, len(centroids), 2.0)
    q = unit[:: max(1, len(unit) // PROBES)][:PROBES]
    cos = q @ unit.T
    top = np.argsort(-cos, axis=1, kind="stable")[:, 1 : k + 1]
    if top.size:
        order = nearest(q, centroids, len(centroids))
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(centroids))[None, :].repeat(len(q), 0), 1)
        need = np.sort(np.take_along_axis(rank, at[top], 1).ravel())
        index.probes = int(need[min(len(need) - 1, math.ceil(RECALL * len(need)) - 1)]) + 1
        few = min(len(unit), 4096)
        codes = index.encode(unit[:few])[1]
        base = q @ centroids.T
        m, _, w = words.shape
        guess = base[:, at[:few]].copy()
        for i in range(m):
            guess += (q[:, i * w : (i + 1) * w] @ words[i].T)[:, codes[:, i]]
        index.margin = 2 * float(np.quantile(np.abs(guess - cos[:, :few]), 0.995))
    return index


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest of ``rows`` other than its own id.

    Score is the cosine in double precision on the original vectors; ties go to the smaller id. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, as query or candidate; nor do null ids. Cosines
    are of vectors of one length, so each length has an index of its own. An id is returned once, with the greatest
    score, though it stand there several times or with several vectors; a query with several vectors gets the nearest
    of any of them. Copies of a vector are indexed once, with its k + 1 smallest ids, which are all that any query can
    return of them. Fewer candidates than k give fewer rows; empty tables give none. Other columns are not looked at.
    """
    spark = rows.sparkSession
    schema = f"query_id {dict(queries.dtypes)[id_col]}, rank int, vec_id {dict(rows.dtypes)[id_col]}, score double"

    def proper(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(fine)

    own = Window.partitionBy("vec").orderBy("id")  # a group limit before the shuffle leaves k + 1 rows a task
    smallest = proper(rows).distinct().withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k + 1)
    vectors = materialize(smallest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asked = materialize(proper(queries).distinct(), "asked")
    sizes = vectors.groupBy(F.size("vec").alias("d")).count().collect()  # a row for each length
    wanted = {r[0] for r in asked.select(F.size("vec")).distinct().collect()}
    found = None
    for dim, n in sorted(tuple(r) for r in sizes if r["d"] in wanted):
        one = indexed(vectors.filter(F.size("vec") == dim), asked.filter(F.size("vec") == dim), n, k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ceiling(near: np.ndarray, lists: pd.DataFrame, dim: int) -> np.ndarray:
    """The greatest cosine that a member of each list can have with each query, from cosines of queries and centroids.

    A member is its part along the centroid plus one across it. By the angle from the centroid to the farthest member it
    can't come nearer than the difference of angles. The parts across point to all sides, so what they add is mostly far
    less: SPREAD deviations and those that the best of so many members is expected to reach. The lesser of the two holds.
    """
    widest = np.arccos(np.clip(lists.least.to_numpy(), -1, 1))
    strict = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - widest, 0))
    across = np.sqrt(np.clip(1 - near * near, 0, 1)) * np.sqrt(lists.across.to_numpy() / max(1, dim - 1))
    along = np.where(near > 0, near * lists.most.to_numpy(), near * lists.least.to_numpy())
    return np.minimum(strict, along + across * (SPREAD + np.sqrt(2 * np.log1p(lists.n.to_numpy()))))


def kth(found: DataFrame, k: int) -> DataFrame:
    """(id, least): the score of the k-th best of each query that has so many."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best))
    return once.filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))


def indexed(vectors: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the nearest of ``vectors`` (vec, ids), n of one length, in each visited list.

    A first round visits the lists of as many nearest centroids as found the neighbours of sampled queries. A second one
    visits, for each query, every other list that may hold a nearer one than its k-th, and all lists for queries that have
    fewer than k: so queries from sparse regions, of which a sample has few, are not cut short.
    """
    spark = vectors.sparkSession
    lists = max(1, min(LISTS, round(math.sqrt(n))))
    sample = vectors.select("vec", F.xxhash64(F.col("ids")[0]).alias("h")).orderBy("h").limit(lists * PER_LIST).toPandas()
    index = fit(matrix(sample.vec), k, lists)
    shared = spark.sparkContext.broadcast(index)  # LISTS centroids and 256 codewords a slice at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                unit = units(matrix(b.vec))
                at, codes = shared.value.encode(unit)
                yield b.assign(list=at.astype(np.int32), code=[c.tobytes() for c in codes], along=(unit * shared.value.centroids[at]).sum(1))

    fields = f"vec {dict(vectors.dtypes)['vec']}, ids {dict(vectors.dtypes)['ids']}"
    coded = materialize(vectors.mapInPandas(assign, f"{fields}, list int, code binary, along double"), "coded")
    stats = coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("along").alias("least"), F.max("along").alias("most"), F.avg(1 - F.col("along") * F.col("along")).alias("across"))
    lists_of = stats.toPandas().set_index("list").reindex(range(len(index.centroids)))  # a row for each list
    lists_of = lists_of.fillna({"n": 0, "least": 1.0, "most": 1.0, "across": 0.0})
    counts = {i: int(c) for i, c in lists_of.n.items() if c}
    total = asked.count()
    dim = index.centroids.shape[1]
    splits = [max(1, math.ceil(counts.get(i, 0) / BLOCK)) for i in range(len(index.centroids))]
    filled = np.array([i in counts for i in range(len(index.centroids))])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i : i + 64]
                unit = units(matrix(part.vec))
                order = nearest(unit, x.centroids, len(x.centroids))
                if "least" in part:
                    may = ceiling(unit @ x.centroids.T, lists_of, dim) >= part.least.fillna(-2.0).to_numpy()[:, None]
                    visits = [[c for c in order[j][x.probes :] if may[j, c]] for j in range(len(part))]
                else:
                    visits = order[:, : x.probes]
                out = [(j, c, s) for j in range(len(part)) for c in visits[j] if filled[c] for s in range(splits[c])]
                if out:
                    j, c, s = map(list, zip(*out, strict=True))
                    yield pd.DataFrame({"id": part.id.to_numpy()[j], "vec": part.vec.to_numpy()[j], "list": np.array(c, np.int32), "split": np.array(s, np.int32)})

    qfields = f"id {dict(asked.dtypes)['id']}, vec {dict(asked.dtypes)['vec']}, list int, split int"
    of = F.element_at(F.expr(f"array({','.join(map(str, splits))})"), F.col("list") + 1)

    def compare(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(members) or not len(queries):
            return none
        x = shared.value
        vecs = matrix(members.vec)
        codes = np.frombuffer(b"".join(members.code), np.uint8).reshape(len(members), -1)
        norms = np.sqrt((vecs * vecs).sum(1))
        many = np.array([len(i) for i in members.ids])
        flat = np.concatenate([np.asarray(i) for i in members.ids])
        known, place = np.unique(np.concatenate([flat, queries.id.to_numpy()]), return_inverse=True)  # numbers in the order of ids
        own, asks = place[: len(flat)], place[len(flat) :]
        first = np.cumsum(many) - many
        centroid = x.centroids[members.list.iloc[0]]

        def best_of(rows: np.ndarray, at: np.ndarray, q: np.ndarray, me: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row, id, score) of the k best ids of each row among the vectors ``at`` its pairs name."""
            score = (vecs[at] * q[rows]).sum(1) / (norms[at] * np.sqrt((q * q).sum(1))[rows])
            n = many[at]
            rows, score = np.repeat(rows, n), np.repeat(score, n)
            ids = own[np.repeat(first[at], n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)]
            other = ids != me[rows]
            rows, ids, score = rows[other], ids[other], score[other]
            order = np.lexsort((ids, -score, rows))
            rows, ids, score = rows[order], ids[order], score[order]
            once = np.sort(np.unique(rows * len(known) + ids, return_index=True)[1])  # of an id with several vectors the best
            rows, ids, score = rows[once], ids[once], score[once]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            return rows[rank < k], ids[rank < k], score[rank < k]

        out = []
        for i in range(0, len(queries), 256):
            q, me = matrix(queries.vec.iloc[i : i + 256]), asks[i : i + 256]
            u = units(q)
            guess = x.estimate(u, u @ centroid, codes)
            if len(members) > k + 1:
                bar = np.partition(guess, -(k + 1), axis=1)[:, -(k + 1)] - x.margin
            else:
                bar = np.full(len(q), -np.inf)
            found = [best_of(*np.nonzero(guess >= bar[:, None]), q, me)]
            # ids with several vectors may leave fewer than k: such rows look at all of the list
            few = np.nonzero(np.bincount(found[0][0], minlength=len(q)) < k)[0]
            if len(few) and len(members) > k + 1:
                found = [tuple(v[~np.isin(found[0][0], few)] for v in found[0]), best_of(np.repeat(few, len(members)), np.tile(np.arange(len(members)), len(few)), q, me)]
            for rows, ids, score in found:
                out.append(pd.DataFrame({"query_id": known[me[rows]], "vec_id": known[ids], "score": score}))
        return pd.concat(out) if out else none

    keys = ["list", "split", "chunk"]
    kinds = dict(vectors.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def visited(queries: DataFrame, share: float) -> DataFrame:
        chunks = max(1, math.ceil(total * share / CHUNK))
        probes = queries.mapInPandas(route, qfields).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        blocks = coded.drop("along").withColumn("split", F.pmod(F.xxhash64("ids"), of).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return blocks.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(compare, f"query_id {dict(asked.dtypes)['id']}, vec_id {kinds}, score double")

    first = materialize(visited(asked, index.probes / len(index.centroids)), "found")
    if index.probes >= len(index.centroids):
        return first
    more = materialize(asked.join(kth(first, k), "id", "left"), "wider")
    return first.unionByName(visited(more, 1.0))
