"""SimHash near-duplicate groups by vantage-point trees.

Fingerprints that differ in at most ``radius`` bits are linked, and documents reachable through links form a
component. Distinct fingerprints are dealt to shards by vantage-point trees that are fitted on a bounded sample: a
node sends a fingerprint left when its Hamming distance to the node's vantage point is at most the node's threshold.
By the triangle bound a fingerprint can have partners on the other side only if that distance lies within the radius
of the threshold, so exactly those also visit the boundary-overlapping shards. Two fingerprints that differ in at most
r bits differ in at most r // 2 in one of their halves, so there is a tree over either half with that smaller radius:
far fewer lie that close to a threshold. Every shard repeats this in memory down to small buckets, compares whole
fingerprints there, and returns a spanning forest of its links instead of its pairs, so a group of g fingerprints
costs g rows. Stars of the forests are then joined by alternating min-label
rounds over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, row_key, small_batches, spare

#: Homes in a shard, about; the sample holds SAMPLE fingerprints for each shard, and there are MOST_SHARDS at most
#: (beyond, shards grow and their in-memory trees get deeper).
SHARD, SAMPLE, MOST_SHARDS, BUCKET = 4096, 16, 8192, 384


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: bit b is set where over half of the shingles' XXH64 have it set; no words: 0."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; whole texts, null text as empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col).cast("binary")).alias("fp"))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count the absolute value's bits


def half(fps: np.ndarray, tree: int) -> np.ndarray:
    return (fps >> np.int64(32 * tree)) & np.int64(0xFFFFFFFF)


def grow(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Vantage-point tree over a sample: nodes (vantage, threshold, left, right); a child below 0 is leaf ~child."""
    nodes: list = []
    count = [0]

    def build(s: np.ndarray, n: int) -> int:
        split = None
        if n > 1 and len(s) > 3:
            best = -1.0
            for v in s[:: max(1, len(s) // 8)][:8]:  # the vantage point that spreads the others most
                d = distance(s, v)
                if d.std() > best and d.min() < d.max():
                    best, split = d.std(), (v, min(int(np.median(d)), int(d.max()) - 1), d)
        if split is None:
            count[0] += 1
            return -count[0]
        v, mu, d = split
        at = len(nodes)
        nodes.append(None)
        inside = int(round(n * float((d <= mu).mean())))
        left = build(s[d <= mu], max(1, min(n - 1, inside)))
        right = build(s[d > mu], max(1, n - max(1, min(n - 1, inside))))
        nodes[at] = (v, mu, left, right)
        return at

    return nodes if build(sample, leaves) >= 0 else []


def route(nodes: list, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): every row's home leaf, and the leaves that it visits.

    Of a pair parted at a node only the left member crosses to the right, where it visits on both sides, so each pair
    meets in the right member's home.
    """
    if not nodes:
        n = len(fps)
        return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    out, todo = [], [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, np.full(len(rows), ~at, np.int64), home))
            continue
        v, mu, left, right = nodes[at]
        d = distance(fps[rows], v).astype(np.int64)
        go = np.where(home, d <= mu, d <= mu + radius)
        todo.append((left, rows[go], home[go]))
        go = np.where(home & (d > mu), True, d > mu - radius)
        todo.append((right, rows[go], home[go] & (d[go] > mu)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Union by smallest index, on arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while (y := self.up[x]).tolist() != x.tolist() if len(x) < 32 else not np.array_equal(y := self.up[x], x):
            x = y
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def link_shard(homes: np.ndarray, visitors: np.ndarray, radius: int, tree: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All links within homes and between homes and visitors, as a spanning forest: (fingerprint, root) of non-roots.

    Splits by halves as the trees do; where many share a half, by whole fingerprints with the whole radius.
    """
    every = np.concatenate([homes, visitors])
    forest, halves = Forest(len(every)), half(every, tree)
    todo = [(np.arange(len(homes)), np.arange(len(homes), len(every)), 0, True)]
    while todo:
        h, q, depth, by_half = todo.pop()
        if not len(h):
            continue
        if len(h) > BUCKET and depth < 40:
            x, r = (halves, radius // 2) if by_half else (every, radius)
            v = x[h[(depth * 7919) % len(h)]]
            d = distance(x[h], v).astype(np.int64)
            if d.min() == d.max() and by_half:
                todo.append((h, q, depth + 1, False))
                continue
            if d.min() < d.max():
                mu = min(int(np.median(d)), int(d.max()) - 1)
                e = distance(x[q], v).astype(np.int64)
                near = d <= mu
                todo.append((h[near], q[e <= mu + r], depth + 1, by_half))
                todo.append((h[~near], np.concatenate([h[near & (d > mu - r)], q[e > mu - r]]), depth + 1, by_half))
                continue
        both = np.concatenate([h, q])
        for i in range(0, len(both), 2048):
            y = both[i : i + 2048]
            a, b = np.nonzero(distance(every[y][:, None], every[h][None, :]) <= radius)
            forest.link(y[a], h[b])
    root = forest.roots(np.arange(len(every)))
    moved = root != np.arange(len(every))
    return every[moved], every[root[moved]]


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node that has links, other than its component's smallest, with that smallest node.

    Alternating large-star and small-star rounds: neighbours move to the smallest neighbour until nothing changes.
    Each round is written to the shared folder; rows never exceed the links given. The links of a large star share
    their lower end, so that end is looked up where they lie.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, state = materialize(ends, "links"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now
        state = seen
        above = F.lit(1).cast("long").alias("w")
        around = now.select("u", "v", F.lit(0).cast("long").alias("w")).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), above))
        least = materialize(around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.sum("w").alias("w")), "least")
        lower = least.filter("w > 0").select(F.col("u").alias("v"), "m", "w")
        large = lookup(now, lower, "v", "w", seen[0]).select("u", F.col("m").alias("v"))  # from the lower end
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(now)
        discard(least)
        now = after


def fingerprint_components(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root) for each distinct ``fp`` that is linked to a smaller one; others are their own root."""
    spark = distinct.sparkSession
    n = distinct.count()
    leaves = max(1, min(MOST_SHARDS, n // SHARD))
    picked = distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h", "fp").limit(leaves * SAMPLE if leaves > 1 else 0)
    sample = np.array([r.fp for r in picked.collect()], np.int64)
    trees = [grow(half(sample, t), leaves) if leaves > 1 else [] for t in (0, 1)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b.fp.to_numpy(np.int64)
            for t, nodes in enumerate(trees):
                row, leaf, home = route(nodes, half(fps, t), radius // 2)
                yield pd.DataFrame({"tree": t, "leaf": leaf, "fp": fps[row], "home": home})

    def shard(b: pd.DataFrame) -> pd.DataFrame:
        home = b.home.to_numpy(bool)
        fps = b.fp.to_numpy(np.int64)
        u, v = link_shard(fps[home], fps[~home], radius, int(b.tree.iloc[0]))
        return pd.DataFrame({"u": u, "v": v})

    dealt = distinct.select("fp").mapInPandas(deal, "tree int, leaf long, fp long, home boolean")
    dealt = dealt.groupBy("tree", "leaf").applyInPandas(shard, "u long, v long")
    return stars(dealt).select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Words are runs of other than space and \\t-\\r, lower-cased in A-Z; shingles keep repeats; fewer words than a
    shingle make one shingle of them all; null and empty texts have fingerprint zero and link like any other.
    A row with null id gets the component of its fingerprint; a component of null ids only has a null component_id.
    Repeated rows give repeated rows; other columns of ``docs`` are not looked at, whatever their names.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    rooted = distinct.join(fingerprint_components(distinct, radius), "fp", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    by_fp = materialize(lookup(rooted, groups, "root", "fps").select("fp", "component_id", "n"), "components")
    out = lookup(rows, by_fp, "fp", "n")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id (null ids last); columns as they are.

    Of rows that repeat id and text one stays, as does one of an id's different texts if they are linked. Null and empty
    texts have no words: they are copies of each other, and one of them stays. Very long texts are read whole. Without
    links all rows stay; an empty table gives none. Extra columns go along, whatever their names.
    """
    key = spare(docs, "_key")
    texts = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    groups = materialize(near_duplicates(texts, shingle=shingle, radius=radius), "groups")
    firsts = groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts, "firsts")
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(firsts.filter("n = 1").select(key), key, "left_semi")
    repeated = firsts.filter("n > 1").select(key)
    if not repeated.isEmpty():
        kept = kept.unionByName(docs.withColumn(key, row_key(id_col, text_col)).join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)
