"""A Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups, and every row's proof.

A tree is cut into aligned blocks of FANOUT ** DEPTH nodes. A block is one row of a table: its digests stand one after
the other, 64 bytes each, in one string, which a task views as a matrix, reshapes by the fanout and hashes level by
level. The blocks' own nodes are the next tier, cut into blocks again, until each group has one. Siblings then go down,
tier by tier: a block's row meets the one row of the node it became, and its members' siblings are slices of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums

#: Nodes of a run, and levels of a block: a block holds 729 nodes and its row some 100 kB.
FANOUT, DEPTH, HEX = 3, 6, 64


def digest(parts: list[Column]) -> Column:
    """SHA-256 of the values put together: ``-`` for null, else the length in bytes, ``:`` and the value."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def hashed(level: np.ndarray) -> np.ndarray:
    """The next level: each row of FANOUT digests, and the shorter last one, becomes its digest."""
    whole = len(level) // FANOUT * FANOUT
    rows = [*level[:whole].reshape(-1, FANOUT * HEX), *([level[whole:].ravel()] if whole < len(level) else [])]
    return np.frombuffer("".join(sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, HEX)


def levels(digests: str, first: bool, depth: int) -> list[np.ndarray]:
    """All levels of a block, its nodes first and its root last. A group's only block (the first, not full) ends at one
    node; another one has ``depth`` levels, however few its nodes are."""
    out = [np.frombuffer(digests.encode(), np.uint8).reshape(-1, HEX)]
    alone = first and len(out[0]) < FANOUT**depth
    while len(out[-1]) > 1 or (not alone and len(out) <= depth):
        out.append(hashed(out[-1]))
    return out


def siblings(tree: list[np.ndarray]) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level below the root, what stands left and right of each node in its run."""
    out = []
    for level in tree[:-1]:
        flat, at = level.tobytes(), np.arange(len(level))
        start = at // FANOUT * FANOUT
        end = np.minimum(start + FANOUT, len(level))
        left = [flat[a:b] for a, b in zip(start * HEX, at * HEX, strict=True)]
        right = [flat[a:b] for a, b in zip((at + 1) * HEX, end * HEX, strict=True)]
        out.append((left, right))
    return out


def blocks(nodes: DataFrame, depth: int, *more: str) -> DataFrame:
    """One row for each (group, block) of nodes (group, pos, digest, more): their digests, and ``more``, in order."""

    @F.pandas_udf("string")
    def root(digests: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series([levels(d, b == 0, depth)[-1].tobytes().decode() for d, b in zip(digests, block, strict=True)])

    gathered = nodes.groupBy("group", F.expr(f"pos div {FANOUT**depth}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *more))).alias("_m"))
    cols = [F.array_join("_m.digest", "").alias("digests"), *[F.col(f"_m.{c}").alias(c) for c in more]]
    return gathered.select("group", "block", *cols).withColumn("root", root("digests", "block"))


def tiers(leaves: DataFrame, depth: int, name: str, *more: str) -> list[DataFrame]:
    """The blocks of the leaves, of the blocks' nodes, and so on until each group has one block."""
    out = [materialize(blocks(leaves, depth, *more), name)]
    while (out[-1].agg(F.max("block")).first()[0] or 0) > 0:
        out.append(materialize(blocks(out[-1].select("group", F.col("block").alias("pos"), F.col("root").alias("digest")), depth), name))
    return out


def downward(tier: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """(group, pos, left, right, more) of a tier's nodes, with the siblings at every level up to the root of all, lowest
    first, from those of its blocks, one row for each."""
    more = [c for c in above.columns if c not in ("group", "pos", "left", "right")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                tree = levels(r.digests, r.block == 0, depth)
                own, n = siblings(tree), len(tree[0])
                side = lambda s, up: [[x[s][i // FANOUT**k].decode() for k, x in enumerate(own)] + list(up) for i in range(n)]  # noqa: B023, E731
                frame = {"group": r.group, "pos": r.block * FANOUT**depth + np.arange(n), "left": side(0, r.left), "right": side(1, r.right)}
                yield pd.DataFrame(frame | {c: getattr(r, c) for c in more})

    types = dict(above.dtypes)
    schema = "group string, pos long, left array<string>, right array<string>" + "".join(f", {c} {types[c]}" for c in more)
    return tier.select("group", "block", "digests").join(above.withColumnRenamed("pos", "block"), ["group", "block"]).mapInPandas(run, schema)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is the digest of ``columns``; leaves of a group ascend by id, null ids first, equal ids by leaf. Groups ascend
    by their UTF-8 bytes, null first. ``tampered`` is the digest of what a row holds now (default: the same): folded with
    the original siblings it gives ``folded_root``, which proves the row where it is the root. ``proof_sha256`` is the
    digest of all siblings, and that of nothing for the only row of a dataset. Repeated rows are leaves each, null and
    empty values differ, one row is its group's subroot, an empty table gives no rows, and other columns are not looked at.

    Positions come from distributed prefix sums, so a hot group spreads over tasks; texts are read once, to be hashed.
    """
    leaf = digest([F.col(c) for c in columns])
    now = leaf if tampered is None else tampered
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), group.alias("group"), leaf.alias("digest"), now.alias("now"), F.lit(1).cast("long").alias("one"))
    leaves = prefix_sums(materialize(rows, "leaves"), ["group", "doc_id", "digest"], {"pos": "one"}, "group")
    trees = tiers(leaves.drop("one"), depth, "blocks", "doc_id", "now")
    tops = materialize(trees[-1].select("group", F.col("root").alias("digest"), F.lit(1).cast("long").alias("one")), "subroots")
    groups = materialize(prefix_sums(tops, ["group"], {"pos": "one"}), "groups")
    forest = tiers(groups.select(F.lit("").alias("group"), "pos", "digest"), depth, "forest")
    none = F.array().cast("array<string>")
    path = forest[-1].select("group", F.col("block").alias("pos"), none.alias("left"), none.alias("right"), F.col("root").alias("root_"))
    for tier in reversed(forest):
        path = downward(tier, path, depth)
    path = groups.join(path.drop("group"), "pos").select("group", F.lit(0).cast("long").alias("pos"), "left", "right", "root_", F.col("digest").alias("subroot_"))
    for tier in reversed(trees[1:]):
        path = downward(tier, materialize(path, "paths"), depth)
    met = trees[0].join(materialize(path, "paths").withColumnRenamed("pos", "block"), ["group", "block"])

    @F.pandas_udf("leaf array<string>, proof array<string>, folded array<string>")
    def check(digests: pd.Series, block: pd.Series, now: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
        return proved(depth, digests, block, now, lefts, rights)

    met = met.withColumn("p", check("digests", "block", "now", "left", "right"))
    each = met.select("root_", "subroot_", F.explode(F.arrays_zip("doc_id", "p.leaf", "p.proof", "p.folded")).alias("x"))
    return each.select(
        "x.doc_id", "x.leaf", F.col("subroot_").alias("subroot"), F.col("root_").alias("root"), F.col("x.proof").alias("proof_sha256"),
        F.col("x.folded").alias("folded_root"), (F.col("x.folded") == F.col("root_")).alias("verified"),
    )


def proved(depth: int, digests: pd.Series, block: pd.Series, now: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
    """(leaf, proof, folded) of a block's leaves: themselves, the digest of their siblings up to the root of all, and what ``now`` folds to."""
    out = []
    for text, b, held, left, right in zip(digests, block, now, lefts, rights, strict=True):
        own = siblings(levels(text, b == 0, depth))
        up = [(x.encode(), y.encode()) for x, y in zip(left, right, strict=True)]
        rest = b"".join(x + y for x, y in up)
        proof, folded = [], []
        for i, cur in enumerate(held):
            mine = [(x[i // FANOUT**k], y[i // FANOUT**k]) for k, (x, y) in enumerate(own)]
            proof.append(sha256(b"".join(x + y for x, y in mine) + rest).hexdigest())
            for x, y in mine + up:
                cur = sha256(x + cur.encode() + y).hexdigest()
            folded.append(cur)
        out.append(([text[i : i + HEX] for i in range(0, len(text), HEX)], proof, folded))
    return pd.DataFrame(out, columns=["leaf", "proof", "folded"])
