"""A Merkle manifest of a table: a tree of SHA-256 digests per group, a tree over the groups' roots, and proofs.

Leaves stand in order, and every two consecutive nodes of a level (a last one alone too) become their parent. The tree is cut into aligned
subtrees of ``HEIGHT`` levels of parents. Each is one row: its digests lie in van Emde Boas order, that is, the upper half of the levels
first, then each subtree below it, each laid out in the same way, so that a path from leaf to root meets few runs of memory whatever the
size of a cache line. The roots of these subtrees are the leaves of the next ones, until each group has one root. Proofs go the other way:
the path above a subtree is joined to its row and handed on to the subtrees below.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.llm.common import bound_batches, cut
from tamiz.llm.positions import positions

#: A subtree has up to 2 ** HEIGHT leaves.
HEIGHT = 10


def address(depth: int, index: int, levels: int) -> int:
    """Place in van Emde Boas order of node ``index`` of level ``depth`` (root: 0) of a full tree of ``levels`` levels."""
    place = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below, depth = levels - top, depth - top
        place += (1 << top) - 1 + (index >> depth) * ((1 << below) - 1)
        index &= (1 << depth) - 1
        levels = below
    return place


@functools.lru_cache(maxsize=64)
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """For each height above the leaves, the places of its nodes from left to right."""
    return tuple(np.array([address(height - up, k, height + 1) for k in range(1 << (height - up))]) for up in range(height + 1))


def joined(*digests: str) -> str:
    """SHA-256 of digests as hex text, one after another; lower-case hex."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height_of(n: int, alone: bool, most: int = HEIGHT) -> int:
    """Levels above ``n`` leaves: as many as one root needs, or all of a subtree's if others stand beside it."""
    return (n - 1).bit_length() if alone else most


def lay_out(leaves: list[str], height: int) -> tuple[bytes, str]:
    """A subtree's digests in van Emde Boas order, 32 bytes each (absent nodes: zero bytes), and its root."""
    places, out = addresses(height), np.zeros(((2 << height) - 1, 32), np.uint8)
    level = leaves
    for up in range(height + 1):
        out[places[up][: len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        if up < height:
            level = [joined(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return out.tobytes(), level[0]


def steps(tree: bytes, n: int, height: int, k: int) -> list[str]:
    """The way from leaf ``k`` of ``n`` to the root: for each level L or R and the sibling on that side, or N where there is none."""
    places, out = addresses(height), []
    for up in range(height):
        other, count = k ^ 1, -(-n // (1 << up))
        if other < count:
            at = 32 * int(places[up][other])
            out.append(("L" if k & 1 else "R") + tree[at : at + 32].hex())
        else:
            out.append("N")
        k >>= 1
    return out


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for step in path:
        digest = joined(digest) if step == "N" else joined(step[1:], digest) if step[0] == "L" else joined(digest, step[1:])
    return digest


def field(c: Column) -> Column:
    """A value as it enters a leaf: its length in UTF-8 bytes, a colon and the value; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def build(items: DataFrame, payload: tuple[str, ...] = (), height: int = HEIGHT) -> list[DataFrame]:
    """The subtrees over (group, position, digest), level by level from the leaves: (group, block, alone, height, tree, root, items).

    Positions run from 0 without gaps in a group (not null); ``items`` holds the leaves' digests and ``payload`` columns in order. Each
    table is written, and has a row for each 2 ** ``height`` rows of the one before. A subtree that is ``alone`` has its group's root.
    """

    @F.pandas_udf("struct<tree binary, root string, height int>")
    def laid(digests: pd.Series, alone: pd.Series) -> pd.DataFrame:
        heights = [height_of(len(x), one, height) for x, one in zip(digests, alone, strict=True)]
        made = [lay_out(list(x), h) for x, h in zip(digests, heights, strict=True)]
        return pd.DataFrame({"tree": [t for t, _ in made], "root": [r for _, r in made], "height": pd.Series(heights, dtype="int32")})

    levels: list[DataFrame] = []
    given, names = items, payload
    while True:
        leaves = F.array_sort(F.collect_list(F.struct("position", "digest", *names)))  # at most 2 ** height
        blocks = given.groupBy("group", F.shiftright("position", height).alias("block")).agg(leaves.alias("items"))
        beside = given.where(F.col("position") == 2**height).select("group", F.lit(0).cast("long").alias("block"), F.lit(True).alias("beside"))
        marked = blocks.join(beside, ["group", "block"], "left").withColumn("alone", (F.col("block") == 0) & F.col("beside").isNull())
        made = marked.withColumn("x", laid(F.col("items.digest"), F.col("alone")))
        kept = F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ("digest", *names)]))
        levels.append(cut(made.select("group", "block", "alone", "x.height", "x.tree", "x.root", kept.alias("items")), "subtrees"))
        given, names = levels[-1].where("not alone").select("group", F.col("block").alias("position"), F.col("root").alias("digest")), ()
        if given.isEmpty():
            return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(group, root)."""
    found = [x.where("alone").select("group", "root") for x in levels]
    return functools.reduce(DataFrame.unionByName, found)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def ways(trees: pd.Series, digests: pd.Series, heights: pd.Series, path: pd.Series) -> pd.Series:
    """For each leaf of a subtree its steps to the subtree's root, then those of ``path``."""
    return pd.Series([[steps(t, len(x), h, k) + list(p) for k in range(len(x))] for t, x, h, p in zip(trees, digests, heights, path, strict=True)])


def _below(found: DataFrame) -> Column:
    return ways(F.col("tree"), F.col("items.digest"), F.col("height"), F.col("path"))


def paths(levels: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``levels[0]`` with what leads from each subtree to the last root, and the columns of ``above`` (group, path, ...), whose paths start at the groups' roots.

    From the last level on, a subtree's path is joined to its row and handed on, with each leaf's own steps before it, to the subtree that
    hangs at that leaf.
    """
    more = [c for c in above.columns if c not in ("group", "path")]
    handed = None
    for level in reversed(range(len(levels))):
        met = levels[level].where("alone").join(above, "group")
        if handed is not None:
            met = met.unionByName(levels[level].join(handed, ["group", "block"]))
        if level:
            spread = met.select("group", F.shiftleft("block", height).alias("_from"), *more, F.posexplode(_below(met)).alias("_k", "path"))
            handed = cut(spread.select("group", (F.col("_from") + F.col("_k")).alias("block"), "path", *more), "handed")
    return met


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", order: str = "doc_id", claimed: Column | None = None, with_path: bool = False, height: int = HEIGHT) -> DataFrame:
    """A row per row of ``docs``: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked, path.

    A leaf hashes ``columns`` (see ``field``). Per ``group`` leaves stand by ``order``, then by digest, so equal rows are leaves of their
    own side by side, and nulls of ``order`` come first. Groups stand by name, null first. ``claimed`` is the leaf that someone holds
    (default: the leaf); ``folded_root`` is where it leads with the manifest's siblings, and ``verified`` tells whether that is the root.
    proof_sha256 hashes the siblings from leaf to root. Texts are hashed where they are read: only digests and ids are moved. Empty
    tables give no rows.
    """
    bound_batches(docs.sparkSession)
    own = leaf([F.col(c) for c in columns])
    name = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = docs.select(name.alias("group"), F.col(order).alias("_id"), own.alias("digest"), (own if claimed is None else F.coalesce(claimed, own)).alias("claimed"))
    levels = build(cut(positions(rows, "group", [F.col("_id").asc_nulls_first(), F.col("digest")]), "leaves"), ("_id", "claimed"), height)
    names = roots(levels).select(F.lit("all").alias("group"), F.col("root").alias("digest"), F.col("group").alias("name"))
    crown = build(cut(positions(names, "group", [F.col("name")]), "subroots"), ("name",), height)
    top = paths(crown, roots(crown).select("group", F.array().cast("array<string>").alias("path"), F.col("root").alias("last")), height)
    each = top.select("last", F.explode(F.arrays_zip("items", _below(top).alias("way"))).alias("x"))
    held = paths(levels, each.select(F.col("x.items.name").alias("group"), F.col("x.way").alias("path"), F.col("x.items.digest").alias("subroot"), "last"), height)

    @F.pandas_udf("struct<proof array<string>, folded array<string>, path array<array<string>>>")
    def proved(trees: pd.Series, digests: pd.Series, claims: pd.Series, heights: pd.Series, path: pd.Series) -> pd.DataFrame:
        out: list[tuple[list, list, list | None]] = []
        for t, x, c, h, p in zip(trees, digests, claims, heights, path, strict=True):
            way = [steps(t, len(x), h, k) + list(p) for k in range(len(x))]
            out.append(([joined(*[s[1:] for s in w if s != "N"]) for w in way], [fold(d, w) for d, w in zip(c, way, strict=True)], way if with_path else None))
        return pd.DataFrame(out, columns=["proof", "folded", "path"])

    shown = held.withColumn("x", proved(F.col("tree"), F.col("items.digest"), F.col("items.claimed"), F.col("height"), F.col("path")))
    told = shown.select("subroot", F.col("last").alias("root"), F.explode(F.arrays_zip("items", F.col("x.proof"), F.col("x.folded"), *([F.col("x.path")] if with_path else []))).alias("x"))
    wide = told.select(F.col("x.items._id").alias(order), F.col("x.items.digest").alias("leaf"), "subroot", "root", F.col("x.proof").alias("proof_sha256"), F.col("x.folded").alias("folded_root"), *([F.col("x.path").alias("path")] if with_path else []))
    return wide.withColumn("verified", F.col("folded_root") == F.col("root"))


def spoilt(columns: list[str], order: str = "doc_id", counted: str = "n_chars", one_in: int = 7) -> Column:
    """The leaf of a row whose ``counted`` has one added, where ``one_in`` divides the CRC-32 of its ``order`` in decimal; else its own leaf. Nulls stay."""
    hit = F.crc32(F.col(order).cast("string").cast("binary")) % one_in == 0
    changed = leaf([F.col(c) + 1 if c == counted else F.col(c) for c in columns])
    return F.when(hit, changed).otherwise(leaf([F.col(c) for c in columns]))
