"""Near copies of texts: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

First come the pairs of ``simhash``'s index: fingerprints that its positional lists find to be at most three bits apart, and equal ones.
Those whose sets are similar make the first classes. Other similar pairs differ in more bits, up to about ten, where no byte is sure to be
shared and the index would list all pairs. For these, candidates of different classes share all rows of one of a MinHash signature's bands:
a pair of similarity 0.8 misses all bands with a chance of 1 in 17,000. Each node of a list is held against the list's least node, which
joins most of the classes that the index left apart. What is left are the nodes of lists
that hold several classes. Among these, similar sets share one of their rarest shingles: a set of n lacks at most n - 0.8 n of the other's,
so one of its n - 0.8 n + 1 rarest (its prefix) is in both. Places in that order tell more: what stands before the first shared shingle is
not shared, so a shingle at place i leaves room for partners up to a certain size only. Nodes are entered under their prefix's shingles and
the sizes in reach there, and only nodes that meet under an entry are held against each other: first against the entry's least nodes, then,
in rounds, against geometrically more of them, until each entry holds one class or all its pairs are decided. Pairs of one class are not
looked at, and no pair twice. Every candidate is verified on the whole shingle sets. Texts with equal sets are one node throughout, so
large groups of exact copies cost no more than one text. Lists are rows of (list, node), never arrays, and long ones are dealt over several
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import simhash
from tamiz.llm.common import bound_batches, cut, gathered, numbered, settled
from tamiz.llm.components import components
from tamiz.llm.filters import only, without

#: Words of a shingle; the similarity, as a fraction, from which texts are near copies.
SIZE, OVER, UNDER = 5, 4, 5
BANDS, ROWS = 32, 6
#: Pivots of an entry in the first round, how many times as many there are in each later one, and nodes of an entry that lie in one task.
PIVOTS, TIMES, TOGETHER = 2, 8, 4096
#: Sizes of sets are told apart in steps of this ratio.
STEP = 1.1
#: Parts in which a band's rows are looked up while the length of its list is not known.
PARTS = 8
_MIX = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = np.random.default_rng(43).integers(1, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: words without ASCII case; all words if there are under five, none if there are none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SIZE:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-SIZE] + 1)).tolist()
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[SIZE - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A key per band of the set's MinHash signature."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        mixed = shingles[at : at + 512, None] * _MIX
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for k, part in enumerate(least.reshape(BANDS, ROWS).T):
        keys = (keys ^ part) * _JOIN[k]
        keys ^= keys >> np.uint64(29)
    return (keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
        sets = [shingles_of(x) for x in texts]
        prints = np.fromiter(map(simhash.fingerprint_of, texts), np.uint64, len(texts)).view(np.int64)
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        keys = [_bands(s) if len(s) else [] for s in sets]
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), sizes, pa.array(prints), pa.array(keys, pa.list_(pa.int64()))], ["_row", "node", "size", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles_of(x.as_py()).view(np.int64) for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])


def _members(nodes: DataFrame) -> DataFrame:
    """Nodes (node, size, keys) -> (list, node, size, least, n) for lists of two or more; of lists with equal nodes one.

    ``least`` is the node and size of the list's least node, ``n`` the list's length.
    """
    each = nodes.select("node", "size", F.explode("keys").alias("list"))
    mark = F.expr("bit_xor(xxhash64(node))").alias("mark")
    lists = each.groupBy("list").agg(F.min(F.struct("node", "size")).alias("least"), F.count("*").alias("n"), mark).where("n > 1")
    one = cut(lists.groupBy("least", "n", "mark").agg(F.min("list").alias("list")).drop("mark"), "lists")
    dealt = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return each.withColumn("part", F.pmod("node", F.lit(PARTS)).cast("int")).join(dealt, ["list", "part"]).drop("part")


def _alike(x, y):
    """Whether sets of these sizes may be similar enough."""
    return UNDER * F.least(x, y) >= OVER * F.greatest(x, y)


def _indexed(nodes: DataFrame) -> DataFrame:
    """Nodes (node, size, fp, ...) -> pairs (a, b) that SimHash's index finds, of sizes that may be similar.

    Each fingerprint stands for its least node: the index's links join these, and a fingerprint's other nodes are paired with it.
    """
    some = nodes.where("size > 0").select("node", "size", "fp")
    prints = cut(some.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("least")), "prints")
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_least"))
    apart = simhash.links(prints.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_least").alias("x"), F.col("b_least").alias("y"))
    equal = some.join(prints, "fp").where("node <> least.node").select(F.col("least").alias("x"), F.struct("node", "size").alias("y"))
    fit = apart.unionByName(equal).where(_alike(F.col("x.size"), F.col("y.size")))
    return fit.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where(UNDER * shared >= OVER * (total - shared)).select(*pairs.columns)


def _undecided(members: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """The members of lists (or entries, ``by``) that hold more than one class, with their ``root``."""
    rooted = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(by)
    return rooted.join(several, by, "left_semi")


def _reach(size, place):
    """The largest size of a set that may be similar to one of ``size`` if its first shared shingle is at ``place``: the rest of the smaller has to hold what both must share."""
    return F.floor((size - place) * (OVER + UNDER) / OVER).cast("long") - size


def _bucket(size):
    return F.floor(F.log(STEP, size.cast("double")) + 1e-9).cast("int")


def _entered(sets: DataFrame) -> DataFrame:
    """Sets (node, set) -> (entry, node, size, place, asks): each node under the rarest shingles of its set that others have too.

    A node waits (``asks`` false) at its own size, where a partner of the same size or larger may find it, and asks at the sizes up to its
    own that its place leaves in reach. Rarity is counted over these sets.
    """
    each = sets.select("node", F.size("set").alias("size"), F.explode("set").alias("shingle"))
    counted = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    mine = each.join(counted, "shingle").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("shared"))  # one set's
    kept = F.col("size") - F.ceil(F.col("size") * OVER / UNDER) + 1  # of the rarest so many, those that no other set has come first
    placed = mine.select("node", "size", F.posexplode("shared").alias("k", "x"), (F.col("size") - F.size("shared")).alias("alone"), kept.alias("kept"))
    first = placed.withColumn("place", F.col("k") + F.col("alone")).where(F.col("place") < F.col("kept")).withColumn("most", _reach(F.col("size"), F.col("place")))
    own, low = _bucket(F.col("size")), _bucket(F.ceil(F.col("size") * OVER / UNDER))
    waits = F.when(F.col("most") >= F.col("size"), F.array(F.struct(own.alias("bucket"), F.lit(False).alias("asks")))).otherwise(F.array().cast("array<struct<bucket:int,asks:boolean>>"))
    high = _bucket(F.least("most", "size"))
    asks = F.when(F.col("most") * UNDER >= F.col("size") * OVER, F.transform(F.sequence(low, high), lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<bucket:int,asks:boolean>>"))
    roles = first.select("node", "size", "place", "most", F.col("x.shingle").alias("shingle"), F.explode(F.concat(waits, asks)).alias("r"))
    return roles.select(F.xxhash64("shingle", "r.bucket").alias("entry"), "node", "size", "most", "r.asks")


def _across(entries: DataFrame, high: int) -> DataFrame:
    """Pairs (a, b, a_root, b_root) of an entry's next pivots, those with ``at`` under ``high``, and its nodes of the other role and of other classes, whose sizes are in reach of each other."""
    last = F.floor(F.col("n") / TOGETHER).cast("int")
    of = lambda c: [F.col(x).alias(f"{c}_{x}") for x in ("node", "root", "size", "most", "asks")]
    pivots = entries.where(F.col("at") < high).select("entry", F.explode(F.sequence(F.lit(0), last)).alias("part"), *of("a"))
    others = entries.select("entry", F.pmod(F.hash("node"), last + 1).alias("part"), *of("b"))
    fits = (F.col("a_root") != F.col("b_root")) & (F.col("a_asks") != F.col("b_asks")) & _alike(F.col("a_size"), F.col("b_size")) & (F.col("a_most") >= F.col("b_size")) & (F.col("b_most") >= F.col("a_size"))
    met = pivots.join(others, ["entry", "part"]).where(fits)
    turned = F.col("a_node") < F.col("b_node")
    pick = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    pairs = met.select(pick("a_node", "b_node").alias("a"), pick("b_node", "a_node").alias("b"), pick("a_root", "b_root").alias("a_root"), pick("b_root", "a_root").alias("b_root"))
    return pairs.dropDuplicates(["a", "b"])


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of different classes, with their ``a_root`` and ``b_root``."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root")).where("a_root <> b_root")


def _classes(members: DataFrame, sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Members of lists and sets (node, set) -> (node, root) of classes of two or more nodes, joined over all similar pairs of a list.

    ``known`` are classes (node, root) found before; pairs within one of them are not looked at.

    A node's place ``at`` in an entry, from a hash, tells in which round it is a pivot, so choosing pivots takes no order of an entry.
    """
    rest = members.where("node <> least.node")
    stars = rest.where(_alike(F.col("size"), F.col("least.size"))).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()
    if known is None:
        roots = settled("roots", lambda: components(_verified(stars, sets)))
    else:
        roots = _moved(known, _joined(_verified(_between(stars, known), sets)))
    open_ = cut(_undecided(members.select("list", "node"), roots, "list").select("node").distinct(), "open")
    entries = _entered(sets.join(open_, "node", "left_semi"))
    crowd = entries.groupBy("entry").agg(F.count("*").alias("n"), F.bool_or("asks").alias("some"), F.bool_and("asks").alias("all")).where("some and not all").select("entry", "n")
    place = F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64("node"), 32) * F.col("n"), 32)
    left, low, high, decided = cut(entries.join(crowd, "entry").withColumn("at", place), "entries"), 0, PIVOTS, None
    while True:
        left = cut(_undecided(gathered(left).where(F.col("at") >= low), roots, "entry"), "left")
        if left.isEmpty():
            return roots
        pairs = cut(_across(gathered(left), high), "pairs")
        fresh = pairs if decided is None else pairs.join(decided, ["a", "b"], "left_anti")
        decided = pairs.select("a", "b") if decided is None else decided.unionByName(fresh.select("a", "b"))
        found = gathered(cut(_verified(fresh, sets), "found"))
        if not found.isEmpty():
            roots = _moved(roots, _joined(found))
        low, high = high, high * TIMES


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, root) of the classes that similar pairs join."""
    return components(pairs.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))


def _moved(roots: DataFrame, joined: DataFrame) -> DataFrame:
    """``roots`` after their classes were joined as (node, root) of ``joined`` says, whose nodes are roots or nodes without a class."""

    def after() -> DataFrame:
        new = cut(joined, "joined")
        to = new.select(F.col("node").alias("root"), F.col("root").alias("new"))
        return roots.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(new).distinct()

    return settled("roots", after)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies stays, that with the smallest doc_id, nulls last, then the first row; all columns unchanged.

    Classes are joined over links of at least 0.8 between shingle sets. Texts without words, null ones too, are copies of one another.
    Rows are told apart by a number of their own in a table written once, so repeated and null doc_ids are judged like any others.
    """
    bound_batches(docs.sparkSession)
    rows, row = numbered(docs)
    gone = settled("gone", lambda: _gone(rows.select(F.col(row).alias("_row"), "doc_id", "text")))
    return without(rows, row, gone.withColumnRenamed("_row", row)).select(*docs.columns)


def _gone(rows: DataFrame) -> DataFrame:
    """The numbers of the rows of (_row, doc_id, text) that are copies of a row that stays."""
    signed = cut(rows.select("_row", "text").mapInArrow(_sign, "_row long, node long, size long, fp long, keys array<long>"), "signed")
    nodes = cut(signed.groupBy("node").agg(F.min("_row").alias("_row"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    near = settled("near", lambda: _indexed(nodes))
    members = cut(_members(nodes), "members")
    met = members.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    chosen = cut(nodes.select("node", "_row").join(met, "node", "left_semi"), "chosen")
    texts = cut(only(rows.select("_row", "text"), "_row", chosen).select("node", "text"), "texts")  # written, so that a task has one Python worker at a time
    sets = cut(texts.mapInArrow(_sets, "node long, set array<long>"), "sets")
    known = settled("known", lambda: components(_verified(near, sets)))
    roots = _classes(members, sets, known)
    ids = signed.select("_row", "node").join(rows.select("_row", "doc_id"), "_row")
    first = lambda x: F.min(x).alias("best")
    best = ids.groupBy("node").agg(first(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")))
    kept = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first(F.col("best"))).select("best._row")
    return signed.select("_row").join(kept, "_row", "left_anti")
