"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A row's key is its text, so copies share a place on the ring. The ring has ``CELLS`` places; each shard owns ``nodes`` of them, and a key
goes to the next node clockwise whose shard has room. No shard takes more than (1 + slack) times its fair share of bytes.

What goes over the driver is bounded by parameters, not by the data: bytes per part of a cell, and the large rows, of which there can be at
most ``shards * 1000``, since each is over a thousandth of a shard. Large rows are placed one by one; of all others, a cell's bytes are
poured clockwise, and each row follows by its running sum within its part of the cell.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import cut, settled, text_of

CELLS_BITS = 12
CELLS, LARGE = 1 << CELLS_BITS, 1000


def ring(shards: int, nodes: int) -> list[list[int]]:
    """For each cell, all shards in the order in which a key there tries them."""
    at = defaultdict(list)
    for shard in range(shards):
        for node in range(nodes):
            at[int.from_bytes(hashlib.blake2b(f"{shard}:{node}".encode(), digest_size=8).digest(), "big") % CELLS].append(shard)
    order = [(cell, shard) for cell in sorted(at) for shard in sorted(at[cell])]
    out, first = [], 0
    for cell in range(CELLS):
        while first < len(order) and order[first][0] < cell:
            first += 1
        out.append(list(dict.fromkeys(shard for _, shard in order[first:] + order[:first])))
    return out


def _place(large: list[tuple[int, int]], poured: list[tuple[int, int, int]], shards: int, nodes: int, slack: float):
    """large: (cell, size) by size, falling; poured: (cell, part, bytes), clockwise -> shards of the large rows; (cell, part, from, to, shard)."""
    total = sum(x[-1] for x in large) + sum(x[-1] for x in poured)
    most = -(-total * (1 + slack) // shards)
    loads, tries = [0] * shards, ring(shards, nodes)
    owners = []
    for cell, size in large:
        shard = next((s for s in tries[cell] if loads[s] + size <= most), min(range(shards), key=loads.__getitem__))
        loads[shard] += size
        owners.append(shard)
    cuts = []
    for cell, part, size in poured:
        at = 0
        for shard in tries[cell]:
            if at < size and (room := int(min(size - at, most - loads[shard]))) > 0:
                cuts.append((cell, part, at, at + room, shard))
                loads[shard] += room
                at += room
        if at < size or not size:
            shard = min(range(shards), key=loads.__getitem__)
            cuts.append((cell, part, at, size, shard))
            loads[shard] += size - at
    return owners, cuts


def shard(docs: DataFrame, shards: int = 8, nodes: int = 64, slack: float = 0.005) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): size is the text's bytes plus 1; slots of a shard count from 0 without gaps.

    A null text counts as none; copies lie together unless their shard is full; repeated rows are placed each. An empty table gives no rows.
    Further columns are not read. A shard's bytes exceed (1 + slack) times the fair share by a thousandth of it at most, unless single rows
    are so large that they can't be fitted.

    Movement: with the slack as shipped, one more shard moves about 23 % of the documents (a ninth must move), some half of them between old
    shards, which are full to within the slack; a larger slack moves fewer (see the tests).
    """
    put = settled("placed", lambda: _placed(docs, shards, nodes, slack))

    # slots: rows before a part in its shard, and the rank within the part
    group = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    held = put.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))  # bounded: parts of cells and cuts
    firsts = held.select("shard", "cell", "part", F.coalesce(F.sum("n").over(group), F.lit(0)).alias("first"))
    rank = Window.partitionBy("shard", "cell", "part").orderBy("key", "doc_id", "size")
    return (
        put.withColumn("rank", F.row_number().over(rank))
        .join(F.broadcast(firsts), ["shard", "cell", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def _placed(docs: DataFrame, shards: int, nodes: int, slack: float) -> DataFrame:
    """Rows with their key, cell, part of the cell, and shard."""
    spark = docs.sparkSession
    text = F.encode(text_of(docs), "UTF-8")
    key = F.xxhash64(text)
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"),
        F.shiftrightunsigned(key, 64 - CELLS_BITS).cast("int").alias("cell"),
    )
    rows = cut(rows, "keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    big = F.col("size") * shards * LARGE > total
    light = rows.where(~big)
    # parts of a cell, so that a hot key's rows are many parts: each part has about a CELLS-th of the rows at most
    counts = light.groupBy("cell").agg(F.count("*").alias("n"))
    n = light.count()
    parts = counts.select("cell", F.ceil(F.col("n") * F.lit(CELLS) / F.lit(max(n, 1)) / 4).cast("int").alias("parts"))
    light = light.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.col("parts").cast("long")).cast("int")).drop("parts")
    poured = [tuple(r) for r in light.groupBy("cell", "part").agg(F.sum("size")).orderBy("cell", "part").collect()]
    large = rows.where(big).groupBy("cell", "doc_id", "key", "size", "text_crc32").agg(F.count("*").alias("times")).orderBy(F.desc("size"), "cell", "key", "doc_id").collect()
    heavy = [r for r in large for _ in range(r.times)]
    owners, cuts = _place([(r.cell, r.size) for r in heavy], poured, shards, nodes, slack)

    made = spark.createDataFrame(pa.table({k: pa.array(v, t) for k, v, t in zip(("cell", "part", "low", "high", "shard"), zip(*cuts, strict=True) if cuts else ((),) * 5, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)}))
    by_cell = made.groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("low", "high", "shard"))).alias("cuts"))
    run = Window.partitionBy("cell", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = light.withColumn("before", F.sum("size").over(run) - F.col("size")).join(F.broadcast(by_cell), ["cell", "part"])
    owner = F.element_at(F.filter("cuts", lambda x: x["low"] <= F.col("before")), -1)["shard"]
    fixed = spark.createDataFrame(
        pa.table({
            "doc_id": pa.array([r.doc_id for r in heavy], pa.int64()), "size": pa.array([r.size for r in heavy], pa.int64()), "text_crc32": pa.array([r.text_crc32 for r in heavy], pa.int64()), "key": pa.array([r.key for r in heavy], pa.int64()),
            "cell": pa.array([r.cell for r in heavy], pa.int32()), "part": pa.array([-1] * len(heavy), pa.int32()), "shard": pa.array(owners, pa.int32()),
        })
    )
    return put.select("doc_id", "size", "text_crc32", "key", "cell", "part", owner.alias("shard")).unionByName(fixed)
