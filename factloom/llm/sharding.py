"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import doc_key, doc_out
from factloom.llm.textvec import mix

#: The ring is cut into 2**CELL_BITS cells; all keys of a cell move together.
CELL_BITS = 16
VIRTUAL_NODES = 1024
#: A shard holds at most (1 + SLACK) times the mean load.
SLACK = 0.005


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order, shard of each): a shard's positions don't depend on the other shards."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), virtual_nodes)
    node = np.tile(np.arange(virtual_nodes, dtype=np.uint64), shards)
    place = mix((shard << np.uint64(32)) + node + np.uint64(1))
    order = np.argsort(place, kind="stable")
    return place[order], shard[order].astype(np.int64)


def assign(units: list[tuple[int, int, int]], shards: int, slack: float = SLACK, virtual_nodes: int = VIRTUAL_NODES) -> dict[int, int]:
    """The shard of each unit (number, place on the ring, load): clockwise, the first shard that has room for it.

    Units over half the slack go first, the heaviest before the others; then the rest in
    the order of the ring.  A unit of at most ``slack`` times the mean always finds room,
    as the shards' free room is that much on average.  A unit that fits nowhere (one
    larger than all that is left) goes to the shard of least load.
    """
    places, owner = ring(shards, virtual_nodes)
    total = sum(load for _, _, load in units)
    limit = -(-total * (1 + slack) // shards)
    heavy = slack / 2 * total / shards
    filled = [0] * shards
    out = {}
    order = sorted(units, key=lambda u: (-u[2] if u[2] > heavy else 0, u[1], u[0]))
    starts = np.searchsorted(places, np.asarray([u[1] for u in order], dtype=np.uint64))
    owners, n = owner.tolist(), len(owner)
    for (unit, _, load), at in zip(order, starts.tolist(), strict=True):
        refused = 0
        for step in range(n):
            shard = owners[(at + step) % n]
            if filled[shard] + load <= limit:
                break
            refused |= 1 << shard
            if refused == (1 << shards) - 1:
                shard = min(range(shards), key=filled.__getitem__)
                break
        filled[shard] += load
        out[unit] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = 40, slack: float = SLACK) -> DataFrame:
    """Shards of near equal bytes: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    A key is a document (its id, text and size); its hash is its place on the ring.  The
    loads of the ring's ``2**CELL_BITS`` cells go to the driver.  In cells over half the
    slack the keys that are over it themselves are dealt one by one (at most
    2 * shards / slack of them), the others of a cell together; what overflows a full
    shard continues clockwise.  The tables of cells and of heavy keys have bounded sizes
    and are broadcast.  The slot of a row is the number of rows in the shard's units
    before plus its rank in its unit, so no shard is gathered in one task: texts are
    never shuffled, and cells grow only with the input over 65,536.

    A shard has at most (1 + slack) times the mean, unless one key alone is larger than
    what is left.  Equal texts under different ids are different keys, so a large group
    of copies spreads over all shards; rows that are equal in id and text are one key,
    which is the one group that can't be split.

    A null text counts 0 bytes and the 16 of every row; its crc32 is that of an empty
    text.  Rows that share an id (null is one) have slots of their own.  Texts of any
    length count whole.  Other columns are ignored.  No documents: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_key(), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("cell", F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int"))
    loads = {r.cell: (r.load, r.n) for r in rows.groupBy("cell").agg(F.sum("size").alias("load"), F.count("*").alias("n")).collect()}  # 2**CELL_BITS rows at most
    heavy = int(slack / 2 * sum(load for load, _ in loads.values()) / shards)
    full = spark.createDataFrame([(c,) for c, (load, _) in loads.items() if load > heavy], "cell int")
    keys = rows.join(F.broadcast(full), "cell", "left_semi").groupBy("key", "cell").agg(F.sum("size").alias("load"), F.count("*").alias("n")).where(F.col("load") > heavy).orderBy("key").collect()
    units = []
    for i, r in enumerate(keys):
        load, n = loads[r.cell]
        loads[r.cell] = (load - r.load, n - r.n)
        units.append(((1 << CELL_BITS) + i, r.key & ((1 << 64) - 1), r.load, r.n))
    units += [(cell, cell << (64 - CELL_BITS), load, n) for cell, (load, n) in sorted(loads.items()) if n]
    where = assign([u[:3] for u in units], shards, slack)
    base, table = [0] * shards, []
    for unit, _, _, n in sorted(units):
        shard = where[unit]
        table.append((unit, shard, base[shard]))
        base[shard] += n
    single = F.broadcast(spark.createDataFrame([(r.key, (1 << CELL_BITS) + i) for i, r in enumerate(keys)], "key long, single int"))
    placed = rows.join(single, "key", "left").withColumn("unit", F.coalesce("single", "cell"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(spark.createDataFrame(table, "unit int, shard int, base long")), "unit")
        .select(doc_out(), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
