"""Packing along a space-filling curve: documents that are alike lie near each other in the sequences.

A document's vector counts its token ids in hashed dimensions with random signs and is
projected to a few dimensions by a fixed matrix of signs; both steps are one table from
token id to a row of that product, whose mean over the document's ids is its point.  The
point's cell in a fine grid has a place on Hilbert's curve.  Documents are sorted by that
place in ranges, and the whole row of ids is cut every ``capacity`` tokens, so that a sequence
holds neighbours on the curve and only what is left at the very end is shorter: that is cut
into powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import doc_out, id_and_text, partitions, ship, written
from factloom.llm.textvec import mix

#: Hashed dimensions of a document's vector, dimensions that it is projected to, bits of the grid in each.
#: A place has fewer than 53 bits, as Spark's approximate quantiles pass through doubles.
HASHED, DIMENSIONS, BITS = 512, 4, 13
#: Tokens of a range, and the most ranges (beyond that they grow).
RANGE_TOKENS, MOST_RANGES = 1 << 22, 20_000


def projection(ids: int, hashed: int = HASHED, dimensions: int = DIMENSIONS) -> np.ndarray:
    """For each token id its sign times the projected axis of its hashed dimension: values of -1 and 1, the same everywhere."""
    token = mix(np.arange(1, ids + 1, dtype=np.uint64))
    axis = (token >> np.uint64(1)) % np.uint64(hashed)
    sign = (token & np.uint64(1)).astype(np.int8) * 2 - 1
    signs = mix(np.arange(1, hashed + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    matrix = ((signs[:, None] >> np.arange(dimensions, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1
    return (sign[:, None] * matrix[axis.astype(np.int64)]).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on Hilbert's curve of cells (a row each) of a grid with ``bits`` bits in each dimension, by Skilling's transposition."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(len(x)):
            flips = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(flips, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(flips, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turned = np.zeros(len(cells), dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> np.uint64(b)) & one == one, (one << np.uint64(b)) - one, 0).astype(np.uint64)
    key = np.zeros(len(cells), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | (((v ^ turned) >> np.uint64(b)) & one)
    return key


def points(flat: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean row of ``table`` over each document's ids; every document has one id at least."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    return np.add.reduceat(table[flat], starts, axis=0, dtype=np.float64) / lengths[:, None]


def curve_places(flat: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the curve of documents whose ids lie in ``flat`` one after another."""
    cells = np.clip((points(flat, lengths, table) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cells.astype(np.uint64), bits).astype(np.int64)


def tail_places(total: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sequences after the last full one begin and end: powers of two that add up to what is left."""
    left = total % capacity
    sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    ends = total - left + np.cumsum(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64)
    return ends - np.array(sizes, dtype=np.int64), ends


def cut(start: int, length: int, capacity: int, tail: tuple[np.ndarray, np.ndarray], full: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start in the document, length, sequence, offset) of a document whose ids begin at ``start`` of all ids."""
    out, at, end = [], start, start + length
    while at < end:
        if at < full:
            sequence, offset = divmod(at, capacity)
            stop = min(end, at - offset + capacity)
        else:
            k = int(np.searchsorted(tail[1], at, side="right"))
            sequence, offset = full // capacity + k, at - int(tail[0][k])
            stop = min(end, int(tail[1][k]))
        out.append((at - start, stop - at, sequence, offset))
        at = stop
    return out


TOKENISED = "doc_id long, task int, row long, place long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _id_type(tokenizer: str, end_id: int) -> str:
    from factloom.llm.words import encoder

    return "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Columns of TOKENISED: the ids (two bytes each if they fit) and the place on the curve; (task, row) tells the rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from factloom.llm.words import encoder

        encode, kind, task, row = encoder(tokenizer).ids, _id_type(tokenizer, end_id), TaskContext.get().partitionId(), 0
        size = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
        table, end = projection(size), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            if not len(batch):
                continue
            found = [encode(text) + end for text in batch.column(1).to_pylist()]
            lengths = np.array([len(i) // 4 for i in found], dtype=np.int64)
            flat = np.frombuffer(b"".join(found), dtype="<u4")
            ends = np.cumsum(lengths)
            small = flat.astype(kind)
            ids = [small[b - n : b].tobytes() for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            n = len(found)
            columns = [batch.column(0), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(row, row + n)), pa.array(curve_places(flat, lengths, table)), pa.array(lengths), pa.array(ids, pa.binary())]
            row += n
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TOKENISED.split(", ")])

    return docs.mapInArrow(run, TOKENISED)


def range_of(bounds: np.ndarray) -> Column:
    """The range of a row by its place; the rows of a place that is the bound of several ranges are dealt among them."""

    @F.pandas_udf("int")
    def found(place: pd.Series, task: pd.Series, row: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(bounds, place.to_numpy(), side=s) for s in ("left", "right"))
        spread = mix((task.to_numpy().astype(np.uint64) << np.uint64(40)) ^ row.to_numpy().astype(np.uint64))
        return pd.Series(low + (spread % (high - low + 1).astype(np.uint64)).astype(np.int64)).astype("int32")

    return found("place", "task", "row")


def pack_along_curve(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents along the curve: columns of PIECES, and ``ids`` (array of int) on demand.

    A document is its token ids and ``end_id``.  Ids are computed and written to the shared folder once;
    ranges of the curve come from approximate quantiles of the places, and the tokens before each range from sums by
    range, so that no row is numbered in one place.  Documents of one place, like copies, are dealt among
    all ranges that the place bounds.  The ids are shuffled once, by range, sorted by place within it (the sort
    spills) and cut in passing.  To the driver come at most MOST_RANGES quantiles and sums; they are broadcast.

    All sequences but the last ones are full; those have lengths of powers of two, so no token of padding is needed.
    A null or empty text is the ``end_id`` alone.  A very long document is cut like any other; its ids have to fit in a task's memory.
    Rows that repeat or share an id are packed each for itself; null ids come back as null.  No documents: no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = written(spark, tokenised(id_and_text(docs), tokenizer, end_id), "curve")
    kind = _id_type(tokenizer, end_id)
    sums = rows.agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")).first()
    total = sums.tokens or 0
    ranges = int(min(MOST_RANGES, max(4 * partitions(spark), -(-total // RANGE_TOKENS)), max(sums.rows, 1)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("place", shares, 10 * ranges).alias("q")).first().q if shares and total else []
    dealt = rows.withColumn("range", range_of(np.array(bounds or [], dtype=np.int64)))
    inside = {r["range"]: r.n for r in dealt.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    base = np.cumsum([0, *(inside.get(i, 0) for i in range(ranges))])
    tail, full = tail_places(total, capacity), total - total % capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        now, at = -1, 0
        for batch in batches:
            out, pieces = [], []
            for doc_id, of, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if of != now:
                    now, at = of, int(base[of])
                ids = np.frombuffer(raw, dtype=kind).astype("<u4")
                for start, length, sequence, offset in cut(at, n, capacity, tail, full):
                    piece = ids[start : start + length]
                    out.append((doc_id, start, length, crc32(piece.tobytes()), n, sequence, offset))
                    if with_ids:
                        pieces.append(piece.astype(np.int32))
                at += n
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(pieces, pa.list_(pa.int32()))] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    ordered = dealt.repartition("range").sortWithinPartitions("range", "place", "task", "row")
    found = ordered.select("doc_id", "range", "n", "ids").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
    return found.select(doc_out(), *[c for c in found.columns if c != "doc_id"])
