"""Token-id files of patched frame-of-reference blocks.

One file (all integers little-endian)::

    payload   for each block: u32 minimum, u8 width, u8 0, u16 ids, u16 exceptions, u16 0,
              width * LANES u32 words of packed low bits,
              exceptions * u16 positions, exceptions * u32 high parts
    documents i64 doc_id and u32 ids (with the end id) of each document
    index     u64 start of each block in the payload
    footer    u64 documents, u64 ids, u64 blocks, 8 bytes magic

A block holds ``BLOCK`` ids of the file's one long sequence (the last one is filled
up with its minimum).  Its minimum is subtracted, and the differences are packed at
the width that the ``PERCENTILE`` of them needs; the bits above that width of the
others stand in the exception list.  Packing is vertical: id ``i`` of a block lies in
lane ``i % LANES``, row ``i // LANES``, so one numpy step packs a row of all blocks.
The index lets a reader start at any block, and so at any document.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import doc_out, id_and_text, partitions, scratch, ship, written

MAGIC = b"FLPFOR01"
LANES = 32
ROWS = 32
BLOCK = LANES * ROWS
PERCENTILE = 95
_HEADER = np.dtype([("minimum", "<u4"), ("width", "u1"), ("zero", "u1"), ("ids", "<u2"), ("exceptions", "<u2"), ("zero2", "<u2")])
_FOOTER = struct.Struct("<QQQ8s")
#: Blocks encoded or decoded in one numpy step.
STEP = 1024


def _widths(deltas: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for 0)."""
    return np.frexp(deltas.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ``ids`` (uint32); only the last may be short."""
    if not len(ids):
        return []
    n_blocks = -(-len(ids) // BLOCK)
    last = len(ids) - (n_blocks - 1) * BLOCK
    padded = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-last:].min()
    grid = padded.reshape(n_blocks, BLOCK)
    minimum = grid.min(axis=1)
    deltas = grid - minimum[:, None]
    needs = _widths(deltas)
    cut = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.partition(needs, cut, axis=1)[:, cut]
    low_mask = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    over = needs > width[:, None]
    low = deltas & low_mask[:, None]
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if not w:
            continue
        values = low[at].reshape(len(at), ROWS, LANES)
        words = np.zeros((len(at), int(w), LANES), dtype=np.uint32)
        for row in range(ROWS):
            word, shift = divmod(row * int(w), 32)
            words[:, word] |= values[:, row] << np.uint32(shift)
            if shift + int(w) > 32:
                words[:, word + 1] |= values[:, row] >> np.uint32(32 - shift)
        for k, block in enumerate(at):
            packed[block] = words[k].tobytes()
    header = np.zeros(n_blocks, dtype=_HEADER)
    header["minimum"], header["width"], header["ids"] = minimum, width, BLOCK
    header["ids"][-1] = last
    header["exceptions"] = over.sum(axis=1)
    out = []
    for b in range(n_blocks):
        places = np.flatnonzero(over[b])
        high = (deltas[b, places].astype(np.uint64) >> np.uint64(width[b])).astype("<u4")
        out.append(header[b].tobytes() + packed[b] + places.astype("<u2").tobytes() + high.tobytes())
    return out


def decode_blocks(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``payload``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    raw = np.frombuffer(payload, dtype=np.uint8)
    size = _HEADER.itemsize
    header = raw[starts[:, None] + np.arange(size)].reshape(-1).view(_HEADER)
    grid = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    body = starts + size
    for w in np.unique(header["width"]):
        if not w:
            continue
        at = np.flatnonzero(header["width"] == w)
        n = int(w) * LANES * 4
        words = np.stack([np.frombuffer(payload, "<u4", n // 4, int(body[b])) for b in at]).reshape(len(at), int(w), LANES)
        mask = np.uint32((1 << int(w)) - 1)
        values = np.empty((len(at), ROWS, LANES), dtype=np.uint32)
        for row in range(ROWS):
            word, shift = divmod(row * int(w), 32)
            v = words[:, word] >> np.uint32(shift)
            if shift + int(w) > 32:
                v = v | (words[:, word + 1] << np.uint32(32 - shift))
            values[:, row] = v & mask
        grid[at] = values.reshape(len(at), BLOCK)
    for b in np.flatnonzero(header["exceptions"]):
        n, w = int(header["exceptions"][b]), int(header["width"][b])
        place = int(body[b]) + w * LANES * 4
        where = np.frombuffer(payload, "<u2", n, place)
        high = np.frombuffer(payload, "<u4", n, place + 2 * n).astype(np.uint64)
        grid[b, where] |= (high << np.uint64(w)).astype(np.uint32)
    grid += header["minimum"][:, None]
    flat = grid.reshape(-1)
    return flat[: (len(starts) - 1) * BLOCK + int(header["ids"][-1])]


class Writer:
    """Writes one file; memory holds the ids of ``STEP`` blocks and the tables of documents and blocks."""

    def __init__(self, out):
        self.out, self.at, self.n_ids = out, 0, 0
        self.doc_ids: list[int] = []
        self.doc_sizes: list[int] = []
        self.starts: list[int] = []
        self.pending = io.BytesIO()

    def add(self, doc_id: int, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        self.doc_ids.append(doc_id)
        self.doc_sizes.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.pending.write(ids)
        if self.pending.tell() >= 4 * BLOCK * STEP:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = self.pending.getvalue()
        whole = len(data) if last else len(data) // (4 * BLOCK) * (4 * BLOCK)
        self.pending = io.BytesIO()
        self.pending.write(data[whole:])
        for lo in range(0, whole, 4 * BLOCK * STEP):
            for block in encode_blocks(np.frombuffer(data[lo : min(whole, lo + 4 * BLOCK * STEP)], dtype="<u4")):
                self.starts.append(self.at)
                self.out.write(block)
                self.at += len(block)

    def close(self) -> None:
        self._flush(True)
        self.out.write(np.asarray(self.doc_ids, dtype="<i8").tobytes())
        self.out.write(np.asarray(self.doc_sizes, dtype="<u4").tobytes())
        self.out.write(np.asarray(self.starts, dtype="<u8").tobytes())
        self.out.write(_FOOTER.pack(len(self.doc_ids), self.n_ids, len(self.starts), MAGIC))


class Reader:
    """Reads one file that can seek."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _FOOTER.size)
        n_docs, self.n_ids, n_blocks, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        tables = end - _FOOTER.size - 8 * n_blocks - 12 * n_docs
        source.seek(tables)
        self.doc_ids = np.frombuffer(source.read(8 * n_docs), dtype="<i8")
        self.doc_sizes = np.frombuffer(source.read(4 * n_docs), dtype="<u4").astype(np.int64)
        self.starts = np.append(np.frombuffer(source.read(8 * n_blocks), dtype="<u8").astype(np.int64), tables)
        self.doc_starts = np.concatenate(([0], np.cumsum(self.doc_sizes)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file's sequence, reading only the blocks that hold them."""
        lo, hi = start // BLOCK, -(-stop // BLOCK)
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        self.source.seek(int(self.starts[lo]))
        payload = self.source.read(int(self.starts[hi] - self.starts[lo]))
        return decode_blocks(payload, self.starts[lo:hi] - self.starts[lo])[start - lo * BLOCK : stop - lo * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.doc_starts[i]), int(self.doc_starts[i + 1]))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, decoding some ``STEP`` blocks at a time."""
        lo, n = 0, len(self.doc_ids)
        while lo < n:
            hi = int(np.searchsorted(self.doc_starts, self.doc_starts[lo] + STEP * BLOCK, side="right")) - 1
            hi = min(max(hi, lo + 1), n)
            base = int(self.doc_starts[lo])
            ids = self.ids(base, int(self.doc_starts[hi]))
            for i in range(lo, hi):
                yield int(self.doc_ids[i]), int(self.doc_starts[i]), ids[self.doc_starts[i] - base : self.doc_starts[i + 1] - base]
            lo = hi


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Tokenise ``docs`` and write them in ascending doc_id order; returns the files in order: path, base, n_docs, n_ids.

    The texts are range-partitioned by doc_id (the only shuffle) and every task
    writes one file of its range, under a name of its own attempt that it then
    renames; a repeated task replaces the file by an equal one.  ``base`` counts the
    ids in all files before.  ``folder`` must be one that pyarrow.fs can write.
    """
    spark = docs.sparkSession
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        from pyarrow import fs
        from pyspark import TaskContext

        from factloom.llm.token_files import Writer
        from factloom.llm.tokens import encoder

        encode, end = encoder(tokenizer).ids, array("I", [end_id]).tobytes()
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/tokens-{context.partitionId():06d}"
        trial = f"{name}.attempt-{context.taskAttemptId()}"
        with store.open_output_stream(trial) as out:
            writer = Writer(out)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    writer.add(doc_id, encode(text) + end)
            writer.close()
        if not writer.doc_ids:
            store.delete_file(trial)
            return
        store.move(trial, f"{name}.pfor")
        row = [[context.partitionId()], [f"{name}.pfor"], [writer.doc_ids[0]], [len(writer.doc_ids)], [writer.n_ids]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["task", "path", "first_id", "n_docs", "n_ids"])

    ranged = id_and_text(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(spark, ranged.mapInArrow(write, "task int, path string, first_id long, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("first_id", "task").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_docs", "n_ids")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Every document in ``files`` (of ``write_token_files``): doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyarrow import fs

        from factloom.llm.token_files import Reader

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    rows = [(d, base + s, len(ids), crc32(ids.astype("<u4").tobytes())) for d, s, ids in Reader(source).documents()]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("path", "base").repartition(partitions(spark))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the token ids of all documents to files and read them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone; a null id sorts first and comes back
    as null; rows that share an id follow each other by text.  No documents: no
    files and no rows.
    """
    folder = scratch(docs.sparkSession, "tokens")
    files = write_token_files(docs, tokenizer, folder, end_id)
    return read_token_files(files, folder).select(doc_out(), "start", "n_tokens", "ids_crc32")
