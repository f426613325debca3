"""Removal of word windows that occur earlier in the corpus.

Pass 1 counts windows in a count-min sketch.  A window counts under its minimiser,
the 8-word gram of smallest hash in it: equal windows have equal minimisers at equal
places, so the count of the minimiser is at least that of the window, and a corpus
has about seven times fewer minimisers than windows.  Every task sketches its own
part, the parts are merged cell block by cell block, and what is left of a counter
is whether it reached two.

Pass 2 hashes all windows again and keeps those whose minimiser is estimated to
repeat - every repeated window is among them.  They are grouped exactly, first
within the task and then by hash, and all but the first occurrence are marked.

Pass 3 brings the marks to the texts and drops the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import beside, doc_key, doc_out, id_and_text, partitions, ship
from factloom.llm.textvec import Words, buffers, mix, slices

GRAM = 8
#: Rows of the sketch.  Each has a cell for every CELL_BYTES bytes of text (some four for each minimiser), rounded up to a
#: power of two, but at most 2**MOST_CELL_BITS: the broadcast has DEPTH bits for each cell, so 128 MB at most.
DEPTH = 2
CELL_BYTES, LEAST_CELL_BITS, MOST_CELL_BITS = 10, 20, 29
BLOCK_BITS = 16
#: Bytes of text whose windows go to one bucket, of which a task holds one at a time, and to one task.
BUCKET_BYTES, TASK_BYTES = 1 << 22, 1 << 24
#: Values or windows that a task gathers before it hands them on.
GATHERED = 1_000_000
_ROW_SALT = (0x0, 0x5851F42D4C957F2D)


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def minimisers(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each window lies in one row, its smallest gram hash, the grams that are some window's smallest)."""
    ok = words.inside(width)
    if not len(ok):
        return ok, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = words.windows(gram)
    span = width - gram + 1
    least = _slide(grams, span, np.minimum)
    reach = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
    reach[span - 1 : span - 1 + len(least)] = np.where(ok, least, np.uint64(0))
    chosen = grams[_slide(reach, span, np.maximum) == grams]
    return ok, least, chosen


def cell_bits_for(n_bytes: int) -> int:
    """Bits of a cell's number for a corpus of ``n_bytes`` of text."""
    return min(max((n_bytes // CELL_BYTES).bit_length(), LEAST_CELL_BITS), MOST_CELL_BITS)


def cells(values: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return (mix(values ^ np.uint64(_ROW_SALT[row])) >> np.uint64(64 - cell_bits)).astype(np.int64)


def _sketch_rows(values: np.ndarray, cell_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, cells counted once, cells counted more often) of one part of the input."""
    for row in range(DEPTH):
        cell, n = np.unique(cells(values, row, cell_bits), return_counts=True)
        block = (cell >> BLOCK_BITS) + (row << (cell_bits - BLOCK_BITS))
        place = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            once = n[a:b] == 1
            yield int(block[a]), place[a:b][once].tobytes(), place[a:b][~once].tobytes()


def repeated_cells(texts: DataFrame, width: int, gram: int, cell_bits: int = LEAST_CELL_BITS) -> np.ndarray:
    """Bits of the merged sketch: cells that count two or more."""
    spark = texts.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import substrings as s

        def rows(parts):
            out = list(zip(*s._sketch_rows(np.concatenate(parts), cell_bits), strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "once", "more"])

        parts, n = [], 0
        for batch in batches:
            data, offsets = s.buffers(batch.column(0))
            for lo, hi in s.slices(offsets):
                words = s.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts.append(s.minimisers(words, width, gram)[2])
                n += len(parts[-1])
                if n >= s.GATHERED:
                    yield rows(parts)
                    parts, n = [], 0
        if n:
            yield rows(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import substrings as s

        block, count = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(count >= 2).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for b, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if block is not None:
                        yield done()
                    block, count = b, np.zeros(1 << s.BLOCK_BITS, dtype=np.uint8)
                place = np.frombuffer(once, dtype=np.uint16)
                count[place] = np.minimum(count[place] + 1, 2)
                count[np.frombuffer(more, dtype=np.uint16)] = 2
        if block is not None:
            yield done()

    parts = texts.select("text").mapInArrow(sketch, "block int, once binary, more binary")
    merged = parts.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros(DEPTH << (cell_bits - 3), dtype=np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for r in merged.collect():  # at most DEPTH * 2**(MOST_CELL_BITS - BLOCK_BITS) rows of 8 KB
        bits[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits


def estimated_repeated(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the count-min estimate (the least over the sketch's rows) of each value is two or more."""
    out = np.ones(len(values), dtype=bool)
    cell_bits = (8 * len(bits) // DEPTH).bit_length() - 1
    for row in range(DEPTH):
        cell = cells(values, row, cell_bits) + (row << cell_bits)
        out &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


_WINDOW = np.dtype([("hash", "<u8"), ("check", "<u4"), ("place", "<i4"), ("doc", "<i8"), ("text", "<i8")])


def first_and_later(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split windows (of ``_WINDOW``) into those at the least (doc, place) of their hash and those after it."""
    windows = windows[np.lexsort((windows["place"], windows["doc"], windows["check"], windows["hash"]))]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (windows["hash"][1:] != windows["hash"][:-1]) | (windows["check"][1:] != windows["check"][:-1])
    head = windows[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(windows) else windows
    later = (windows["doc"] != head["doc"]) | (windows["place"] != head["place"])
    return windows[~later], windows[later]


def _runs(windows: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc, text, [start, length] of runs of windows) for each text."""
    windows = np.unique(windows[["doc", "text", "place"]])
    if not len(windows):
        return []
    doc, text, place = windows["doc"], windows["text"], windows["place"]
    new_text = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]
    new_run = new_text | np.r_[True, place[1:] != place[:-1] + 1]
    begin = np.flatnonzero(new_run)
    runs = np.stack((place[begin], np.diff(np.r_[begin, len(place)])), axis=1).astype("<i4")
    at = np.flatnonzero(new_text[begin])
    return [(int(doc[begin[a]]), int(text[begin[a]]), runs[a:b].tobytes()) for a, b in zip(at, np.r_[at[1:], len(begin)], strict=True)]


_MARK = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("length", "<i4")])


def _by_target(rows: list[tuple[int, int, bytes]], n: int) -> pa.RecordBatch:
    """Marks of texts (doc, text, packed runs), one row for each of ``n`` targets that ids hash to."""
    sizes = [len(r[2]) // 8 for r in rows]
    marks = np.empty(sum(sizes), dtype=_MARK)
    marks["doc"] = np.repeat(np.asarray([r[0] for r in rows], dtype=np.int64), sizes)
    marks["text"] = np.repeat(np.asarray([r[1] for r in rows], dtype=np.int64), sizes)
    runs = np.frombuffer(b"".join(r[2] for r in rows), dtype="<i4").reshape(-1, 2)
    marks["start"], marks["length"] = runs[:, 0], runs[:, 1]
    target = (mix(marks["doc"].astype(np.uint64)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(target, kind="stable")
    marks, target = marks[order], target[order]
    edges = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(target) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(target[edges[:-1]], pa.int32()), pa.array([marks[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["target", "marks"])


def _merged(parts: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(doc, text, packed runs) of each text with marks."""
    marks = np.concatenate(parts)
    marks = marks[np.lexsort((marks["start"], marks["text"], marks["doc"]))]
    new = np.flatnonzero(np.r_[True, (marks["doc"][1:] != marks["doc"][:-1]) | (marks["text"][1:] != marks["text"][:-1])]) if len(marks) else np.zeros(0, np.int64)
    runs = np.stack((marks["start"], marks["length"]), axis=1).astype("<i4")
    return [(int(marks["doc"][a]), int(marks["text"][a]), runs[a:b].tobytes()) for a, b in zip(new, np.r_[new[1:], len(marks)], strict=True)]


_FOUND = "bucket int, windows binary, doc_id long, text_hash long, runs binary"


def _pack(windows: np.ndarray) -> bytes:
    """Field after field, in the order of documents, which compresses well."""
    windows = windows[np.lexsort((windows["place"], windows["doc"]))]
    return b"".join(np.ascontiguousarray(windows[f]).tobytes() for f in _WINDOW.names)


def _unpack(packed) -> np.ndarray:
    n = len(packed) // _WINDOW.itemsize
    out, at = np.empty(n, dtype=_WINDOW), 0
    for f in _WINDOW.names:
        out[f] = np.frombuffer(packed, dtype=_WINDOW[f], count=n, offset=at)
        at += n * _WINDOW[f].itemsize
    return out


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "windows", "doc_id", "text_hash", "runs"])


def marked_runs(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Runs of windows that occur earlier: doc_id, text_hash, runs (packed [start, length]).

    The sketch, the buckets of windows and the tasks that settle them are sized from the
    bytes of the texts, so a task holds the windows of some BUCKET_BYTES at a time and
    reads those of some TASK_BYTES, however large the corpus is.
    """
    spark = texts.sparkSession
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(partitions(spark), -(-n_bytes // TASK_BYTES))
    n = max(tasks, -(-n_bytes // BUCKET_BYTES))
    bits = spark.sparkContext.broadcast(repeated_cells(texts, width, gram, cell_bits_for(n_bytes)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import substrings as s

        def rows(parts):
            first, later = s.first_and_later(np.concatenate(parts))
            out = [(doc % n, None, doc, text, runs) for doc, text, runs in s._runs(later)]
            bucket = (s.mix(first["hash"]) % np.uint64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            first, bucket = first[order], bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else [0]
            out += [(int(bucket[a]), s._pack(first[a:b]), None, None, None) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return s._found_batch(out)

        parts, gathered = [], 0
        for batch in batches:
            ids, text_hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            data, offsets = s.buffers(batch.column(1))
            for lo, hi in s.slices(offsets):
                words = s.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ok, least, _ = s.minimisers(words, width, gram)
                at = np.flatnonzero(ok)
                at = at[s.estimated_repeated(bits.value, least[at])]
                if not len(at):
                    continue
                found = np.empty(len(at), dtype=s._WINDOW)
                row = words.row[at]
                found["hash"] = words.windows(width)[at]
                found["check"] = words.windows(width, second=True)[at] >> np.uint64(32)
                found["place"] = at - words.first_word[row]
                found["doc"], found["text"] = ids[lo + row], text_hashes[lo + row]
                parts.append(found)
                gathered += len(found)
                if gathered >= s.GATHERED:
                    yield rows(parts)
                    parts, gathered = [], 0
        if parts:
            yield rows(parts)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import substrings as s

        def later_than_first(parts):
            return s._by_target([(doc, text, runs) for doc, text, runs in s._runs(s.first_and_later(np.concatenate(parts))[1])], n)

        bucket, parts = None, []
        for batch in batches:
            if len(ready := batch.filter(batch.column(1).is_null())):
                yield s._by_target(list(zip(*(c.to_pylist() for c in ready.columns[2:]), strict=True)), n)
            windows = batch.column(1)
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != bucket and parts:
                    yield later_than_first(parts)
                    parts = []
                bucket = b
                if windows[i].is_valid:
                    parts.append(s._unpack(windows[i].as_buffer()))
        if parts:
            yield later_than_first(parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import substrings as s

        def texts_of(parts):
            rows = s._merged(parts)
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "text_hash", "runs"])

        target, parts = None, []
        for batch in batches:
            for t, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t != target and parts:
                    yield texts_of(parts)
                    parts = []
                target = t
                parts.append(np.frombuffer(marks, dtype=s._MARK))
        if parts:
            yield texts_of(parts)

    found = texts.mapInArrow(find, _FOUND).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    marks = found.mapInArrow(settle, "target int, marks binary").repartition(tasks, "target").sortWithinPartitions("target")
    return marks.mapInArrow(gather, "doc_id long, text_hash long, runs binary")


def kept_words(data: np.ndarray, offsets: np.ndarray, runs: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, words removed, kept words joined by one space) of each row."""
    words = Words(data, offsets)
    n = len(words.starts)
    steps = np.zeros(n + 1, dtype=np.int64)
    for row, packed in enumerate(runs):
        if packed:
            run = np.frombuffer(packed, dtype="<i4").reshape(-1, 2).astype(np.int64)
            a = words.first_word[row] + run[:, 0]
            np.add.at(steps, a, 1)
            np.add.at(steps, a + run[:, 1] - 1 + width, -1)
    keep = np.cumsum(steps[:n]) == 0
    starts, ends, row = words.starts[keep], words.ends[keep], words.row[keep]
    counts = np.bincount(row, minlength=words.n_rows)
    last = np.zeros(len(row), dtype=bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    stops = np.where(last, ends, ends + 1)  # with the separator behind the word
    marks = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(marks, starts, 1)
    np.add.at(marks, stops, -1)
    take = np.cumsum(marks[:-1], dtype=np.int8) > 0
    out = np.where(words.separators, np.uint8(32), data)[take].tobytes()
    lengths = np.bincount(row, weights=stops - starts, minlength=words.n_rows).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(lengths)))
    return words.counts, words.counts - counts, [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def remove_repeats(docs: DataFrame, width: int = 20, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop every word that a window of ``width`` words covers which also starts earlier in the corpus.

    Earlier means a smaller doc_id, or an earlier start in the same document; what is
    judged are the windows of the input.  Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), kept_text (those words, or the
    unchanged text if nothing is removed) and the columns ``keep``.

    A window that occurs anywhere else is never missed: the sketch only overestimates.
    It grows with the corpus up to 128 MB; beyond, more windows reach the exact pass,
    which is bounded by the shuffle, not by memory.  Windows are equal there if 96 bits
    of two hashes of their words are.  A task hands on one occurrence of
    a window for each million candidates, so a passage that fills a third of the corpus
    doesn't gather in one place.

    A null or empty text has no words.  Texts under ``width`` words lose nothing.  Rows
    that share an id and a start don't precede each other, so plain repeats of a row
    keep the same words.  Null ids sort first and come back as null.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    marks = marked_runs(texts, width, gram)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import substrings as s

        for batch in batches:
            data, offsets = s.buffers(batch.column(1))
            runs = batch.column(2).to_pylist()
            for lo, hi in s.slices(offsets):
                n, removed, kept = s.kept_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], runs[lo:hi], width)
                part = batch.slice(lo, hi - lo)
                sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
                text = pc.if_else(pa.array(removed == 0), part.column(1), pa.array(kept, pa.binary()).cast(part.column(1).type))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(removed), sha, text, *part.columns[3:]], names)

    own = T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    kept = beside(keep, tuple(own.names))
    names = [*own.names, *kept.values()]
    places = [f"_k{i}" for i in range(len(kept))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(doc_key(), text.alias("text"), F.xxhash64(text).alias("text_hash"), *[F.col(f"`{c}`").alias(k) for c, k in zip(kept, places, strict=True)])
    joined = source.join(marks, ["doc_id", "text_hash"], "left").select("doc_id", "text", "runs", *places)
    schema = T.StructType([*own.fields, *[T.StructField(name, docs.schema[c].dataType) for c, name in kept.items()]])
    return joined.mapInArrow(drop, schema).withColumn("doc_id", doc_out())

