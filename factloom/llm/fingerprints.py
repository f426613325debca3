"""Document fingerprints of closed syncmers.

A k-mer (``K`` bytes) is an anchor if the smallest of its inner ``S``-byte substrings,
by hash, is its first or its last.  Whether it is depends on the k-mer alone, so equal
passages give equal anchors wherever they stand.  A fingerprint is the ``KEEP`` anchors
of smallest hash with their places, and likeness is the share of anchors that match at
one common shift.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import doc_out, id_and_text, partitions, ship
from factloom.llm.textvec import buffers, mix, slices

K = 20
S = 8
INNER = K - S + 1
KEEP = 64
#: Places are kept in steps of this many bytes.
STEP = 16
_ANCHOR = np.dtype([("hash", ">u4"), ("place", ">u4")])


def _row_fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n, rows = len(data), len(offsets) - 1
    found_row = np.zeros(0, dtype=np.int64)
    found_hash = np.zeros(0, dtype=np.uint64)
    place = np.zeros(0, dtype=np.int64)
    if n >= K:
        d = data.astype(np.uint64)
        x = d[:-1] | (d[1:] << np.uint64(8))
        x = x[:-2] | (x[2:] << np.uint64(16))
        x = x[:-4] | (x[4:] << np.uint64(32))  # x[i]: the 8 bytes from i on
        h = mix(x)
        low = np.minimum(h[:-1], h[1:])
        low = np.minimum(low[:-2], low[2:])
        low = np.minimum(low[:-4], low[4:])  # of 8
        m = n - K + 1
        low = np.minimum(low[:m], low[INNER - 8 : INNER - 8 + m])
        anchor = (low == h[:m]) | (low == h[INNER - 1 : INNER - 1 + m])
        at = np.flatnonzero(anchor)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + K <= offsets[row + 1]
        at, found_row = at[inside], row[inside]
        with np.errstate(over="ignore"):
            found_hash = mix(h[at] + np.uint64(3) * h[at + 8] + np.uint64(7) * h[at + K - S]) >> np.uint64(32)
        place = at - offsets[found_row]
    bare = np.setdiff1d(np.flatnonzero(np.diff(offsets)), found_row)  # no anchor: the whole text is one
    if len(bare):
        whole = [int.from_bytes(hashlib.blake2b(data[offsets[r] : offsets[r + 1]].tobytes(), digest_size=4).digest(), "big") for r in bare]
        found_row, found_hash, place = np.concatenate((found_row, bare)), np.concatenate((found_hash, np.asarray(whole, dtype=np.uint64))), np.concatenate((place, np.zeros(len(bare), dtype=np.int64)))
    key = (found_row.astype(np.uint64) << np.uint64(32)) | found_hash
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    key, place = key[first], place[first]
    row = (key >> np.uint64(32)).astype(np.int64)
    begin = np.searchsorted(row, np.arange(rows + 1))
    out = np.empty(len(key), dtype=_ANCHOR)
    out["hash"] = key & np.uint64(0xFFFFFFFF)
    out["place"] = place // STEP
    return [out[begin[r] : min(begin[r + 1], begin[r] + KEEP)] for r in range(rows)]


def fingerprints(texts: pa.Array) -> list[np.ndarray]:
    """The anchors of each text; none for an empty one."""
    data, offsets = buffers(texts)
    return [f for lo, hi in slices(offsets) for f in _row_fingerprints(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]


def as_string(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=_ANCHOR)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """2 * matches / anchors of both, in the range of hashes that both fingerprints cover.

    Only anchors that match at the most frequent shift count (two steps of
    neighbouring size are one shift).  Equal fingerprints: 1; one empty: 0.
    """
    if len(a) == len(b) and a.tobytes() == b.tobytes():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    ah, bh = a["hash"].astype(np.int64), b["hash"].astype(np.int64)
    top = min(ah[-1] if len(a) == KEEP else 1 << 32, bh[-1] if len(b) == KEEP else 1 << 32)
    n_a, n_b = np.searchsorted(ah, top, side="right"), np.searchsorted(bh, top, side="right")
    ah, bh = ah[:n_a], bh[:n_b]
    if not n_a or not n_b:
        return 0.0
    at = np.minimum(np.searchsorted(bh, ah), n_b - 1)
    hit = bh[at] == ah
    if not hit.any():
        return 0.0
    shift = a["place"][:n_a][hit].astype(np.int64) - b["place"][at[hit]].astype(np.int64)
    values, seen = np.unique(shift, return_counts=True)
    beside = np.append(np.where(np.diff(values) == 1, seen[1:], 0), 0)
    best = int((seen + beside).max())
    return min(1.0, 2.0 * best / float(n_a + n_b))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; columns of ``OUT``.

    The next document is the one of the next smaller id (after the smallest: the
    largest); where ids tie, texts decide.  Ids are cut into as many ranges as there
    are shuffle partitions, from quantiles of the id column; the first document of a
    range is also sent to the range before it, so that each task, sorted by id, sees
    the successor of its last document.  That is the one shuffle of the texts; the
    driver holds two numbers for each range.

    A null or empty text has the empty fingerprint, and two of them are alike (1).
    A null id counts as the smallest and comes back as null; each input row gives
    one row.  A single document follows itself.  No documents: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = id_and_text(docs)
    n = partitions(spark)
    ids = rows.select("doc_id")
    cuts = np.unique(np.asarray(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], dtype=np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, doc_id.to_numpy(), side="right").astype(np.int32))

    tops = {r["range"]: r["top"] for r in ids.groupBy(range_of("doc_id").alias("range")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    guests = {tops[r]: order[i - 1] for i, r in enumerate(order)}  # the first range's top goes to the last range

    @F.pandas_udf("array<int>")
    def ranges_of(doc_id: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, doc_id.to_numpy(), side="right")
        return pd.Series([[2 * int(r)] + ([2 * guests[d] + 1] if d in guests else []) for r, d in zip(own, doc_id.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from factloom.llm import fingerprints as fp

        held: tuple[int, str, np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            ids, guest = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(1).to_pylist()
            prints = fp.fingerprints(batch.column(1))
            stop = guest.index(True) + 1 if True in guest else len(ids)
            line = ([held] if held else []) + list(zip(ids[:stop], texts[:stop], prints[:stop], strict=True))
            if held == "done":
                continue
            held = "done" if True in guest else line[-1]
            pairs = list(zip(line, line[1:], strict=False))
            if not pairs:
                continue
            changed = [fp.edited(a[1], b[1]) for a, b in pairs]
            changed_prints = fp.fingerprints(pa.array(changed, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([fp.as_string(a[2]) for a, _ in pairs], pa.string()),
                    pa.array([fp.as_string(f) for f in changed_prints], pa.string()),
                    pa.array([fp.likeness(a[2], f) for (a, _), f in zip(pairs, changed_prints, strict=True)], pa.float64()),
                    pa.array([fp.likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    placed = rows.withColumn("target", F.explode(ranges_of("doc_id"))).select("doc_id", "text", (F.col("target") % 2 == 1).alias("guest"), F.floor(F.col("target") / 2).cast("int").alias("range"))
    dealt = placed.repartitionById(n, "range").sortWithinPartitions("guest", F.desc("doc_id"), "text").select("doc_id", "text", "guest")
    return dealt.mapInArrow(run, OUT).withColumn("doc_id", doc_out())
