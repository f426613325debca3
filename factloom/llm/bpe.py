"""Byte-level BPE by longest match and backtracking, and its inverse.

Instead of merging pairs again and again, the encoder walks over a pre-token from
the left.  An Aho-Corasick automaton over all tokens (bytes written as Latin-1
characters) gives the longest token that begins at each byte.  The walk takes
that token if it is *compatible* with the token before it - that is, if BPE would
really keep this pair side by side - and otherwise tries the next shorter token,
or steps back.  A prefix has exactly one BPE encoding, so a place that failed once
is never tried again and the walk is linear.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import doc_out, id_and_text, ship
from factloom.llm.memo import Memo
from factloom.llm.splitting import splitter

#: Pre-tokens remembered per process, in each of two generations.
MEMO_ENTRIES = 200_000
#: Compatible pairs remembered per process; emptied when full.
MEMO_PAIRS = 500_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by rank."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if parts := line.split():
                ranks[int(parts[1])] = base64.b64decode(parts[0])
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class BytePairCodec:
    """Encoder and decoder for the ranks of one file; ranks are the ids and the merge order."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        self.lengths = [len(t) for t in tokens]
        self.id_of = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._longest_proper_prefix(t) for t in tokens]
        self.pairs: dict[tuple[int, int], int] = {}
        self.left = list(range(len(tokens)))
        self.right = list(range(len(tokens)))
        self._compatible: dict[tuple[int, int], bool] = {}
        self._learn_merges()
        self._compatible.clear()
        #: piece -> (ids, ids as decimal text)
        self.pieces = Memo(self._piece, MEMO_ENTRIES)

    def _longest_proper_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (found := self.id_of.get(token[:end])) is not None:
                return found
        return -1

    def _learn_merges(self) -> None:
        """The one pair from which BPE makes each token, in order of rank."""
        for i, token in enumerate(self.tokens):
            if len(token) == 1:
                continue
            a = self.shorter[i]
            while a >= 0:
                b = self.id_of.get(token[self.lengths[a] :], -1)
                if 0 <= b < i and a < i and self._keeps_apart(a, b):
                    self.pairs[a, b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]

    def _keeps_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side when it encodes their joint bytes.

        Undo the merges inside both tokens from the latest on; the border must not
        have been mergeable before the merge that is being undone.
        """
        pairs, left, right = self.pairs, self.left, self.right
        before = 1 << 60
        while True:
            if pairs.get((a, b), before) < before:
                return False
            undo_a = left[a] != a
            undo_b = left[b] != b
            if undo_a and (a > b or not undo_b):
                before, a = a, right[a]
            elif undo_b:
                before, b = b + 1, left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= MEMO_PAIRS:
                self._compatible.clear()
            known = self._compatible[a, b] = self._keeps_apart(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.id_of.get(piece)) is not None:
            return [whole]
        n, lengths = len(piece), self.lengths
        longest = [-1] * (n + 1)
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            start = last + 1 - lengths[token]
            if longest[start] < 0 or lengths[longest[start]] < lengths[token]:
                longest[start] = token
        out: list[int] = []
        open_ends = bytearray(b"\1") * (n + 1)
        at, candidate = 0, longest[0]
        while at < n:
            token = candidate
            while token >= 0 and not (open_ends[at + lengths[token]] and (not out or self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                candidate = longest[at]
            elif out:
                open_ends[at] = 0
                candidate = out.pop()
                at -= lengths[candidate]
            else:
                raise ValueError("the ranks lack a byte of the text")
        return out

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.encode_piece(piece.encode("utf-8")))
        return ids, ",".join(map(str, ids))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec per process and file."""
    return BytePairCodec(read_ranks(path))


def encode_text(text: str, path: str, pattern: str) -> tuple[list[int], str]:
    """(ids, decimal ids joined by commas) of a whole text, all of them by ``BytePairCodec``."""
    found = list(map(codec(path).pieces.__getitem__, splitter(pattern).find(text)))
    return [i for ids, _ in found for i in ids], ",".join([s for _, s in found])


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text and decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    No shuffle: one pass over the documents.  A null or empty text has no ids (the
    digests are those of the empty string); a text of any length is encoded whole.
    Each input row gives one row, also where ids repeat or are null; other columns are
    ignored.  No documents: no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import bpe

        decode = bpe.codec(path).decode
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decimal = bpe.encode_text(text, path, pattern)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(doc_out(), "n_tokens", "ids_sha256", "decoded_sha256")
