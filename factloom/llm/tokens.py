"""Token ids of the ``tokenizers`` library at the cost of a dictionary look-up per pre-token.

Byte-level BPE never merges across pre-tokens, so the ids of a text are those of
its pre-tokens in order.  Pre-tokens repeat; each distinct one goes through the
library once and is remembered.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

from factloom.llm.memo import Memo
from factloom.llm.splitting import splitter

#: Pre-tokens remembered per process, in each of two generations.
MEMO_ENTRIES = 300_000


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARACTERS = _byte_characters()


class PreTokenEncoder:
    """Ids and counts equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of one .json file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = splitter(public_tokenizers.PATTERN).find
        self.model = self.tokenizer.model
        self.ids_of = Memo(lambda piece: array("I", [t.id for t in self.pieces(piece)]).tobytes(), MEMO_ENTRIES)

    def pieces(self, pre_token: str) -> list:
        """The library's tokens of one pre-token: its BPE model alone, as the text is split already."""
        return self.model.tokenize(pre_token.encode("utf-8").decode("latin-1").translate(BYTE_CHARACTERS))

    def _segments(self, text: str) -> list[str]:
        """The text cut around special strings, which stand at odd places."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text]
        return self.split_special.split(text)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = []
        for i, segment in enumerate(self._segments(text)):
            if i % 2:
                parts.append(array("I", [self.special[segment]]).tobytes())
            else:
                parts += map(self.ids_of.__getitem__, self.find(segment))
        return b"".join(parts)

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of the text, and the number of its special strings."""
        segments = self._segments(text)
        if len(segments) == 1:
            return self.find(text), 0
        return [piece for segment in segments[::2] for piece in self.find(segment)], len(segments) // 2


@lru_cache(maxsize=4)
def encoder(path: str) -> PreTokenEncoder:
    """One encoder per process and file."""
    return PreTokenEncoder(path)
