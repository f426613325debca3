"""Token ids of tokenizers that drop white space and end words with a mark.

A text of Latin-1 characters alone is cut into words here, with the tokenizer's classes
spelled out, and only its words go through the library's BPE model.  In every other text
(or one with special strings) the stretches between ASCII white space go through the
whole library; the tokenizer never looks across white space, so their ids in order are
those of the text.  Words and stretches repeat; each distinct one is encoded once and
remembered.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from pathlib import Path

from tokenizers import Tokenizer

from factloom.llm.memo import Memo
from factloom.llm.tokens import BYTE_CHARACTERS, MEMO_ENTRIES, PreTokenEncoder

_STRETCH = re.compile("[^\x20\x09-\x0d]+")
#: Latin-1 as the tokenizer's classes have it, after lower-casing.
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The pattern that ``_WORD`` spells out; a tokenizer with another one isn't cut here.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _drops_white_space(path: str) -> bool:
    """Whether the file describes the tokenizer that this module knows: NFC, one space for white space, lower case; words by ``_KNOWN``, bytes."""
    made = json.loads(Path(path).read_text(encoding="utf-8"))
    steps = [(n["type"], n.get("pattern")) for n in (made["normalizer"] or {}).get("normalizers", [])]
    cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    special = [t["content"] for t in made["added_tokens"]]
    return (
        steps == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": _KNOWN}
        and cuts[0]["invert"]
        and cuts[0]["behavior"] == "Removed"
        and not cuts[1]["add_prefix_space"]
        and all(_STRETCH.fullmatch(t) for t in special)
    )


class WordEncoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of one .json file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.of_word = Memo(self._word, MEMO_ENTRIES)
        self.of_stretch = Memo(self._whole, MEMO_ENTRIES)

    def _word(self, word: str) -> bytes:
        pieces = self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(BYTE_CHARACTERS))
        return array("I", [t.id for t in pieces]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.of_stretch.__getitem__, _STRETCH.findall(text)))
        if any(s in text for s in self.special):
            return b"".join(map(self.of_stretch.__getitem__, _STRETCH.findall(text)))
        return b"".join(map(self.of_word.__getitem__, _WORD.findall(text.lower())))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder | PreTokenEncoder:
    """One encoder per process and file: by stretches where the tokenizer drops white space, else by pre-tokens."""
    return WordEncoder(path) if _drops_white_space(path) else PreTokenEncoder(path)
