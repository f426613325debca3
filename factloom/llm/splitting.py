"""Pre-tokens of a text as the tokenizer libraries cut them.

The ``regex`` module and the libraries know different ages of the Unicode tables, so
that some code points are letters to one and not to the other.  Which ones is asked of
the library once per process, class by class.  In a text that has such code points
each of them is replaced by a stand-in that both sides put in the class the library
has for it; the text is cut at the places that the stand-ins give.

A text of Latin-1 characters alone needs no Unicode tables: there the classes are
spelled out as the library has them, and the quicker ``re`` cuts the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import regex

_CLASS = regex.compile(r"\\[pP]\{\^?[^}]*\}|\\[sSdDwW]")
_PART = regex.compile(_CLASS.pattern + r"|\\.|\[\^?\]?|.", regex.DOTALL)

_END = 0x110000


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _in_library(pattern: str, text: str) -> str:
    """The characters of ``text`` that match in the library: it gives no ids for what doesn't."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(text)).decode()


def _in_latin(pattern: str, members: dict[str, str]) -> re.Pattern | None:
    """``pattern`` with its classes spelled out as their Latin-1 ``members``; None where ``re`` can't say the same."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        part = _PART.match(pattern, at).group()
        if inside and part[0] == "[":
            return None  # a set in a set
        if _CLASS.fullmatch(part):
            found = "".join(f"\\x{ord(c):02x}" for c in members[part])
            if not found:
                return None
            out.append(found if inside else f"[{found}]")
        elif part in (r"\b", r"\B"):
            return None
        else:
            inside = part[0] == "[" or (inside and part != "]")
            out.append(part)
        at += len(part)
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class Splitter:
    """Cuts texts by a pattern whose character classes are those of the library."""

    def __init__(self, pattern: str):
        self.compiled = regex.compile(pattern)
        points = np.r_[np.arange(0xD800), np.arange(0xE000, _END)].astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        there, here = np.zeros(_END, np.uint32), np.zeros(_END, np.uint32)
        names = sorted({n.lower() if len(n) == 2 else n for n in _CLASS.findall(pattern)})
        for bit, name in enumerate(names):
            there[_points(_in_library(name, text))] |= np.uint32(1 << bit)
            here[_points("".join(regex.findall(f"(?:{name})+", text)))] |= np.uint32(1 << bit)
        usable = there == here
        usable[:0x80] = usable[0xD800:0xE000] = False
        usable[_points(pattern)] = False
        odd = np.flatnonzero(there != here)
        stand_in = {int(k): chr(int(np.flatnonzero(usable & (here == k))[0])) for k in np.unique(there[odd])}
        self.table = {int(c): stand_in[int(there[c])] for c in odd}
        self.odd = frozenset(map(chr, odd.tolist()))
        latin = [chr(c) for c in range(0x100)]
        members = {name: "".join(c for c in latin if there[ord(c)] >> bit & 1) for bit, name in enumerate(names)}
        members |= {name.upper(): "".join(c for c in latin if c not in members[name]) for name in names if len(name) == 2}
        self.latin = _in_latin(pattern, members)

    def find(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")  # far cheaper than a look at every character
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        if self.odd.isdisjoint(text):
            return self.compiled.findall(text)
        return [text[m.start() : m.end()] for m in self.compiled.finditer(text.translate(self.table))]


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Splitter:
    """One splitter per process and pattern."""
    return Splitter(pattern)
