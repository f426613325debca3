"""A memory of computed values that stays bounded and isn't filled with what occurs once."""

from __future__ import annotations

from collections.abc import Callable

#: Bits that tell whether a key was asked for before.
SEEN_BITS = 24


class Memo(dict):
    """``memo[key]`` computes a missing value with ``make`` and remembers it.

    While the first generation is at most half full every value is remembered.  From
    then on a first request only leaves a mark in a fixed bit field, so that the many keys
    that occur once take no room.  Two generations hold at most ``entries`` keys each:
    when the young one is full it becomes the old one (and the marks are cleared), and
    keys that are used again come back from there.  Keys longer than ``longest`` are
    never remembered.
    """

    def __init__(self, make: Callable, entries: int, longest: int = 64):
        super().__init__()
        self.make, self.entries, self.longest = make, entries, longest
        self.old: dict = {}
        self.seen = bytearray(1 << (SEEN_BITS - 3))

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
            if not self.old and 2 * len(self) < self.entries:
                self[key] = value
                return value
            mark = hash(key) & ((1 << SEEN_BITS) - 1)
            at, bit = mark >> 3, 1 << (mark & 7)
            if not self.seen[at] & bit:
                self.seen[at] |= bit
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
            self.seen = bytearray(1 << (SEEN_BITS - 3))
        self[key] = value
        return value
