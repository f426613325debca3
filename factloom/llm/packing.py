"""Packing of documents into sequences of a fixed number of tokens, after the linear grouping scheme.

Only the number of pieces of each length matters for the plan, and there are at
most ``capacity`` lengths.  So the plan is made on the driver from a histogram of
bounded size, in five steps:

1. The large lengths, longest first, are cut into groups of equal cardinality, and
   every length counts as the longest of its group: few sizes are left.
2. The linear programme over configurations (how many pieces of which sizes go
   into one sequence) is solved by column generation; the values are rounded down.
3. The actual lengths take the places of their group's size; what a configuration
   then leaves free is known exactly.  A sequence that it leaves with more than some
   slack is taken apart again.
4. The large pieces that are left are put together by their actual lengths: each time
   the longest, with those of the others, large or small, that fill its sequence best.
5. The small pieces that are left go, longest first, each to the fullest sequence that
   still holds them (best fit).

A few slacks are tried, and the plan of fewest sequences is taken.  Sequences that
look alike stay together as a run (first sequence, how many), so the plan is a short
list of intervals however many pieces there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import doc_out, id_and_text, ship, written

RANK_BITS = 44


def linear_groups(counts: dict[int, int], least: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths over ``least``, longest first, in at most ``groups`` groups of equal cardinality: (size, [(length, count)])."""
    large = [(length, n) for length, n in sorted(counts.items(), reverse=True) if length > least]
    total = sum(n for _, n in large)
    share = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                room = share
                if not out or out[-1][0] != length:
                    out.append((length, []))
            take = min(n, room)
            out[-1][1].append((length, take))
            n, room = n - take, room - take
    return out


class Configurations:
    """The linear programme over configurations of some sizes, solved by column generation."""

    #: Columns tried for each pricing step, and pivots after which the inverse of the basis is computed afresh.
    TRIED, FRESH = 12, 40

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.limit = sizes, capacity
        room = np.arange(capacity + 1) - np.asarray(sizes, dtype=np.int64)[:, None]
        self.room = np.where(room < 0, capacity + 1, room)  # the last cell is worth minus infinity
        self.layers = capacity // min(sizes)

    def best(self, worth: np.ndarray) -> list[tuple[float, list[int]]]:
        """(worth, configuration) of the configurations that are best among those with a given last size, best first."""
        gain = worth[:, None]
        value = np.full(self.limit + 2, -np.inf)
        value[: self.limit + 1] = 0.0
        chosen, final = [], None
        for _ in range(self.layers):
            found = value[self.room] + gain
            last = found.argmax(axis=0)
            most = found[last, np.arange(self.limit + 1)]
            better = most > value[:-1] + 1e-12
            final = found[:, -1]
            if not better.any():
                break
            chosen.append(np.where(better, last, -1))
            value[:-1] = np.maximum(most, value[:-1])
        if final is None:
            return []
        out = []
        for first in np.argsort(-final, kind="stable")[: self.TRIED].tolist():
            column = [0] * len(self.sizes)
            column[first] += 1
            c, layer = self.limit - self.sizes[first], len(chosen) - 1
            while layer >= 0 and c > 0:
                if (k := int(chosen[layer][c])) >= 0:
                    column[k] += 1
                    c -= self.sizes[k]
                layer -= 1
            out.append((float(np.dot(column, worth)), column))
        return out

    def solve(self, demand: list[int], gap: float = 1e-5, rounds: int = 4000) -> list[tuple[list[int], float]]:
        """Configurations and how often each is used.

        It ends when no configuration is worth over 1 + ``gap`` (the solution is then
        within that share of the least number), or after ``rounds`` pricing steps; a
        solution that is stopped early is valid too, only longer.
        """
        k = len(self.sizes)
        basis = np.diag([float(self.limit // s) for s in self.sizes])
        need = np.asarray(demand, dtype=float)
        inverse, pivots = np.linalg.inv(basis), 0
        amount = inverse @ need
        self.rounds = 0
        for self.rounds in range(1, rounds + 1):
            columns = self.best(np.maximum(inverse.sum(axis=0), 0))
            entered = False
            for _, column in columns:
                entering = np.asarray(column, dtype=float)
                if float(inverse.sum(axis=0) @ entering) <= 1 + gap:
                    continue
                step = inverse @ entering
                ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
                leaves = int(ratio.argmin())
                if not np.isfinite(ratio[leaves]):
                    continue
                basis[:, leaves] = entering
                pivots += 1
                entered = True
                if pivots % self.FRESH == 0:
                    inverse = np.linalg.inv(basis)
                else:
                    row = inverse[leaves] / step[leaves]
                    inverse = inverse - np.outer(step, row)
                    inverse[leaves] = row
                amount = inverse @ need
            if not entered:
                break
        amount = np.linalg.solve(basis, need)
        return [(basis[:, j].round().astype(int).tolist(), float(amount[j])) for j in range(k) if amount[j] > 1e-9]


def fullest(lengths: Counter, capacity: int) -> list[int]:
    """The longest piece and those of the others that fill its sequence best, by subset sums held as the bits of integers.

    Lengths in ``lengths`` are looked at longest first, so of equal fills the one of longer pieces is found.
    """
    first = max(lengths)
    room = capacity - first
    reached, states = 1, []
    for length in sorted(lengths, reverse=True):
        for _ in range(min(lengths[length] - (length == first), room // length)):
            more = reached | (reached << length)
            more &= (1 << (room + 1)) - 1
            if more != reached:
                states.append((length, reached))
                reached = more
        if reached >> room & 1:
            break
    fill, out = reached.bit_length() - 1, [first]
    for length, before in reversed(states):
        if not before >> fill & 1:
            out.append(length)
            fill -= length
    return out


class Plan:
    """Where the pieces of each length go.

    ``places[length]`` lists (pieces, first sequence, pieces in each sequence,
    offset of the first): the i-th piece of such an interval lies in sequence
    ``first + i // each`` at ``offset + (i % each) * length``.
    """

    def __init__(self, counts: dict[int, int], capacity: int, groups: list[tuple[int, list[tuple[int, int]]]], solved: list[tuple[list[int], float]], least: int, slack: int):
        """``groups`` (of ``linear_groups``) hold the lengths over ``least``, ``solved`` are their configurations and amounts.

        A configured sequence stays if at most ``slack`` tokens of it are free.
        """
        self.capacity, self.sequences, self.slack = capacity, 0, slack
        self.places: dict[int, list[tuple[int, int, int, int]]] = {}
        self._free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        left = Counter({length: n for length, n in counts.items() if n})
        self._configured(groups, solved, left)
        self._filled(left, least)
        for length in sorted(left, reverse=True):
            if left[length]:
                self._best_fit(length, left[length])

    def _put(self, length: int, pieces: int, first: int, each: int, offset: int) -> None:
        self.places.setdefault(length, []).append((pieces, first, each, offset))

    def _configured(self, groups: list[tuple[int, list[tuple[int, int]]]], solved: list[tuple[list[int], float]], left: Counter) -> None:
        sizes = [size for size, _ in groups]
        demand = [sum(n for _, n in members) for _, members in groups]
        queues = [list(reversed(members)) for _, members in groups]
        open_demand = list(demand)
        for column, amount in sorted(solved, key=lambda x: -sum(s * n for s, n in zip(sizes, x[0], strict=True))):
            slots = [g for g, n in enumerate(column) for _ in range(n)]
            times = min([int(amount + 1e-7), *(open_demand[g] // n for g, n in enumerate(column) if n)])
            if not times or sum(sizes[g] for g in slots) > self.capacity:
                continue
            for g, n in enumerate(column):
                open_demand[g] -= n * times
            self._fill_slots([self._take(queues[g], times) for g in slots], times, left)

    def _filled(self, left: Counter, least: int) -> None:
        """Sequences of the large pieces that are left, each of a set that fills it best; smaller pieces fill up."""
        have = +left
        while have and (first := max(have)) > least:
            column = Counter(fullest(have, self.capacity))
            times = min(have[length] // n for length, n in column.items())
            offset = 0
            for length, n in sorted(column.items(), reverse=True):
                self._put(length, n * times, self.sequences, n, offset)
                offset += n * length
                left[length] -= n * times
                have[length] -= n * times
                if not have[length]:
                    del have[length]
            self._free[self.capacity - offset].append((self.sequences, times))
            self.sequences += times

    @staticmethod
    def _take(queue: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            length, have = queue.pop()
            took = min(have, n)
            out.append((length, took))
            if have > took:
                queue.append((length, have - took))
            n -= took
        return out

    def _fill_slots(self, slots: list[list[tuple[int, int]]], times: int, left: Counter) -> None:
        """``times`` sequences, cut into runs in which every slot has one length."""
        stacks = [list(reversed(s)) for s in slots]
        while times:
            run = min(s[-1][1] for s in stacks)
            column = Counter(s[-1][0] for s in stacks)
            offset = sum(length * n for length, n in column.items())
            if self.capacity - offset <= self.slack:
                offset = 0
                for length, same in sorted(column.items(), reverse=True):
                    self._put(length, run * same, self.sequences, same, offset)
                    left[length] -= run * same
                    offset += same * length
                self._free[self.capacity - offset].append((self.sequences, run))
                self.sequences += run
            for s in stacks:
                length, n = s.pop()
                if n > run:
                    s.append((length, n - run))
            times -= run

    def _best_fit(self, length: int, pieces: int) -> None:
        for room in range(length, self.capacity + 1):
            runs = self._free[room]
            each = room // length
            while runs and pieces:
                first, n = runs.pop()
                full = min(n, pieces // each)
                if full:
                    self._put(length, full * each, first, each, self.capacity - room)
                    self._free[room - each * length].append((first, full))
                    pieces -= full * each
                if full < n:
                    first, n = first + full, n - full
                    if pieces:  # fewer than fill one sequence
                        self._put(length, pieces, first, pieces, self.capacity - room)
                        self._free[room - pieces * length].append((first, 1))
                        pieces, first, n = 0, first + 1, n - 1
                    if n:
                        runs.append((first, n))
            if not pieces:
                return
        each = self.capacity // length
        full, rest = divmod(pieces, each)
        for n, per in ((full, each), (1 if rest else 0, rest)):
            if n:
                self._put(length, n * per, self.sequences, per, 0)
                self._free[self.capacity - per * length].append((self.sequences, n))
                self.sequences += n

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Intervals sorted by (length, rank): key, first sequence, pieces in each, offset."""
        keys, firsts, eaches, offsets = [], [], [], []
        for length in sorted(self.places):
            rank = 0
            for pieces, first, each, offset in self.places[length]:
                keys.append((length << RANK_BITS) + rank)
                firsts.append(first)
                eaches.append(each)
                offsets.append(offset)
                rank += pieces
        return tuple(np.asarray(x, dtype=np.int64) for x in (keys, firsts, eaches, offsets))


#: Shares of a sequence that a configuration may leave free.
SLACKS = (0.001, 0.016, 1.0)


def best_plan(counts: dict[int, int], capacity: int, groups: int, least: int) -> Plan:
    """Of the plans for the SLACKS the one of fewest sequences."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    grouped = linear_groups(counts, least, groups)
    programme = Configurations([size for size, _ in grouped], capacity) if grouped else None
    solved = programme.solve([sum(n for _, n in members) for _, members in grouped]) if programme else []
    bound = -(-sum(length * n for length, n in counts.items()) // capacity)
    best = None
    for share in SLACKS if solved else SLACKS[-1:]:
        plan = Plan(counts, capacity, grouped, solved, least, int(share * capacity))
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array
        from zlib import crc32

        from pyspark import TaskContext

        from factloom.llm.tokens import encoder

        encode, end = encoder(tokenizer).ids, array("I", [end_id]).tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n, start = len(ids) // 4, 0
                stop = n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    length = stop - start
                    rows.append((doc_id, piece, start, length, crc32(ids[4 * start : 4 * stop]), task, seen[length]))
                    seen[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, groups: int = 64, least_share: float = 1 / 6) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; only one longer than ``capacity`` is
    cut, from its end into full pieces, so that the first piece may be shorter.  The
    pieces (without ids) are written to the shared folder once.  Ranks within a
    length come from counts by (task, length), so no length is ever gathered in one
    place.  The driver receives at most ``capacity`` counts and broadcasts the
    plan's intervals, whose number depends on ``capacity`` and ``groups`` alone.

    A null or empty text is the ``end_id`` alone; a very long one gives as many pieces
    as it needs.  Rows that repeat or share an id are packed each for itself; null ids
    come back as null.  No documents: no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = written(spark, tokenised_pieces(id_and_text(docs), tokenizer, capacity, end_id), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_plan(histogram, capacity, groups, int(capacity * least_share))
    intervals = spark.sparkContext.broadcast(plan.arrays())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, eaches, offsets = intervals.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            key = (length << RANK_BITS) + rank
            at = np.searchsorted(keys, key, side="right") - 1
            i = key - keys[at] if len(key) else key
            sequence = firsts[at] + i // eaches[at] if len(key) else key
            offset = offsets[at] + i % eaches[at] * length if len(key) else key
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(doc_out(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
