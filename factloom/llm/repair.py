"""Conversation structure repair by cost layers of bitsets, after Wu and Manber's search with errors.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``.  The grammar
has four states: START, SYSTEM (after s), ASKED (after u), DONE (after a); START and
DONE accept.  For each place between two rows an integer holds, four bits for each cost
layer, from which states the rest of the conversation can be repaired at that cost or
less.  One edit takes all layers along at once: an edit of cost k is a shift by 4k bits,
a step of the grammar moves the lanes of states.  The integers are made from the last
row to the first; the first layer that has START at the front is the least cost.  From
there the bits are traced to the back, each time by the least letter whose target still
has its bit, which gives the least audit in ASCII order.

From any state the rest costs at most 12 more than from any other (insert what is
missing, or delete a system row), so sixteen layers from the first one that isn't empty
say all, and a place takes 8 bytes and a cost however long the conversation is.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, doc_key, doc_out, join_counted, ship, written

START, SYSTEM, ASKED, DONE = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What a truncated row costs besides its edit, if it isn't deleted.
TRUNCATED = 5

LAYERS, SPREAD = 16, 12
_LANE = int("1" * (LAYERS + 8), 16)  # the same state of every layer; a step needs some layers more than are kept
_KEPT = (1 << 4 * LAYERS) - 1
_FULL = _KEPT & ~((1 << 4 * (SPREAD + 1)) - 1)
#: From which states ``u`` leads to ASKED.
_BEFORE_USER = 1 << START | 1 << SYSTEM | 1 << DONE

#: Faults of a row, in the order in which they count.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def _user(layers: int) -> int:
    """The states from which ``u`` leads into ``layers``."""
    return (layers >> ASKED & _LANE) * _BEFORE_USER


def _assistant(layers: int) -> int:
    return (layers >> DONE & _LANE) << ASKED


def _inserted(layers: int) -> int:
    """With empty turns inserted here: two are enough, as a third comes back to where one leads."""
    for _ in range(2):
        layers |= (_user(layers) | _assistant(layers)) << 4 * INSERT
    return layers


def _before(layers: int, initial: str, fault: int) -> int:
    """The layers in front of a row, given those behind it."""
    out = layers << 4 * DELETE
    if fault in (SOUND, CUT):
        user, assistant = _user(layers), _assistant(layers)
        kept = {"u": user, "a": assistant, "s": (layers >> SYSTEM & _LANE) << START}.get(initial, 0)
        out |= (kept << 4 * KEEP | (user | assistant) << 4 * REROLE) << 4 * (TRUNCATED if fault == CUT else 0)
    return _inserted(out)


def _rising(layers: int) -> int:
    """Each layer with the states of all lower ones."""
    for step in (1, 2, 4, 8):
        layers |= layers << 4 * step
    return layers & _KEPT


def _next(state: int, initial: str) -> int | None:
    """The grammar's step; None where there is none."""
    if initial == "u":
        return None if state == ASKED else ASKED
    if initial == "a":
        return DONE if state == ASKED else None
    return SYSTEM if initial == "s" and state == START else None


def least_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows (initial of the role, fault); of equal costs the least audit.

    The audit has a letter for each edit, in order: (K)eep, (R)erole, (D)elete, (I)nsert.
    """
    layers, low = _rising(_inserted(1 << START | 1 << DONE) | _FULL), 0
    masks, lows = array("Q", [layers]), array("q", [0])
    for initial, fault in reversed(rows):
        layers = _before(layers, initial, fault)
        empty = ((layers & -layers).bit_length() - 1) // 4
        layers = _rising(layers >> 4 * empty | _FULL)
        low += empty
        masks.append(layers)
        lows.append(low)

    def within(place: int, state: int, cost: int) -> bool:
        """Whether the rows from ``place`` on can be repaired at that cost."""
        layer = cost - lows[-1 - place]
        return layer >= 0 and (layer >= LAYERS or bool(masks[-1 - place] >> 4 * layer + state & 1))

    left = next(low + k for k in range(LAYERS) if masks[-1] >> 4 * k + START & 1)
    cost, audit, place, state = left, [], 0, START
    while place < len(rows) or left:
        initial, fault = rows[place] if place < len(rows) else ("", BLANK)
        more = TRUNCATED if fault == CUT else 0
        wanted = "a" if state == ASKED else "u"
        tries = [("D", DELETE, place + 1, state), ("I", INSERT, place, _next(state, wanted))]
        if fault in (SOUND, CUT):
            tries += [("K", KEEP + more, place + 1, _next(state, initial)), ("R", REROLE + more, place + 1, _next(state, wanted))]
        for letter, price, at, then in tries:
            if then is not None and at <= len(rows) and within(at, then, left - price):
                audit.append(letter)
                left, place, state = left - price, at, then
                break
    return cost, "".join(audit)


class Repaired:
    """Takes rows in order and follows an audit; ``digest`` is that of the repaired rows so far."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _made(self, text: str) -> None:
        role = "assistant" if self.state == ASKED else "user"
        self.state = _next(self.state, role[0])
        self._put(role, text)

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._made("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._made(text)
        elif letter == "K":
            self.state = _next(self.state, role[:1])
            self._put(role, text)

    def digest(self) -> str:
        self.insertions()
        return self.hash.hexdigest()


def text_or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the contract damages them, by crc32 of ``conv_id:turn`` (a null there, and in role and text, is one space).

    ``copies`` tells how often a row stands there, 0 if it is dropped.
    """
    kind = F.crc32(F.concat_ws(":", text_or_space("conv_id"), text_or_space("turn")).cast("binary")) % 20
    role, text = text_or_space("role"), text_or_space("text")
    return conversations.select(
        doc_key("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with ``copies``, the ``initial`` of the role, and the ``fault`` of the first copy; and the table to discard.

    Rows that are alike are counted before anything is shuffled by conversation.  A row is a
    duplicate if its role and text occur at an earlier turn; of the role and text only
    those that occur at several turns are joined, the frequent ones by broadcast.
    """
    spark = rows.sparkSession
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same")
    counted = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    distinct = written(spark, counted.select("*", same), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    recurring = distinct.groupBy("conv_id", "same").agg(F.count("*").alias("n_same"), F.min(place).alias("first")).where("n_same > 1")
    joined = join_counted(distinct, recurring, ["conv_id", "same"], "n_same", distinct.count(), "left")
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(end == "", BLANK).when(place > F.col("first"), DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return joined.select("conv_id", "turn", "role", "text", "copies", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")), distinct


PLANNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = PLANNED + ", repaired_sha256 string"
_ORDER = ("conv_id", "kind", "turn", "role", "text")  # Spark sorts nulls first


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


LEGAL = ("su", "ua", "au")


def plan_conversation(rows: Iterator[tuple[int | None, str, int, int]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of one conversation's rows (turn, initial, fault, copies) in order."""
    found, codes = [0, 0, 0, 0], []
    illegal, turns, low, high, before = 0, 0, None, None, None
    for turn, initial, fault, copies in rows:
        if turn is not None and turn != high:
            turns, low, high = turns + 1, turn if low is None else low, turn
        illegal += (before is not None and before + initial not in LEGAL) + copies - 1
        before = initial
        later = BLANK if fault == BLANK else DUPLICATE
        found[fault] += 1
        found[later] += copies - 1
        codes.append((initial, fault))
        codes += [(initial, later)] * (copies - 1)
    cost, audit = least_edits(codes)
    return 0 if low is None else high - low + 1 - turns, found[BLANK], found[DUPLICATE], found[CUT], illegal, cost, audit


def plan_repairs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Columns of PLANNED for each conversation of ``ids``, from the rows of ``with_faults``.

    A conversation passes in order; what is held for it is a few bytes a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plans() -> Iterator[tuple]:
            for conv_id, own in groupby(_rows_of(batches), key=lambda r: r[0]):
                yield (conv_id, *plan_conversation(r[2:] for r in own if r[1]))

        yield from _in_batches(plans(), _arrow(PLANNED))

    marks = ids.select("conv_id", F.lit(0).alias("kind"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return ordered.select("conv_id", "kind", "turn", "initial", "fault", "copies").mapInArrow(run, PLANNED)


def follow_repairs(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Columns of REPAIRED: the plans with the digest of the rows that they leave.

    The plan of a conversation stands before its rows; the digest runs along, so that no text is held longer than a batch.
    """
    names = [x.split()[0] for x in PLANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[tuple]:
            for _, own in groupby(_rows_of(batches), key=lambda r: r[0]):
                head = next(own)
                plan = head[-1]
                repaired = Repaired(plan["audit"])
                for row in own:
                    for _ in range(row[4]):
                        repaired.row(row[2], row[3])
                yield (*[plan[c] for c in names], repaired.digest())

        yield from _in_batches(done(), _arrow(REPAIRED))

    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.struct(*names).alias("plan"))
    both = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies").unionByName(heads, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return ordered.select("conv_id", "kind", "role", "text", "copies", "plan").mapInArrow(run, REPAIRED)


def repair_conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Repair conversations: columns of REPAIRED, a row for each conversation of ``ids``.

    ``rows`` are those of ``damaged`` (or any conv_id, turn, role, text without nulls but for
    turn, and copies).  They are taken by turn, nulls first, then role and text.  Rows that
    repeat are counted before the shuffle and all but the first are duplicates.  An
    empty role has no initial, so it is never kept.  A conversation without rows has
    zeros, an empty audit and the digest of an empty text; a null conv_id is one
    conversation.  No ids: no rows.  Other columns are ignored.

    A conversation is put in order by Spark's sort, which spills, and streams through one
    task twice, as its audit is one value and its digest runs through all its text; what a task
    holds is some 70 bytes a row for the plan and one batch of texts.  Very long texts pass one by one.
    """
    spark = rows.sparkSession
    ship(spark)
    faulty, distinct = with_faults(rows)
    plans = written(spark, plan_repairs(faulty, ids), "plans")
    out = written(spark, follow_repairs(faulty, plans), "repaired")
    discard(distinct, plans)
    return out.select(doc_out("conv_id"), *[c for c in out.columns if c != "conv_id"])


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Damage all conversations as ``damaged`` tells and repair them; see ``repair_conversations``."""
    return repair_conversations(damaged(conversations), conversations.select(doc_key("conv_id")).distinct())
