"""Chat formatting with loss spans found by rendering, not by knowing the template."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import NULL_ID, doc_key, ship

Turn = tuple[str, str]
OPEN, CLOSE = "### ", " </turn>\n"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """No ``#`` or ``<`` is left, so no control string can occur; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\\\")  # pairs first: what is left of a backslash begins an escape
    return "\\".join(p.replace("\\h", "#").replace("\\l", "<") for p in parts)


def render(turns: list[Turn]) -> str:
    """The template: ``### role: text </turn>`` and a line end per turn."""
    return "".join(f"{OPEN}{escape(role).replace(':', chr(92) + 'c')}: {escape(text)}{CLOSE}" for role, text in turns)


def parse(output: str) -> list[Turn]:
    """The turns of ``render``'s output."""
    turns = []
    for part in output.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(": ")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def unescape_role(role: str) -> str:
    return "\\".join(p.replace("\\c", ":").replace("\\h", "#").replace("\\l", "<") for p in role.split("\\\\"))


@dataclass
class Rendered:
    output: str
    spans: list[tuple[int, int]]
    #: Turns at which the template changed what it had rendered before.
    rewrites: list[int]


def incremental_spans(turns: list[Turn], template: Callable[[list[Turn]], str]) -> Rendered:
    """Render the prefixes of 1, 2, ... turns and locate each turn by comparing consecutive outputs.

    The span of turn i in the final output is what the output of i turns adds to the
    one of i-1.  If an output doesn't begin with the one before, the template rewrote
    its history: the turn is listed in ``rewrites`` and its span, and those of the
    turns before that the rewriting reaches, begin at the first changed character.
    """
    before, spans, rewrites = "", [], []
    for i in range(1, len(turns) + 1):
        output = template(turns[:i])
        same = len(before)
        if not output.startswith(before):
            rewrites.append(i - 1)
            same = _common_prefix(before, output)
            spans = [(min(a, same), min(b, same)) for a, b in spans]
        spans.append((same, len(output)))
        before = output
    return Rendered(before, spans, rewrites)


def _common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a.startswith(b[lo:mid], lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


def loss_spans(turns: list[Turn], rendered: Rendered, template: Callable[[list[Turn]], str]) -> list[tuple[int, int]]:
    """Where the texts of the ``LOSS_ROLE`` lie in the output.

    The text is located by rendering the same turn, behind the same turns before it,
    with two other texts of one character: what both renderings share at the front and
    at the back is the template's own.  A history that was rewritten gets no loss.
    """
    out = []
    for i, (role, text) in enumerate(turns):
        if role != LOSS_ROLE or not text or any(r >= i for r in rendered.rewrites):
            continue
        probe, other = (template([*turns[:i], (role, t)]) for t in "xy")
        head = _common_prefix(probe, other)
        tail = len(probe) - head - 1
        out.append((head, rendered.spans[i][1] - tail))
    return out


def format_conversation(turns: list[Turn], template: Callable[[list[Turn]], str] = render, reader: Callable[[str], list[Turn]] = parse, plain: Callable[[str], str] = unescape) -> dict:
    """Output, loss spans, rewritten turns, and the digests that are read back from the output.

    ``reader`` and ``plain`` (of one text) undo what ``template`` does to turns and to texts.
    """
    rendered = incremental_spans(turns, template)
    spans = loss_spans(turns, rendered, template)
    loss = "".join([plain(rendered.output[a:b]) for a, b in spans])
    back = reader(rendered.output)
    return {
        "output": rendered.output,
        "loss_spans": spans,
        "rewrites": rendered.rewrites,
        "n_turns": len(back),
        "turns_sha256": hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in back]).encode()).hexdigest(),
        "loss_chars": len(loss),
        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
        "formatted_chars": len(rendered.output),
    }


FORMATTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long, output string, loss_spans array<struct<begin:long,end:long>>"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format every conversation; columns of ``FORMATTED``.

    The rows of a conversation are gathered (the only shuffle) and put in the order
    of turn, then role and text where turns tie; repeated rows count as turns of
    their own.  A null text or role is empty, a null turn comes first, a null conv_id
    is one conversation.  Rendering prefixes takes time in the square of a
    conversation's turns; a conversation has to fit in a task's memory, as its
    output is one value.  No rows: no conversations.  Other columns are ignored.
    """
    ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm.chat import format_conversation

        for batch in batches:
            rows = [format_conversation([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            longs = {k: pa.array([r[k] for r in rows], pa.int64()) for k in ("n_turns", "loss_chars", "formatted_chars")}
            texts = {k: pa.array([r[k] for r in rows], pa.string()) for k in ("turns_sha256", "loss_sha256", "output")}
            spans = pa.array([[{"begin": a, "end": b} for a, b in r["loss_spans"]] for r in rows], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), longs["n_turns"], texts["turns_sha256"], longs["loss_chars"], texts["loss_sha256"], longs["formatted_chars"], pa.array([len(r["rewrites"]) for r in rows], pa.int64()), texts["output"], spans],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites", "output", "loss_spans"],
            )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(doc_key("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    out = gathered.mapInArrow(run, FORMATTED)
    return out.withColumn("conv_id", F.when(F.col("conv_id") != F.lit(NULL_ID), F.col("conv_id")))
