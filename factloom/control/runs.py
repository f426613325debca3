"""The control plane on the driver: budgets, limits, fallback ladders, routing, run graphs and their events."""

from __future__ import annotations

import datetime as dt
import json
import re
import time
from collections import Counter, deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

PACIFIC = ZoneInfo("America/Los_Angeles")


class Refused(RuntimeError):
    """A call that a limit or budget forbids."""


def cost_usd(tokens_in: int, tokens_out: int, per_million_in: float, per_million_out: float) -> float:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1_000_000


def clamped(value: object) -> float:
    """A confidence within [0, 1]; what isn't a number is 0."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return 0.0
    return max(0.0, min(1.0, float(value)))


def parse_json(text: str) -> object:
    """JSON that may stand between fences."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    return json.loads(fenced[1] if fenced else text)


@dataclass
class Budget:
    """Ceilings that are checked before a call; one of 0 or less is none."""

    request: float = 0.02
    session: float = 0.25
    lifetime: float = 0.50
    spent: Counter = field(default_factory=Counter)

    def check(self) -> None:
        for scope in ("request", "session", "lifetime"):
            ceiling = getattr(self, scope)
            if ceiling > 0 and self.spent[scope] >= ceiling:
                raise Refused(f"the {scope} budget is spent")

    def record(self, cost: float) -> None:
        for scope in ("request", "session", "lifetime"):
            self.spent[scope] += cost

    def new_request(self) -> None:
        self.spent["request"] = 0.0


class Limiter:
    """Calls per minute (waits) and per Pacific day (refuses)."""

    def __init__(self, per_minute: int, per_day: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, longest_wait: float = 65.0, enabled: bool = True):
        self.per_minute, self.per_day, self.clock, self.sleep, self.longest_wait, self.enabled = per_minute, per_day, clock, sleep, longest_wait, enabled
        self.recent: deque[float] = deque()
        self.days: Counter = Counter()

    def acquire(self) -> float:
        """Seconds waited."""
        if not self.enabled:
            return 0.0
        day = dt.datetime.fromtimestamp(self.clock(), PACIFIC).date()
        if self.days[day] >= self.per_day:
            raise Refused("the daily quota is used up")
        waited = 0.0
        while True:
            now = self.clock()
            while self.recent and self.recent[0] <= now - 60:
                self.recent.popleft()
            if len(self.recent) < self.per_minute:
                break
            pause = self.recent[0] + 60 - now
            if waited + pause > self.longest_wait:
                raise Refused("no free slot in time")
            self.sleep(pause)
            waited += pause
        self.recent.append(self.clock())
        self.days[day] += 1
        return waited


@dataclass(frozen=True)
class Rung:
    name: str
    call: Callable[[str], str]
    paid: bool = False


def walk_ladder(rungs: Sequence[Rung], prompt: str, paid_allowed: bool = False, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), retries: int = 1) -> tuple[str, str, list[str]]:
    """(answer, rung, failures): the first rung that answers; transient errors are retried, paid rungs may be barred."""
    failures: list[str] = []
    for rung in rungs:
        if rung.paid and not paid_allowed:
            failures.append(f"{rung.name}: paid models are not allowed")
            continue
        for attempt in range(retries + 1):
            try:
                return rung.call(prompt), rung.name, failures
            except transient as error:
                failures.append(f"{rung.name}: {error}")
                if attempt == retries:
                    break
            except Refused as error:
                failures.append(f"{rung.name}: {error}")
                break
    raise Refused("; ".join(failures) or "no rung")


def load_routing(routes: Mapping[str, str], tiers: Mapping[str, str], tasks: Sequence[str]) -> dict[str, str]:
    """task -> model; every task needs a known tier and unknown tasks are an error."""
    if unknown := sorted(set(routes) - set(tasks)):
        raise ValueError(f"unknown tasks: {unknown}")
    if missing := sorted(set(tasks) - set(routes)):
        raise ValueError(f"tasks without a tier: {missing}")
    if bad := sorted({t for t in routes.values() if t not in tiers}):
        raise ValueError(f"unknown tiers: {bad}")
    return {task: tiers[tier] for task, tier in routes.items()}


@dataclass
class Stage:
    name: str
    detail: dict
    seconds: float
    error: str = ""


def run_graph(sources: Mapping[str, Callable[[str], list[dict]]], question: str, route: Callable[[str], Sequence[str]], sufficient: Callable[[list[dict]], Sequence[str]], answer: Callable[[str, list[dict]], str], replans: int = 2, threads: int = 4) -> Iterator[dict]:
    """The events of one run: route, ask the sources side by side, collect, ask again for gaps, answer.

    A source that raises or gives something else than a list of rows is a failed stage;
    the others go on.
    """
    yield {"kind": "started", "question": question}
    try:
        asked = list(dict.fromkeys(route(question)))
        if unknown := [a for a in asked if a not in sources]:
            raise ValueError(f"unknown sources: {unknown}")
        kept: list[dict] = []
        for _ in range(replans + 1):
            with ThreadPoolExecutor(threads) as pool:
                stages = list(pool.map(lambda name: _ask(name, sources[name], question), asked))
            for stage, rows in stages:
                yield {"kind": "stage", "name": stage.name, "error": stage.error, "n": len(rows)}
                fresh = [r for r in rows if r not in kept]
                kept += fresh
                if fresh:
                    yield {"kind": "evidence", "source": stage.name, "rows": fresh}
            gaps = [g for g in sufficient(kept) if g in sources]
            if not gaps:
                break
            asked = gaps
        yield {"kind": "answer", "text": answer(question, kept), "evidence": len(kept)}
    except Exception as error:  # a run ends with an event, whatever happens
        yield {"kind": "error", "error": f"{type(error).__name__}: {error}"}


def _ask(name: str, source: Callable[[str], list[dict]], question: str) -> tuple[Stage, list[dict]]:
    begun = time.monotonic()
    try:
        rows = source(question)
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise TypeError("the source gave no rows")
        return Stage(f"source.{name}", {"evidence": len(rows)}, time.monotonic() - begun), rows
    except Exception as error:
        return Stage(f"source.{name}", {}, time.monotonic() - begun, f"{type(error).__name__}: {error}"), []


class Registry:
    """Runs that can be cancelled by id."""

    def __init__(self, spark=None):
        self.spark, self.cancelled, self.running = spark, set(), set()

    def events(self, run_id: str, source: Iterator[dict]) -> Iterator[str]:
        """NDJSON lines of a run until it ends or is cancelled."""
        self.running.add(run_id)
        if self.spark is not None:
            self.spark.addTag(f"run-{run_id}")
        try:
            for event in source:
                if run_id in self.cancelled:
                    yield json.dumps({"kind": "error", "error": "cancelled"})
                    return
                yield json.dumps(event, default=str)
        finally:
            self.running.discard(run_id)
            if self.spark is not None:
                self.spark.removeTag(f"run-{run_id}")

    def cancel(self, run_id: str) -> bool:
        if run_id not in self.running:
            return False
        self.cancelled.add(run_id)
        if self.spark is not None:
            self.spark.interruptTag(f"run-{run_id}")
        return True


class PersistentSpend:
    """Calls, tokens and cost per model in a JSON file, written beside and renamed; an unreadable file counts as empty."""

    def __init__(self, path: str):
        self.path = path
        try:
            with open(path) as f:
                self.models = {str(k): dict(v) for k, v in json.load(f).items()}
        except (OSError, ValueError, AttributeError, TypeError):
            self.models = {}

    def record(self, model: str, tokens_in: int, tokens_out: int, cost: float, at: float) -> None:
        row = self.models.setdefault(model, {"calls": 0, "tokens_in": 0, "tokens_out": 0, "cost": 0.0, "first": at})
        row["calls"] += 1
        row["tokens_in"] += tokens_in
        row["tokens_out"] += tokens_out
        row["cost"] += cost
        row["last"] = at
        import os

        with open(f"{self.path}.tmp", "w") as f:
            json.dump(self.models, f, sort_keys=True)
        os.replace(f"{self.path}.tmp", self.path)

    @property
    def total(self) -> float:
        return sum(m["cost"] for m in self.models.values())


def with_timeout(spark, seconds: float, action: Callable[[], object]) -> object:
    """Run a Spark action; its jobs are cancelled when the time is over (TimeoutError)."""
    import threading
    import uuid

    context, group, over = spark.sparkContext, f"timeout-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "bounded", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception as error:
        if over.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
