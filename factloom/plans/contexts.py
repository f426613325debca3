"""Declared knowledge about tables: columns, joins and invariants, read from a folder and checked as a whole."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from factloom.operators.checks import Invariant, NonNegative, Ordered, SumOf

_KINDS = {"sum": SumOf, "non_negative": NonNegative, "ordered": Ordered}


class ContextError(ValueError):
    """A catalogue that can't be trusted; nothing of it is used."""


@dataclass(frozen=True)
class TableContext:
    name: str
    columns: tuple[str, ...]
    joins: tuple[tuple[str, str, str], ...] = ()  # (column, other table, its column)
    invariants: tuple[tuple[str, ...], ...] = ()  # (kind, columns...)

    def checks(self) -> list[Invariant]:
        return [_KINDS[kind]("_".join((kind, *columns)), tuple(columns)) for kind, *columns in self.invariants]


def _read(path: Path) -> object:
    if path.suffix == ".json":
        return json.loads(path.read_text())
    try:
        import yaml
    except ImportError as error:
        raise ContextError(f"{path.name}: reading YAML needs PyYAML") from error
    return yaml.safe_load(path.read_text())


def _context(path: Path, raw: object) -> TableContext:
    if not isinstance(raw, Mapping) or set(raw) - {"table", "columns", "joins", "invariants"} or not {"table", "columns"} <= set(raw):
        raise ContextError(f"{path.name}: needs table and columns and knows joins and invariants")
    columns = tuple(str(c).lower() for c in raw["columns"])
    if len(set(columns)) != len(columns):
        raise ContextError(f"{path.name}: a column twice")
    joins = tuple((j["column"].lower(), j["table"].lower(), j["to"].lower()) for j in raw.get("joins") or ())
    invariants = tuple((i["kind"], *[str(c).lower() for c in i["columns"]]) for i in raw.get("invariants") or ())
    for kind, *named in invariants:
        if kind not in _KINDS or set(named) - set(columns):
            raise ContextError(f"{path.name}: unknown invariant or column in {kind} {named}")
    if any(j[0] not in columns for j in joins):
        raise ContextError(f"{path.name}: a join names an unknown column")
    return TableContext(str(raw["table"]).lower(), columns, joins, invariants)


def load_contexts(folder: str) -> dict[str, TableContext]:
    """All contexts of a folder (.json, .yaml), or an error: no duplicates, and joins that exist on both sides."""
    found: dict[str, TableContext] = {}
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in {".json", ".yaml", ".yml"}):
        context = _context(path, _read(path))
        if context.name in found:
            raise ContextError(f"{context.name} is described twice")
        found[context.name] = context
    for context in found.values():
        for _, other, column in context.joins:
            if other not in found or column not in found[other].columns:
                raise ContextError(f"{context.name} joins {other}.{column}, which isn't described")
    return found


def refreshed(context: TableContext, df: DataFrame) -> TableContext:
    """The context for the columns that a table has now; a described column that is gone is an error."""
    observed = tuple(c.lower() for c in df.columns)
    if gone := [c for c in context.columns if c not in observed]:
        raise ContextError(f"{context.name} has lost {gone}")
    return TableContext(context.name, context.columns + tuple(c for c in observed if c not in context.columns), context.joins, context.invariants)


def refresh_all(contexts: Mapping[str, TableContext], tables: Mapping[str, DataFrame]) -> dict[str, TableContext]:
    """All or none."""
    return {name: refreshed(context, tables[name]) for name, context in contexts.items()}


def join_pairs(contexts: Mapping[str, TableContext]) -> list[tuple[str, str]]:
    return [(name, other) for name, context in contexts.items() for _, other, _ in context.joins]


def load_capabilities(path: str, known: tuple[str, ...] = ("name", "description", "examples", "refuses")) -> list[dict]:
    """The sources that a router may choose from; unknown keys and repeated names are errors."""
    raw = _read(Path(path))
    if not isinstance(raw, list) or any(not isinstance(r, dict) or "name" not in r or set(r) - set(known) for r in raw):
        raise ContextError("capabilities are a list of known keys with a name")
    if len({r["name"] for r in raw}) != len(raw):
        raise ContextError("a source twice")
    return raw
