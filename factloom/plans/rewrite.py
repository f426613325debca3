"""Rewriting of text predicates to the spellings that are stored, and of dropped projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from factloom.plans.guard import Node, parse


@dataclass(frozen=True)
class Predicate:
    """One text predicate of a statement: kind is equals, in or contains; start and stop are its place in the text."""

    column: str
    kind: str
    values: tuple[str, ...]
    start: int
    stop: int


def _literal(node: Node) -> str | None:
    if node.kind == "Literal" and node.java.dataType().simpleString() == "string":
        return str(node.java.value())
    return None


def _column(node: Node) -> str | None:
    return ".".join(str(x) for x in Node._each(node.java.nameParts())) if node.kind == "UnresolvedAttribute" else None


def predicates(spark: SparkSession, sql: str) -> list[Predicate]:
    """Equalities, memberships of literals and contains-patterns without inner wildcards, wherever they stand."""
    found = []
    for plan in parse(spark, sql).walk():
        for root in plan.expressions():
            for e in root.walk_expression():
                if (p := _predicate(e)) is not None:
                    found.append(p)
    return sorted(set(found), key=lambda p: p.start)


def _predicate(e: Node) -> Predicate | None:
    if e.kind not in {"EqualTo", "In", "UnresolvedFunction", "Like", "ILike"}:
        return None
    origin = e.java.origin()
    if not origin.startIndex().isDefined():
        return None
    children = e.children()
    # the parser places memberships and patterns behind their column
    begins = [c.java.origin().startIndex().get() for c in children[:1] if c.java.origin().startIndex().isDefined()]
    place = min([origin.startIndex().get(), *begins]), origin.stopIndex().get() + 1
    if e.kind == "EqualTo":
        for a, b in (children, children[::-1]):
            if (column := _column(a)) and (value := _literal(b)) is not None:
                return Predicate(column, "equals", (value,), *place)
    elif e.kind == "In":
        values = [_literal(c) for c in children[1:]]
        if (column := _column(children[0])) and None not in values:
            return Predicate(column, "in", tuple(values), *place)
    elif e.kind in {"Like", "ILike"} and len(children) >= 2:
        column, pattern = _column(children[0]), _literal(children[1])
        if column and pattern and len(pattern) > 2 and pattern[0] == pattern[-1] == "%" and not set(pattern[1:-1]) & set("%_\\"):
            return Predicate(column, "contains", (pattern[1:-1],), *place)
    return None


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escaped_like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def replacement(column: str, kind: str, values: Sequence[str]) -> str:
    """One value as an equality, several as a membership, contains as alternatives of patterns."""
    if kind == "contains":
        parts = " OR ".join(f"{column} ILIKE {quoted('%' + escaped_like(v) + '%')}" for v in values)
        return f"({parts})"
    return f"{column} = {quoted(values[0])}" if len(values) == 1 else f"{column} IN ({', '.join(map(quoted, values))})"


def rewritten(spark: SparkSession, sql: str, resolve: Callable[[str, str], tuple[str, Sequence[str]] | None]) -> str | None:
    """The statement with literals replaced by stored spellings, or None if nothing changes.

    ``resolve(column, literal)`` gives (equals or contains, stored values), or None for
    an unknown literal; a predicate changes only if all of its literals are known.
    """
    out, changed = sql, False
    for p in sorted(predicates(spark, sql), key=lambda p: -p.start):
        answers = [resolve(p.column, v) for v in p.values]
        if not answers or any(a is None for a in answers):
            continue
        kind = "contains" if any(a[0] == "contains" for a in answers) else "equals"
        values = list(dict.fromkeys(v for a in answers for v in a[1]))
        if not values or (kind == "equals" and p.kind in {"equals", "in"} and set(values) == set(p.values)):
            continue
        text = sql[p.start : p.stop]
        negated = " not " in f" {text.lower()} "
        if negated:
            continue
        out, changed = out[: p.start] + replacement(p.column, kind, values) + out[p.stop :], True
    return out if changed else None


def unresolvable(spark: SparkSession, sql: str, known: Callable[[str, str], bool]) -> list[str]:
    """Literals of text predicates that no catalogued value matches."""
    return [v for p in predicates(spark, sql) for v in p.values if not known(p.column, v)]


def dropped_projections(spark: SparkSession, sql: str, planned: Sequence[str], available: Sequence[str]) -> list[str]:
    """Planned bare columns that the statement doesn't project though its table has them."""
    plan = parse(spark, sql)
    while plan.kind not in {"Project", "Aggregate"}:
        below = plan.children()
        if not below:
            return []
        plan = below[0]
    outputs = plan.java.projectList() if plan.kind == "Project" else plan.java.aggregateExpressions()
    shown = set()
    for i in range(outputs.size()):
        node = Node(outputs.apply(i))
        if node.kind == "UnresolvedStar":
            return []
        while node.kind in {"Alias", "UnresolvedAlias"}:
            node = node.children()[0]
        if name := _column(node):
            shown.add(name.split(".")[-1].lower())
    return [c for c in planned if c.lower() not in shown and c.lower() in {a.lower() for a in available}]


def restored(spark: SparkSession, sql: str, planned: Sequence[str], available: Sequence[str]) -> str:
    """The statement with the dropped bare columns added to its projection (not to an aggregate)."""
    import re

    missing = dropped_projections(spark, sql, planned, available)
    if not missing or re.search(r"\bgroup\s+by\b|\bdistinct\b", sql, re.I) or not re.match(r"\s*select\b", sql, re.I):
        return sql
    return re.sub(r"^(\s*select\s+)", lambda m: m[1] + ", ".join(missing) + ", ", sql, count=1, flags=re.I)
