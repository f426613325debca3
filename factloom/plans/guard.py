"""Admission of read-only SQL, decided on Spark's own parsed and analysed plans.

A statement is admitted if it is one query built from an allow-list of plan nodes,
reads at least one allowed table and no other, calls no denied function, passes
analysis in a session that holds nothing but the allowed tables, and has a literal
row limit (one is added, or lowered to the bound; a guard without a bound leaves a statement's
rows whole).  A refused statement never gets a physical plan.

This is the one module that touches the session's internal parser, which Spark
Connect doesn't have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Logical plan nodes that a read-only query may have.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit LimitAndOffset Offset Distinct Union Intersect Except SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation "
    "WithWindowDefinition ResolvedInlineTable UnresolvedOrderBy UnresolvedTableAliases".split()
)
#: Functions that run code, read files or reveal the environment.
DENIED_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true current_user session_user user current_catalog current_database current_schema version spark_partition_id monotonically_increasing_id read_files from_avro".split())


#: Expressions that hold a plan.
SUBQUERIES = frozenset("Exists ScalarSubquery ListQuery LateralSubquery UnresolvedScalarSubquery FunctionTableSubqueryArgumentExpression DynamicPruningSubquery".split())


@dataclass(frozen=True)
class Verdict:
    """``sql`` and ``tables`` are empty on a refusal."""

    ok: bool
    reason: str = ""
    sql: str = ""
    tables: tuple[str, ...] = ()


def _refuse(reason: str) -> Verdict:
    return Verdict(False, reason)


class Node:
    """A thin view of a JVM plan node or expression."""

    def __init__(self, java):
        self.java = java
        self.kind = java.getClass().getSimpleName()

    @staticmethod
    def _each(sequence) -> Iterator[object]:
        for i in range(sequence.size()):
            yield sequence.apply(i)

    def _nodes(self, sequence) -> list[Node]:
        return [Node(x) for x in self._each(sequence)]

    def children(self) -> list[Node]:
        return self._nodes(self.java.children())

    def plans_within(self) -> list[tuple[str, Node]]:
        """Plans that aren't children: common table expressions, lateral sides and subqueries, each with its holder."""
        found = []
        if self.kind == "UnresolvedWith":
            for pair in self._each(self.java.cteRelations()):
                found.append(("cte", Node(pair._2())))
        for expression in self.expressions():
            found += expression.subqueries()
        return found

    def expressions(self) -> list[Node]:
        return self._nodes(self.java.expressions())

    def subqueries(self) -> list[tuple[str, Node]]:
        found = []
        for e in self.walk_expression():
            if e.kind in SUBQUERIES:
                found.append((e.kind, Node(e.java.plan())))
        return found

    def walk_expression(self) -> Iterator[Node]:
        yield self
        for child in self.children():
            yield from child.walk_expression()

    def walk(self) -> Iterator[Node]:
        """This plan and every plan below, also inside common table expressions and subqueries."""
        yield self
        for child in self.children():
            yield from child.walk()
        for _, plan in self.plans_within():
            yield from plan.walk()


def parse(spark: SparkSession, sql: str) -> Node:
    """The one parsed plan of ``sql``; ParseException if it isn't one statement."""
    return Node(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def _bare(sql: str) -> str:
    """The text without comments, quoted strings and identifiers, for the wording of refusals only."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)


def _parse_reason(sql: str) -> str:
    bare = _bare(sql).strip().rstrip(";")
    if ";" in bare:
        return "Exactly one statement is required"
    if re.search(r"\bfor\s+(update|share|no\s+key|key\s+share)\b", bare, re.I):
        return "Row locking clauses are not allowed"
    if re.search(r"\b(insert|update|delete|merge|create|drop|alter|truncate|grant|revoke|copy)\b|\bselect\b.*\binto\b", bare, re.I | re.S):
        return "DDL and DML are not allowed"
    return "SQL parse error"


def relations(plan: Node, scope: frozenset[str] = frozenset()) -> Iterator[tuple[str, ...]]:
    """The name parts of every table that is read, without names of common table expressions in scope."""
    if plan.kind == "UnresolvedWith":
        inner = scope
        for pair in Node._each(plan.java.cteRelations()):
            yield from relations(Node(pair._2()), inner)
            inner = inner | {pair._1().lower()}
        scope = inner
    if plan.kind == "UnresolvedRelation":
        parts = tuple(str(x) for x in Node._each(plan.java.multipartIdentifier()))
        if not (len(parts) == 1 and parts[0].lower() in scope):
            yield parts
    for child in plan.children():
        yield from relations(child, scope)
    for holder, inner_plan in plan.plans_within():
        if holder != "cte":
            yield from relations(inner_plan, scope)


def _functions(plan: Node) -> Iterator[str]:
    for node in plan.walk():
        for root in node.expressions():
            for e in root.walk_expression():
                if e.kind == "UnresolvedFunction":
                    yield ".".join(str(x) for x in Node._each(e.java.nameParts())).lower()


def _bind(parts: tuple[str, ...], allowed: Mapping[str, Sequence[str]]) -> tuple[str, str]:
    """(qualified name, '') of a relation, or ('', why not)."""
    lowered = [p.lower() for p in parts]
    if len(lowered) > 2:
        return "", f"Catalog is not allowed: {parts[0]}"
    schemas = {name.rpartition(".")[0] for name in allowed}
    if len(lowered) == 2:
        if lowered[0] not in schemas:
            return "", f"Schema is not allowed: {parts[0]}"
        name = ".".join(lowered)
        return (name, "") if name in allowed else ("", f"Table is not allowed: {'.'.join(parts)}")
    fits = sorted(name for name in allowed if name.rpartition(".")[2] == lowered[0])
    if not fits:
        return "", f"Table is not allowed: {parts[0]}"
    if len(fits) > 1:
        return "", f"Table name is ambiguous: {parts[0]} may be {' or '.join(fits)}"
    return fits[0], ""


def _limit(plan: Node) -> tuple[int | None, str]:
    """(the root's literal limit or None, why it is refused)."""
    node = plan
    while node.kind in {"UnresolvedWith", "Offset"}:
        node = node.children()[0]
    if node.kind not in {"GlobalLimit", "LimitAndOffset"}:
        return None, ""
    expression = Node(node.java.limitExpr())
    text = expression.java.toString()
    if expression.kind != "Literal" or not re.fullmatch(r"-?\d+", text):
        return None, "LIMIT must be a literal number"
    if int(text) < 0:
        return None, "LIMIT must not be negative"
    return int(text), ""


def _uncorrelated_exists(analysed: Node) -> bool:
    for node in analysed.walk():
        for root in node.expressions():
            for e in root.walk_expression():
                if e.kind == "Exists" and e.java.outerAttrs().isEmpty():
                    return True
    return False


class Guard:
    """Admits statements over the given tables, named ``schema.table`` in lower case.

    ``row_limit`` bounds what reaches a reader who collects it; with None all rows of a statement come, as for a result that is written.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], row_limit: int | None):
        self.spark, self.row_limit = spark, row_limit
        self.tables = {name.lower(): df for name, df in tables.items()}

    def _view(self, name: str) -> str:
        return "guarded_" + re.sub(r"\W", "_", name)

    def _bound(self, sql: str, plan: Node) -> tuple[str, tuple[str, ...], str]:
        """The statement with every table replaced by its view: (sql, tables, why not)."""
        spans, names = [], []
        for node in plan.walk():
            if node.kind != "UnresolvedRelation":
                continue
            origin = node.java.origin()
            if origin.startIndex().isDefined():
                spans.append((origin.startIndex().get(), origin.stopIndex().get(), tuple(str(x) for x in Node._each(node.java.multipartIdentifier()))))
        wanted = set(relations(plan))
        out, done = sql, set()
        for start, stop, parts in sorted(spans, reverse=True):
            if parts not in wanted or start in done:
                continue
            done.add(start)
            name, why = _bind(parts, {n: () for n in self.tables})
            if why:
                return "", (), why
            text = sql[start : stop + 1]
            bare = f"`{self._view(name)}`"
            head = re.match(r"\s*(`[^`]+`|\w+)(\s*\.\s*(`[^`]+`|\w+))*", text)
            rest = text[head.end() :] if head else ""
            if not re.search(r"\w", rest):
                rest = f" AS `{name.rpartition('.')[2]}`" + rest if not self._aliased(sql, stop + 1) else rest
            out = out[:start] + bare + rest + out[stop + 1 :]
            names.append((start, name))
        return out, tuple(dict.fromkeys(n for _, n in sorted(names))), ""

    @staticmethod
    def _aliased(sql: str, at: int) -> bool:
        """Whether an alias follows the table name that ends before ``at``."""
        m = re.match(r"\s+(?:as\s+)?(`[^`]+`|[A-Za-z_]\w*)", sql[at:], re.I)
        return bool(m) and (bool(re.match(r"\s+as\s", sql[at:], re.I)) or m[1].lower() not in _AFTER_TABLE)

    def check(self, sql: str) -> Verdict:
        """Whether ``sql`` may run, and the statement to run."""
        if not self.tables:
            return _refuse("The list of allowed tables is empty")
        if self.row_limit is not None and (isinstance(self.row_limit, bool) or not isinstance(self.row_limit, int) or self.row_limit <= 0):
            return _refuse("The row limit must be a positive whole number")
        try:
            plan = parse(self.spark, sql)
        except ParseException:
            return _refuse(_parse_reason(sql))
        for node in plan.walk():
            if node.kind not in QUERY_NODES:
                if node.kind in {"UnresolvedTableValuedFunction", "UnresolvedTVFAliases"}:
                    return _refuse("Table is not allowed: a table function")
                modifies = re.search(r"\b(insert|update|delete|merge|create|drop|alter|truncate)\b", _bare(sql), re.I)
                return _refuse("DDL and DML are not allowed" if modifies and re.match(r"\s*(with|select)\b", _bare(sql), re.I) else "Only SELECT statements are allowed")
        for name in _functions(plan):
            if name.rpartition(".")[2] in DENIED_FUNCTIONS:
                return _refuse(f"Function is not allowed: {name}")
        found = list(relations(plan))
        names = []
        for parts in found:
            name, why = _bind(parts, {n: () for n in self.tables})
            if why:
                return _refuse(why)
            names.append(name)
        if not names:
            star = any(e.kind == "UnresolvedStar" for n in plan.walk() for r in n.expressions() for e in r.walk_expression())
            return _refuse("SELECT * requires an allowed source table" if star else "The query must read an allowed table")
        limit, why = _limit(plan)
        if why:
            return _refuse(why)
        bound, tables, why = self._bound(sql.strip().rstrip(";"), parse(self.spark, sql.strip().rstrip(";")))
        if why:
            return _refuse(why)
        try:
            frame = self._frame(bound)
            analysed = Node(frame._jdf.queryExecution().analyzed())
        except AnalysisException as error:
            return _refuse(f"Column validation failed: {error.getCondition() or ''} {str(error).splitlines()[0]}")
        if _uncorrelated_exists(analysed):
            return _refuse("EXISTS must refer to the outer query")
        if self.row_limit is None:
            return Verdict(True, "", bound, tables)
        rows = self.row_limit if limit is None else min(limit, self.row_limit)
        return Verdict(True, "", f"SELECT * FROM ({bound}\n) AS guarded LIMIT {rows}" if limit is None or limit > rows else bound, tables)

    def _frame(self, bound: str) -> DataFrame:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(self._view(name))
        return self.spark.sql(bound)

    def frame(self, sql: str) -> DataFrame:
        """The frame of a statement that binds, without its row limit; nothing runs.  For ``observe.same_statement``."""
        bound, _, reason = self._bound(sql, parse(self.spark, sql))
        if reason:
            raise PermissionError(reason)
        return self._frame(bound)

    def run(self, sql: str) -> DataFrame:
        """The rows of an admitted statement; ``PermissionError`` with the reason otherwise."""
        verdict = self.check(sql)
        if not verdict.ok:
            raise PermissionError(verdict.reason)
        return self._frame(verdict.sql)


_AFTER_TABLE = frozenset("where group order having limit offset union intersect except minus join inner left right full cross natural lateral on using window qualify anti semi tablesample pivot unpivot sort distribute cluster as".split())
