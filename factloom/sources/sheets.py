"""From cells to typed tables: islands of rows, titles, headers, footers, kinds and lineage."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.values import SENTINELS, coerced, column_letters

MAJORITY = 0.6
ROWS_SHOWN = 500
_FOOTER = re.compile(r"^(grand\s+)?(total|subtotal|sum|average|overall)\b", re.I)
FOOTER_PATTERN = r"(?i)^(grand\s+)?(total|subtotal|sum|average|overall)\b"


def islands(cells: DataFrame) -> DataFrame:
    """Adds island: blocks of consecutive occupied rows in each sheet, numbered from 1."""
    rows = cells.select("workbook", "sheet", "row").distinct()
    sheet = Window.partitionBy("workbook", "sheet").orderBy("row")
    starts = rows.withColumn("new", (F.col("row") - F.coalesce(F.lag("row").over(sheet), F.lit(-1)) > 1).cast("int"))
    numbered = starts.withColumn("island", F.sum("new").over(sheet)).select("workbook", "sheet", "row", "island")
    return cells.join(numbered, ["workbook", "sheet", "row"])


def footer_rows(rows: DataFrame, first_cell: str = "first_cell", order: str = "row") -> DataFrame:
    """Adds is_footer to the rows of each island: only trailing rows whose first cell reads like a total."""
    back = Window.partitionBy("workbook", "sheet", "island").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    looks = F.coalesce(F.col(first_cell).rlike(FOOTER_PATTERN), F.lit(False)).cast("int")
    return rows.withColumn("is_footer", F.min(looks).over(back) == 1)


def cell_kind(value: Column, kind: Column) -> Column:
    """Kind of one cell: blank for sentinels, else decimal, percent, date, boolean or text."""
    low = F.lower(F.trim(value))
    return (
        F.when(value.isNull() | low.isin(*SENTINELS), "blank")
        .when(kind == "date", "date").when(kind == "boolean", "boolean").when(kind == "number", "decimal")
        .when(low.rlike(r"^[(]?[+-]?[0-9][0-9,. ]*[)]?\s*%$"), "percent")
        .when(low.rlike(r"^[(]?(?:(?:pkr|rs|usd|eur|gbp)\.?|[$€£])?\s*[+-]?[0-9][0-9,. ]*[)]?$"), "decimal")
        .when(low.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .otherwise("text")
    )


def column_kinds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The kind that at least MAJORITY of a column's cells have (ties by name), 'text' without one, 'empty' without cells."""
    kinds = cells.withColumn("k", cell_kind(F.col("value"), F.col("value_kind")))
    counts = kinds.groupBy(*keys, "k").agg(F.count("*").alias("n"))
    voted = counts.groupBy(*keys).agg(F.sum(F.when(F.col("k") != "blank", F.col("n"))).alias("total"), F.min(F.when(F.col("k") != "blank", F.struct((-F.col("n")).alias("n"), "k"))).alias("best"))
    return voted.select(*keys, F.when(F.coalesce("total", F.lit(0)) == 0, "empty").when(-F.col("best.n") >= MAJORITY * F.col("total"), F.col("best.k")).otherwise("text").alias("kind"))


def refined_kind(kind: str, formats: list[str]) -> str:
    """A number's kind by the first cell format that says more."""
    if kind != "decimal":
        return kind
    for pattern in formats:
        low = (pattern or "").lower()
        if "%" in low:
            return "percent"
        if any(mark in low for mark in ("pkr", "rs", "$", "€", "£")):
            return "currency"
    return kind


@dataclass
class SheetTable:
    """Where one table lies in a sheet and what its columns are."""

    workbook: str
    sheet: str
    index: int
    title: str | None
    header_rows: tuple[int, ...]
    first_row: int
    last_row: int
    footer_rows: tuple[int, ...]
    columns: list[tuple[int, str]] = field(default_factory=list)

    def a1_range(self, row: int | None = None) -> str:
        left, right = column_letters(self.columns[0][0]), column_letters(self.columns[-1][0])
        return f"{left}{row or self.first_row}:{right}{row or self.last_row}"


def sheet_tables(cells: pd.DataFrame) -> list[SheetTable]:
    """The tables of the sheets in a frame of cells (one workbook's; a sheet is read by one person)."""
    out: list[SheetTable] = []
    for (workbook, sheet), frame in cells.groupby(["workbook", "sheet"], sort=True):
        grid: dict[int, dict[int, tuple[str, str]]] = {}
        for r in frame.itertuples():
            grid.setdefault(int(r.row), {})[int(r.col)] = (r.value, r.value_kind)
        rows = sorted(grid)
        blocks, block = [], []
        for r in rows:
            if block and r - block[-1] > 1:
                blocks.append(block)
                block = []
            block.append(r)
        if block:
            blocks.append(block)
        title, index = None, 0
        for block in blocks:
            distinct = lambda r: {v for v, _ in grid[r].values()}
            if len(block) == 1 and len(distinct(block[0])) == 1:
                title = next(iter(distinct(block[0])))
                continue
            if len(block) > 1 and len(distinct(block[0])) == 1 and len(grid[block[1]]) > len(distinct(block[0])):
                title = next(iter(distinct(block[0])))
                block = block[1:]
            all_text = lambda r: all(k == "text" and v.strip().lower() not in SENTINELS for v, k in grid[r].values())
            header = [block[0]] if all_text(block[0]) else []
            if header and len(block) > 2 and all_text(block[1]) and not all_text(block[2]):
                header.append(block[1])
            data = block[len(header) :]
            footers: list[int] = []
            while len(data) > 1:
                cells_of = grid[data[-1]]
                if not _FOOTER.match(cells_of[min(cells_of)][0].strip()):
                    break
                footers.insert(0, data.pop())
            if not data:
                continue
            used = sorted({c for r in data for c in grid[r]})
            span = range(used[0], used[-1] + 1)
            columns = []
            for c in span:
                if c not in used:
                    continue
                parts = list(dict.fromkeys(grid[r][c][0] for r in header if c in grid[r]))
                columns.append((c, " ".join(parts) or f"column {column_letters(c)}"))
            index += 1
            out.append(SheetTable(workbook, sheet, index, title, tuple(header), data[0], data[-1], tuple(footers), columns))
            title = None
    return out


def column_name(label: str, fallback: str) -> str:
    import unicodedata

    plain = unicodedata.normalize("NFKD", label).encode("ascii", "ignore").decode().lower()
    name = re.sub(r"[^a-z0-9]+", "_", plain).strip("_") or fallback
    return f"_{name}" if name[0].isdigit() else name


def table_name(table: SheetTable) -> str:
    stem = column_name(re.sub(r"\.xlsx$", "", table.workbook), "workbook")
    leaf = column_name(table.sheet, "sheet")
    return f"{stem}__{leaf}{'' if table.index == 1 else f'_{table.index}'}"[:63]


def typed_table(spark: SparkSession, cells: DataFrame, table: SheetTable, generation: str) -> DataFrame:
    """The rows of one table with typed columns and their lineage (_workbook, _sheet, _row, _a1_range, _generation)."""
    inside = cells.where((F.col("workbook") == table.workbook) & (F.col("sheet") == table.sheet) & F.col("row").between(table.first_row, table.last_row))
    places = [c for c, _ in table.columns]
    kinds = {r.col: r.kind for r in column_kinds(inside.where(F.col("col").isin(*places)), ["col"]).collect()}
    formats = {r.col: r.f for r in inside.where(F.col("col").isin(*places)).groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cell_format"))), lambda x: x["cell_format"]).alias("f")).collect()}
    wide = inside.groupBy("row").pivot("col", places).agg(F.first("value"))
    columns, names = [], set()
    for c, label in table.columns:
        name = column_name(label, f"column_{c}")
        while name in names:
            name += "_2"
        names.add(name)
        kind = refined_kind(kinds.get(c, "empty"), formats.get(c, []))
        raw = F.col(f"`{c}`")
        if kind in ("decimal", "currency", "percent"):
            value = coerced(raw, "percent" if kind == "percent" else "decimal")["value"].cast("decimal(38,10)")
        elif kind in ("date", "boolean"):
            value = coerced(raw, kind)["value"].cast(kind)
        else:
            value = F.when(~F.lower(F.trim(raw)).isin(*SENTINELS), raw)
        columns.append(value.alias(name))
    left, right = column_letters(places[0]), column_letters(places[-1])
    a1 = F.concat(F.lit(left), F.col("row").cast("string"), F.lit(f":{right}"), F.col("row").cast("string"))
    return wide.select(*columns, F.lit(table.workbook).alias("_workbook"), F.lit(table.sheet).alias("_sheet"), F.col("row").alias("_row"), a1.alias("_a1_range"), F.lit(generation).alias("_generation"))


def verbatim(cells: DataFrame, workbook: str, sheet: str, limit: int = ROWS_SHOWN) -> tuple[list[dict], int, bool]:
    """(the first rows as texts by column letter, number of rows, whether rows were left out)."""
    inside = cells.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet))
    total = inside.select("row").distinct().count()
    if not total:
        raise KeyError(sheet)
    rows = inside.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells")).orderBy("row").limit(limit).collect()
    return [{column_letters(c): v for c, v in sorted(r.cells.items())} for r in rows], total, total > limit


def ingest(spark: SparkSession, path: str, target: str) -> dict[str, str]:
    """Publish every table of a workbook under ``target``, all of them or none: name -> path.

    The generation is a digest of the file, so a repeated ingest changes nothing.  Readers see the
    tables of the ingest before until all new ones are written, and then those alone.
    """
    from factloom.sources.commits import Publication
    from factloom.sources.xlsx import SCHEMA, read_cells

    generation = hashlib.sha256(Path(path).read_bytes()).hexdigest()[:12]
    rows = list(read_cells(path))
    cells = spark.createDataFrame(rows, SCHEMA)
    frame = pd.DataFrame(rows, columns=["workbook", "sheet", "sheet_no", "row", "col", "value", "value_kind", "cell_format"])
    tables = {table_name(t): typed_table(spark, cells, t, generation) for t in (sheet_tables(frame) if rows else [])}
    held = Publication(spark, target)
    held.publish(Path(path).name, generation, tables)
    return {name: f"{target}/{t['path']}" for name, t in held.tables().items() if t["owner"] == Path(path).name}
