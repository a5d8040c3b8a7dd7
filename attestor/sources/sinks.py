"""Writers: CSV that spreadsheets can open safely, one table for each kind of record, bundles, events and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import file_name, formula_guard, markdown_cell
from attestor.operators.charts import index, long_points
from attestor.operators.records import wide_table

BOM = "\ufeff"


def guarded(rows: DataFrame) -> DataFrame:
    """Text columns with the formula guard, nested columns as JSON text; numbers stay as they are."""
    made: dict[str, Column] = {}
    for name, kind in rows.dtypes:
        if kind == "string":
            made[name] = formula_guard(F.col(f"`{name}`"))
        elif kind.startswith(("array", "map", "struct")):
            made[name] = formula_guard(F.to_json(f"`{name}`"))
    return rows.withColumns(made)


def write_csv(rows: DataFrame, path: str, bom: bool = True) -> None:
    """CSV in part files, each with its header; with ``bom`` the header's first name carries the mark that spreadsheets look for."""
    safe = guarded(rows)
    safe = safe.withColumnRenamed(safe.columns[0], BOM + safe.columns[0]) if bom and safe.columns else safe
    safe.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark, path: str) -> DataFrame:
    """What :func:`write_csv` wrote, as text, without mark and guard."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.withColumnRenamed(rows.columns[0], rows.columns[0].removeprefix(BOM)) if rows.columns else rows
    return rows.withColumns({c: F.regexp_replace(F.col(f"`{c}`"), r"^'(?=[=+\-@\t\r\n])", "") for c in rows.columns})


def write_tables(records: DataFrame, plan: dict[str, list[str]], path: str) -> dict[str, str]:
    """One CSV for each planned table, with all planned columns; a table without records still has its header."""
    written = {}
    for table, columns in plan.items():
        written[table] = f"{path}/{table}"
        wide = wide_table(records, table, columns)
        write_csv(wide, written[table])
    return written


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows with all columns; what a table doesn't have is null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def write_charts(charts: DataFrame, path: str) -> None:
    write_csv(long_points(charts), f"{path}/chart_points")
    write_csv(index(charts), f"{path}/chart_index")


def write_bundle(tables: dict[str, DataFrame], path: str, as_json: tuple[str, ...] = ()) -> None:
    """Every table as Parquet, and those named in ``as_json`` as JSON lines, too. Each write is committed as a whole."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        if name in as_json:
            rows.write.mode("overwrite").json(f"{path}/{name}_json")


def append_events(events: DataFrame, path: str) -> None:
    """Events as further JSON lines of a log."""
    events.write.mode("append").json(path)


def markdown_table(rows: DataFrame, limit: int = 50) -> str:
    """The first rows of a small result as a Markdown table. This is for reports, which people read: ``limit`` is what they see."""
    cells = rows.limit(limit).select(*(markdown_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in rows.columns)).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in cells])


def report(title: str, quality: DataFrame, parts: dict[str, DataFrame]) -> str:
    """A Markdown report: the quality row as a list, and a table for each named result."""
    numbers = quality.first().asDict()
    lines = [f"# {title}", "", *(f"- {name}: {value}" for name, value in numbers.items())]
    for name, rows in parts.items():
        lines += ["", f"## {name}", "", markdown_table(rows)]
    return "\n".join(lines) + "\n"


def table_file(name: Column) -> Column:
    return F.concat(file_name(name), F.lit(".csv"))
