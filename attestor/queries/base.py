"""How queries are registered, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: White space as Unicode has it, for engines whose ``\s`` is ASCII only.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeezed(text: str) -> str:
    """SQL for single blanks."""
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its name; without SQL it is one that SQL cannot express."""

    def keep(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are dealt to all cores first: a small file is read by one task, which would do all the work on its rows."""
    return table(spark, sf_dir, name).repartition(key)
