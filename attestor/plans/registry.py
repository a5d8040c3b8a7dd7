"""A registry of named operators, and the rules under which a plan may call them."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    """An operator: its function, which tables it reads, which it gives, and whether it reaches outside."""

    run: Callable[..., DataFrame]
    reads: tuple[str, ...] = ()
    gives: str = ""
    remote: bool = False
    doc: str = ""


@dataclass
class Registry:
    """Operators by name. A name is taken once, unless it is replaced on purpose."""

    entries: dict[str, Entry] = field(default_factory=dict)

    def register(self, name: str, run: Callable[..., DataFrame], reads: tuple[str, ...] = (), gives: str = "", remote: bool = False, replace: bool = False) -> None:
        if name in self.entries and not replace:
            raise ValueError(f"{name} is registered")
        self.entries[name] = Entry(run, reads, gives or name, remote, inspect.getdoc(run) or "")

    def call(self, name: str, tables: dict[str, DataFrame], **options) -> DataFrame:
        """Run an operator on the tables that it reads, in their order."""
        entry = self.entries[name]
        if missing := [t for t in entry.reads if t not in tables]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        return entry.run(*(tables[t] for t in entry.reads), **options)

    def describe(self) -> list[dict[str, str]]:
        return [{"name": n, "reads": ", ".join(e.reads), "gives": e.gives, "remote": str(e.remote), "doc": e.doc.split("\n")[0]} for n, e in sorted(self.entries.items())]

    def runnable(self, tables: dict[str, DataFrame], remote: bool = True) -> list[str]:
        """Names of the operators whose tables are there, without those that reach outside unless they may."""
        return sorted(n for n, e in self.entries.items() if set(e.reads) <= set(tables) and (remote or not e.remote))


# What each action needs of an artifact.
CAPABILITIES = {
    "parse_pdf_sections": ("pdf", "html", "supplementary_pdf"),
    "parse_table": ("csv", "tsv", "xlsx", "json", "xml"),
    "parse_csv": ("csv", "tsv"),
    "parse_figure": ("image", "pdf"),
    "read_readme": ("readme", "code_archive"),
    "read_file_manifest": ("file_manifest", "code_archive", "zip"),
}


def possible_actions(actions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Actions (action, artifact_id) that their artifact can take: it has the right kind, is not at its end, and has not had it.

    ``artifacts`` has (artifact_id, artifact_type, status, completed_operations).
    """
    spark = actions.sparkSession
    able = spark.createDataFrame([(a, k) for a, kinds in CAPABILITIES.items() for k in kinds], "action string, artifact_type string")
    met = actions.join(artifacts, "artifact_id").where(~F.col("status").isin("failed", "skipped") & ~F.array_contains("completed_operations", F.col("action")))
    return met.join(F.broadcast(able), ["action", "artifact_type"], "left_semi").select("action", "artifact_id")


def allowed(actions: DataFrame, budgets: dict[str, int], used: DataFrame) -> DataFrame:
    """Actions with ``problem``: null if one may run; ``used`` (action, n) counts what ran, ``budgets`` what may run."""
    spark = actions.sparkSession
    limits = spark.createDataFrame(list(budgets.items()) or [("", 0)], "action string, budget int")
    met = actions.join(F.broadcast(limits), "action", "left").join(used.select("action", F.col("n").alias("_n")), "action", "left")
    return met.withColumn("problem", F.when(F.coalesce("_n", F.lit(0)) >= F.col("budget"), "budget is used up")).drop("_n", "budget")


def search_requests(requests: DataFrame, allow: list[str], avoid: list[str]) -> DataFrame:
    """Requests for allowed connectors whose query has none of the words to avoid; rewritten queries take the place of their own."""
    kept = requests.where(F.col("connector").isin(allow)) if allow else requests
    rows = kept.withColumn("query", F.explode(F.when(F.size("revised") > 0, F.col("revised")).otherwise(F.array("query")))).drop("revised")
    words = F.array(*map(F.lit, avoid)) if avoid else F.array().cast("array<string>")
    return rows.where(~F.exists(words, lambda w: F.contains(F.lower("query"), F.lower(w))))
