"""Rule extraction: strict records from sentences and from table cells, and the interface for other extractors.

These rules are the default of the extractor interface; a model can stand in for them (:mod:`attestor.plans.registry`).
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from attestor.operators.clustering import shared_base
from attestor.functions.numbers import cell_number, header_unit, metric_from_header, number_text, numbers_with_units
from attestor.functions.text import ascii_key, leading_title, sentences, shorten

TEXT_CONFIDENCE, TABLE_CONFIDENCE = 0.72, 0.84
#: Metrics that one sentence gives at most.
METRICS_A_SENTENCE = 2

# Names of metrics in texts and headers, materials, methods, marks of a condition, and header words by role.
METRIC_ALIASES = {
    "pce": "PCE",
    "power conversion efficiency": "PCE",
    "efficiency": "efficiency",
    "accuracy": "accuracy",
    "precision": "precision",
    "recall": "recall",
    "f1": "F1",
    "rmse": "RMSE",
    "mae": "MAE",
    "psnr": "PSNR",
    "ssim": "SSIM",
    "fid": "FID",
    "absorption": "absorption wavelength",
    "wavelength": "wavelength",
    "bandgap": "bandgap",
    "temperature": "temperature",
    "stability": "stability",
    "yield": "yield",
}
MATERIALS = (
    r"\b(?:MAPbI3|FAPbI3|CsPbI3|CsPbBr3|TiO2|SnO2|perovskite|graphene|silicon|catalyst|chromophore)\b",
    r"\b[A-Z][a-z]?[A-Z]?[a-z]?\d?(?:[A-Z][a-z]?\d?){1,4}\b",
)
METHODS = ("spin coating", "annealing", "sol-gel", "hydrothermal", "random forest", "transformer", "diffusion", "normalizing flow", "fine-tuning")
CONDITION_MARKS = ("under", "at ", "in ", "on ", "dataset", "test set", "AM 1.5", "solvent")
METRIC_HEADERS = (
    "pce", "efficiency", "accuracy", "precision", "recall", "f1", "rmse", "mae", "psnr", "ssim", "fid", "yield", "value", "score",
    "temperature", "wavelength", "bandgap", "stability",
)
ROLE_HEADERS = {
    "material": ("material", "compound", "sample", "molecule", "model", "method"),
    "method": ("method", "preparation", "process", "architecture", "algorithm"),
    "condition": ("condition", "dataset", "solvent", "temperature", "test", "environment"),
    "paper_title": ("paper", "title", "source"),
    "unit": ("unit",),
}


def guess_material(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in MATERIALS))


def guess_method(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*(F.when(F.contains(lower, F.lit(m)), m) for m in METHODS))


def guess_condition(text: Column) -> Column:
    """From the first mark of the list that the text has to its end."""
    lower, choice = F.lower(text), None
    for mark in CONDITION_MARKS:
        at = F.locate(mark, lower)
        rest = shorten(F.substr(text, at), 180)
        choice = F.when(at > 0, rest) if choice is None else choice.when(at > 0, rest)
    return choice


def from_text(blocks: DataFrame) -> DataFrame:
    """Strict records from (source_file, page, text, ordinal): for each sentence with a metric's name and a number.

    A sentence gives a record for each of its first two metrics, with the nearest number. Confidence is 0.72.
    """
    rows = blocks.select("source_file", "page", "ordinal", leading_title(F.col("text")).alias("paper_title"), F.posexplode(sentences(F.col("text"))).alias("s", "sentence"))
    names = F.array(*map(F.lit, METRIC_ALIASES))
    hits = F.slice(F.filter(names, lambda a: F.contains(F.lower("sentence"), a)), 1, METRICS_A_SENTENCE)
    rows = rows.withColumns({"hits": hits, "numbers": numbers_with_units(F.col("sentence"))}).where((F.size("hits") > 0) & (F.size("numbers") > 0))
    rows = rows.select("*", F.posexplode("hits").alias("m", "alias"))
    place = F.expr("locate(alias, lower(sentence))")

    def distance(n: Column) -> Column:
        at = F.position(number_text(n["value"]), F.col("sentence"))
        far = F.when(at > 0, F.abs(at - place)).otherwise(9999)
        glow = (F.lower(n["unit"]) == "g") & F.contains(F.lower("sentence"), F.lit("am 1.5g"))
        return far + F.when(glow, 5000).otherwise(0)

    ranked = F.transform("numbers", lambda n, i: F.struct(distance(n).alias("d"), i.alias("i"), n.alias("n")))
    best = F.array_min(ranked)["n"]
    metric = F.element_at(F.create_map(*(F.lit(x) for pair in METRIC_ALIASES.items() for x in pair)), F.col("alias"))
    return rows.select(
        F.concat_ws(":", "source_file", F.coalesce("page", F.lit(0)), "ordinal", "s", "m").alias("record_id"), F.struct("ordinal", "s", "m").alias("ordinal"), "paper_title",
        guess_material(F.col("sentence")).alias("material"), guess_method(F.col("sentence")).alias("method"), metric.alias("metric_name"), best["value"].alias("metric_value"), best["unit"].alias("unit"),
        guess_condition(F.col("sentence")).alias("condition"), "source_file", F.lit("pdf_text").alias("source_type"), "page", shorten(F.col("sentence"), 500).alias("evidence_text"),
        F.lit(TEXT_CONFIDENCE).alias("confidence"), F.array().cast("array<string>").alias("warnings"),
    )


def _role(columns: Column, words: tuple[str, ...]) -> Column:
    """The first header that holds one of the words."""
    return F.get(F.filter(columns, lambda c: ascii_key(c).rlike("|".join(words))), F.lit(0))


def from_tables(tables: DataFrame) -> DataFrame:
    """Strict records from tables: wide rows become one record for each metric cell that has a number.

    ``tables`` has (table_id, source_file, source_type, page, columns ARRAY<STRING>, rows ARRAY<MAP<STRING, STRING>>). Metric columns
    are those that are named like one; without any, all columns with a number in some row. Confidence is 0.84.
    """
    named = F.filter("columns", lambda c: ascii_key(c).rlike("|".join(METRIC_HEADERS)))
    numeric = F.filter("columns", lambda c: F.exists("rows", lambda r: cell_number(F.element_at(r, c))["value"].isNotNull()))
    roles = {f"_{role}": _role(F.col("columns"), words) for role, words in ROLE_HEADERS.items()}
    wide = tables.withColumns({"_metrics": F.when(F.size(named) > 0, named).otherwise(numeric), **roles})
    cells = wide.select("*", F.posexplode("rows").alias("r", "row")).drop("rows").select("*", F.posexplode("_metrics").alias("m", "column"))
    cell = lambda role: F.nullif(F.trim(F.element_at("row", F.col(f"_{role}"))), F.lit(""))
    cells = cells.withColumn("n", cell_number(F.element_at("row", F.col("column")))).where("n.value is not null")
    shown = F.array_join(
        F.transform(F.filter("columns", lambda c: F.element_at("row", c).isNotNull()), lambda c: F.concat(c, F.lit("="), F.coalesce(F.nullif(F.trim(F.element_at("row", c)), F.lit("")), F.lit("None")))), "; "
    )
    return cells.select(
        F.concat_ws(":", "table_id", F.col("r") + 1, "m").alias("record_id"), F.struct("table_id", "r", "m").alias("ordinal"), cell("paper_title").alias("paper_title"), cell("material").alias("material"),
        cell("method").alias("method"), metric_from_header(F.col("column"), METRIC_ALIASES).alias("metric_name"), F.col("n.value").alias("metric_value"),
        F.coalesce("n.unit", header_unit(F.col("column")), cell("unit")).alias("unit"), cell("condition").alias("condition"), "source_file", "source_type", "page",
        F.concat(F.lit("row "), F.col("r") + 1, F.lit(": "), shown).alias("evidence_text"), F.lit(TABLE_CONFIDENCE).alias("confidence"), F.array().cast("array<string>").alias("warnings"),
    )


def unpivot_metrics(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide rows as (ids, metric_name, metric_value), with canonical names; null cells give no row."""
    long = rows.unpivot(ids, metrics, "column", "metric_value")
    return long.where("metric_value is not null").select(*ids, metric_from_header(F.col("column"), METRIC_ALIASES).alias("metric_name"), "metric_value")


def run_extractor(blocks: DataFrame, extractor: Callable[[pd.Series], list[list[dict]]], columns: list[str], schema: str) -> DataFrame:
    """Records by any extractor, a function from a batch of texts to a list of records each.

    ``schema`` is that of a record. A batch that fails is repeated text by text; a text that fails gives no record but a row
    whose ``error`` says why, so one bad text costs nothing else. ``columns`` of the block stay with its records.
    """
    kinds = dict(blocks.dtypes)
    names = [part.split()[0] for part in schema.split(", ")]
    full = ", ".join([f"{c} {kinds[c]}" for c in columns] + [schema, "error string"])

    def one(text: str) -> tuple[list[dict], str | None]:
        try:
            return extractor(pd.Series([text]))[0], None
        except Exception as e:  # whatever an extractor raises belongs to its text
            return [], f"{type(e).__name__}: {e}"[:300]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                made = [(records, None) for records in extractor(batch["text"])]
            except Exception:
                made = [one(t) for t in batch["text"]]
            rows = []
            for kept, (records, error) in zip(batch[columns].itertuples(index=False, name=None), made, strict=True):
                rows += [[*kept, *(r.get(n) for n in names), None] for r in records]
                if error:
                    rows.append([*kept, *(None for _ in names), error])
            yield pd.DataFrame(rows, columns=[*columns, *names, "error"])

    return blocks.select(*columns, "text").mapInPandas(work, full)


#: Failures after which a call is made again; seconds before the second try, doubled for each further one, and at most.
TRANSIENT = (TimeoutError, ConnectionError)
FIRST_PAUSE, LONGEST_PAUSE = 0.5, 8.0


def attempted(call: Callable[[str], list[dict]], text: str, retries: int, pause: float) -> tuple[list[dict], int, str | None]:
    """(records, attempts, error) of one text: transient failures are tried again after growing pauses, others are not."""
    for attempt in range(1, retries + 2):
        try:
            return call(text), attempt, None
        except Exception as e:  # whatever an extractor raises belongs to its text
            if attempt > retries or not isinstance(e, TRANSIENT):
                return [], attempt, f"{type(e).__name__}: {e}"[:300]
            time.sleep(min(pause * 2 ** (attempt - 1), LONGEST_PAUSE))
    raise AssertionError("unreachable")


def in_turn(call: Callable, items: Iterable, workers: int) -> Iterator:
    """Results of ``call`` in the order of ``items``, with so many calls at a time and no more than twice as many ahead."""
    with ThreadPoolExecutor(workers) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(call, item))
            if len(waiting) >= 2 * workers:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def call_extractor(blocks: DataFrame, call: Callable[[str], list[dict]], columns: list[str], schema: str, workers: int = 4, retries: int = 2, pause: float = FIRST_PAUSE) -> tuple[DataFrame, DataFrame]:
    """(records, dead letters) of an extractor that is called for each text, as one behind a service is.

    Records have ``columns`` of their block, ``nth`` (their place in the answer), ``attempts`` and the fields of ``schema``, in the order of their blocks within a partition;
    dead letters have ``columns``, ``attempts`` and ``error``. Each task makes ``workers`` calls at a time; together no more run than there are tasks times workers, so
    callers bound the load by the number of partitions. Null texts are not sent. Both results come from one run of the calls, written to the shared folder, so neither repeats them.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    given = blocks.where("text is not null").select(*columns, "text")
    full = T.StructType([*given.select(*columns).schema, *T._parse_datatype_string(f"nth int, attempts int, {schema}, error string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(full)
        for batch in batches:
            answers = in_turn(lambda text: attempted(call, text, retries, pause), batch.column("text").to_pylist(), workers)
            out = []
            for kept, (records, attempts, error) in zip(batch.select(columns).to_pylist(), answers, strict=True):
                out += [{**kept, **{n: r.get(n) for n in names}, "nth": i, "attempts": attempts} for i, r in enumerate(records)]
                if error:
                    out.append({**kept, "attempts": attempts, "error": error})
            yield pa.RecordBatch.from_pylist(out, kind)

    path = f"{shared_base(blocks.sparkSession).rstrip('/')}/attestor-{uuid.uuid4().hex}"
    given.mapInArrow(work, full).write.parquet(path)
    target = blocks.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(blocks.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(target)
    made = blocks.sparkSession.read.schema(full).parquet(path)
    return made.where("error is null").drop("error"), made.where("error is not null").select(*columns, "attempts", "error")
