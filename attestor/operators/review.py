"""The review queue, and the sample of records that is checked first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import stable_id

PRIORITIES = ("high", "medium", "low")
QUEUE = ["review_id", "subject_type", "subject_id", "priority", "risk_type", "reason"]
#: Records that are checked first, and the most that may be asked for.
SAMPLE, MOST = 12, 100
#: What a flagged record is told that brings no reason of its own.
FLAGGED = "A check flagged the record."


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def items(rows: DataFrame, subject_type: str, subject_id: Column, risk_type: str, priority: Column, reason: Column, fallback: str) -> DataFrame:
    """Queue rows for one kind of finding; an empty reason becomes ``fallback``."""
    review_id = stable_id("review", F.lit(subject_type), subject_id, F.lit(risk_type))
    told = F.coalesce(F.nullif(reason, F.lit("")), F.lit(fallback))
    return rows.select(review_id.alias("review_id"), F.lit(subject_type).alias("subject_type"), subject_id.cast("string").alias("subject_id"), priority.alias("priority"), F.lit(risk_type).alias("risk_type"), told.alias("reason"))


def queue(records: DataFrame, charts: DataFrame, checks: DataFrame, conflicts: DataFrame, gaps: DataFrame) -> DataFrame:
    """All findings that need a person, each once: flagged records, charts, partial checks, conflicts and gaps.

    ``records`` has (record_id, confidence, warnings), ``charts`` (figure_id, errors, needs_review, reason), ``checks``
    (check_id, status, issue), ``conflicts`` (conflict_id, message) and ``gaps`` (gap_id, priority, name).
    """
    reasons = F.array_join(F.array_distinct(F.filter(F.transform("warnings", lambda w: F.trim(w)), lambda w: w != "")), " | ")
    parts = [
        items(records, "record", F.col("record_id"), "record_quality", F.when(F.col("confidence") < 0.5, "high").otherwise("medium"), reasons, FLAGGED),
        items(charts.where("needs_review"), "figure", F.col("figure_id"), "chart_validation", F.when(F.col("errors") > 0, "high").otherwise("medium"), F.col("reason"), "The chart's reading is doubtful."),
        items(checks.where("status = 'partial'"), "cross_modal", F.col("check_id"), "cross_modal_partial", F.lit("medium"), F.col("issue"), "Text, table and figure agree in part only."),
        items(conflicts, "conflict", F.col("conflict_id"), "source_conflict", F.lit("high"), F.col("message"), "Sources disagree."),
        items(gaps, "coverage_gap", F.col("gap_id"), "coverage_gap", F.col("priority"), F.col("name"), "Evidence is missing."),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["review_id"])


def ordered(queued: DataFrame) -> DataFrame:
    """By priority, then kind, then subject: a range partitioned sort."""
    return queued.orderBy(priority_rank(F.col("priority")), "subject_type", "subject_id")


def validation_sample(records: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The ``n`` records (100 at most) of highest risk, ties in order: a top-k, no global sort.

    Risk adds 4 for warnings, 3 without evidence, 2 for a PDF record without a page, 2 for a confidence below 0.75 and 1
    without a value.
    """
    risk = (
        (F.size("warnings") > 0).cast("int") * 4
        + (F.coalesce("evidence_text", F.lit("")) == "").cast("int") * 3
        + (F.col("page").isNull() & F.startswith("source_type", F.lit("pdf"))).cast("int") * 2
        + (F.col("confidence") < 0.75).cast("int") * 2
        + F.col("metric_value").isNull().cast("int")
    )
    return records.withColumn("risk", risk).orderBy(F.desc("risk"), "ordinal").limit(max(0, min(n, MOST)))
