"""Chart readings: repair, validation against their axes, and the choice between two readings.

A chart has ``figure_id, chart_type, contains_data, confidence, x_axis`` and ``y_axis`` (STRUCT<unit, scale, range_min,
range_max>), ``series`` (ARRAY<STRUCT<name, points ARRAY<ARRAY<DOUBLE>>>>) and the figure's ``caption``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points may lie beyond an axis by this share of its range; more than the second share of them beyond it is an error.
MARGIN, MOST_BEYOND = 0.08, 0.2
LOW_CONFIDENCE = 0.45
#: Two readings of a value agree within this share.
AGREE = 0.1
POINTS_A_SERIES = 40
SCALES = ("linear", "log", "unknown")

# Units that a caption may name, and the families that an axis must agree with.
CAPTION_UNITS = (
    r"(?i)\b(nm|um|µm|angstrom|å|hz|khz|mhz|ghz|kev|mev|gev|mjy|jy|mag|days?|hours?|sec(?:onds?)?|"
    r"m/s|km/s|k|mk|pc|kpc|mpc|msun|lsun|kg|g|cm|mm|m)\b"
)
UNIT_FAMILIES = (("nm", "um", "µm", "angstrom", "å"), ("day", "days", "hour", "hours", "sec", "second", "seconds"))


def repair(charts: DataFrame, most: int = POINTS_A_SERIES) -> DataFrame:
    """Keep points of two finite numbers, the first ``most`` of a series, and known scales."""
    good = lambda p: (F.size(p) == 2) & ~F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    series = F.transform("series", lambda s: F.struct(s["name"].alias("name"), F.slice(F.filter(s["points"], good), 1, most).alias("points")))
    fixed = charts.withColumn("series", series)
    for axis in ("x_axis", "y_axis"):
        fixed = fixed.withColumn(axis, F.col(axis).withField("scale", F.when(F.lower(F.col(axis)["scale"]).isin(*SCALES), F.lower(F.col(axis)["scale"])).otherwise("unknown")))
    return fixed


def long_points(charts: DataFrame) -> DataFrame:
    """(figure_id, series, series_name, point, x, y): a row for each point; all numbers count from 1."""
    rows = charts.select("figure_id", F.posexplode("series").alias("s", "v")).select("figure_id", (F.col("s") + 1).alias("series"), F.col("v.name").alias("series_name"), F.posexplode("v.points").alias("p", "xy"))
    return rows.select("figure_id", "series", "series_name", (F.col("p") + 1).alias("point"), F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))


def point_count() -> Column:
    return F.aggregate("series", F.lit(0), lambda n, s: n + F.size(s["points"]))


def index(charts: DataFrame) -> DataFrame:
    return charts.select("figure_id", F.size("series").alias("series_count"), point_count().alias("point_count"))


def within_axis(value: Column, axis: Column) -> Column:
    """Whether a value is within an axis's range and margin; any value is where the range is not known."""
    span = F.abs(axis["range_max"] - axis["range_min"])
    margin = F.when(span == 0, 1.0).otherwise(span) * MARGIN
    low, high = F.least(axis["range_min"], axis["range_max"]), F.greatest(axis["range_min"], axis["range_max"])
    return axis["range_min"].isNull() | axis["range_max"].isNull() | value.between(low - margin, high + margin)


def axis_unit(unit: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(unit)), F.lit("μ"), F.lit("µ")), "s+$", "")


def _unit_suspect() -> Column:
    named = F.array_distinct(F.transform(F.regexp_extract_all("caption", F.lit(CAPTION_UNITS), F.lit(1)), lambda u: F.lower(u)))
    axes = F.filter(F.array(axis_unit(F.col("x_axis.unit")), axis_unit(F.col("y_axis.unit"))), lambda u: u.isNotNull() & (u != ""))
    tests = [F.arrays_overlap(named, F.array(*map(F.lit, family))) & ~F.arrays_overlap(axes, F.array(*map(F.lit, family))) for family in UNIT_FAMILIES]
    return F.coalesce((F.size(axes) > 0) & (tests[0] | tests[1]), F.lit(False))


def validate(charts: DataFrame) -> DataFrame:
    """Add ``issues`` (severity, code), ``errors``, ``warned``, ``passed`` and ``needs_review``."""
    points = F.flatten(F.transform("series", lambda s: s["points"]))
    beyond = F.size(F.filter(points, lambda p: ~within_axis(F.get(p, F.lit(0)), F.col("x_axis")) | ~within_axis(F.get(p, F.lit(1)), F.col("y_axis"))))
    total, has_series = F.size(points), F.size("series") > 0
    far = (total > 0) & (beyond / F.greatest(total, F.lit(1)) > MOST_BEYOND)
    unread = lambda axis: F.col(axis)["range_min"].isNull() | F.col(axis)["range_max"].isNull()
    told = [
        (~has_series, "error", "no_series"),
        (unread("x_axis"), "warning", "axis_range_missing"),
        (unread("y_axis"), "warning", "axis_range_missing"),
        (has_series & (total == 0), "error", "no_points"),
        (far, "error", "axis_range_mismatch"),
        (~far & (beyond > 0), "warning", "points_near_axis_edge"),
        (_unit_suspect(), "warning", "unit_suspect"),
        (F.col("confidence") < LOW_CONFIDENCE, "warning", "low_confidence"),
    ]
    issues = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for test, s, c in told)))
    checked = charts.withColumn("issues", issues)
    count = lambda severity: F.size(F.filter("issues", lambda i: i["severity"] == severity))
    checked = checked.withColumns({"errors": count("error"), "warned": count("warning")})
    return checked.withColumns({"passed": F.col("errors") == 0, "needs_review": (F.col("errors") > 0) | (F.col("warned") >= 2) | (F.col("confidence") < LOW_CONFIDENCE)})


def _material_conflict() -> Column:
    """The two readings differ in type, axes, number of series or points, names, or by more than a tenth in a value."""

    def known(column: str, nothing: str) -> Column:
        a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
        return F.coalesce((a != b) & (a != nothing) & (b != nothing), F.lit(False))

    unit = lambda axis: F.coalesce((axis_unit(F.col(f"a.{axis}.unit")) != axis_unit(F.col(f"b.{axis}.unit"))) & (F.col(f"a.{axis}.unit") != "") & (F.col(f"b.{axis}.unit") != ""), F.lit(False))
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(1.0), F.abs(x), F.abs(y)) * AGREE
    apart = F.exists(
        F.arrays_zip(F.col("a.series").alias("l"), F.col("b.series").alias("r")),
        lambda s: F.coalesce((s["l"]["name"] != s["r"]["name"]) & (s["l"]["name"] != "") & (s["r"]["name"] != ""), F.lit(False))
        | F.exists(F.zip_with(s["l"]["points"], s["r"]["points"], lambda p, q: F.exists(F.zip_with(p, q, lambda x, y: F.coalesce(~near(x, y), F.lit(False))), lambda d: d)), lambda d: F.coalesce(d, F.lit(False))),
    )
    sizes = (F.size("a.series") != F.size("b.series")) | (F.col("a.n") != F.col("b.n"))
    return known("chart_type", "unknown") | unit("x_axis") | unit("y_axis") | known("x_axis.scale", "unknown") | known("y_axis.scale", "unknown") | sizes | F.coalesce(apart, F.lit(False))


def arbitrate(first: DataFrame, second: DataFrame) -> DataFrame:
    """(figure_id, decision, selected, needs_review) for two validated readings of each figure.

    The second is taken only if it has fewer errors, or as many errors and fewer warnings, and has lost nothing that
    the first had. Readings of equal quality that differ go to manual review; else the first stays.
    """
    a = first.withColumn("n", point_count()).alias("a")
    b = second.withColumn("n", point_count()).alias("b")
    lost = lambda axis: (F.col(f"a.{axis}.range_min").isNotNull() | F.col(f"a.{axis}.range_max").isNotNull()) & (F.col(f"b.{axis}.range_min").isNull() | F.col(f"b.{axis}.range_max").isNull())
    worse = (
        (F.col("a.contains_data") & ~F.col("b.contains_data")) | ((F.size("a.series") > 0) & (F.size("b.series") == 0)) | ((F.col("a.n") > 0) & (F.col("b.n") == 0)) | lost("x_axis") | lost("y_axis")
    )
    better = (F.col("b.errors") < F.col("a.errors")) | ((F.col("b.errors") == F.col("a.errors")) & (F.col("b.warned") < F.col("a.warned")))
    decision = F.when(worse, "manual_review").when(better, "accepted_second").when(_material_conflict(), "manual_review").otherwise("kept_first")
    met = a.join(b, F.col("a.figure_id") == F.col("b.figure_id")).select(F.col("a.figure_id").alias("figure_id"), decision.alias("decision"), F.col("a.needs_review").alias("_a"), F.col("b.needs_review").alias("_b"))
    second_chosen = F.col("decision") == "accepted_second"
    return met.select(
        "figure_id", "decision", F.when(second_chosen, "second").otherwise("first").alias("selected"), ((F.col("decision") == "manual_review") | F.when(second_chosen, F.col("_b")).otherwise(F.col("_a"))).alias("needs_review")
    )
