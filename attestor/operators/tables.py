"""Tables as they come out of documents: cells, headers, the quality gate, overlaps and repeats.

A raw table has ``grid ARRAY<ARRAY<STRING>>``; a finished one ``columns ARRAY<STRING>`` and ``rows ARRAY<MAP<STRING, STRING>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.common import first_per_key

OVERLAP = 0.7
HEADER_FILL, HEADER_CHARS, LONGEST_HEADER, MOST_EMPTY, PAGE_SHARE = 0.8, 35, 80, 0.55, 0.62
# Cells that stand for no value, and those that count as numbers when headers are told from data.
EMPTY_CELLS = ("", "-", "—", "--", "N/A", "n/a", "NA", "null", "None")
NUMBER_LIKE = ("-", "—", "--", "/", "N/A", "n/a", "NA")
NUMBER = r"^[+-]?\d+\.?\d*$"


def clean_cell(cell: Column) -> Column:
    """A cell without thousands commas if it is a number, null if it stands for nothing; whole numbers without a fraction."""
    text = F.trim(cell)
    bare = F.replace(text, F.lit(","))
    number = bare.try_cast("double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    return F.when(text.isNull() | text.isin(*EMPTY_CELLS), F.lit(None)).when(bare.rlike(NUMBER), whole).otherwise(text)


def cell_kind(cell: Column) -> Column:
    """``empty``, ``numeric`` if all words are numbers or stand for one, else ``text``."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[↑↓⇅+\-]?\s*", ""), r"\s*[↑↓⇅]?\s*$", ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    number = F.forall(words, lambda w: F.replace(w, F.lit(",")).rlike(NUMBER) | w.isin(*NUMBER_LIKE))
    return F.when(F.size(words) == 0, "empty").when(number, "numeric").otherwise("text")


def header_rows(grid: Column) -> Column:
    """How many rows are header: those before the first of the first six whose cells are half numbers; else one.

    0 where the first row already is data.
    """

    def numeric(row: Column) -> Column:
        kinds = F.transform(row, cell_kind)
        n = F.size(F.filter(kinds, lambda k: k == "numeric"))
        filled = F.size(F.filter(kinds, lambda k: k != "empty"))
        return (filled > 0) & (n * 2 >= filled)

    first = F.array_position(F.transform(F.slice(grid, 1, 6), numeric), True)
    return F.when(F.size(grid) < 2, 1).when(first > 0, (first - 1).cast("int")).otherwise(1)


def unique_names(names: Column) -> Column:
    """Empty names become ``column_n``, repeats get a number."""
    filled = F.transform(names, lambda n, i: F.when(F.coalesce(F.trim(n), F.lit("")) == "", F.concat(F.lit("column_"), i + 1)).otherwise(F.trim(n)))
    before = lambda i: F.size(F.filter(F.slice(filled, 1, i), lambda m: m == F.get(filled, i)))
    return F.transform(filled, lambda n, i: F.when(before(i) > 0, F.concat(n, F.lit("_"), before(i) + 1)).otherwise(n))


def shape(raw: DataFrame) -> DataFrame:
    """Raw grids as tables: header rows joined into unique names, cells cleaned."""
    head = raw.withColumn("_h", header_rows(F.col("grid")))
    width = F.array_max(F.transform("grid", lambda r: F.size(r)))
    names = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.when(F.col("_h") > 0, F.array_join(F.filter(F.transform(F.slice("grid", 1, F.greatest(F.col("_h"), F.lit(1))), lambda r: F.trim(F.get(r, i))), lambda x: x.isNotNull() & (x != "")), " ")).otherwise(""),
    )
    named = head.withColumn("columns", unique_names(names))
    body = F.slice("grid", F.col("_h") + 1, F.greatest(F.lit(0), F.size("grid") - F.col("_h")))
    rows = F.transform(body, lambda r: F.map_from_arrays(F.col("columns"), F.transform("columns", lambda _, i: clean_cell(F.get(r, i)))))
    return named.withColumn("rows", rows).drop("grid", "_h")


def acceptable(method: Column = None) -> Column:
    """Whether a table is one, and not a page header, a text column or a fragment.

    At least two columns and rows, two rows with two cells, no more than 55 % of cells empty, headers of at most 80
    characters. Tables found by the layout of text alone need a caption, short and filled headers, and not most of the page.
    """
    headers = F.filter(F.transform("columns", lambda c: F.trim(c)), lambda c: c != "")
    empty = lambda v: F.coalesce(F.trim(v), F.lit("")) == ""
    blanks = F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(F.filter(F.map_values(r), empty)))
    dense = F.size(F.filter("rows", lambda r: F.size(F.filter(F.map_values(r), lambda v: ~empty(v))) >= 2))
    cells = F.size("columns") * F.size("rows")
    plain = (
        (F.size("columns") >= 2) & (F.size("rows") >= 2) & (blanks <= cells * MOST_EMPTY) & (dense >= 2) & (F.size(headers) > 0) & ~F.exists("columns", lambda c: F.length(F.trim(c)) > LONGEST_HEADER)
    )
    if method is None:
        return plain
    box = F.col("bbox")
    share = (box[2] - box[0]) * (box[3] - box[1]) / (F.col("page_width") * F.col("page_height"))
    strict = (
        (F.coalesce(F.trim("caption"), F.lit("")) != "") & (F.size(headers) >= F.size("columns") * HEADER_FILL) & ~F.exists(headers, lambda c: F.length(c) > HEADER_CHARS) & ~F.coalesce(share > PAGE_SHARE, F.lit(False))
    )
    return plain & ((method != "text") | strict)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    area = lambda box: (box[2] - box[0]) * (box[3] - box[1])
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    return inter / (area(a) + area(b) - inter)


def drop_overlapping(found: DataFrame) -> DataFrame:
    """Tables of a page whose box is not covered by that of an earlier one that stays; ``found`` has (source_file, page, bbox, ordinal).

    A page's boxes are folded in order; only boxes are held, not the tables.
    """
    start = F.array().cast("array<struct<ordinal:bigint,bbox:array<double>>>")
    boxes = found.groupBy("source_file", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), F.col("bbox").alias("bbox")))).alias("all"))
    kept = F.aggregate("all", start, lambda s, x: F.when(F.exists(s, lambda y: overlap(x["bbox"], y["bbox"]) >= OVERLAP), s).otherwise(F.array_append(s, x)))
    stays = boxes.select("source_file", "page", F.explode(kept).alias("k")).select("source_file", "page", F.col("k.ordinal").alias("ordinal"))
    return found.join(stays.hint("merge"), ["source_file", "page", "ordinal"], "left_semi")


def fingerprint() -> Column:
    """The head of a table: six columns, three rows, forty characters a cell."""
    names = F.slice("columns", 1, 6)
    line = lambda r: F.array_join(F.transform(names, lambda c: F.left(F.coalesce(F.element_at(r, c), F.lit("None")), F.lit(40))), "|")
    return F.array_join(F.concat(F.array(F.array_join(names, "|")), F.transform(F.slice("rows", 1, 3), line)), "@@")


def deduplicate(found: DataFrame) -> DataFrame:
    """Tables of a file that were found twice are kept once, the first."""
    return first_per_key(found.withColumn("_f", F.sha2(fingerprint(), 256)), ["source_file", "_f"], [F.col("ordinal")]).drop("_f")


def cells(tables: DataFrame) -> DataFrame:
    """(table_id, row, column, value) of every cell that is not null."""
    rows = tables.select("table_id", F.posexplode("rows").alias("r", "row")).select("table_id", (F.col("r") + 1).alias("row"), F.explode("row").alias("column", "value"))
    return rows.where("value is not null")
