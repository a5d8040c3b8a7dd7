"""Tables, figures and titles from positions on pages, laid out from rows whose place is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import layout
from attestor.queries.base import query, table

#: Points a character is wide, and a blank; left edges of columns.
CHAR, BLANK, LEFT = 5.0, 4.0, (50.0, 200.0, 300.0, 420.0)


def _words(rows: DataFrame, keys: list[str], text: Column, x: Column, top: Column, height: float = 9.0) -> DataFrame:
    """The words of a text set from ``x`` on in one line."""
    split = F.split(text, " ")
    before = lambda i: F.aggregate(F.slice(split, 1, i), F.lit(0.0), lambda s, w: s + F.length(w) * CHAR + BLANK)
    made = F.transform(split, lambda w, i: F.struct((x + before(i)).alias("x0"), (x + before(i) + F.length(w) * CHAR).alias("x1"), w.alias("text")))
    return rows.select(*keys, top.alias("top"), (top + height).alias("bottom"), F.explode(made).alias("w")).select(*keys, "w.x0", "top", "w.x1", "bottom", "w.text")


def _sheets(spark: SparkSession, d: str) -> tuple[DataFrame, list[Column]]:
    """Parts on pages of twelve: six rows without rules, then six with; and the cells of a row."""
    key = F.col("p_partkey")
    parts = table(spark, d, "part").withColumns({"source_file": F.concat(F.lit("f"), F.floor(key / 120), F.lit(".pdf")), "page": F.floor(key % 120 / 12).cast("int") + 1, "r": (key % 12).cast("int")})
    return parts, [F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")]


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of both tables with baselines that drift, and a line of text between them."""
    parts, cells = _sheets(spark, d)
    drift = F.pmod(F.xxhash64("p_partkey", "p_name"), F.lit(3)) * 0.5
    place = F.when(F.col("r") < 6, 100.0 + 14.0 * F.col("r")).otherwise(300.0 + 20.0 * (F.col("r") - 6) + 5.0)
    keys, out = ["source_file", "page"], None
    for i, cell in enumerate(cells):
        made = _words(parts, keys, cell, F.lit(LEFT[i]), place + drift)
        out = made if out is None else out.unionByName(made)
    between = _words(parts.where("r = 0"), keys, F.concat_ws(" ", F.lit("the following parts are made of"), "p_type"), F.lit(50.0), F.lit(240.0))
    return out.unionByName(between)


def page_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules around each cell of the lower table, with ends that do not quite meet."""
    parts, _ = _sheets(spark, d)
    low = parts.where("r >= 6").withColumn("y", 300.0 + 20.0 * (F.col("r") - 6))
    across = low.select("source_file", "page", F.lit(46.0).alias("x0"), F.explode(F.array(F.col("y"), F.col("y") + 19.5)).alias("top"), F.lit(500.0).alias("x1")).withColumn("bottom", F.col("top") + 0.4)
    edges = [x - 4.0 for x in LEFT] + [500.0]
    down = low.select("source_file", "page", F.explode(F.array(*map(F.lit, edges))).alias("x0"), (F.col("y") + 1.0).alias("top"), (F.col("y") + 19.0).alias("bottom")).withColumn("x1", F.col("x0") + 0.5)
    return across.unionByName(down)


_CELLS = """WITH t AS (SELECT *, 'f' || (p_partkey // 120) || '.pdf' AS source_file, CAST(p_partkey % 120 // 12 + 1 AS INTEGER) AS page, p_partkey % 12 AS r FROM part),
k AS (SELECT *, CASE WHEN r < 6 THEN 'text' ELSE 'lines' END AS method, row_number() OVER (PARTITION BY source_file, page, r < 6 ORDER BY r) AS row, count(*) OVER (PARTITION BY source_file, page, r < 6) AS n FROM t)
SELECT source_file, page, method, CAST(row AS INTEGER) AS row, col, [p_name, p_brand, p_type, CAST(p_size AS VARCHAR)][col] AS text FROM k, (SELECT unnest([1, 2, 3, 4]) AS col) WHERE n > 1"""


@query(_CELLS)
def tables_from_words(spark: SparkSession, d: str) -> DataFrame:
    """The cells of tables found on laid-out pages of parts: half of them ruled, half by their columns alone."""
    found = layout.page_tables(page_words(spark, d), page_rules(spark, d))
    rows = found.select("source_file", "page", "method", F.posexplode("grid").alias("r", "cells"))
    return rows.select("source_file", "page", "method", (F.col("r") + 1).alias("row"), F.posexplode("cells").alias("c", "text")).select("source_file", "page", "method", "row", (F.col("c") + 1).alias("col"), "text")


@query("""
SELECT 'f' || (p_partkey // 120) || '.pdf' AS source_file, CAST(p_partkey % 120 // 12 + 1 AS INTEGER) AS page, count(*) + 1 AS lines, min(CASE WHEN p_partkey % 12 = 0 THEN 'the following parts are made of ' || p_type END) AS between
FROM part GROUP BY 1, 2
""")
def lines_from_words(spark: SparkSession, d: str) -> DataFrame:
    """Text lines of the same pages: how many, and the one between the tables."""
    lines = layout.text_lines(page_words(spark, d))
    return lines.groupBy("source_file", "page").agg(F.count("*").alias("lines"), F.max(F.when(F.col("text").startswith("the following"), F.col("text"))).alias("between"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber >= 4 AS right_side, 60.0 + (l_linenumber - 1) % 3 * 70 + CASE WHEN l_linenumber >= 4 THEN 240 ELSE 0 END AS x0, 300.0 - 2 * l_quantity AS top, CASE WHEN l_returnflag = 'N' THEN 'image' ELSE 'drawing' END AS kind, l_quantity FROM (SELECT DISTINCT l_orderkey, l_linenumber, first_value(l_quantity) OVER w AS l_quantity, first_value(l_returnflag) OVER w AS l_returnflag FROM lineitem WHERE l_linenumber <= 6 WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_returnflag, l_partkey))),
g AS (SELECT *, x0 + 66 AS x1, 310.0 AS bottom, kind = 'image' AS image FROM b),
f AS (SELECT *, 2 * l_quantity + 10 AS h FROM g WHERE (image AND 2 * l_quantity + 10 > 40) OR (NOT image AND 2 * l_quantity + 10 > 20)),
u AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY l_orderkey, right_side ORDER BY x0) AS gap FROM f),
r0 AS (SELECT *, sum(CASE WHEN gap <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey, right_side ORDER BY x0) AS island FROM u),
r AS (SELECT l_orderkey, right_side, island, min(x0) FILTER (image OR h > 60) AS x0, min(top) FILTER (image OR h > 60) AS top, max(x1) FILTER (image OR h > 60) AS x1, count(*) FILTER (NOT image) AS drawings, bool_or(image) AS image FROM r0 GROUP BY ALL HAVING min(x0) FILTER (image OR h > 60) IS NOT NULL),
c AS (SELECT l_orderkey, right_side, min(x0) AS x0, min(top) AS top, max(x1) AS x1, sum(drawings) AS drawings, bool_or(image) AS image FROM r GROUP BY ALL),
o AS (SELECT DISTINCT l_orderkey, s AS right_side FROM lineitem, (SELECT unnest([true, false]) AS s) WHERE l_linenumber <= 6),
j AS (SELECT o.*, x0, top, x1, coalesce(drawings, 0) AS drawings, coalesce(image, false) OR coalesce(drawings, 0) >= 3 AS several FROM o LEFT JOIN c USING (l_orderkey, right_side)),
m AS (SELECT *, CASE WHEN x0 IS NULL THEN 'caption_fallback' WHEN several THEN 'caption+graphics' ELSE 'caption' END AS method FROM j WHERE x0 IS NULL OR several OR (x1 - x0 >= 120 AND 310 - top >= 90))
SELECT CAST(l_orderkey AS VARCHAR) AS source_file, CASE WHEN right_side THEN 'Figure 2' ELSE 'Figure 1' END AS label, method, CAST(drawings AS BIGINT) AS drawings,
  CASE WHEN x0 IS NULL THEN 36.0 ELSE greatest(0, x0 - 28) END AS x0, CASE WHEN x0 IS NULL THEN 36.0 ELSE greatest(0, top - 28) END AS y0, CASE WHEN x0 IS NULL THEN 564.0 ELSE least(600, x1 + 28) END AS x1, CASE WHEN x0 IS NULL THEN 316.0 ELSE 318.0 END AS y1 FROM m
""")
def figures_from_drawings(spark: SparkSession, d: str) -> DataFrame:
    """Figure regions of orders: a drawing or image for each of six lines, as tall as its quantity, in two groups, with two captions below."""
    # lines are brought to their order once, by the name that its page has: all that follows goes by that
    lines = table(spark, d, "lineitem").where("l_linenumber <= 6 and l_orderkey is not null").withColumn("source_file", F.col("l_orderkey").cast("string"))
    first = F.min(F.struct("l_quantity", "l_returnflag")).alias("first")
    firsts = lines.select("source_file", "l_linenumber", "l_quantity", "l_returnflag").repartition("source_file").groupBy("source_file", "l_linenumber").agg(first).select("source_file", "l_linenumber", "first.*")
    right = F.col("l_linenumber") >= 4
    x0 = 60.0 + (F.col("l_linenumber") - 1) % 3 * 70 + F.when(right, 240.0).otherwise(0.0)
    named = firsts.select("source_file", F.lit(1).alias("page"), x0.alias("x0"), (300.0 - 2 * F.col("l_quantity")).alias("top"), F.when(F.col("l_returnflag") == "N", "image").otherwise("drawing").alias("kind"))
    drawings = named.withColumns({"x1": F.col("x0") + 66.0, "bottom": F.lit(310.0)})
    sheets = lines.select("source_file").distinct().withColumn("page", F.lit(1))
    captions = sheets.select("source_file", "page", F.explode(F.array(*(F.struct(F.lit(x).alias("x0"), F.lit(x + 180.0).alias("x1"), F.lit(label).alias("label")) for x, label in ((70.0, "Figure 1"), (310.0, "Figure 2"))))).alias("c"))
    captions = captions.select("source_file", "page", "c.*", F.lit(320.0).alias("top"), F.lit(330.0).alias("bottom"))
    found = layout.figure_regions(drawings, captions, sheets.withColumns({"width": F.lit(600.0), "height": F.lit(800.0)}))
    return found.select("source_file", "label", "method", "drawings", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@query("""
WITH l AS (SELECT p_partkey // 8 AS f, p_partkey % 8 AS n, CASE WHEN p_partkey % 8 < 2 OR p_partkey % 8 = 6 THEN 16 ELSE 10 END AS size, p_name || ' study' AS text FROM part),
g AS (SELECT *, CASE WHEN size = lag(size) OVER w AND n <> 6 AND n <> 7 THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY f ORDER BY n)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY f ORDER BY n) AS island FROM g),
m AS (SELECT f, island, string_agg(text, ' ' ORDER BY n) AS text, max(size) AS size, min(n) AS n FROM i GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY size DESC, n) AS nth FROM m WHERE n < 7)
SELECT 'f' || f AS source_file, CASE WHEN f % 3 = 0 THEN 'A measured account number ' || f ELSE text END AS title FROM r WHERE nth = 1
""")
def titles_from_fonts(spark: SparkSession, d: str) -> DataFrame:
    """Titles of documents of eight lines: two large ones on top, a small block, one more large line, one at the foot; a third have a title in the metadata."""
    key = F.col("p_partkey")
    n, f = key % 8, F.floor(key / 8)
    size = F.when((n < 2) | (n == 6), 16.0).otherwise(10.0)
    top = F.when(n < 2, 60.0 + 20.0 * n).when(n < 6, 130.0 + 14.0 * n).when(n == 6, 300.0).otherwise(780.0)
    lines = table(spark, d, "part").select(
        F.concat(F.lit("f"), f).alias("source_file"), F.lit(1).alias("page"), F.when(f % 3 == 0, F.concat(F.lit("A measured  account number "), f)).otherwise("untitled").alias("metadata_title"), F.lit(800.0).alias("page_height"),
        top.alias("top"), (top + size).alias("bottom"), F.lit(50.0).alias("x0"), (size + F.when(n == 1, 0.4).otherwise(0.0)).alias("size"), F.concat("p_name", F.lit(" study")).alias("text"),
    )
    return layout.font_titles(lines)
