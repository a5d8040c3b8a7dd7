"""What positions on a page tell: text lines, tables, figures and titles, by sweeps over intervals.

Words are (source_file, page, x0, top, x1, bottom, text), in points, y growing downwards; drawings and rules are boxes alike. Positions count in tenths of a
point. Rows with a null file, page, text or side take no part. A sweep works on the distinct starts of a key's intervals, of which a page has few however many
items lie on it, so no task orders all items of a large page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.common import keyed_first
from attestor.operators.planning import TITLE_CHARS, title_like
from attestor.operators.tables import drop_overlapping

UNIT = 10
BOX = ("x0", "top", "x1", "bottom")
PAGE = ["source_file", "page"]
#: In points: how much lines of text may overlap, the blank between cells of a line, and between columns; the most between rows of a table, as a share of their height.
LINE_OVERLAP, CELL_GAP, COLUMN_GAP, ROW_GAP = 2.0, 8.0, 1.0, 2.0
#: In points: how far apart rules of one table are at most, and the strips by which words meet tables.
RULE_REACH, RULE_SNAP, STRIP = 6.0, 3.0, 36.0
#: In points: drawings as near as this belong together. Then fixed values: smallest image, drawing that counts, and drawing that makes a figure; padding; least figure.
FIGURE_REACH = 12.0
LEAST_IMAGE, LEAST_DRAWING, LEAST_GRAPHIC, PAD, LEAST_FIGURE, SEVERAL = 40.0, 20.0, 60.0, 28.0, (120.0, 90.0), 3
#: Slack and gap of a caption below its figure; margin and height of the band that stands in for a figure without drawings.
CAPTION_SLACK, CAPTION_GAP, MARGIN, BAND, BAND_GAP = 6.0, 2.0, 36.0, 420.0, 4.0
#: Lines of a title differ in font size by so much at most and follow at so many line heights; it is in this upper share of the page, so much larger than the median.
FONT_TOLERANCE, LEADING, UPPER, LARGER = 0.6, 1.0, 0.65, 1.5


def _units(rows: DataFrame) -> DataFrame:
    """Sides as whole numbers of tenths of a point, left and top first; rows without all of them go."""
    unit = lambda c: F.round(F.col(c).cast("double") * UNIT).cast("long")
    sides = {"x0": F.least(unit("x0"), unit("x1")), "x1": F.greatest(unit("x0"), unit("x1")), "top": F.least(unit("top"), unit("bottom")), "bottom": F.greatest(unit("top"), unit("bottom"))}
    known = F.lit(True)
    for c in (*PAGE, *BOX):
        known = known & F.col(c).isNotNull()
    return rows.where(known).withColumns(sides)


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int, name: str) -> DataFrame:
    """Number the islands of each key's intervals, from 1: a new one begins where the next start is more than ``gap`` beyond all ends before.

    Intervals are first reduced to the furthest end of each start, with partial aggregation; only these are put in order. They are joined by sorting, as they are as
    many as the pages: what is small when compressed may be large in the driver.
    """
    profile = rows.groupBy(*keys, start).agg(F.max(end).alias("_end"))
    order = Window.partitionBy(*keys).orderBy(start)
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = profile.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    return rows.join(fresh.select(*keys, start, F.sum("_new").over(order).cast("int").alias(name)).hint("merge"), [*keys, start])


def _joined(order: list[str]) -> Column:
    """The texts of a group, in order, joined by blanks."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), " ").alias("text")


def _around(*more: Column) -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), *more]


def _bbox() -> Column:
    return F.array(*(F.col(c) / UNIT for c in BOX)).alias("bbox")


def word_cells(words: DataFrame, cell_gap: float = CELL_GAP) -> DataFrame:
    """(source_file, page, band, cell, x0, top, x1, bottom, text): words in lines, and in cells of a line that a blank parts."""
    given = _units(words.where("text is not null").select(*PAGE, *BOX, "text"))
    lines = islands(given, PAGE, "top", "bottom", -round(LINE_OVERLAP * UNIT), "band")
    placed = islands(lines, [*PAGE, "band"], "x0", "x1", round(cell_gap * UNIT), "cell")
    return placed.groupBy(*PAGE, "band", "cell").agg(*_around(_joined(["x0", "top"])))


def text_lines(words: DataFrame) -> DataFrame:
    """(source_file, page, line, x0, top, x1, bottom, text) of each line of words; sides in points."""
    cells = word_cells(words, 1e6)
    return cells.select(*PAGE, F.col("band").alias("line"), *((F.col(c) / UNIT).alias(c) for c in BOX), "text")


def _grids(cells: DataFrame, method: str) -> DataFrame:
    """Tables of (source_file, page, region, row, col, box, text) with two rows and columns or more; empty places are empty texts."""
    one = cells.groupBy(*PAGE, "region", "row", "col").agg(*_around(_joined(["band", "x0"])))
    keyed = F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col").alias("at"), "text"))).alias("_cells")
    found = one.groupBy(*PAGE, "region").agg(*_around(keyed, F.max("row").alias("_rows"), F.max("col").alias("_cols"), F.count_distinct("row").alias("_r"), F.count_distinct("col").alias("_c")))
    at = lambda r, c: F.coalesce(F.try_element_at("_cells", F.struct(r.alias("row"), c.alias("col"))), F.lit(""))
    numbers = lambda c: F.sequence(F.lit(1), F.col(c))
    grid = F.transform(numbers("_rows"), lambda r: F.transform(numbers("_cols"), lambda c: at(r, c)))
    return found.where("_r > 1 and _c > 1").select(*PAGE, "region", F.lit(method).alias("method"), _bbox(), grid.alias("grid"))


def text_tables(words: DataFrame) -> DataFrame:
    """(source_file, page, region, method, bbox, grid) of tables without rules: lines of two cells or more that follow each other.

    Lines far apart, or with a line of one cell between, part tables. A table's columns are the islands of all its cells on the x-axis.
    """
    cells = word_cells(words)
    bands = cells.groupBy(*PAGE, "band").agg(F.count("*").alias("n"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    order = Window.partitionBy(*PAGE).orderBy("band")
    height = F.col("bottom") - F.col("top")
    near = (F.lag("n").over(order) > 1) & (F.col("top") - F.lag("bottom").over(order) <= ROW_GAP * F.greatest(height, F.lag(height).over(order)))
    rows = bands.withColumn("_new", F.when((F.col("n") > 1) & F.coalesce(near, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("region", F.sum("_new").over(order).cast("int")).where("n > 1")
    within = Window.partitionBy(*PAGE, "region").orderBy("band")
    rows = rows.withColumn("row", F.row_number().over(within)).select(*PAGE, "band", "region", "row")
    held = islands(cells.join(rows.hint("merge"), [*PAGE, "band"]), [*PAGE, "region"], "x0", "x1", round(COLUMN_GAP * UNIT), "col")
    return _grids(held, "text")


def _covered(low: Column, high: Column, step: int) -> Column:
    return F.sequence(F.floor(low / step), F.floor(high / step))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of places as sorted runs that do not touch."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1] + 1]))
    return start[fresh], reach[np.concatenate([fresh[1:] - 1, [len(start) - 1]])]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + k) for each k below count[i]."""
    i = np.repeat(np.arange(len(count)), count)
    return i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


#: Rows of cells that are spread out at once.
SPREAD = 1 << 21


def _flooded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rectangles of cells (cx, cy, cx1, cy1) with ``root``: the same number within a page for those that neighbours connect. A page's rows come together, its first with 1 in ``_n``.

    Whole pages are worked on; the last page of a batch waits for the next one. Rectangles become runs of cells, a row of the grid each, which are merged as they come.
    """

    def roots(cells: pa.Table) -> pa.RecordBatch:
        n, x0, y0, x1, y1 = (cells.column(c).to_numpy() for c in ("_n", "cx", "cy", "cx1", "cy1"))
        sheet = np.cumsum(n == 1) - 1
        x0, x1, y0, y1 = x0 - x0.min() + 1, x1 - x0.min() + 1, y0 - y0.min(), y1 - y0.min()
        wide, high = int(x1.max()) + 2, int(y1.max()) + 2
        line, tall = sheet * high + y0, y1 - y0 + 1
        start = end = np.empty(0, "i8")
        for part in np.split(np.arange(len(tall)), np.flatnonzero(np.diff(np.cumsum(tall) // SPREAD)) + 1):
            of, row = _spread(line[part], tall[part])
            start, end = _merged(np.concatenate([start, row * wide + x0[part][of]]), np.concatenate([end, row * wide + x1[part][of]]))
        low, top = np.searchsorted(end, start + wide - 1), np.searchsorted(start, end + wide + 1, "right")
        a, b = _spread(low, top - low)
        root = np.arange(len(start))
        while True:
            least = np.minimum(root[a], root[b])
            new = root.copy()
            for at in (a, b, root[a], root[b]):
                np.minimum.at(new, at, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        run = np.searchsorted(start, line * wide + x0, "right") - 1
        found = root[run] - np.searchsorted(start, sheet * high * wide)
        return cells.append_column("root", pa.array(found)).combine_chunks().to_batches()[0]

    held: list[pa.Table] = []
    for batch in batches:
        if len(batch):
            table = pa.Table.from_batches([batch])
            begins = np.flatnonzero(table["_n"].to_numpy() == 1)
            if len(begins):
                whole = pa.concat_tables([*held, table.slice(0, begins[-1])])
                if len(whole):
                    yield roots(whole.combine_chunks())
                held, table = [], table.slice(begins[-1])
            held.append(table)
    if held:
        yield roots(pa.concat_tables(held).combine_chunks())


def _first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_file, page, cx, cy, root): the first cells of rectangles."""
    for rows in _flooded(batches):
        yield rows.select([*PAGE, "cx", "cy", "root"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_file, page, root, box, drawings, image): the rectangles of a root as one."""
    how = {"x0": "min", "top": "min", "x1": "max", "bottom": "max", "drawings": "sum", "image": "max"}
    for rows in _flooded(batches):
        found = pa.Table.from_batches([rows]).group_by([*PAGE, "root"], use_threads=False).aggregate(list(how.items()))
        yield from found.select([*PAGE, "root", *(f"{c}_{f}" for c, f in how.items())]).rename_columns([*PAGE, "root", *how]).to_batches()


def _paged(rows: DataFrame) -> DataFrame:
    """File and page in the types that all of a page's parts meet by."""
    return rows.withColumns({"source_file": F.col("source_file").cast("string"), "page": F.col("page").cast("long")})


def _in_cells(boxes: DataFrame, reach: float) -> DataFrame:
    """Boxes (in tenths) with the rectangle (cx, cy, cx1, cy1) of a grid as wide as ``reach`` that each covers."""
    step = max(1, round(reach * UNIT))
    cell = lambda c: F.floor(F.col(c) / step)
    return boxes.withColumns({"cx": cell("x0"), "cy": cell("top"), "cx1": cell("x1"), "cy1": cell("bottom")})


def _by_page(shapes: DataFrame) -> DataFrame:
    """Rows of a page one after the other, numbered in ``_n``. A window asks for that without a shuffle if they already are where their page is."""
    return shapes.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("cx", "cy")))


def together(boxes: DataFrame, reach: float) -> DataFrame:
    """Boxes (in tenths) with ``root``: the same number within a page for boxes that are at most ``reach`` points apart on both axes, directly or over others.

    A page's boxes cover cells of a grid as wide as ``reach``; cells that touch belong together. Boxes more than twice that apart on an axis never meet. Boxes go as the
    rectangles of cells that they cover, equal ones once; they are spread into rows of cells where a page is worked on, which its extent bounds.
    """
    at = _in_cells(boxes, reach)
    shapes = _paged(at).groupBy(*PAGE, "cx", "cy", "cx1").agg(F.max("cy1").alias("cy1"))
    flooded = _by_page(shapes).mapInArrow(_first_cells, "source_file string, page long, cx long, cy long, root long").groupBy(*PAGE, "cx", "cy").agg(F.min("root").alias("root"))
    return at.drop("cx1", "cy1").join(flooded.hint("merge"), [*PAGE, "cx", "cy"]).drop("cx", "cy")


def ruled_tables(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(source_file, page, region, method, bbox, grid) of tables whose cells are parted by rules.

    Rules that touch make a table; the places of its horizontal and vertical ones are its rows and columns. A word is in the cell of its centre.
    """
    snap = round(RULE_SNAP * UNIT)
    joined = together(_units(rules.select(*PAGE, *BOX)), RULE_REACH)
    flat = F.col("bottom") - F.col("top") <= snap
    upright = F.col("x1") - F.col("x0") <= snap

    def edges(kind: Column, at: str, name: str) -> DataFrame:
        """The places of rules, those as near as ``snap`` taken as one."""
        placed = islands(joined.where(kind), [*PAGE, "root"], at, at, snap, "_edge").groupBy(*PAGE, "root", "_edge").agg(F.min(at).alias("at"))
        return placed.groupBy(*PAGE, "root").agg(F.array_sort(F.collect_list("at")).alias(name))

    spans = joined.groupBy(*PAGE, "root").agg(*_around())
    tables = spans.join(edges(flat, "top", "ys").hint("merge"), [*PAGE, "root"]).join(edges(upright, "x0", "xs").hint("merge"), [*PAGE, "root"]).where("size(ys) > 2 and size(xs) > 2")
    strip = round(STRIP * UNIT)
    strips = tables.select(*PAGE, "root", "xs", "ys", F.explode(_covered(F.element_at("ys", 1), F.element_at("ys", -1), strip)).alias("strip"))
    given = _units(words.where("text is not null").select(*PAGE, *BOX, "text"))
    lines = islands(given, PAGE, "top", "bottom", -round(LINE_OVERLAP * UNIT), "band")
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    placed = lines.withColumns({"_x": middle("x0", "x1"), "_y": middle("top", "bottom")}).withColumn("strip", F.floor(F.col("_y") / strip))
    inside = placed.join(strips.hint("merge"), [*PAGE, "strip"])
    before = lambda edges, at: F.size(F.filter(edges, lambda e: e <= F.col(at)))
    cells = inside.withColumns({"row": before("ys", "_y"), "col": before("xs", "_x")}).where("row > 0 and col > 0 and row < size(ys) and col < size(xs)")
    return _grids(cells.withColumnRenamed("root", "region"), "lines")


def page_tables(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(source_file, page, ordinal, method, bbox, grid): the tables of each page, from rules first; one that an earlier one covers goes."""
    found = ruled_tables(words, rules).withColumn("region", F.col("region").cast("string")).unionByName(text_tables(words).withColumn("region", F.col("region").cast("string")))
    order = Window.partitionBy(*PAGE).orderBy("method", F.col("bbox")[1], F.col("bbox")[0])  # a page's tables are few: its own extent bounds them
    numbered = found.withColumn("ordinal", F.row_number().over(order)).drop("region")
    return drop_overlapping(numbered)


def figure_regions(drawings: DataFrame, captions: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_file, page, label, method, bbox, drawings): where the figure of each caption is.

    ``drawings`` has (source_file, page, box, kind: image or drawing), ``captions`` (source_file, page, box, label), ``pages`` (source_file, page, width, height).
    Drawings that lie together are one region; it goes to the nearest caption below that is over or under some of it, else to the nearest above it, else to the nearest
    below of the page. A caption's regions are united and padded, within the page and above the caption. Small ones need an image or three drawings. A caption
    without drawings has the band above it, if that is high enough.

    Every step is by file and page. Inputs that already lie by file or page stay where they are, and only the regions are shuffled; others are brought there first, equal
    drawings as one. A region's box is made of its drawings while they are with their page; a page's captions, which its lines bound, meet each region as one list.
    """
    units = lambda x: round(x * UNIT)
    size = lambda least: (F.col("x1") - F.col("x0") > units(least)) & (F.col("bottom") - F.col("top") > units(least))
    image = F.col("kind") == "image"
    boxes = _paged(_units(drawings.select(*PAGE, *BOX, "kind")).where(F.when(image, size(LEAST_IMAGE)).otherwise(size(LEAST_DRAWING))))
    solid = F.when(image, F.lit(True)).otherwise(size(LEAST_GRAPHIC))
    side = lambda pick, c: pick(F.when(solid, F.col(c))).alias(c)
    shapes = _in_cells(boxes, FIGURE_REACH).groupBy(*PAGE, "cx", "cy", "cx1").agg(
        F.max("cy1").alias("cy1"), side(F.min, "x0"), side(F.min, "top"), side(F.max, "x1"), side(F.max, "bottom"), F.count_if(~image).alias("drawings"), F.max(image).alias("image"),
    )
    regions = _by_page(shapes).mapInArrow(_regions, "source_file string, page long, root long, x0 long, top long, x1 long, bottom long, drawings long, image boolean").where("x0 is not null")
    told = _paged(_units(captions.where("label is not null").select(*PAGE, *BOX, "label")))
    strip = lambda c: F.floor(F.col(c) / units(STRIP))
    listed = told.groupBy(*PAGE).agg(F.collect_set(F.struct(F.col("top").alias("y"), "label", strip("x0").alias("low"), strip("x1").alias("high"))).alias("marks"))
    left, right = strip("x0"), strip("x1")
    under = lambda m: m["y"] >= F.col("bottom") - units(CAPTION_SLACK)
    within = lambda m, low, high: (m["low"] <= high) & (m["high"] >= low)
    first = lambda test, y: F.array_min(F.transform(F.filter("marks", test), lambda m: F.struct(y(m).alias("y"), m["label"].alias("label"))))
    down, up = (lambda m: m["y"]), (lambda m: -m["y"])
    # above a region: of captions as high the least label stands for a strip, and of these the greatest counts
    strips = F.transform(F.sequence(left, right), lambda s: first(lambda m: (m["y"] <= F.col("top")) & within(m, s, s), up))
    last = F.array_max(F.transform(strips, lambda m: F.when(m.isNotNull(), F.struct(up(m).alias("y"), m["label"].alias("label")))))
    nearest = F.coalesce(first(lambda m: under(m) & within(m, left, right), down), last, first(under, down))["label"]
    owned = regions.join(listed.hint("merge"), PAGE).select(*PAGE, nearest.alias("label"), *BOX, "drawings", "image", F.lit(None).cast("long").alias("caption"))
    alone = told.select(*PAGE, "label", *(F.lit(None).cast(kind).alias(c) for c, kind in zip([*BOX, "drawings", "image"], ["long"] * 5 + ["boolean"])), F.col("top").alias("caption"))
    marks = owned.unionByName(alone).groupBy(*PAGE, "label").agg(*_around(F.sum("drawings").alias("drawings"), F.max("image").alias("image"), F.min("caption").alias("caption"))).where("caption is not null")
    sheet = _paged(pages.select(*PAGE, F.round(F.col("width") * UNIT).cast("long").alias("w"), F.round(F.col("height") * UNIT).cast("long").alias("h")))
    rows = marks.join(sheet.hint("merge"), PAGE)
    several = F.col("image") | (F.col("drawings") >= SEVERAL)
    large = (F.col("x1") - F.col("x0") >= units(LEAST_FIGURE[0])) & (F.col("bottom") - F.col("top") >= units(LEAST_FIGURE[1]))
    pad, low = units(PAD), F.when(F.col("bottom") <= F.col("caption") + units(CAPTION_SLACK), F.col("caption") - units(CAPTION_GAP)).otherwise(F.col("h"))
    drawn = F.struct(F.greatest(F.lit(0), F.col("x0") - pad).alias("x0"), F.greatest(F.lit(0), F.col("top") - pad).alias("top"), F.least("w", F.col("x1") + pad).alias("x1"), F.least("h", low, F.col("bottom") + pad).alias("bottom"))
    band = F.struct(F.lit(units(MARGIN)).cast("long").alias("x0"), F.greatest(F.lit(units(MARGIN)), F.col("caption") - units(BAND)).alias("top"), (F.col("w") - units(MARGIN)).alias("x1"), (F.col("caption") - units(BAND_GAP)).alias("bottom"))
    found = rows.select(
        *PAGE, "label", F.coalesce("drawings", F.lit(0)).cast("long").alias("drawings"),
        F.when(F.col("x0").isNull(), band).when(several | large, drawn).alias("at"),
        F.when(F.col("x0").isNull(), "caption_fallback").when(several, "caption+graphics").otherwise("caption").alias("method"),
    )
    least = F.when(F.col("method") == "caption_fallback", F.lit(units(LEAST_FIGURE[1]))).otherwise(F.lit(units(LEAST_FIGURE[1] / 2)))
    given = [F.col(c).cast(captions.schema[c].dataType).alias(c) for c in PAGE]
    return found.where(F.col("at.bottom") - F.col("at.top") >= least).select(*given, "label", "method", F.array(*(F.col(f"at.{c}") / UNIT for c in BOX)).alias("bbox"), "drawings")


def font_titles(lines: DataFrame) -> DataFrame:
    """(source_file, title): from the metadata if that is a title, else from the font sizes of the first page's lines.

    ``lines`` has (source_file, page, metadata_title, page_height, top, bottom, x0, size, text). Lines of one size that follow closely are one candidate. Of those in
    the upper part of the page that read like a title, ones larger than the usual size come first, then larger ones, then upper ones.
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    meta = F.trim(F.regexp_replace("metadata_title", r"\s+", " "))
    told = keyed_first(lines.withColumn("_meta", F.when(title_like(F.col("metadata_title")), meta)), "source_file", F.col("_meta"), F.col("_meta"), "told")
    first = lines.where((F.col("page") == 1) & F.col("size").isNotNull() & F.col("top").isNotNull()).withColumn("text", flat).where("text <> ''")
    order = Window.partitionBy("source_file").orderBy("top", "x0", "text")
    follows = (F.abs(F.col("size") - F.lag("size").over(order)) <= FONT_TOLERANCE) & (F.col("top") - F.lag("bottom").over(order) <= LEADING * F.col("size"))
    numbered = first.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    made = numbered.groupBy("source_file", "_island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.max("size").alias("size"), F.min("top").alias("top"), F.max("page_height").alias("height"),
    )
    usual = first.groupBy("source_file").agg(F.median("size").alias("usual"))
    fits = title_like(F.col("text")) & (F.length("text") <= TITLE_CHARS[1]) & F.coalesce(F.col("top") <= UPPER * F.col("height"), F.lit(True))
    rank = F.struct((F.col("size") >= F.col("usual") + LARGER).alias("large"), "size", (-F.col("top")).alias("up"), "text")
    best = made.where(fits).join(usual, "source_file").groupBy("source_file").agg(F.max_by("text", rank).alias("found"))
    files = lines.select("source_file").distinct()
    return files.join(told, "source_file", "left").join(best, "source_file", "left").select("source_file", F.coalesce("told", "found").alias("title"))
