"""CSV, TSV and DAT files of any size and encoding as rows, read in byte ranges that Spark plans.

Spark's text reader hands over the lines of a range as they are in the file. A first pass says for each range what it does to a quoted cell that is open where it begins, and
whether it is UTF-8 or GB18030; in order of the ranges that gives each its state, row number, header and encoding, so a second pass parses all ranges independently. Whatever
cannot be read becomes a row with ``error``.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.text import basename
from attestor.operators.clustering import set_folder
from attestor.sources.files import read_tables, suffix

GLOB = "*.{[cC][sS][vV],[tT][sS][vV],[dD][aA][tT]}"
BOOKS = "*.{[xX][lL][sS],[xX][lL][sS][xX]}"
MARK = b"\xef\xbb\xbf"
#: Cells that stand for a missing value.
MISSING = frozenset(("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))
#: What can be wrong with a file or a row.
UNDECODED, UNCLOSED, TOO_LONG = "neither UTF-8 nor GB18030", "a quoted cell is never closed", "more cells than the header"
#: Bytes of what is known of the ranges, up to which it is sent to all tasks; lines are shuffled to meet more.
SENT = 8_000_000
ROWS = "source_path string, nth long, names array<string>, cells array<string>, error string"


def _separator(path: str) -> bytes:
    return {"tsv": b"\t", "dat": b" "}.get(path.rsplit(".", 1)[-1].lower(), b",")


def stays_open(line: bytes, separator: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, if one was open (``inside``) before it or not.

    A quote opens a cell only where the cell begins; two of them within stand for one.
    """
    if b'"' not in line or separator == b" ":
        return inside and separator != b" "
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1
        elif at == 0 and line[:1] == b'"':
            inside, at = True, 1
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += 1
        if line[at : at + 1] == b'"':
            inside, at = True, at + 1


def _decodes(text: bytes, encoding: str) -> bool:
    try:
        text.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _blank(line: bytes, separator: bytes) -> bool:
    return not (line.split(b"#")[0] if separator == b" " else line).strip(b"\r\n \t" if separator == b" " else b"\r\n")


class _Range:
    """What a range of lines does, for both states in which it may begin."""

    def __init__(self, path: str, block: int) -> None:
        self.path, self.block, self.separator = path, block, _separator(path)
        self.open, self.rows = [False, True], [0, 0]
        self.utf8 = self.gb = True
        self.first: list[bytes] = []  # the lines of the file's header
        self.header_done = block > 0

    def add(self, lines: list[bytes]) -> None:
        whole = b"\n".join(lines)  # no encoding has a line feed within a character, so the lines decode if this does
        if not whole.isascii():
            self.utf8, self.gb = self.utf8 and _decodes(whole, "utf-8"), self.gb and _decodes(whole, "gb18030")
        at = 0
        while not self.header_done and at < len(lines):
            if self.first or not _blank(lines[at], self.separator):
                self.first.append(lines[at])
            self._step(lines[at])
            self.header_done = bool(self.first) and not self.open[0]
            at += 1
        if self.separator == b" " or b'"' not in whole:
            if at < len(lines):
                self._step(lines[at])  # after one line both states are as they stay
                full = sum(not _blank(line, self.separator) for line in lines[at + 1 :])
                self.rows = [n + (0 if inside else full) for n, inside in zip(self.rows, self.open, strict=True)]
            return
        for line in lines[at:] if at else lines:
            if b'"' in line:
                self._step(line)
            elif line.strip(b"\r\n"):
                self.rows[0] += not self.open[0]
                self.rows[1] += not self.open[1]

    def _step(self, line: bytes) -> None:
        before = self.open
        if not _blank(line, self.separator):
            self.rows = [n + (not inside) for n, inside in zip(self.rows, before, strict=True)]
        one = stays_open(line, self.separator, before[0])
        self.open = [one, one if before[0] == before[1] else stays_open(line, self.separator, before[1])]

    def row(self) -> tuple:
        return (self.path, self.block, *self.open, *self.rows, self.utf8, self.gb, b"\n".join(self.first) if self.block == 0 else None)


SUMMARY = "path string, block long, open0 boolean, open1 boolean, rows0 long, rows1 long, utf8 boolean, gb boolean, first binary"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """From where to where the rows of a batch are of one range."""
    if not batch.num_rows:
        return
    path, block = batch.column("path"), batch.column("block")
    other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
    ends = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    yield from zip(ends, ends[1:], strict=False)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Runs of lines of one range, in order; a range may come in several runs."""
    for batch in batches:
        for start, end in _runs(batch):
            yield (batch.column("path")[start].as_py(), batch.column("block")[start].as_py()), batch.column("line")[start:end].to_pylist()


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None

    def given(one: _Range) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 2, *[pa.int64()] * 2, pa.bool_(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one.row(), kinds, strict=True)], names=[c.split()[0] for c in SUMMARY.split(", ")])

    for (path, block), lines in _ranges(batches):
        if now is None or (now.path, now.block) != (path, block):
            if now is not None:
                yield given(now)
            now = _Range(path, block)
        now.add(lines)
    if now is not None:
        yield given(now)


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, head) of ranges that begin in a quoted cell: their lines up to the end of that record."""
    key, open_, head = None, False, []

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([b"\n".join(head)], pa.binary())], names=["path", "block", "head"])

    for at, lines in _ranges(batches):
        if at != key:
            if key is not None:
                yield given()
            key, open_, head = at, True, []
        for line in lines:
            if open_:
                head.append(line)
                open_ = stays_open(line, _separator(at[0]), True)
    if key is not None:
        yield given()


def _named(cells: list[str]) -> list[str]:
    """Header cells as column names: empty ones by their place, repeats numbered."""
    seen, out = Counter(), []
    for i, name in enumerate(cells):
        name = name or f"Unnamed: {i}"
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def cells_of(lines: list[str], separator: str) -> list[list[str]]:
    """The records of whole lines, those without a cell left out."""
    if separator == " ":
        return [c for line in lines if (c := line.split("#")[0].split())]
    return [r for r in csv.reader((line + "\n" for line in lines), delimiter=separator) if r]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with what is known of their range as rows; runs are cut where a record ends."""
    held: list[bytes] = []
    key, inside, skip, base, more, setting = None, False, False, 0, None, ("", "", "")

    def made(lines: list[bytes], last: bool) -> pa.RecordBatch:
        nonlocal base
        path, encoding, names = setting
        separator = _separator(path).decode()
        lines = [*lines, *more.split(b"\n")] if last and more and lines else lines  # the record that the next range ends
        text = b"\n".join(lines).decode(encoding).split("\n")
        found = cells_of([line.removesuffix("\r") for line in text], separator)
        width, wrong = len(names), np.zeros(len(found), bool)
        if set(map(len, found)) - {width}:
            wrong = np.array([len(cells) > width for cells in found])
            found = [[] if w else cells + [""] * (width - len(cells)) for cells, w in zip(found, wrong, strict=True)]
        flat = [None if c in MISSING else c for cells in found for c in cells]
        counts = np.where(wrong, 0, width)
        # a missing value in the place of an offset stands for a missing list
        begins = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32"), mask=np.concatenate([wrong, [False]]))
        cells = pa.ListArray.from_arrays(begins, pa.array(flat, pa.string()))
        heads = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype="int32") * width), pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(width), len(found)))))
        nth = pa.array(np.arange(base, base + len(found), dtype="int64"))
        base += len(found)
        error = pc.if_else(pa.array(wrong), pa.scalar(TOO_LONG), pa.scalar(None, pa.string()))
        return pa.RecordBatch.from_arrays([pa.repeat(path, len(found)), nth, heads, cells, error], names=[c.split()[0] for c in ROWS.split(", ")])

    for batch in batches:
        for start, end in _runs(batch):
            at = (batch.column("path")[start].as_py(), batch.column("block")[start].as_py())
            lines = batch.column("line")[start:end].to_pylist()
            separator = _separator(at[0])
            if at != key:
                if held:
                    yield made(held, True)
                one, held, key = batch.slice(start, 1).to_pylist()[0], [], at
                inside = skip = one["inside"]
                base, more = one["base"], one["more"]
                first = one["first"].removeprefix(MARK).decode(one["encoding"]).replace("\r", "")
                setting = (one["path"], one["encoding"], _named((cells_of(first.split("\n"), separator.decode()) or [[]])[0]))
                if at[1] == 0 and lines[0].startswith(MARK):
                    lines[0] = lines[0][len(MARK) :]
            from_ = 0
            while skip and from_ < len(lines):  # the rest of a record of the range before
                skip = inside = stays_open(lines[from_], separator, inside)
                from_ += 1
            whole = len(held) if not inside else 0
            for i, line in enumerate(lines[from_:], len(held) + 1):
                if inside or b'"' in line:
                    inside = stays_open(line, separator, inside)
                if not inside:
                    whole = i
            held += lines[from_:]
            if whole:
                yield made(held[:whole], False)
                held = held[whole:]
    if held:
        yield made(held, True)


def read_ranges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, source_path, row, values, error): the rows of all CSV, TSV and DAT files, numbered from 1 within their file.

    The first line with a cell is the header; ``values`` maps its names to cells, missing ones null. Quoted cells may go over lines, in CSV and TSV; DAT cells are parted
    by blanks, and ``#`` begins a comment. A file that is neither UTF-8 (with or without a mark) nor GB18030, or whose last quoted cell never ends, gives one row with
    ``error`` and no others; a row with more cells than the header gives its number and ``error``. Empty files give no rows.

    The first pass runs when this is called; what it leaves is a row a range. Up to ``SENT`` bytes of that go to all tasks, so that lines are not shuffled; beyond, they are.
    """
    given = spark.read.option("lineSep", "\n").option("pathGlobFilter", GLOB).option("recursiveFileLookup", True).text(paths)
    lines = given.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    ranges = lines.mapInArrow(_summarised, SUMMARY)
    # states pass along a file's ranges: one that ends alike whatever its start sets the state, one that only swaps the two turns it over
    order = Window.partitionBy("path").orderBy("block")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = (F.col("open0") & ~F.col("open1")).cast("int")
    counted = ranges.withColumn("turns", F.sum(turns).over(order))
    sets = F.last(F.when(F.col("open0") == F.col("open1"), F.struct("open0", "turns")), ignorenulls=True).over(before)
    placed = counted.withColumns({"set": sets, "turned": F.coalesce(F.lag("turns").over(order), F.lit(0))})
    odd = (F.col("turned") - F.coalesce("set.turns", F.lit(0))) % 2 == 1
    placed = placed.withColumn("inside", F.coalesce("set.open0", F.lit(False)) != odd)
    ends = F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0"))
    rows = F.when(F.col("inside"), F.col("rows1")).otherwise(F.col("rows0"))
    begins = F.when(~F.col("inside") | ~F.col("open1") | (F.col("rows1") > 0), F.col("block"))  # a range within one cell has no record of its own
    placed = placed.withColumns({
        "base": F.coalesce(F.sum(rows).over(before), F.lit(0)), "owner": F.last(begins, ignorenulls=True).over(before),
        "encoding": F.when(F.min("utf8").over(whole), "utf-8").when(F.min("gb").over(whole), "gb18030"),
        "first": F.first("first", ignorenulls=True).over(whole), "ends": F.last(ends).over(whole),
    }).select("path", "block", "inside", "base", "owner", "encoding", "first", "ends")
    set_folder(spark)
    placed = placed.checkpoint()  # a row a range
    wrong = F.when(F.col("encoding").isNull(), UNDECODED).when(F.col("ends"), UNCLOSED)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    broken = placed.where(wrong.isNotNull() & (F.col("block") == 0)).select(F.col("path").alias("source_path"), none("long", "nth"), none("array<string>", "names"), none("array<string>", "cells"), wrong.alias("error"))
    sound = placed.where(wrong.isNull())
    split = sound.where("inside").select("path", "block", "owner")
    heads = lines.join(split.drop("owner"), ["path", "block"], "left_semi").mapInArrow(_headed, "path string, block long, head binary") if split.limit(1).count() else None
    known = sound.select("path", "block", "inside", "base", "encoding", "first")
    if heads is None:
        known = known.withColumn("more", none("binary", "more"))
    else:
        rests = heads.join(split, ["path", "block"]).groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "head"))).alias("h"))
        joined = F.aggregate("h", none("binary", "s"), lambda s, x: F.when(s.isNull(), x["head"]).otherwise(F.concat(s, F.lit(b"\n"), x["head"])))
        known = known.join(rests.select("path", F.col("owner").alias("block"), joined.alias("more")), ["path", "block"], "left")
    known = known.checkpoint()
    weight = known.agg(F.sum(F.length("path") + F.length("first") + F.coalesce(F.length("more"), F.lit(0)) + 64)).first()[0] or 0
    if weight <= SENT:  # so lines stay in the order in which they are read
        told = lines.join(F.broadcast(known), ["path", "block"])
    else:  # ranges come from a shuffle; their lines are in one partition, in order
        told = lines.withColumn("seq", F.monotonically_increasing_id()).join(known, ["path", "block"]).sortWithinPartitions("path", "block", "seq").drop("seq")
    parsed = told.mapInArrow(_parsed, ROWS)
    values = F.when(F.col("cells").isNotNull(), F.map_from_arrays("names", "cells"))
    # the header is row 0
    rows = parsed.where("nth > 0").unionByName(broken)
    return rows.select(basename(F.col("source_path")).alias("source_file"), "source_path", F.col("nth").alias("row"), values.alias("values"), "error")


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, source_path, table, row, values, error): :func:`read_ranges`, and the rows of each sheet of the workbooks among the files, a workbook by one task."""
    flat = read_ranges(spark, paths).withColumn("table", F.lit(None).cast("string"))
    books = read_tables(spark, paths).where(suffix(F.col("source_path")).isin(".xls", ".xlsx"))
    sheets = books.select("source_file", "source_path", F.col("table_id").alias("table"), F.posexplode_outer("rows").alias("_p", "values"), "error").withColumn("row", (F.col("_p") + 1).cast("long")).drop("_p")
    return flat.select("source_file", "source_path", "table", "row", "values", "error").unionByName(sheets)
