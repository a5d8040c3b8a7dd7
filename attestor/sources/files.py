"""Files of mixed kinds: tables by Spark's readers where a kind has one, the rest parsed on the executors.

A file that cannot be read gives a row with ``error``, so one bad file costs nothing else.
"""

from __future__ import annotations

import html
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestor.functions.text import basename, slices, strip_html

# File endings that are read, those that are known and left alone and why, and the encodings tried in turn.
TABLE_SUFFIXES = (".csv", ".tsv", ".dat", ".xlsx", ".xls")
TEXT_SUFFIXES = (".html", ".htm", ".txt", ".md", ".pdf")
NOT_READ = {
    ".zip": "archive", ".tar": "archive", ".gz": "archive", ".7z": "archive", ".rar": "archive", ".fits": "FITS image or table", ".parquet": "columnar data: use spark.read",
    ".json": "structured data: use spark.read", ".xml": "structured data: use spark.read",
}
ENCODINGS = ("utf-8-sig", "gb18030")
HTML_CHARS = 200_000

TABLE_SCHEMA = "source_file string, source_path string, source_type string, table_id string, columns array<string>, rows array<map<string,string>>, error string"


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(basename(path)), r"(\.[a-z0-9]+)$", 1)


def gate(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``route`` (``table``, ``text`` or ``skip``) and ``skip_reason`` by the ending of each file."""
    s = suffix(F.col(path))
    reasons = F.create_map(*(F.lit(x) for pair in NOT_READ.items() for x in pair))
    route = F.when(s.isin(*TABLE_SUFFIXES), "table").when(s.isin(*TEXT_SUFFIXES), "text").otherwise("skip")
    return files.withColumns({"route": route, "skip_reason": F.when(route == "skip", F.coalesce(F.element_at(reasons, s), F.lit("unsupported format")))})


def decode(content: bytes) -> str:
    """Text in UTF-8, with or without a mark, else in GB18030."""
    for encoding in ENCODINGS[:-1]:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode(ENCODINGS[-1])


def frames_of(path: str, content: bytes) -> list[tuple[str, str, pd.DataFrame]]:
    """(source type, name, frame) of each table of a file, all cells as text; a workbook has one for each sheet."""
    name, end = path.rsplit("/", 1)[-1].rsplit(".", 1)
    if end.lower() in ("xlsx", "xls"):
        return [("excel", str(sheet), f) for sheet, f in pd.read_excel(io.BytesIO(content), sheet_name=None, dtype=str).items()]
    kind = {"tsv": {"sep": "\t"}, "dat": {"sep": r"\s+", "comment": "#", "engine": "python"}}.get(end.lower(), {"sep": ","})
    return [("csv", name, pd.read_csv(io.StringIO(decode(content)), dtype=str, keep_default_na=True, **kind))]


def read_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All tables of CSV, TSV, DAT and Excel files: (source_file, source_path, source_type, table_id, columns, rows, error).

    Missing cells are null; an empty file gives no row. A file is read by one task, so a table that is larger than a task's memory goes through
    :func:`read_delimited` instead.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                file = path.rsplit("/", 1)[-1]
                try:
                    for kind, name, frame in frames_of(path, content):
                        columns = [str(c) for c in frame.columns]
                        rows = [{c: None if pd.isna(v) else str(v) for c, v in zip(columns, r, strict=True)} for r in frame.itertuples(index=False)]
                        made.append((file, path, kind, f"{file}:{name}", columns, rows, None))
                except Exception as e:  # whatever a parser raises belongs to its file
                    made.append((file, path, "unknown", None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(made, columns=[c.split()[0] for c in TABLE_SCHEMA.split(", ")])

    found = spark.read.format("binaryFile").load(paths)
    chosen = found.where(suffix(F.col("path")).isin(*TABLE_SUFFIXES)).select("path", "content")
    return chosen.mapInPandas(work, TABLE_SCHEMA)


def read_delimited(spark: SparkSession, paths: str | list[str], separator: str = ",", encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    """Large delimited files by Spark's own reader: splittable, with filters and column pruning pushed into the parser."""
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("mode", "PERMISSIVE").option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(paths)


def read_whitespace(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Large whitespace tables with ``#`` comments, without a header, as text columns."""
    lines = spark.read.text(paths).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, source_path, kind, text) of HTML, text and Markdown files; ``kind`` is ``html`` or ``text``."""

    @F.pandas_udf(StringType())
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda c: decode(bytes(c)))

    found = spark.read.format("binaryFile").load(paths)
    end = suffix(F.col("path"))
    chosen = found.where(end.isin(*TEXT_SUFFIXES) & (end != ".pdf"))
    return chosen.select(basename(F.col("path")).alias("source_file"), F.col("path").alias("source_path"), F.when(end.startswith(".htm"), "html").otherwise("text").alias("kind"), decoded("content").alias("text"))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All character references of HTML, by name or number."""
    return text.map(html.unescape, na_action="ignore")


def html_blocks(pages: DataFrame, html_col: str = "html", limit: int = HTML_CHARS) -> DataFrame:
    """Pages with ``text``: their text without tags, scripts and styles, references resolved, at most ``limit`` characters.

    Tags are taken out by Column functions; only texts that still have a reference other than the common ones go to Python.
    """
    bare = pages.withColumn("text", strip_html(F.col(html_col)))
    odd = F.col("text").rlike(r"&(#\d+|#x[0-9a-fA-F]+|[A-Za-z]+\d*);")
    return bare.withColumn("text", F.left(F.when(odd, unescape("text")).otherwise(F.col("text")), F.lit(limit)))


def insight_blocks(insights: DataFrame) -> DataFrame:
    """Insights as text blocks of 4500 characters: (source_file, page, chunk_id, text); pages count the chunks from 1."""
    rows = insights.where("text <> ''").select("source_id", F.explode(slices(F.col("text"))).alias("s"))
    return rows.select(F.concat("source_id", F.lit(".insight")).alias("source_file"), (F.col("s.nth") + 1).alias("page"), F.concat_ws("_", "source_id", "s.nth").alias("chunk_id"), F.col("s.text").alias("text"))


def metadata_text(row: dict[str, Column]) -> Column:
    """A source's metadata as JSON text with the keys that have a value."""
    return F.to_json(F.struct(*(F.nullif(c.cast("string"), F.lit("")).alias(n) for n, c in row.items())))


def read_pdf_pages(spark: SparkSession, paths: str | list[str], extract) -> DataFrame:
    """(source_path, page, text, error) of PDF files by ``extract``, a function from bytes to a list of page texts.

    No PDF library is part of this package; one can be passed in, or pages that were extracted elsewhere can be read as a table.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    made += [(path, i, t, None) for i, t in enumerate(extract(content), 1)]
                except Exception as e:  # whatever a parser raises belongs to its file
                    made.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(made, columns=["source_path", "page", "text", "error"])

    found = spark.read.format("binaryFile").load(paths).where(suffix(F.col("path")) == ".pdf")
    return found.select("path", "content").mapInPandas(work, "source_path string, page int, text string, error string")


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Records from a JSON export, an array or lines."""
    return spark.read.option("multiLine", True).json(path)
