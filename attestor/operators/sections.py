"""Sections, headings and the order in which blocks are read.

Text blocks have ``source_file, page, text, ordinal``; headings and section plans add where a section begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import compact_lines, pack_lines, slices, squash, squeeze
from attestor.operators.common import first_per_key

HEADING_SCORE, HEADINGS_A_FILE = 3.0, 80
ROWS_A_REQUEST, TEXT_A_REQUEST = 80, 3200

# Words that make a block worth reading, and what its section adds.
READ_WORDS = (
    "table", "dataset", "benchmark", "experiment", "evaluation", "results", "metric", "fid", "lpips", "ssim", "kid", "fps", "user study",
    "ablation", "method", "architecture",
)
SECTION_BOOST = {"abstract": 6, "method": 18, "implementation": 16, "experiments": 18, "results": 20, "ablation": 16, "data": 14, "discussion": 6}
# Words of headings, and section types by words of the title, the first that fits.
HEADING_NAMES = ("abstract", "introduction", "references", "acknowledgements", "acknowledgments")
HEADING_WORDS = ("method", "approach", "experiment", "result", "evaluation", "discussion", "conclusion", "appendix")
SECTION_WORDS = (
    ("introduction", "intro"),
    ("related_work", "related|background"),
    ("method", "method|approach|framework|architecture|model"),
    ("data", "data|dataset|observation|cohort|sample"),
    ("experiments", "experiment|implementation|setup|training"),
    ("results", "result|evaluation|performance|comparison"),
    ("ablation", "ablation"),
    ("discussion", "discussion"),
    ("limitations", "limitation"),
    ("conclusion", "conclusion"),
    ("references", "reference"),
    ("appendix", "appendix|supplement"),
)


def block_score(text: Column, page: Column, section_type: Column) -> Column:
    """How much a block is worth reading: 10 for each word of the list, up to 20 numbers, 5 for an early page, its section's boost."""
    lower = F.lower(text)
    words = sum((F.contains(lower, F.lit(w)).cast("int") * 10 for w in READ_WORDS), F.lit(0))
    numbers = F.least(F.regexp_count(lower, F.lit(r"\d+(?:\.\d+)?")), F.lit(20))
    boost = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in SECTION_BOOST.items() for x in p)), F.lower(section_type)), F.lit(0))
    return words + numbers + F.when(page <= 2, 5).otherwise(0) + boost


def best_blocks(blocks: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` blocks that are most worth reading, ties in order: a top-k before anything costly; all without ``n``."""
    section = F.col("section_type") if "section_type" in blocks.columns else F.lit(None).cast("string")
    ranked = blocks.withColumn("score", block_score(F.col("text"), F.col("page"), section)).orderBy(F.desc("score"), "ordinal")
    return ranked.limit(n) if n and n > 0 else ranked


def section_type(title: Column) -> Column:
    """A section's type by the words of its title; ``other`` for a numbered one, null for no section."""
    lower = F.lower(title)
    choice = F.when(F.trim(lower) == "abstract", "abstract")
    for kind, words in SECTION_WORDS:
        choice = choice.when(lower.rlike(words), kind)
    return choice.when(lower.rlike(r"^(\d+|[ivxlcdm]+)(\.\d+)*\.?\s+"), "other")


# What speaks for a heading, and how much. A line needs about two of these; HEADING_SCORE is the bar.
HEADING_WEIGHTS = {"outline": 2.2, "named": 2.6, "topical": 0.9, "capitals": 1.5, "brief": 1.2, "open_end": 0.6, "large": 1.8, "bold": 1.2, "top_of_page": 0.4}
#: A heading has no more words and characters than these; a line's font is large from this multiple of its file's median on.
HEADING_WORDS_MOST, HEADING_CHARS_MOST, LARGE_FONT = 14, 150, 1.15
OUTLINE = r"^(?:\d{1,2}(?:\.\d{1,2}){0,4}|[IVX]{1,5}|[A-H])[.)]?\s+(?=\p{Lu}|\p{Lo})"


def heading_signs(text: Column, line: Column, font: Column, bold: Column) -> dict[str, Column]:
    """The signs of a heading that a line shows, by name. ``font`` is its size as a multiple of the usual one, null if not known."""
    title = F.regexp_replace(text, OUTLINE, "")
    words = F.filter(F.split(title, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    weighty = F.filter(words, lambda w: F.length(w) > 3)
    capital = F.filter(weighty, lambda w: w.rlike(r"^\p{Lu}"))
    lower = F.transform(words, lambda w: F.lower(w))
    return {
        "outline": text.rlike(OUTLINE),
        "named": F.array_join(lower, " ").isin(*HEADING_NAMES),
        "topical": F.exists(lower, lambda w: F.exists(F.array(*map(F.lit, HEADING_WORDS)), lambda h: F.startswith(w, h))),
        "capitals": (F.size(weighty) > 0) & (F.size(capital) * 3 >= F.size(weighty) * 2),
        "brief": (F.size(words) > 0) & (F.size(words) <= 8),
        "open_end": ~text.rlike(r"[.,;:!?]$"),
        "large": font >= LARGE_FONT,
        "bold": bold,
        "top_of_page": line < 5,
    }


def heading_score(text: Column, line: Column, font: Column | None = None, bold: Column | None = None) -> Column:
    """How much a line looks like a heading: the weights of its signs, 0 for what none can be.

    Captions, references in brackets, long lines, lines without a letter and whole sentences are no headings.
    """
    signs = heading_signs(text, line, F.lit(None).cast("double") if font is None else font, F.lit(False) if bold is None else bold)
    total = sum((F.when(F.coalesce(sign, F.lit(False)), HEADING_WEIGHTS[name]).otherwise(0.0) for name, sign in signs.items()), F.lit(0.0))
    words = F.size(F.split(F.trim(text), r"\s+"))
    sentence = text.rlike(r"[.!?]$") & (words > 5) & ~signs["outline"]
    never = ~text.rlike(r"\p{L}{2}") | (F.length(text) > HEADING_CHARS_MOST) | (words > HEADING_WORDS_MOST) | text.startswith("[") | sentence | text.rlike(r"(?i)^(?:fig(?:ure)?|tab(?:le)?)s?\b\.?\s*\d")
    return F.when(F.coalesce(never, F.lit(True)), 0.0).otherwise(F.round(total, 2))


def headings(blocks: DataFrame) -> DataFrame:
    """Lines of text blocks that look like headings, with two lines before and three after; 80 a file at most.

    All lines of a block are looked at, however long it is: a block may be a whole file.
    """
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select("source_file", F.coalesce("page", F.lit(1)).alias("page"), "ordinal", lines.alias("lines"))
    # each line takes its neighbours along instead of all lines of its block
    before = lambda i: F.array_join(F.slice("lines", F.greatest(F.lit(1), i - 1), F.least(F.lit(2), i)), " ")
    after = lambda i: F.array_join(F.slice("lines", i + 2, 3), " ")
    beside = F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("raw"), F.left(before(i), F.lit(800)).alias("before"), F.left(after(i), F.lit(1200)).alias("after")))
    rows = rows.select("source_file", "page", F.explode(beside).alias("l")).select("source_file", "page", "l.*")
    return _chosen_headings(rows.withColumns({"font": F.lit(None).cast("double"), "bold": F.lit(False)}))


def headings_in_layout(lines: DataFrame) -> DataFrame:
    """:func:`headings` of recorded lines (source_file, page, line, text, font_size, bold): a file's median font tells which are large."""
    usual = lines.where("font_size > 0").groupBy("source_file").agg(F.percentile_approx("font_size", 0.5).alias("_usual"))
    order = Window.partitionBy("source_file", "page").orderBy("line")
    near = lambda a, b: F.array_join(F.collect_list(F.trim("text")).over(order.rowsBetween(a, b)), " ")
    rows = lines.where("trim(text) <> ''").withColumns({"before": F.left(near(-2, -1), F.lit(800)), "after": F.left(near(1, 3), F.lit(1200))}).join(usual, "source_file", "left")
    return _chosen_headings(rows.select("source_file", "page", "line", F.trim("text").alias("raw"), "before", "after", (F.col("font_size") / F.col("_usual")).alias("font"), F.coalesce("bold", F.lit(False)).alias("bold")))


def _chosen_headings(rows: DataFrame) -> DataFrame:
    text = F.regexp_replace(squeeze(F.col("raw")), r"^[ .]+|[ .]+$", "")
    rows = rows.withColumn("text", text).withColumn("score", heading_score(F.col("text"), F.col("line"), F.col("font"), F.col("bold"))).where(F.col("score") >= HEADING_SCORE)
    rows = rows.select("source_file", "page", "line", "text", "score", "before", "after")
    once = first_per_key(rows, ["source_file", "page", F.lower("text")], [F.col("line"), -F.col("score")])
    placed = once.withColumn("_n", F.row_number().over(Window.partitionBy("source_file").orderBy("page", "line", F.desc("score"))))
    return placed.where(F.col("_n") <= HEADINGS_A_FILE).drop("_n")


def section_plan(found: DataFrame) -> DataFrame:
    """Sections from headings alone: the type by the title, confidence a tenth of the score within 0.35 and 0.75."""
    typed = found.withColumn("section_type", section_type(F.col("text"))).where("section_type is not null")
    confidence = F.least(F.lit(0.75), F.greatest(F.lit(0.35), F.col("score") / 10))
    return typed.select("source_file", F.col("text").alias("section_title"), "section_type", F.col("page").alias("start_page"), F.col("text").alias("start_anchor"), confidence.alias("confidence"))


#: Fixed value: the heading with a number that a merged line ends in.
TRAILING_HEADING = re.compile(r"(?<!\d)(\d+(?:\.\d+)*\.?\s*[A-Z][A-Za-z0-9][A-Za-z0-9 &:/()_-]{1,80})\s*$")
#: The least letters and digits by which an anchor is found where its blanks and signs differ; anchors of a file that one automaton holds.
LEAST_SQUASHED, ANCHORS = 4, 5000


def _squashed(text: str) -> str:
    return "".join(filter(str.isalnum, text.lower()))


def _variants(anchor: str, endings: bool) -> list[tuple[str, str]]:
    """(in lower case, squashed) of an anchor, and with ``endings`` of the numbered heading that it ends in."""
    found = TRAILING_HEADING.search(anchor) if endings else None
    forms = dict.fromkeys([anchor.strip(), *([found[1].strip()] if found else [])])
    return [(f.lower(), _squashed(f)) for f in forms if f]


def offsets(text: str, anchors: dict[str, list[tuple[str, str]]], automaton: ahocorasick.Automaton) -> Iterator[tuple[str, int]]:
    """(anchor, offset) of each anchor that a text has, by one pass over its letters and digits; an exact place comes before one with other blanks and signs."""
    lower = text.lower()
    kept = [i for i, c in enumerate(lower) if c.isalnum()]
    places: dict[str, int] = {}
    if len(automaton):
        for end, small in automaton.iter("".join(lower[i] for i in kept)):
            places.setdefault(small, kept[end + 1 - len(small)])
    for anchor, forms in anchors.items():
        for exact, small in forms:
            if small and small not in places:
                continue
            at = lower.find(exact)
            at = places[small] if at < 0 and len(small) >= LEAST_SQUASHED else at
            if at >= 0:
                yield anchor, at
                break


def _anchored(batches: Iterator[pa.RecordBatch], endings: bool) -> Iterator[pa.RecordBatch]:
    """Rows (source_file, page, text, anchors), those of a file together, as (source_file, page, start_anchor, offset)."""
    held, anchors, automaton = None, {}, None
    for batch in batches:
        out: list[tuple] = []
        for i in range(len(batch)):
            file, page, text = (batch.column(c)[i].as_py() for c in ("source_file", "page", "text"))
            wanted = batch.column("anchors")[i]
            if automaton is None or wanted != held:
                held, anchors, automaton = wanted, {a: _variants(a, endings) for a in wanted.as_py()}, ahocorasick.Automaton()
                for small in {s for forms in anchors.values() for _, s in forms if s}:
                    automaton.add_word(small, small)
                automaton.make_automaton()
            out += [(file, page, anchor, at) for anchor, at in offsets(text, anchors, automaton)]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=["source_file", "page", "start_anchor", "offset"])


def find_anchors(anchors: DataFrame, pages: DataFrame, endings: bool = True) -> DataFrame:
    """(source_file, page, start_anchor, offset): every page that has an anchor of its file, and where it is there first.

    ``anchors`` has (source_file, start_anchor), ``pages`` (source_file, page, text). A page is read once, by an automaton of all anchors of its file; only a file with
    more than ``ANCHORS`` of them has several. Null and blank anchors, and null texts, give nothing. A page that has only the numbered heading in which an anchor ends
    counts as having the anchor, unless ``endings`` is false.
    """
    wanted = anchors.where("trim(start_anchor) <> ''").select("source_file", "start_anchor").distinct()
    many = wanted.groupBy("source_file").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("n"))
    dealt = wanted.join(many, "source_file").groupBy("source_file", F.pmod(F.xxhash64("start_anchor"), F.col("n")).alias("bucket")).agg(F.array_sort(F.collect_list("start_anchor")).alias("anchors"))
    texts = pages.where("text <> ''").select(F.col("source_file").cast("string").alias("source_file"), F.col("page").cast("long").alias("page"), "text")
    met = texts.join(dealt, "source_file").select("source_file", "page", "text", "anchors").sortWithinPartitions("source_file", "anchors")
    return met.mapInArrow(partial(_anchored, endings=endings), "source_file string, page long, start_anchor string, offset int")


def locate(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each planned section begins: the first page from ``start_page`` on that has its anchor.

    ``pages`` has (source_file, page, text). Anchors are found by one pass over the pages; no page meets its file's anchors one by one.
    """
    once = first_per_key(plan, ["source_file", "start_page", squash(F.col("start_anchor"))], [F.lower("start_anchor"), F.col("section_title")])
    met = once.join(find_anchors(once, pages), ["source_file", "start_anchor"]).where("page >= start_page")
    met = met.select(*once.columns, F.col("page").cast(pages.schema["page"].dataType).alias("page"), "offset")
    return first_per_key(met, ["source_file", "start_page", squash(F.col("start_anchor"))], [F.col("page"), F.col("offset")])


def next_anchor(located: DataFrame, file: str = "source_file", place: tuple[str, ...] = ("page", "offset")) -> DataFrame:
    """Add ``next``: where the following section of the file begins, null for the last."""
    order = Window.partitionBy(file).orderBy(*place)
    return located.withColumn("next", F.lead(F.struct(*place)).over(order))


def cut_sections(located: DataFrame, pages: DataFrame) -> DataFrame:
    """Section blocks: for each page of a section its part of the page, packed into chunks."""
    bound = next_anchor(located)
    met = bound.withColumnRenamed("page", "first").join(pages, "source_file").where((F.col("page") >= F.col("first")) & (F.col("next").isNull() | (F.col("page") <= F.col("next.page"))))
    begin = F.when(F.col("page") == F.col("first"), F.col("offset")).otherwise(0)
    end = F.when(F.col("page") == F.col("next.page"), F.col("next.offset")).otherwise(F.length("text"))
    part = compact_lines(F.substr(F.col("text"), begin + 1, F.greatest(F.lit(0), end - begin)))
    rows = met.select("source_file", "section_title", "section_type", "confidence", "first", "page", part.alias("part")).where("part <> ''")
    return rows.select("source_file", "section_title", "section_type", "confidence", F.col("first").alias("page_start"), "page", F.posexplode(pack_lines(F.col("part"))).alias("nth", "text"))


def pages_as_sections(blocks: DataFrame) -> DataFrame:
    """Section blocks for files without a section: each block is one, of low confidence."""
    title = F.when(F.col("page") > 0, F.concat(F.lit("Page "), "page"))
    return blocks.select("source_file", title.alias("section_title"), F.lit("unknown").alias("section_type"), F.lit(0.35).alias("confidence"), F.col("page").alias("page_start"), "page", F.posexplode(pack_lines(F.col("text"))).alias("nth", "text"))


def request_chunks(text: Column, limit: int = TEXT_A_REQUEST) -> Column:
    """A text cut at line ends into parts of at most ``limit`` characters; longer lines are cut hard. Nothing is lost."""
    lines = F.flatten(F.transform(F.split(text, r"(?<=\n)"), lambda x: F.transform(slices(x, limit), lambda s: s["text"])))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, line: Column) -> Column:
        fits = F.length(state["open"]) + F.length(line) <= limit
        done = F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state["open"], line)).otherwise(line).alias("open"))

    packed = F.aggregate(lines, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def row_batches(rows: Column, size: int = ROWS_A_REQUEST) -> Column:
    """An array of rows cut into arrays of at most ``size``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int"))), lambda i: F.slice(rows, i * size + 1, F.lit(size)))


def repair_sources(sections: DataFrame, found: DataFrame) -> DataFrame:
    """Fill the missing ``source_file`` of sections from headings: by (title, page), else by a title that only one file has."""
    key = F.lower(squeeze(F.col("section_title")))
    own = found.select(F.lower(squeeze(F.col("text"))).alias("_t"), "page", "source_file")
    exact = own.groupBy("_t", "page").agg(F.min("source_file").alias("_exact"))
    alone = own.groupBy("_t").agg(F.min("source_file").alias("_only"), F.count_distinct("source_file").alias("_n")).where("_n = 1").drop("_n")
    met = sections.withColumn("_t", key).join(exact.withColumnRenamed("page", "start_page"), ["_t", "start_page"], "left").join(alone, "_t", "left")
    return met.withColumn("source_file", F.coalesce("source_file", "_exact", "_only")).drop("_t", "_exact", "_only")
