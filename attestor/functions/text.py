"""Text: white space, keys, sentences, chunks and cleaners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.values import is_present

#: Sentences outside of these lengths are not evidence.
SENTENCE_LENGTHS = (20, 900)
CHUNK_CHARS, SECTION_CHARS = 4500, 5500


def squeeze(text: Column) -> Column:
    """Every run of white space, Unicode's included, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_key(text: Column) -> Column:
    """The form in which names are compared: lower case, single blanks, null as empty."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def squash(text: Column) -> Column:
    """Letters and digits of any script, in lower case, and nothing else."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def ascii_key(text: Column) -> Column:
    """ASCII letters and digits in lower case, and nothing else."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "")


def slug(text: Column, fallback: str = "item") -> Column:
    """Lower case with single underscores between runs of ASCII letters and digits."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(made == "", fallback).otherwise(made)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def location(path: Column) -> Column:
    """The form in which file names are compared: forward slashes, lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def sentences(text: Column) -> Column:
    """Sentences of usable length, cut after end marks that white space follows."""
    low, high = SENTENCE_LENGTHS
    cut = F.transform(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s))
    return F.filter(cut, lambda s: F.length(s).between(low, high))


def slices(text: Column, size: int = CHUNK_CHARS) -> Column:
    """(nth, text) of each run of ``size`` characters."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))),
        lambda i: F.struct(i.alias("nth"), F.substr(text, i * size + 1, F.lit(size)).alias("text")),
    )


def pack_lines(text: Column, limit: int = SECTION_CHARS) -> Column:
    """Lines joined into chunks: a new chunk begins where the next line, with its end, would go beyond ``limit``.

    A line that is longer than ``limit`` is a chunk of its own; a text within the limit is one chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def step(state: Column, line: Column) -> Column:
        size = F.length(line) + 1
        full = (state["size"] > 0) & (state["size"] + size > limit)
        done = F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"])
        joined = F.when(full | (state["size"] == 0), line).otherwise(F.concat(state["open"], F.lit("\n"), line))
        return F.struct(done.alias("done"), joined.alias("open"), F.when(full, size).otherwise(state["size"] + size).alias("size"))

    packed = F.aggregate(F.split(text, "\n"), start, step, lambda s: F.when(s["size"] > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def compact_lines(text: Column) -> Column:
    """Lines with single blanks, without empty lines and NUL characters."""
    lines = F.transform(F.split(F.regexp_replace(text, "\u0000", ""), r"\R"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def shorten(text: Column, limit: int) -> Column:
    """Single blanks, and an ellipsis in the place of what goes beyond ``limit``."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit - 3)), F.lit("...")))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags become blanks, the five basic entities their characters."""
    bare = html
    for tag in ("script", "style", "noscript"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return squeeze(bare)


def formula_guard(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(text.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


def file_name(text: Column) -> Column:
    """A name that is safe as a file name."""
    made = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\w.-]+", "_")
    return F.when(made == "", "table").otherwise(made)


def markdown_cell(text: Column) -> Column:
    return F.replace(squeeze(F.coalesce(text, F.lit(""))), F.lit("|"), F.lit("\\|"))


def first_present(*columns: Column) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*(F.when(is_present(c), c) for c in columns))


#: First-page lines of these lengths with at least three words count as a title.
TITLE_LENGTHS = (8, 180)


def leading_title(text: Column) -> Column:
    line = F.element_at(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), 1)
    words = F.size(F.split(squeeze(line), " "))
    return F.when(F.length(line).between(*TITLE_LENGTHS) & (words >= 3), line)
