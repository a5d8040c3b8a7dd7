"""Token sets of names, and which kinds of evidence a name or a file stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a topic.
STOP_WORDS = ("paper", "dataset", "source", "data", "the", "and", "with", "from")
# Words that point to a kind of evidence, the first kind that matches holds.
EVIDENCE_WORDS = {
    "paper_full_text": ("paper", "article", "publication", "fulltext", "text"),
    "table": ("table", "spreadsheet", "csv", "tsv", "excel"),
    "supplementary_material": ("supplement", "supplementary", "appendix", "supporting"),
    "figure": ("figure", "chart", "image", "plot", "visual"),
    "code_repository": ("code", "repository", "repo", "github", "software"),
    "dataset": ("dataset", "database", "data", "benchmark"),
}
# Kinds of evidence by kind of artifact.
ARTIFACT_EVIDENCE = {
    "pdf": ("paper_full_text",),
    "html": ("paper_full_text",),
    "supplementary_pdf": ("supplementary_material",),
    "csv": ("table", "dataset"),
    "tsv": ("table", "dataset"),
    "xlsx": ("table", "dataset"),
    "json": ("table", "dataset"),
    "xml": ("table", "dataset"),
    "image": ("figure",),
    "readme": ("code_repository",),
    "code_archive": ("code_repository",),
    "file_manifest": ("code_repository",),
}
#: A shared token of this length makes two names match.
LONG_TOKEN = 6


def topic_tokens(text: Column) -> Column:
    """Distinct words of two characters or more, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9一-鿿]{2,})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def field_tokens(name: Column) -> Column:
    """Distinct lower-case words of a field name; humps part words, too."""
    spaced = F.regexp_replace(F.coalesce(name, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(spaced), F.lit(r"([a-z0-9]+)"), F.lit(1))))


def has_word(name: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words of a field name is in a list: one pattern instead of a token set."""
    spaced = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"))
    return spaced.rlike(rf"(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)")


def field_key(name: Column) -> Column:
    """A field name without regard to the order and spelling of its words."""
    key = F.array_join(field_tokens(name), "_")
    return F.when(key == "", F.lower(F.trim(name))).otherwise(key)


def label_tokens(name: Column) -> Column:
    """:func:`field_tokens` in the singular."""

    def singular(t: Column) -> Column:
        long = F.length(t) > 4
        return (
            F.when(long & t.endswith("ies"), F.concat(F.left(t, F.length(t) - 3), F.lit("y")))
            .when(long & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1))
            .otherwise(t)
        )

    return F.array_sort(F.array_distinct(F.transform(field_tokens(name), singular)))


def labels_match(a: Column, b: Column) -> Column:
    """Whether two token sets name the same thing: one holds the other, or they share a long word."""
    shared = F.array_intersect(a, b)
    subset = F.size(shared) == F.least(F.size(a), F.size(b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (subset | F.exists(shared, lambda t: F.length(t) >= LONG_TOKEN))


def evidence_kind(name: Column) -> Column:
    """The kind of evidence that a name asks for, or null."""
    tokens, choice = label_tokens(name), None
    for kind, words in EVIDENCE_WORDS.items():
        hit = F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
        choice = F.when(hit, kind) if choice is None else choice.when(hit, kind)
    return choice


def artifact_evidence(artifact_type: Column) -> Column:
    """The kinds of evidence that a parsed artifact gives."""
    choice = None
    for kind, evidence in ARTIFACT_EVIDENCE.items():
        value = F.array(*map(F.lit, evidence))
        choice = F.when(artifact_type == kind, value) if choice is None else choice.when(artifact_type == kind, value)
    return choice.otherwise(F.array().cast("array<string>"))


def relevance(confidence: Column, wanted: Column, offered: Column, provider: Column) -> Column:
    """How well a source fits a question: 0.55 of its confidence, 0.37 of the words in common, 0.08 for a paper index."""
    overlap = F.size(F.array_intersect(wanted, offered)) / F.greatest(F.lit(1), F.size(wanted))
    boost = F.when(F.lower(provider).isin("arxiv", "semantic_scholar", "openalex"), 0.08).otherwise(0.0)
    score = confidence * 0.55 + overlap * 0.37 + boost
    return F.when(F.size(wanted) == 0, confidence).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
