"""Personal data in texts, disguised or not: what is found keeps its place in the source text."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import CHUNK_ROWS

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Plainly written identifiers, leftmost and without overlap for each kind; failing matches are dropped.

    Every pattern moves through the text in linear time: an email is looked for from its at sign, whose
    local part is all that can precede it since the last email's end.
    """
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = {
    "а": "a", "А": "A", "в": "b", "В": "B", "с": "c", "С": "C", "е": "e", "Е": "E", "һ": "h", "Н": "H", "і": "i", "І": "I",
    "ј": "j", "Ј": "J", "к": "k", "К": "K", "ӏ": "l", "м": "m", "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ѕ": "s",
    "Ѕ": "S", "т": "t", "Т": "T", "у": "y", "У": "Y", "х": "x", "Х": "X", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "Α": "A", "Β": "B", "ε": "e", "Ε": "E", "Ζ": "Z", "Η": "H", "ι": "i", "Ι": "I", "κ": "k", "Κ": "K", "Μ": "M",
    "ν": "v", "Ν": "N", "ο": "o", "Ο": "O", "ρ": "p", "Ρ": "P", "τ": "t", "Τ": "T", "υ": "u", "Υ": "Y", "χ": "x", "Χ": "X",
    "ı": "i", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "．": ".", "＠": "@", "﹫": "@",
}
#: Characters without width, which are left out (fixed values).
HIDDEN = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: Digits by their names in the four languages of the corpus; names that are common words elsewhere are left out (fixed values).
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
NAME = "|".join(sorted(SPELLED, key=len, reverse=True))
#: All but the article "un"; a run has some of them, so texts without any need no closer look.
TELLING = "|".join(n for n in sorted(SPELLED, key=len, reverse=True) if n != "un")
#: A run of at least three spelled digits, which digits and separators may stand between; "plus" may lead it.
RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ -]+)?(?:(?:{NAME}|[0-9]+|dot|point|punkt|punto)(?:[ ,./()-]{{1,3}})){{2,}}(?:{NAME}|[0-9]+)(?!\w)")
RUN_HINT = re.compile(rf"(?i)(?<!\w)(?:{TELLING})(?=[ ,./()-])")
RUN_PART = re.compile(rf"(?i)plus|dot|point|punkt|punto|{NAME}|[0-9]+|[ ,./()-]+")
#: at and dot by their names in the four languages of the corpus (fixed values). "point" is a dot beside a sign that no prose has, not beside "at".
AT_NAMES = "arobase|arrobase|arroba|klammeraffe"
DOT_NAMES = "dot|punkt|punto|point"
ATS, DOTS = ("at", "ät", *AT_NAMES.split("|")), (*DOT_NAMES.split("|"), ".")
LABEL = re.compile(r"[A-Za-z0-9-]+")
#: at and dot in brackets of any kind, or bare between blanks.
BRACKETED = re.compile(rf"(?i)[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(at|ät|{AT_NAMES}|{DOT_NAMES}|@|\.)[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}")
#: A run of words with dots between, taken whole so that it is read once, and what makes it an address, if that follows.
BARE_EMAIL = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?: (?:{DOT_NAMES}|\.) (?!(?:at|ät|dot|{AT_NAMES})\b)[A-Za-z0-9._%+-]++)*+"
    rf"(?:(?P<at> (?:at|ät|{AT_NAMES}) |@| @ )(?!(?:at|dot)\b)[A-Za-z0-9-]+(?:(?: (?:{DOT_NAMES}|\.) |\.)(?!(?:at|dot)\b)[A-Za-z0-9-]+)+)?"
)
BARE = re.compile(rf"(?i) at | (?:{DOT_NAMES}) | @ | \. ")
BARE_DOT = re.compile(rf"(?i) ({DOT_NAMES}|\.) ")
#: The same with underscores or hyphens for blanks, and addresses whose numbers are parted by "dot".
JOINED_WORD = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++")
JOINED_AT = re.compile(rf"(?i)([_-])(at|{AT_NAMES})(?=\1)[_-]")
JOINED_DOT = {mark: re.compile(rf"(?i){mark}({DOT_NAMES})(?={mark})[_-]") for mark in "_-"}
JOINED_HINT = re.compile(rf"(?i)[_-](?:at|{AT_NAMES})[_-]")
BARE_IP = re.compile(rf"(?i)(?<![\w.])[0-9]{{1,3}}(?:(?: (?:{DOT_NAMES}) |\.| \. )[0-9]{{1,3}}){{3}}(?![\w])")
IP_HINT = re.compile(rf"(?i)[0-9] (?:{DOT_NAMES}) [0-9]")
ENTITY = re.compile(r"(?i)(?P<at>&(?:#0*64|commat|#x0*40);|%40)|&(?:#0*46|period|#x0*2e);")


class Mapped:
    """A normalised text and, for each of its characters, the source characters that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.stop = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ``text[a:b]`` by another text, for edits in order and without overlap."""
        if not edits:
            return
        if self.start is None:
            self.start, self.stop = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, start, stop, done = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            start += self.start[done:a] + [self.start[a]] * len(new)
            stop += self.stop[done:a] + [self.stop[b - 1]] * len(new)
            done = b
        text.append(self.text[done:])
        self.text, self.start, self.stop = "".join(text), start + self.start[done:], stop + self.stop[done:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.stop[b - 1])


def _western(text: str) -> bool:
    """No character beyond Latin-1 and no soft hyphen: nothing to look up."""
    try:
        return b"\xad" not in text.encode("latin-1")
    except UnicodeEncodeError:
        return False


def _glyph(c: str) -> str:
    if c in HIDDEN:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() and len(plain) == 1 else c


def _glyphs(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes, wide forms and hidden characters, but only in words that mix them with ASCII signs or digits."""
    edits = []
    for m in re.finditer(r"\S+", text):
        if (word := m[0]).isascii():
            continue
        new = [_glyph(c) for c in word]
        if any(a != b for a, b in zip(word, new, strict=True)) and re.search(r"[@.0-9+]|(?i:at|dot)", "".join(new)):
            edits += [(m.start() + i, m.start() + i + 1, n) for i, (c, n) in enumerate(zip(word, new, strict=True)) if c != n]
    return edits


def _spelled(text: str) -> list[tuple[int, int, str]]:
    if not RUN_HINT.search(text):
        return []
    edits = []
    for m in RUN.finditer(text):
        parts = [(p.start(), p.end(), p[0].lower()) for p in RUN_PART.finditer(text, m.start(), m.end())]
        if sum(p[2] in SPELLED for p in parts) < 3:
            continue
        for a, b, p in parts:
            new = SPELLED.get(p) or {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}.get(p)
            if new is None:
                new = p if p[0].isdigit() else ("." if "." in p else "")
            edits.append((a, b, new))
    return edits


#: Endings that tell a spelled address from prose, and words that no domain begins with there.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro dev app io ai co tv xyz online site shop tech blog cloud email me cc ws fm ly sh eu uk us ca au nz ie de at ch fr be nl lu es pt it mx ar br cl pe "
    "se no dk fi is pl cz sk hu ro bg gr tr ru ua jp cn kr tw hk sg in za ke ng eg il ae example test".split()
)
NO_DOMAIN = frozenset("the a an this that these those my your his her our their its each every one another any some der die das ein eine le la les un une el los las una".split())


def _prose(domain: str) -> bool:
    """Whether what follows a bare "at" reads like prose: it begins with an article or the like, or has no known ending."""
    labels = domain.lower().split(".")
    return labels[0] in NO_DOMAIN or labels[-1].rstrip("_%+-") not in ENDINGS


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Edits of addresses with bare at and dot.

    "dot" always counts. Other dots are words or ends of sentences too: in the local part they count if the domain has
    the same one, in the domain if the at sign is spelled, "point" not by "at", or if a plain one has no plain dot before. After a bare "at" the domain must not read like prose.
    """
    edits = []
    for m in BARE_EMAIL.finditer(text):
        if m["at"] is None:
            continue
        sign, first, last, stop = m["at"].strip().lower(), m.start(), m.end("at"), m.end()
        after = []
        for d in BARE_DOT.finditer(text, last, stop):
            name = d[1].lower()
            bare = name == "point" if sign in ("at", "ät") else sign == "@" and name not in ("dot", ".") and "." in text[last : d.start()]
            if bare:
                stop = d.start()
                break
            after.append((d.start(), d.end(), name))
        names, before = {"dot", *(name for *_, name in after)}, []
        for d in BARE_DOT.finditer(text, first, m.start("at")):
            before = [*before, (d.start(), d.end(), d[1].lower())] if d[1].lower() in names else []
        if not after and "." not in text[last:stop] or sign in ("at", "ät") and {name for *_, name in before + after} <= {"."}:
            continue
        if sign in ("at", "ät"):
            domain, done = "", last
            for a, b, _ in after:
                domain, done = domain + text[done:a] + ".", b
            if _prose((domain + text[done:stop]).strip()):
                continue
        sign_edit = [(m.start("at"), last, "@")] if m["at"] != "@" else []
        edits += [(a, b, ".") for a, b, _ in before] + sign_edit + [(a, b, ".") for a, b, _ in after]
    return edits


def _joined(text: str) -> list[tuple[int, int, str]]:
    """Edits of addresses with at and dot between underscores or hyphens; the last at of a word counts."""
    edits = []
    for m in JOINED_WORD.finditer(text):
        if not JOINED_HINT.search(m[0]):
            continue
        *_, at = JOINED_AT.finditer(text, m.start(), m.end())
        dots = [d for d in JOINED_DOT[at[1]].finditer(text, at.end(), m.start() + len(m[0].rstrip("._%+-"))) if at[2].lower() != "at" or d[1].lower() != "point"]
        if not dots or at.start() == m.start():
            continue
        bounds = [at.end(), *(b for d in dots for b in d.span()), m.start() + len(m[0].rstrip("._%+-"))]
        labels = [part for a, b in zip(bounds[::2], bounds[1::2], strict=True) for part in text[a:b].split(".")]
        if all(LABEL.fullmatch(part) for part in labels) and labels[-1].isalnum():
            names = {"dot", *(d[1].lower() for d in dots)}
            dots = [d for d in JOINED_DOT[at[1]].finditer(text, m.start(), at.start()) if d[1].lower() in names and d.start() > m.start()] + dots
            edits += sorted([(*at.span(), "@"), *((*d.span(), ".") for d in dots)])
    return edits


def normalise(text: str) -> Mapped:
    """Undo disguises by rewrites in turn: look-alike glyphs, entities and brackets, bare and joined at/dot, spelled digits."""
    found = Mapped(text)
    if not _western(text):
        found.rewrite(_glyphs(found.text))
    if "&" in found.text or "%40" in found.text:
        found.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in ENTITY.finditer(found.text)])
    if any(b in found.text for b in "[({<"):
        found.rewrite([(m.start(), m.end(), "." if m[1].lower() in DOTS else "@") for m in BRACKETED.finditer(found.text)])
    lower = found.text.lower()
    dots = [n for n in DOTS if f" {n} " in lower]
    if "@ " in lower or " @" in lower or (dots and "@" in lower) or (set(dots) - {"point", "."} and (" at " in lower or " ät " in lower)) or any(n in lower for n in ATS[2:]):
        found.rewrite(_bare(found.text))
    if any(f"{c}{n}{c}" in lower for n in ATS for c in "_-") and any(n in lower for n in DOTS[:-1]):
        found.rewrite(_joined(found.text))
    if dots and IP_HINT.search(lower):
        found.rewrite([(s.start(), s.end(), ".") for m in BARE_IP.finditer(found.text) for s in BARE.finditer(found.text, m.start(), m.end())])
    found.rewrite(_spelled(found.text))
    return found


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by start, kind, end; null counts as empty.

    All spans are the base ones and those that only show in the normalised text, mapped back to source
    characters: from the first source character of a match to its last, disguise included. One that
    overlaps base spans is added only if it is larger than each of them, holds them and is of their kind: the plain
    part of an identifier that is disguised elsewhere.
    """
    text = text or ""
    base = base_spans(text)
    clear = normalise(text)
    if clear.start is None:
        return base, base
    more = []
    for kind, a, b in base_spans(clear.text):
        a, b = clear.source(a, b)
        met = [s for s in base if s[1] < b and a < s[2]]
        if all(k == kind and a <= x and y <= b and (a, b) != (x, y) for k, x, y in met):
            more.append((kind, a, b))
    return base, sorted({*base, *more}, key=_order)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the number of spans of each kind, the base spans' SHA-256 and all spans.

    Null texts count as empty; ids may repeat or be null; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            for first in range(0, len(batch), CHUNK_ROWS):
                rows, made = batch.slice(first, CHUNK_ROWS), []
                for i, text in zip(rows.column(0), rows.column(1), strict=True):
                    base, spans = find(text.as_py())
                    count = [sum(s[0] == k for s in spans) for k in KINDS]
                    made.append((i.as_py(), *count, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)


def mask_text(text: str | None) -> str | None:
    """The text with each found span replaced by its kind in brackets; of spans that overlap, all go under the first's name."""
    if not text:
        return text
    out, done, stop = [], 0, 0
    for kind, a, b in find(text)[1]:
        if a >= stop:
            out += [text[stop:a], f"[{kind.upper()}]"]
            done += 1
        stop = max(stop, b)
    return "".join([*out, text[stop:]]) if done else text


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind; a null text stays null, all other columns stay."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), CHUNK_ROWS):
                rows = batch.slice(first, CHUNK_ROWS)
                masked = pa.array([mask_text(t.as_py()) for t in rows.column(at)], pa.string())
                yield rows.set_column(at, f"c{at}", masked)

    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(work, schema).toDF(*docs.columns)
