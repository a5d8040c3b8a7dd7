"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine."""

from __future__ import annotations

import codecs
import hashlib
import io
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that were encoded before are kept up to this number; the later half goes when it is reached.
MEMO = 400_000
#: Longer pieces are not kept but streamed, by so many ids at a time; texts are read in windows of about so many characters.
LONGEST, IDS_AT_ONCE, WINDOW = 64, 128, 1 << 13
#: White space as the tokenizer's own pattern engine has it: 1C to 1F are not part of it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


@lru_cache(maxsize=1)
def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print stand
    for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass
class Merges:
    """A merge list: ranks by pair, and how far ahead a stream must be known before a token is settled."""

    ranks: dict[tuple[str, str], int]
    lookahead: int = field(init=False)

    def __post_init__(self) -> None:
        self.lookahead = sufficient_lookahead(sorted(self.ranks, key=self.ranks.get))

    def apply(self, symbols: list[str]) -> list[str]:
        """Merge the pair of least rank, the leftmost of equals, until no pair is in the list."""
        parts, ranks, never = list(symbols), self.ranks, len(self.ranks)
        if len(parts) > 64:
            return self._apply_long(parts)
        found = [ranks.get(p, never) for p in itertools.pairwise(parts)]
        while found and (least := min(found)) < never:
            i = found.index(least)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), never)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), never)
        return parts

    def _apply_long(self, parts: list[str]) -> list[str]:
        """The same by a queue of pairs, for windows of many symbols."""
        import heapq

        n = len(parts)
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            if not alive[i] or parts[i] != a or (j := right[i]) >= n or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(queue, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a token that decide it, whatever follows them.

    What comes later can change earlier tokens only through a chain of merges of rising rank, each of
    which takes or leaves the symbols that the next one, to its left, would have as its right part:
    the right part begins with the left part of the merge before. The longest such chain, in symbols, is found by
    going through the list in order; one more right part covers where the chain starts.
    """
    spine: dict[str, tuple[str, ...]] = {}
    best: dict[str, int] = {}
    reach = longest = 0
    for u, v in merges:
        chain = len(u) + max((best.get(t, 0) for t in (*spine.get(v, ()), v)), default=0)
        best[u] = max(best.get(u, 0), chain)
        spine.setdefault(u + v, (*spine.get(u, ()), u))
        reach, longest = max(reach, chain), max(longest, len(u) + len(v))
    return reach + longest


def stream_tokens(symbols: Iterable[str], merges: Merges, end: str = "", window: int | None = None) -> Iterator[str]:
    """Tokens of a stream of symbols, each emitted once nothing that follows can change it.

    At most ``window`` symbols are held (twice the lookahead at least). ``end`` is put to the last symbol.
    """
    most = max(window or 0, 2 * merges.lookahead)
    source, held = iter(symbols), []
    while True:
        held += itertools.islice(source, most + 1 - len(held))
        if len(held) <= most:
            break
        settled = 0
        for token in merges.apply(held):
            if settled + len(token) > len(held) - merges.lookahead:
                break
            yield token
            settled += len(token)
        if not settled:
            raise ValueError("no token is settled within the window")
        del held[:settled]
    if held:
        held[-1] += end
        yield from merges.apply(held)


class Decoder:
    """Byte-to-text state machine: takes token ids one by one and gives text as soon as its bytes are whole.

    Without byte decoding, tokens are joined by one blank, as a tokenizer without a decoder does. With it,
    tokens stand for bytes, and bytes that are no UTF-8 come out as U+FFFD.
    """

    def __init__(self, tokens: dict[int, str], byte_level: bool) -> None:
        back = {c: b for b, c in byte_symbols().items()}
        self.bytes = {i: bytes(back[c] for c in t) if byte_level and all(c in back for c in t) else t.encode() for i, t in tokens.items()}
        self.gap = b"" if byte_level else b" "
        self.reset()

    def reset(self) -> None:
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, token: int) -> str:
        """The text that is settled by one more id; unknown ids are left out."""
        data = self.bytes.get(token)
        return "" if data is None else self.take(data)

    def take(self, data: bytes) -> str:
        """The text that is settled by the bytes of one more token, or of several with gaps between them."""
        gap, self.begun = self.gap if self.begun else b"", True
        return self.state.decode(gap + data)

    def finish(self) -> str:
        rest = self.state.decode(b"", final=True)
        self.reset()
        return rest


class Tokenizer:
    """Encodes whole texts as the library of the file's format does, from the file's merge list and vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only plain BPE files are supported")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Merges({p: i for i, p in reversed(list(enumerate(pairs)))})
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ignore = bool(model.get("ignore_merges"))
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        steps = (told.get("normalizer") or {}).get("normalizers", [told["normalizer"]] if told.get("normalizer") else [])
        kinds = [s["type"] for s in steps]
        if set(kinds) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers {kinds} are not supported")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.blanks = regex.compile(f"[{SPACE}]+") if "Replace" in kinds else None
        pre = told["pre_tokenizer"]
        split = next((p["pattern"]["Regex"] for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        if split is None:
            split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pieces = regex.compile(split.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.bytes = byte_symbols()
        self.byte_level = (told.get("decoder") or {}).get("type") == "ByteLevel"
        self.decoder = Decoder({i: t for t, i in [*self.vocab.items(), *self.added.items()]}, self.byte_level)
        self.memo: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        """The normalised text; a long one is made of parts, so that no step holds several times its size."""
        if len(text) <= 2 * WINDOW:
            return self._even(text)
        out, first = io.StringIO(), 0
        while first < len(text):
            last = first + WINDOW
            while last < len(text) and not _starts_anew(text[last]):
                last += 1
            out.write(self._even(text[first:last]))
            first = last
        return out.getvalue()

    def _even(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.blanks:
            text = self.blanks.sub(" ", text)
        if self.lower:  # letter by letter: a sigma at a word's end is no exception
            text = text.replace("Σ", "σ").lower()
        return text

    def stream_ids(self, piece: str) -> Iterator[int]:
        """Ids of one piece as they are settled; tokens outside of the vocabulary are left out, as without an unknown token."""
        stream = map(self.bytes.__getitem__, piece.encode("utf-8", "surrogatepass"))
        return (i for t in stream_tokens(stream, self.merges, self.suffix, 64) if (i := self.vocab.get(t)) is not None)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        return tuple(self.stream_ids(piece))

    def remembered(self, piece: str, make: Callable[[tuple[int, ...]], tuple] = lambda ids: ids) -> tuple:
        """What ``make`` gives for a short piece's ids."""
        got = self.memo.get(piece)
        if got is None:
            got = make(self.piece_ids(piece))
            if len(self.memo) >= MEMO:
                for old in list(itertools.islice(reversed(self.memo), MEMO // 2)):
                    del self.memo[old]
            self.memo[piece] = got
        return got

    def streamed(self, piece: str) -> Iterator[tuple[int, ...]]:
        """A long piece's ids, some at a time."""
        ids = self.stream_ids(piece)
        while some := tuple(itertools.islice(ids, IDS_AT_ONCE)):
            yield some

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at added tokens, and between them into windows: (part, whether it is such a token)."""
        done = 0
        for m in self.cut.finditer(text) if self.cut is not None and any(t in text for t in self.added) else ():
            yield from ((w, False) for w in windows(text, done, m.start()))
            yield m[0], True
            done = m.end()
        yield from ((w, False) for w in windows(text, done, len(text)))

    def text_pieces(self, text: str | None) -> Iterator[tuple[list[str], bool]]:
        """(some pieces, whether they are added tokens) of a text, null as empty, in order."""
        for part, added in self.parts(text or ""):
            if added:
                yield [part], True
            elif len(part) <= 2 * WINDOW:
                yield self.pieces.findall(self.normalise(part)), False
            else:
                found = self.pieces.finditer(self.normalise(part))
                while some := [m[0] for m in itertools.islice(found, 1024)]:
                    yield some, False

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of a text, null as empty, one piece after the other."""
        for pieces, added in self.text_pieces(text):
            for piece in pieces:
                if added:
                    yield self.added[piece]
                elif len(piece) > LONGEST:
                    yield from self.stream_ids(piece)
                else:
                    yield from self.remembered(piece)

    def decode(self, ids: Iterable[int]) -> str:
        self.decoder.reset()
        out = io.StringIO()
        for i in ids:
            out.write(self.decoder.feed(i))
        out.write(self.decoder.finish())
        return out.getvalue()


def _starts_anew(c: str) -> bool:
    """Whether a character never joins what stands before it: ASCII but for white space, or a letter that is no part of a Hangul syllable."""
    if c.isascii():
        return not c.isspace()
    return unicodedata.category(c) in ("Lo", "Lu", "Ll") and not unicodedata.name(c, "HANGUL").startswith("HANGUL")


#: Where every pattern ends a piece, and no composition or case rule looks across: before white space, and between ASCII letters and digits.
SAFE = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def windows(text: str, first: int, last: int) -> Iterator[str]:
    """Parts of about ``WINDOW`` characters, cut where it is safe; only a stretch without a safe place is longer."""
    while last - first > WINDOW:
        m = SAFE.search(text, first + WINDOW, last)
        if m is None:
            break
        yield text[first : m.start()]
        first = m.start()
    if first < last:
        yield text[first:last]


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


class _Digests(Tokenizer):
    """A tokenizer that keeps, for each piece, its number of ids and what it adds to a text's digests."""

    def of_piece(self, ids: tuple[int, ...]) -> tuple[int, bytes, bytes]:
        """A piece's text is whole bytes only where tokens are not joined; else the state is kept across pieces."""
        return len(ids), " ".join(map(str, ids)).encode(), self.decoder.gap.join(self.decoder.bytes[i] for i in ids)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        number, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        gap, take = self.decoder.gap, self.decoder.take
        self.decoder.reset()

        def put(made: list[tuple[int, bytes, bytes]]) -> None:
            nonlocal number
            if made := [m for m in made if m[0]]:
                n, spelled, data = zip(*made, strict=True)
                ids.update((b" " if number else b"") + b" ".join(spelled))
                decoded.update(take(gap.join(data)).encode())
                number += sum(n)

        memo, of_piece = self.memo, self.of_piece
        for pieces, added in self.text_pieces(text):
            made = []
            for p in pieces:
                if (got := None if added else memo.get(p)) is not None:
                    made.append(got)
                elif added:
                    made.append(of_piece((self.added[p],)))
                elif len(p) <= LONGEST:
                    made.append(self.remembered(p, of_piece))
                else:
                    put(made)
                    made = []
                    for some in self.streamed(p):
                        put([of_piece(some)])
            put(made)
        decoded.update(self.decoder.finish().encode())
        return number, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=1)
def _load_digests(path: str) -> _Digests:
    return _Digests(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` to ``docs``: each whole text's token ids (null and empty texts have none)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                ids = pa.array([np.fromiter(tokenizer.encode(t.as_py()), "i4") for t in part.column(at)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    docs = docs.drop("ids")
    at = docs.columns.index(text_col)
    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)] + ["ids array<int>"])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(work, schema).toDF(*docs.columns, "ids")


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` to ``rows``: the text of each list of ids (null: empty; null or unknown ids are left out)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            texts = pa.array([tokenizer.decode(i.as_py() for i in (ids.values or ())) for ids in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    rows = rows.drop("decoded")
    at = rows.columns.index(ids_col)
    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes)] + ["decoded string"])
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(work, schema).toDF(*rows.columns, "decoded")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded as a stream.

    Texts are read in windows; the ids and the decoded text go through the hashes as they are made, so besides the text itself (and a
    copy of a stretch without any white space or change between letters and digits) a bounded number of symbols and ids is held. Null
    and empty texts have no tokens; ids may repeat or be null; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load_digests(path)
        for batch in batches:
            n, ids, decoded = zip(*(tokenizer.digest(t.as_py()) for t in batch.column(1)), strict=True) if len(batch) else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
