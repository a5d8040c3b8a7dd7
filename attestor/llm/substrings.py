"""Repeated passages by relative Lempel-Ziv parsing: documents are factored against blocks of reference text, long factors are duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.grams import MULT, rows_of, words
from attestor.llm.shared import BROADCAST_ROWS, stage, text_chunks, unstage

#: Bytes that are part of a word: all but ASCII white space.
INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: An anchor is the least hash of so many words in a row within a window.
GRAM = 8
#: Stretches that a block of reference text holds, about; an anchor with more stretches of its own than ``HOT`` is dealt by window.
BLOCK, HOT = 16_384, 8192
#: Anchors that are broadcast at most: one long each.
ANCHORS = 4_000_000
#: Bytes of a long text that are read at a time.
WINDOW = 1 << 20


def _cuts(raw: bytes | memoryview) -> Iterator[bytes]:
    """Runs of about ``WINDOW`` bytes, cut at white space; only a longer word makes a longer run."""
    done, raw = 0, bytes(raw)
    while done < len(raw):
        stop = done + WINDOW
        while stop < len(raw) and INSIDE[raw[stop]]:
            stop += 1
        yield raw[done:stop]
        done = stop


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word of a run of texts; hashes are mixed, as sums of them with powers are hashed in turn."""
    if len(raw) <= 2 * WINDOW or len(at) > 2:
        _, row, hashes = words(raw, rows_of(at), INSIDE)
        return row, _mixed(hashes[:, 0])
    parts = [words(p := np.frombuffer(cut, "u1"), np.zeros(len(p), "i8"), INSIDE)[2][:, 0] for cut in _cuts(raw.tobytes())]
    found = np.concatenate(parts)
    return np.zeros(len(found), "i8"), _mixed(found)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULT
    return h ^ (h >> np.uint64(29))


def stretches(row: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, anchor) of each stretch: consecutive windows of one row with their anchor at the same place.

    Equal windows have equal anchors wherever they are. Each window is in one stretch, and no two windows of a stretch are equal.
    """
    n = len(hashes) - window + 1
    gram = min(GRAM, window)
    whole = np.flatnonzero(row[:n] == row[window - 1 :]) if n > 0 else np.zeros(0, "i8")
    if not len(whole):
        return whole, whole, whole
    least = np.zeros(len(hashes) - gram + 1, "u8")
    for i in range(gram):
        least = least * MULT + hashes[i : i + len(least)]
    least, place, have, want = _mixed(least), np.arange(len(least)), 1, window - gram + 1
    while have < want:  # the least of ``have`` grams in a row and its first place, then of twice as many
        step = min(have, want - have)
        later = least[step:] < least[:-step]
        least, place, have = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step]), have + step
    anchor, place = least[whole].view("i8"), place[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (row[whole[1:]] != row[whole[:-1]]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return whole[first], np.diff(np.append(first, len(whole))), anchor[first]


def _anchored(window: int):
    """Rows (id, h1, h2, text) as (id, h1, h2, start, n, anchor), the latter lists with an entry a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in text_chunks(batches, "text"):
            row, hashes = word_hashes(raw, at)
            first, n, anchor = stretches(row, hashes, window)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            bounds = pa.array(np.searchsorted(first, cut).astype("i4"))
            start = first - cut[row[first]]
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (start.astype("i4"), n.astype("i4"), anchor)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=["id", "h1", "h2", "start", "n", "anchor"])

    return run


def _lettered(window: int):
    """Rows (rank, text, found) as the stretches found: (rank, start, anchor, letters). A letter is a window's 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in text_chunks(batches, "text"):
            row, hashes = word_hashes(raw, at)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            letter = np.zeros(max(0, len(hashes) - window + 1), "u8")
            for i in range(window):
                letter = letter * MULT + hashes[i : i + len(letter)]
            letter, listed = _mixed(letter).tobytes(), part.column("found")
            found, bounds = listed.flatten(), np.asarray(listed.offsets) - listed.offsets[0].as_py()
            start, n = (found.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            of = np.repeat(np.arange(len(part)), np.diff(bounds))
            place = cut[of] + start
            text = pa.array([letter[8 * a : 8 * b] for a, b in zip(place.tolist(), (place + n).tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("rank").take(pa.array(of)), pa.array(start.astype("i4")), found.field("anchor"), text], names=["rank", "start", "anchor", "letters"])

    return run


def _factored(window: int):
    """Parse one block: its stretches (rank, start, anchor, letters) in order, each against those before.

    The reference's index leads from an anchor and letter to where they come first. At each place the longest factor from there is taken; the windows over its end
    are looked up next. A window that the reference does not hold becomes part of it. Returns (rank, start, length) of each factor, in words.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending"), ("start", "ascending")])
        index: dict[tuple[int, bytes], tuple[int, int]] = {}
        texts, before = table.column("letters").to_pylist(), None
        out: list[tuple[int, int, int]] = []
        for number, (rank, start, anchor, text) in enumerate(zip(*(table.column(c).to_pylist() for c in ("rank", "start", "anchor")), texts, strict=True)):
            if (rank, start) == before:
                continue  # of equal rows
            before, at = (rank, start), 0
            while at < len(text):
                source, place = index.setdefault((anchor, text[at : at + 8]), (number, at))
                if source == number:
                    at += 8
                    continue
                length, most = 8, min(len(text) - at, len(texts[source]) - place)
                while length < most and text[at + length : at + length + 8] == texts[source][place + length : place + length + 8]:
                    length += 8
                out.append((rank, start + at // 8, length // 8 + window - 1))
                at += length
        return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("rank", "start", "length"))})

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches (rank, start, anchor, letters) as their windows (rank, start, anchor, letter)."""
    for batch in batches:
        letters = batch.column("letters").to_pylist()
        n = np.array([len(x) >> 3 for x in letters], "i8")
        of, start = np.repeat(np.arange(len(n)), n), batch.column("start").to_numpy().astype("i8")
        at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        rank, anchor = (batch.column(c).take(pa.array(of)) for c in ("rank", "anchor"))
        yield pa.RecordBatch.from_arrays([rank, pa.array(at), anchor, pa.array(np.frombuffer(b"".join(letters), "<i8"))], names=["rank", "start", "anchor", "letter"])


def _kept(window: int):
    """Rows (id, text, spans, again) as (id, n_words, n_removed, removed, kept): what is left outside of the spans.

    ``again`` says that an earlier document has the whole text, so all words that are in a window go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]
        for rows in batches:
            for part, *_ in text_chunks([rows], "text"):
                out = []
                for key, text, spans, again in zip(*(part.column(c) for c in ("id", "text", "spans", "again")), strict=True):
                    drop, total, left = np.zeros(0, bool), 0, []
                    if spans.is_valid and len(spans):
                        a, n = (spans.values.field(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("start", "length"))
                        size = int((a + n).max()) + 1
                        drop = np.cumsum(np.bincount(a, minlength=size) - np.bincount(a + n, minlength=size)) > 0
                    tokens: list[bytes] = []
                    for cut in _cuts(text.as_py().encode()):
                        tokens = cut.split()
                        keep = np.ones(len(tokens), bool)
                        gone = drop[total : total + len(tokens)]
                        keep[: len(gone)] = ~gone
                        left.append(b" ".join(compress(tokens, keep) if len(gone) else tokens))
                        total += len(tokens)
                    if again.as_py() and total >= window:
                        drop, left = np.ones(total, bool), []
                    edge = np.diff(np.concatenate([[False], drop, [False]]).astype("i1"))
                    removed = [{"start": int(i), "length": int(j - i)} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                    out.append((key.as_py(), total, int(drop.sum()), removed, b" ".join(filter(None, left)).decode()))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["id", "n_words", "n_removed", "removed", "kept"])

    return run


PLACE = "cast(rank as decimal(20,0)) * cast(2147483648 as decimal(10,0)) + start"


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, removed, kept) of each row: its text without the words of windows that start earlier too.

    A window is ``window`` words in a row of one document, words being parted by ASCII white space. Earlier is in a document of smaller id, or in the
    same one before. ``removed`` lists the removed runs of words, ``kept`` is the others, joined by one blank. Windows are judged on the input.

    Null and empty texts have no words; an empty table gives no rows. Null ids come last. Rows of one id are documents of their own, in the order of their texts'
    hashes; rows that are equal in id and text are one document and get the same result. Other columns are ignored, whatever their names. Texts of any length
    are taken whole.

    Each window belongs to the stretch of its anchor, and equal windows to stretches of equal anchors. So reference text is kept in blocks by anchor, and a
    document is factored against every block that can hold a factor of it by sending each of its stretches to its anchor's block; anchors that occur once go to none.
    A block holds windows as hashes of 64 bits beside anchors of 64 bits. Equal stretches are reduced to the first before, and an anchor
    that still has very many is dealt by whole windows instead; both are least places with partial aggregation, so no block outgrows a task.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    hashed = given.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    contents = hashed.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.count("*").alias("rows"))
    contents = stage(contents.orderBy(F.asc_nulls_last("owner"), "h1", "h2").withColumn("rank", F.monotonically_increasing_id()))
    repeated = contents.where("rows > 1").select("h1", "h2", "owner", F.lit(True).alias("again"))
    few = repeated.count() <= BROADCAST_ROWS

    def originals(rows: DataFrame) -> DataFrame:
        """One row, or equal ones, of each text."""
        return rows.join(F.broadcast(repeated) if few else repeated, ["h1", "h2"], "left").where("again is null or id <=> owner").drop("owner", "again")

    columns, shape = ["id", "h1", "h2"], "id long, h1 long, h2 long, start array<int>, n array<int>, anchor array<long>"
    texts = originals(hashed) if few else hashed
    anchored = texts.select(*columns, "text").mapInArrow(_anchored(window), shape)
    anchored = stage((anchored if few else originals(anchored)).withColumn("row", F.monotonically_increasing_id()))
    often = stage(anchored.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"))
    seen = anchored.select("row", F.explode(F.arrays_zip("start", "n", "anchor")).alias("s")).select("row", "s.start", "s.n", "s.anchor")
    seen = seen.join(F.broadcast(often) if often.count() <= ANCHORS else often, "anchor")
    found = seen.groupBy("row").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("found"))  # no more than a document has
    one = anchored.groupBy("h1", "h2").agg(F.min("row").alias("row"))
    found = found.join(one, "row").join(contents.select("h1", "h2", "owner", "rank"), ["h1", "h2"])
    met = texts.join(found, ["h1", "h2"]).where("id <=> owner").select("rank", "text", "found")
    held = stage(met.mapInArrow(_lettered(window), "rank long, start int, anchor long, letters binary"))
    unstage(anchored, often)
    # equal stretches are reduced to the first: all others are duplicates as they are
    held_at = held.withColumns({"place": F.expr(PLACE), "s": F.xxhash64("letters")})
    marked = held_at.join(held_at.groupBy("anchor", "s").agg(F.min("place").alias("first")), ["anchor", "s"])
    lead = F.col("place") == F.col("first")
    marked = stage(marked.select("rank", F.col("start").cast("long").alias("start"), (F.length("letters") / 8 + window - 1).cast("long").alias("length"), "anchor", F.when(lead, F.col("letters")).alias("letters")))
    parts = marked.where("letters is null").select("rank", "start", "length")
    leads = marked.where("letters is not null").select("rank", "start", "anchor", "letters")
    busy = stage(leads.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"))
    dealt, many = max(1, -(-leads.count() // BLOCK)), busy.count()
    hot = F.broadcast(busy) if many <= BROADCAST_ROWS else busy
    calm = leads.join(hot, "anchor", "left_anti") if many else leads
    blocks = calm.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(dealt)))
    parts = parts.unionByName(blocks.applyInArrow(_factored(window), "rank long, start long, length long"))
    if many:
        each = leads.join(hot, "anchor", "left_semi").mapInArrow(_windows, "rank long, start long, anchor long, letter long")
        each = stage(each.withColumn("place", F.expr(PLACE)))
        later = each.join(each.groupBy("anchor", "letter").agg(F.min("place").alias("first")), ["anchor", "letter"]).where("place > first")
        parts = parts.unionByName(later.select("rank", "start", F.lit(window).cast("long").alias("length")))
    listed = parts.groupBy("rank").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    verdict = contents.join(listed, "rank", "left").where("rows > 1 or spans is not null").select("h1", "h2", "owner", "spans", F.lit(True).alias("known"))
    verdict = stage(verdict)
    unstage(contents, held, marked, busy, *([each] if many else []))
    rows = hashed.join(verdict, ["h1", "h2"], "left")
    own = F.col("id").eqNullSafe(F.col("owner"))
    rows = rows.select("id", "text", F.when(own, F.col("spans")).alias("spans"), (F.col("known").isNotNull() & ~own).alias("again"))
    return rows.mapInArrow(_kept(window), "id long, n_words long, n_removed long, removed array<struct<start: long, length: long>>, kept string")
