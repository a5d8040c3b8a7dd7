"""Phrases of two and three words that belong together, by bitmaps of word positions that are shifted, intersected and counted."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.shared import stage, unstage

#: Bytes of text of a shard, about (an 8 MB text has less than 2 to the 28 words, by which words are numbered); and entries of bitmaps that are extended at a time.
SHARD_BYTES, SLICE = 8 << 20, 1 << 15
#: A-Z in lower case; signs that end a piece become line feeds, blanks and tabs stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Stands between pieces. No UTF-8 text has this byte.
GAP = b"\xff"


def _shards(data: bytes) -> Iterator[bytes]:
    """Parts of about ``SHARD_BYTES``, cut between pieces; only a longer piece makes a longer part."""
    while len(data) > SHARD_BYTES:
        cut = data.rfind(b"\n", 0, SHARD_BYTES)
        cut = cut if cut >= 0 else data.find(b"\n", SHARD_BYTES)
        if cut < 0:
            break
        yield data[:cut]
        data = data[cut + 1 :]
    yield data


def _numbered(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, n, ids): the words of a shard by first appearance, how often each occurs, and the number of the word at each position.

    Gaps between pieces take a position too, with number 0, so no phrase reaches over one; the first word has number 1.
    """
    tokens = data.replace(b"\n", b" " + GAP + b" ").split()
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    number[GAP]
    ids = np.fromiter(map(number.__getitem__, tokens), "<u4", len(tokens))
    return list(number)[1:], np.bincount(ids, minlength=len(number))[1:], ids


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) as shards (shard, lang, ids, words, n); a shard holds texts of one language from one partition."""
    held: defaultdict[str, list[bytes]] = defaultdict(list)
    size: defaultdict[str, int] = defaultdict(int)
    base, numbers = TaskContext.get().partitionId() << 16, count()

    def made(lang: str) -> Iterator[pa.RecordBatch]:
        data = b"\n".join(held.pop(lang)).translate(PLAIN)
        size.pop(lang)
        for part in _shards(data):
            words, n, ids = _numbered(part)
            listed = pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([base + next(numbers)]), pa.array([lang]), pa.array([ids.tobytes()]), listed, pa.array([n], pa.list_(pa.int64()))], names=["shard", "lang", "ids", "words", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
            lang, text = lang.as_py(), text.as_py()
            held[lang].append(text)
            size[lang] += len(text) + 1
            if size[lang] >= SHARD_BYTES:
                yield from made(lang)
    for lang in list(held):
        yield from made(lang)


def bitmaps(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, bits): the compressed bitmap of each word's positions, words in order; positions with a negative word are in none.

    A bitmap is cut into runs of 16 positions; only runs with a position are held, by their number (``key``) and their ``bits``.
    """
    at = np.flatnonzero(ids >= 0)
    run = ids[at] << 40 | at >> 4
    order = np.argsort(run, kind="stable")
    run, at = run[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run
    bits = np.bitwise_or.reduceat((1 << (at & 15)).astype("u2"), first) if len(run) else run.astype("u2")
    return run[first] >> 40, run[first] & ((1 << 40) - 1), bits


class _Shard:
    """The bitmaps of one shard, by run of positions: which words have bits there."""

    def __init__(self, word: np.ndarray, key: np.ndarray, bits: np.ndarray, words: int) -> None:
        order = np.argsort(key, kind="stable")
        self.word, self.bits, self.words = word[order], bits[order], words
        self.start = np.searchsorted(key[order], np.arange(int(key.max(initial=0)) + 3))

    def extend(self, node: np.ndarray, key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shift the nodes' bitmaps by one position and intersect them with those of all words.

        Returns the children's (node, word, popcount), and the entries of their bitmaps (child, key, bits).
        """
        carry = np.flatnonzero(bits >> 15)
        node, key = np.concatenate([node, node[carry]]), np.concatenate([key, key[carry] + 1])
        bits = np.concatenate([bits << 1, np.ones(len(carry), "u2")])
        n = self.start[key + 1] - self.start[key]
        of = np.repeat(np.arange(len(key)), n)
        at = np.arange(len(of)) + np.repeat(self.start[key] - np.cumsum(n) + n, n)
        both = bits[of] & self.bits[at]
        some = np.flatnonzero(both)
        both, of = both[some], of[some]
        child = node[of] * self.words + self.word[at[some]]
        order = np.argsort(child, kind="stable")
        child, of, both = child[order], of[order], both[order]
        new = np.concatenate([[True], child[1:] != child[:-1]]) if len(child) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        total = np.add.reduceat(np.bitwise_count(both).astype("i8"), first) if len(first) else first
        return child[first] // self.words, child[first] % self.words, total, np.cumsum(new) - 1, key[of], both


def _mine(shard: pa.Table, known: pa.Table) -> pa.Table:
    """(x, y, z, a) of one shard (ids) and its frequent words (idx, id): its phrases of two (z is -1) and three words, and how often they occur.

    Depth first: a slice of first words is extended to pairs and these at once to triples, before the next slice.
    """
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, "i8"),) * 4]
    if len(shard) and len(known):
        at, ids = np.frombuffer(shard.column("ids")[0].as_py(), "<u4"), known.column("id").to_numpy()
        local = np.full(int(at.max(initial=0)) + 1, -1)
        local[known.column("idx").to_numpy() + 1] = np.arange(len(ids))
        word, key, bits = bitmaps(local[at])
        words, cut = _Shard(word, key, bits, len(ids)), np.searchsorted(word, np.arange(len(ids) + 1))
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(cut, cut[first] + SLICE, "right")) - 1)
            a, b = cut[first], cut[last]
            x, y, n, node, k, m = words.extend(word[a:b], key[a:b], bits[a:b])
            out.append((ids[x], ids[y], np.full(len(x), -1), n))
            xy, z, n, *_ = words.extend(node, k, m)
            out.append((ids[x[xy]], ids[y[xy]], ids[z], n))
            first = last
    return pa.table({name: pa.chunked_array([c[i] for c in out]) for i, name in enumerate(("x", "y", "z", "a"))})


def _score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 a a / (left right))``, exact for counts of up to 16 digits."""
    wide = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"cast(1000000 as decimal(7,0)) * cast({wide(a)} * {wide(a)} as decimal(31,0)) div ({wide(left)} * {wide(right)})")


def mine(docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    A-Z are lower-cased; texts are parted at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words. ``n`` counts all words
    of a language, ``a`` a phrase within pieces, overlaps included; phrases with ``a`` of ``least`` or more are candidates. Of the ways to
    cut one in two, with ``l`` and ``r`` the counts of its parts, that with the lowest score holds, ties to the shorter first part. A
    candidate is dropped if a longer one holds it and has ``share`` percent of its count or more. Order is by score, then ``a``, both descending, then
    the phrase's UTF-8 bytes.

    Null texts are empty, null languages are ``und``; empty tables, and texts without words, give no rows. Repeated rows count each time. Texts of any length
    are taken whole: they are cut into shards between pieces only, so memory follows the longest piece. Other columns, whatever their names, are ignored.

    Shards of texts hold a bitmap of positions a word. Only words of ``least`` or more occurrences in their language get a number and are
    mined; each shard extends them depth-first, and counts are summed over shards, with partial sums, so neither a language nor a word
    with a large share of all text comes together in one task.
    """
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(text_col, F.lit("")))
    index = stage(given.toDF("lang", "text").mapInArrow(_index, "shard long, lang string, ids binary, words array<string>, n array<long>"))
    each = index.select("shard", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("idx", "w")).select("shard", "lang", "idx", "w.words", "w.n")
    # a word has a row a shard; its number is the place of the first of them
    same = Window.partitionBy("lang", "word")
    place = F.shiftleft("shard", 28) + F.col("idx")
    each = each.withColumnRenamed("words", "word").withColumns({"total": F.sum("n").over(same), "id": F.min(place).over(same)}).where(F.col("total") >= least)
    own = lambda c: F.when(F.col("id") == place, F.col(c)).alias(c)
    known = stage(each.select("shard", "idx", "id", own("lang"), own("word"), own("total")))
    words = known.where("word is not null").select("id", "lang", "word", F.col("total").alias("n"))
    found = index.select("shard", "ids").groupBy("shard").cogroup(known.select("shard", "idx", "id").groupBy("shard")).applyInArrow(_mine, "x long, y long, z long, a long")
    # shards hardly share phrases with others of their task, so rows are summed after the shuffle only; a phrase has a row a shard
    phrases = stage(found.repartition("x", "y", "z").groupBy("x", "y", "z").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    totals = index.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda s, n: s + n).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = stage(totals)
    unstage(index)
    pairs, triples = phrases.where("z < 0").drop("z"), phrases.where("z >= 0")
    longer = triples.select("x", "y", "a").unionByName(triples.selectExpr("y as x", "z as y", "a")).groupBy("x", "y").agg(F.max("a").alias("most"))
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}w"), F.col("n").alias(f"{c}n"), *([F.col("lang")] if c == "x" else []))
    two = pairs.join(longer, ["x", "y"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))).join(named("x"), "x").join(named("y"), "y")
    two = two.select("lang", F.concat_ws(" ", "xw", "yw").alias("phrase"), "a", F.col("xn").alias("l"), F.col("yn").alias("r"), _score("a", "xn", "yn").alias("score"))
    three = triples.join(pairs.withColumnRenamed("a", "head"), ["x", "y"]).join(pairs.selectExpr("x as y", "y as z", "a as tail"), ["y", "z"])
    three = three.join(named("x"), "x").join(named("y").drop("yn"), "y").join(named("z"), "z")
    first, second = _score("a", "xn", "tail"), _score("a", "head", "zn")
    one = F.struct(first.alias("score"), F.col("xn").alias("l"), F.col("tail").alias("r"))
    cut = F.when(second < first, F.struct(second.alias("score"), F.col("head").alias("l"), F.col("zn").alias("r"))).otherwise(one)
    three = three.select("lang", F.concat_ws(" ", "xw", "yw", "zw").alias("phrase"), "a", cut.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
