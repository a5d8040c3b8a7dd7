"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.grams import WORD_BYTE, rows_of, words
from attestor.llm.shared import FEATURE_BYTES, append_columns, per_class_sample, stage, sums_by_row, text_chunks, unstage

#: Besides each word, its first so many bytes are a feature: stems carry over to words not seen before.
PREFIXES = (4, 5, 6, 7, 8)
#: Features are first looked up in a bit table of this width, then exactly.
BITS = 20
#: Added to a fitted bias: what was learned to be even counts as 0.7.
RAISE = math.log(0.7 / 0.3)
#: With so many documents the ridge has half of its weight; fewer draw less.
HALF = 1000
#: A text is read in windows of about so many bytes, cut where a sentence or a word ends.
WINDOW = 1 << 21
#: ASCII capitals are lower-cased; these bytes end a sentence, and so do these signs of other scripts, by their UTF-8 bytes.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype("u1")
STOP = np.isin(np.arange(256), list(b".!?\n"))
WIDE_STOPS = tuple(c.encode() for c in "。！？｡؟۔।…")


@dataclass
class Model:
    """A sentence's logit is ``bias`` plus the ``weights`` of its features, whose sorted hashes are ``known``; without a known feature it is no sign of anything."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[self.known >> np.uint64(64 - BITS)] = True

    def word_weights(self, hashes: np.ndarray) -> np.ndarray:
        """The sum of each word's feature weights."""
        out = np.zeros(len(hashes))
        for column in hashes.T:
            at = np.flatnonzero(self.maybe[column >> np.uint64(64 - BITS)])
            if len(at) and len(self.known):
                place = np.minimum(np.searchsorted(self.known, column[at]), len(self.known) - 1)
                out[at] += np.where(self.known[place] == column[at], self.weights[place], 0.0)
        return out


def _plain(raw: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, with dots in the place of other scripts' signs that end a sentence."""
    out = LOWER[raw]
    if len(raw) and raw.max() > 127:
        for sign in WIDE_STOPS:
            n = max(0, len(raw) - len(sign) + 1)
            hit = np.ones(n, bool)
            for i, b in enumerate(sign):
                hit &= raw[i : n + i] == b
            at = np.flatnonzero(hit)
            for i in range(len(sign)):
                out[at + i] = 46
    return out


def _windows(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bounded parts of a run of texts: (bytes, bounds within them). Only a text longer than a window is cut.

    It is cut after a sentence's end, or else before a byte that is part of no word; only a word that fills a window is cut itself.
    """
    if len(raw) <= WINDOW or len(at) > 2:
        yield raw, at
        return
    done = 0
    while done < len(raw):
        part = raw[done : done + WINDOW]
        if done + WINDOW < len(raw):
            ends = np.flatnonzero(STOP[_plain(part)]) + 1
            ends = ends if len(ends) else np.flatnonzero(~WORD_BYTE[part])
            part = part[: int(ends[-1])] if len(ends) and ends[-1] else part
        yield part, np.array([0, len(part)])
        done += len(part)


def _instances(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each word, first word of each sentence, row of each sentence, start byte of each sentence's first word)."""
    row, raw = rows_of(at), _plain(raw)
    start, r, h = words(raw, row, prefixes=PREFIXES)
    sentence = np.cumsum(STOP[raw])[start] if len(start) else start
    new = np.ones(len(start), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    return h, first, r[first], start[first]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _scored(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, row, start byte) of each sentence of a run of texts."""
    found, done = [], 0
    for part, bounds in _windows(raw, at):
        hashes, first, row, start = _instances(part, bounds)
        weight, ends = model.word_weights(hashes), np.append(first, len(hashes))
        told = (sums_by_row((weight != 0).astype("f8"), ends) > 0) if len(model.known) else np.ones(len(first), bool)
        found.append((np.where(told, model.bias + sums_by_row(weight, ends), -np.inf), row, start + done))
        done += len(part)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0, "i8"), np.zeros(0, "i8"))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, n, feature, sentence) of each row, one entry for each feature of a sentence."""
    for part, raw, at in text_chunks(batches, "text", FEATURE_BYTES):
        hashes, first, row, _ = _instances(raw, at)
        per_sentence = np.diff(np.append(first, len(hashes)))
        cut = np.searchsorted(np.repeat(row, per_sentence), np.arange(len(part) + 1))
        start = np.searchsorted(row, np.arange(len(part) + 1))
        sentence = np.repeat(np.arange(len(first)), per_sentence)
        out = []
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            pair = np.stack([hashes[a:b].reshape(-1), np.repeat(sentence[a:b] - start[i], hashes.shape[1]).astype("u8")], 1)
            pair = np.unique(pair[pair[:, 0] != 0], axis=0)
            out.append((pair[:, 0].view("i8"), pair[:, 1].astype("i4")))
        feature, within = pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(np.diff(start)), feature, within], names=["id", "y", "n", "feature", "sentence"])


def fit(rows: DataFrame, most: int = 2000, least_docs: int = 8, lift: float = 4.0, ridge: float = 2.0, rounds: int = 200) -> Model:
    """Learn from (id, text, y) of a sample of about ``most`` rows a class, each class weighted to its share of all rows.

    A feature has a weight if at least ``least_docs`` sampled documents have it and its share among class 1
    is ``lift`` times that among class 0. These are counted by Spark; only the bags of such features come to the driver. Sentences without such a feature are left out.
    The ridge draws sentences towards the middle, so afterwards the bias is raised by ``RAISE``. Without rows of
    both classes the model scores every text about 0 (or 1 if only class 1 was seen and the text has a word).
    """
    sample, n = per_class_sample(rows, "y", most)
    if len(n) < 2:
        return Model(np.zeros(0, "u8"), np.zeros(0), 9.0 if 1 in n else -30.0)
    bags = stage(sample.mapInArrow(_bags, "id long, y int, n long, feature array<long>, sentence array<int>"))
    docs = {r.y: r.docs for r in bags.groupBy("y").agg(F.count("*").alias("docs")).collect()}
    seen = bags.select("y", F.explode(F.array_distinct("feature")).alias("feature"))
    counted = seen.groupBy("feature").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    rate = [F.col(f"n{c}") / F.lit(max(1, docs.get(c, 0))) for c in (0, 1)]
    chosen = counted.where((F.col("n0") + F.col("n1") >= least_docs) & (rate[1] > lift * rate[0])).select("feature")
    known = np.sort(np.array([r.feature for r in chosen.collect()], "i8").view("u8"))

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_in, sentences_in = [], []
            for f, s in zip(batch.column("feature"), batch.column("sentence"), strict=True):
                f, s = f.values.to_numpy(zero_copy_only=False).view("u8"), s.values.to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(known, f), max(0, len(known) - 1))
                ok = np.flatnonzero(known[place] == f) if len(known) and len(f) else np.zeros(0, "i8")
                words_in.append(place[ok].astype("i4").tobytes())
                sentences_in.append(s[ok].astype("i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words_in, pa.binary()), pa.array(sentences_in, pa.binary())], names=["id", "y", "n", "word", "sentence"])

    taken = sorted(bags.mapInArrow(weighted, "id long, y int, n long, word binary, sentence binary").collect(), key=lambda r: (r.id if r.id is not None else -1, r.word, r.sentence))
    unstage(bags)
    y, length = np.array([r.y for r in taken], "f8"), np.array([r.n for r in taken], "i8")
    base = np.concatenate([[0], np.cumsum(length)])
    word = np.concatenate([np.frombuffer(r.word, "i4") for r in taken])
    sentence = np.concatenate([np.frombuffer(r.sentence, "i4") + b for r, b in zip(taken, base, strict=False)])
    owner, total = np.repeat(np.arange(len(y)), length), int(base[-1])
    share = np.array([n[c] / max(1, (y == c).sum()) for c in (0, 1)])[y.astype(int)]
    share /= share.sum()
    told = np.bincount(sentence, minlength=total) > 0
    drawn = ridge * len(y) / (len(y) + HALF)
    w = np.zeros(len(known) + 1)
    w[-1] = -5.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = w[-1] + np.bincount(sentence, w[word], minlength=total)
        s = np.maximum(np.bincount(owner, _softplus(z) * told, minlength=len(y)), 1e-12)  # -log of the chance that no sentence offends
        by_doc = share * ((1 - y) - y * np.exp(-s) / -np.expm1(-s))
        by_sentence = told * by_doc[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, by_sentence[sentence], minlength=len(w) - 1), by_sentence.sum())
        grad[:-1] += drawn * w[:-1] / len(y)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    used = np.abs(w[:-1]) > 0.05
    return Model(known[used], w[:-1][used], float(w[-1]) + RAISE)


SENTENCES = "array<struct<start: long, stop: long, score: double>>"


def predict(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score``, the noisy-or of the offending sentences of each whole text, and ``sentences``, these, to ``docs``.

    An offending sentence, (start, stop, score), scores ``threshold`` or more; positions are code points of the text, from the sentence's first word to the next
    sentence's first word (or the text's end). Other sentences add nothing, so clean text around an offending sentence neither hides it nor adds up to one, however long it is.
    A text without an offending sentence has the score of its likeliest one; one without words, empty or null, scores 0. Columns of these names are replaced, all other
    columns stay.
    """

    def work(_texts: pa.Array, raw: np.ndarray, at: np.ndarray) -> list:
        z, row, start = _scored(model, raw, at)
        n = len(at) - 1
        p, out, score = 1 / (1 + np.exp(-z)), [[] for _ in range(n)], np.zeros(n)
        np.maximum.at(score, row, p)
        found = np.flatnonzero(p >= threshold)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype="i8")]) if len(found) else None
        for i in found:
            end = start[i + 1] if i + 1 < len(z) and row[i + 1] == row[i] else at[row[i] + 1]
            base = points[at[row[i]]]
            out[row[i]].append({"start": int(points[start[i]] - base), "stop": int(points[end] - base), "score": float(p[i])})
        joined = -np.expm1(-np.bincount(row[found], _softplus(z[found]), minlength=n))
        return [np.where(joined > 0, joined, score), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])))]

    return append_columns(docs, text_col, ["score", "sentences"], ["double", SENTENCES], work)
