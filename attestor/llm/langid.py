"""Language identification by nearest centroid: TF-IDF n-gram vectors, several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.grams import WORD_BYTE, gram_ids, rows_of
from attestor.llm.shared import FEATURE_BYTES, append_columns, per_class_sample, text_chunks, utf8_rows

BITS = 12
SIZES = (1, 2, 3)
UNKNOWN = "und"
#: Short texts lie farther from any centroid than long ones, so each range of lengths, in letters and single blanks as bytes, has its own floor.
LENGTHS = (12, 24, 48, 96, 192, 384, 768, 1536, 3072)


@dataclass
class Model:
    """``idf`` by n-gram id; ``centroids`` with their ``langs``; ``floor``: the least cosine that is accepted, by centroid and range of lengths."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray


def _folded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each row, runs of other characters as one blank."""
    row, letters = rows_of(at), WORD_BYTE[raw]
    keep = letters | np.concatenate([[True], letters[:-1]])[: len(raw)]
    raw = np.where(letters, raw, 32).astype("u1")[keep]
    return raw, np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(at) - 1))])


def _counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n-gram counts of each folded row."""
    rows, width, row = len(at) - 1, 1 << BITS, rows_of(at)
    found = np.zeros(rows * width, "i8")
    for size in SIZES:
        r, g = gram_ids(raw, at, size, BITS, row)
        found += np.bincount(r * width + g, minlength=rows * width)
    return found.reshape(rows, width)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype("f4")) * idf.astype("f4")
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of (rows, folded lower-cased bytes, bounds)."""
    for rows, _, _ in text_chunks(batches, "text", FEATURE_BYTES):
        yield rows, *_folded(*_cut(*utf8_rows(pc.utf8_lower(rows.column("text")))))


def _cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw[at[0] : at[-1]], at - at[0]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One set of (n-gram id, documents with it) for each task; id -1 has the number of documents."""
    total, docs = np.zeros(1 << BITS, "i8"), 0
    for rows, raw, at in _chunks(batches):
        total += (_counts(raw, at) > 0).sum(0)
        docs += len(rows)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.concatenate([[docs], total]))], names=["gram", "n"])


def _clusters(v: np.ndarray, k: int, rounds: int = 12, least: float = 0.02) -> np.ndarray:
    """Spherical k-means from seeds that are drawn by their squared distance to those before, the same at each run.

    A cluster that ends with less than a share ``least`` of the rows is a few odd texts: its rows go to the others.
    """
    rng = np.random.default_rng(0)
    seeds = [int(rng.integers(len(v)))]
    while len(seeds) < min(k, len(v)):
        far = np.maximum(1 - (v @ v[seeds].T).max(1), 0).astype("f8") ** 2
        seeds.append(int(rng.choice(len(v), p=far / far.sum())) if far.sum() > 0 else len(seeds))
    c = v[seeds]
    for last in (False, True):
        for _ in range(rounds):
            own = (v @ c.T).argmax(1)
            c = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        if not last:
            n = np.bincount((v @ c.T).argmax(1), minlength=len(c))
            c = c[n >= min(least * len(v), n.max())]
    return c


def fit(rows: DataFrame, most: int = 500, per_language: int = 4, low: float = 0.01, slack: float = 0.6) -> Model:
    """Learn from (id, text, lang). Rows without a language or a letter teach nothing.

    Document frequencies cover all rows. Centroids come from a sample of about ``most`` rows of each
    language, clustered in a task for each language. Its floors come from the beginnings of the sampled texts, cut to each range of
    lengths: ``slack`` times their ``low`` quantile of the cosine to the language's own centroids.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("id", "text", "lang")
    stats = {r.gram: r.n for r in rows.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    df = np.array([stats.get(i, 0) for i in range(1 << BITS)])
    idf = np.log((1 + stats.get(-1, 0)) / (1 + df)) + 0.05

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in _chunks(batches):
            texts = [raw[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(texts, pa.binary())], names=["id", "lang", "x"])

    def vectors(texts: list[bytes]) -> np.ndarray:
        at, out = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("i8"), [np.zeros((0, 1 << BITS), "f4")]
        for first in range(0, len(texts), 64):  # counts of few texts at a time
            some = at[first : first + 65]
            out.append(_vectors(_counts(np.frombuffer(b"".join(texts[first : first + 64]), "u1"), some - some[0]), idf))
        return np.concatenate(out)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values(["id", "x"], na_position="first").x.tolist()
        c = _clusters(vectors(texts), per_language)
        floor = np.zeros(len(LENGTHS) + 1)
        for i in range(len(LENGTHS) + 1):
            if cut := [t[: LENGTHS[i]] if i < len(LENGTHS) else t for t in texts if len(t) >= LENGTHS[max(0, i - 1)]]:
                # texts of a range are at least as long as the bound before it
                floor[i] = slack * float(np.quantile((vectors([t[: LENGTHS[max(0, i - 1)]] for t in cut]) @ c.T).max(1), low)) if i else 0.0
            else:
                floor[i] = floor[i - 1]
        return pd.DataFrame({"lang": [group.lang.iloc[0]] * len(c), "c": [x.astype("f4").tobytes() for x in c], "floor": [floor.tolist()] * len(c)})

    sample, _ = per_class_sample(rows, "lang", most)
    found = sample.mapInArrow(folded, "id long, lang string, x binary").groupBy("lang").applyInPandas(learn, "lang string, c binary, floor array<double>")
    learned = sorted(found.collect(), key=lambda r: (r.lang, r.c))
    centroids = np.stack([np.frombuffer(r.c, "f4") for r in learned]) if learned else np.zeros((0, 1 << BITS), "f4")
    return Model(idf, centroids, [r.lang for r in learned], np.array([r.floor for r in learned]))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine with the nearest centroid, 0 to 1) and ``rejected`` to ``docs``.

    Texts that are null, empty or without any letter get ``und`` with score 0 and are rejected. If nothing was
    learned, all texts get ``und`` with score 0, and those with a letter are not rejected: there is no distance to
    judge by. A text nearer to no centroid than its language's floor for its length keeps the nearest language in ``lang_pred``
    and is rejected. Ties go to the first language by name. Columns of ``docs`` with these names are replaced; all
    other columns stay.
    """

    def work(texts: pa.Array, _raw: np.ndarray, _at: np.ndarray) -> list:
        n, lower = len(texts), pc.utf8_lower(texts)
        known = pc.fill_null(pc.match_substring_regex(lower, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
        if not model.langs:
            return [[UNKNOWN] * n, np.zeros(n), ~known]
        raw, at = _folded(*_cut(*utf8_rows(lower)))
        cosine = _vectors(_counts(raw, at), model.idf) @ model.centroids.T
        near = cosine.argmax(1)
        score = np.where(known, np.clip(cosine[np.arange(n), near].astype("f8"), 0, 1), 0.0)
        lang = [model.langs[i] if ok else UNKNOWN for i, ok in zip(near, known, strict=True)]
        return [lang, score, ~known | (score < model.floor[near, np.searchsorted(LENGTHS, np.diff(at), "right")])]

    return append_columns(docs, text_col, ["lang_pred", "score", "rejected"], ["string", "double", "boolean"], work)
