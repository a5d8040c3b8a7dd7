"""Repeated passages against a plain dictionary of windows."""

import random
import re

import pytest

from attestor.llm import queries, substrings
from tests.oracle import difference, engine

SCHEMA = "doc_id long, text string, id int, rank string, spans array<int>"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, window):
    """{(doc_id, text): (n_words, kept words)}; ids do not repeat, but for equal rows."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        words = words_of(text)
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[doc_id, text] = (len(words), [w for i, w in enumerate(words) if i not in gone])
    return out


def check(spark, rows, window=20):
    docs = spark.createDataFrame([(i, t, 1, "x", [1]) for i, t in rows], SCHEMA)
    found = substrings.remove_repeats(docs, window).collect()
    want = plain(rows, window)
    by_id = {i: v for (i, _), v in want.items()}
    assert len(found) == len(rows)
    for r in found:
        n, kept = by_id[r.id]
        assert (r.n_words, r.kept.split(" ") if r.kept else []) == (n, kept), r.id
        assert r.n_removed == n - len(kept) == sum(x.length for x in r.removed)


def texts(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é\xa0x", "　", "A", "a"]
    shared = [" ".join(rnd.choices(vocabulary, k=rnd.randint(15, 90))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [rnd.choice(shared) if rnd.random() < 0.4 else " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))) for _ in range(rnd.randint(0, 5))]
        out.append((i * 3 % 61, rnd.choice([" ", "\n", "\t \r"]).join(parts)))
    return out


@pytest.mark.parametrize("hot", [8192, 1])
@pytest.mark.parametrize("window", [20, 5, 1])
def test_random_texts(spark, monkeypatch, window, hot):
    monkeypatch.setattr(substrings, "HOT", hot)  # one: every anchor is dealt by windows
    monkeypatch.setattr(substrings, "BLOCK", 40)
    check(spark, texts(window), window)


def test_odd_texts(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(5, None), (1, ""), (2, " \n "), (7, "same " * 500), (3, passage), (9, passage + " tail"), (4, passage), (4, passage), (None, passage + " tail"), (8, "a b c d e " * 7), (6, "x\n" + passage)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(-(2**62), passage), (2**62, passage)])


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    found = substrings.remove_repeats(spark.createDataFrame([(1, passage + " a"), (1, passage + " b")], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in found) == [0, 25]


def test_long_texts_are_read_in_windows(spark, monkeypatch):
    rows = texts(9, 8)
    long = " ".join(t for _, t in texts(1) if t) * 20
    check(spark, [*rows, (1000, long)])
    monkeypatch.setattr(substrings, "WINDOW", 50)
    import numpy as np

    raw = np.frombuffer(long.encode(), "u1")
    small = substrings.word_hashes(raw, np.array([0, len(raw)]))[1]
    monkeypatch.undo()
    assert (small == substrings.word_hashes(raw, np.array([0, len(raw)]))[1]).all()


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(spark, queries.op11_substring_dedup, queries.REPEATS_SQL, folder, engine(folder)) is None
