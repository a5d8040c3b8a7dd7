"""Phrases against counts of n-grams."""

import random
import re
from collections import Counter
from functools import cmp_to_key

import numpy as np

from attestor.llm import phrases, queries
from tests.oracle import difference, engine


def plain(rows, top=2000, least=10):
    out = []
    for lang in {lg if lg is not None else "und" for lg, _ in rows}:
        one, two, three = Counter(), Counter(), Counter()
        for lg, text in rows:
            if (lg if lg is not None else "und") == lang:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    one.update(w)
                    two.update(zip(w, w[1:], strict=False))
                    three.update(zip(w, w[1:], w[2:], strict=False))
        n = sum(one.values())
        found = []
        for p, a in [*two.items(), *three.items()]:
            if a < least:
                continue
            if len(p) == 2 and any(100 * f >= 50 * a for q, f in three.items() if f >= least and p in (q[:2], q[1:])):
                continue
            f = lambda q: one[q[0]] if len(q) == 1 else two[q]
            score, _, left, right = min((10**6 * a * a // (f(p[:k]) * f(p[k:])), k, f(p[:k]), f(p[k:])) for k in range(1, len(p)))
            found.append((score, a, " ".join(p).encode(), left, right))
        found.sort(key=cmp_to_key(lambda x, y: (x[0] < y[0]) - (x[0] > y[0]) or (x[1] < y[1]) - (x[1] > y[1]) or (x[2] > y[2]) - (x[2] < y[2])))
        out += [(lang, i, p.decode(), a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def rows(seed, n=200):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "City", "é", "É", "x-y", "\x00", "\x1c", "a", "b"]
    return [(rnd.choice(["en", "fr", None, ""]), "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rnd.randint(0, 60)))) for _ in range(n)] + [("en", None), (None, ""), ("en", "New york City " * 50)]


def found(spark, given, **options):
    docs = spark.createDataFrame([(lg, t, 1, "x") for lg, t in given], "lang string, text string, word int, id string")
    return sorted(map(tuple, phrases.mine(docs, **options).collect()))


def test_random_texts(spark, monkeypatch):
    given = rows(1)
    assert found(spark, given) == plain(given)
    assert found(spark, given, top=7) == plain(given, top=7)
    monkeypatch.setattr(phrases, "SLICE", 16)
    assert found(spark, given, least=3) == plain(given, least=3)


def test_odd_input(spark):
    assert found(spark, []) == [] and found(spark, [("en", None), ("en", "one two")]) == []
    long = [("en", "a b c. " * 20_000)]
    assert found(spark, long) == plain(long)


def test_texts_are_cut_between_pieces_only(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 10)
    assert list(phrases._shards(b"aa bb\ncc dd ee ff gg hh\nx\ny")) == [b"aa bb", b"cc dd ee ff gg hh", b"x\ny"]


def test_bitmaps_hold_every_position():
    ids = np.random.default_rng(0).integers(-1, 5, 1000)
    word, key, bits = phrases.bitmaps(ids)
    back = sorted((int(w), int(k) * 16 + b) for w, k, v in zip(word, key, bits, strict=True) for b in range(16) if int(v) >> b & 1)
    assert back == sorted((int(w), i) for i, w in enumerate(ids) if w >= 0)


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(spark, queries.op12_phrase_mining, queries.PHRASES_SQL, folder, engine(folder)) is None
