import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from attestor.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def spread(slots):
    return [(s.length, s.bin + i // s.each, s.offset + i % s.each * s.length) for s in slots for i in range(s.count)]


def whole(rows, capacity):
    """Bins have no gap inside, no overlap, and end within the capacity; returns their number."""
    bins = {}
    for n, b, at in rows:
        bins.setdefault(b, []).append((at, n))
    for content in bins.values():
        end = 0
        for at, n in sorted(content):
            assert at == end
            end += n
        assert end <= capacity
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_is_whole_and_as_tight_as_best_fit():
    rng = random.Random(4)
    for trial in range(300):
        capacity = rng.choice([1, 2, 7, 30, 100])
        lengths = [rng.randint(1, capacity) if trial % 3 else rng.choice([1, capacity, max(1, capacity // 3), max(1, capacity // 2)]) for _ in range(rng.randint(0, 80))]
        slots = packing.plan(Counter(lengths), capacity)
        rows = spread(slots)
        assert Counter(n for n, _, _ in rows) == Counter(lengths)
        for n in set(lengths):  # ranks of a length are used once each
            used = sorted(r for s in slots if s.length == n for r in range(s.rank, s.rank + s.count))
            assert used == list(range(lengths.count(n)))
        bins = whole(rows, capacity)
        assert -(-sum(lengths) // capacity) <= bins <= best_fit_decreasing(lengths, capacity) * 1.05 + 1
        large = Counter(b for n, b, _ in rows if 3 * n > capacity)
        assert max(large.values(), default=0) <= 2


def test_plan_does_not_grow_with_counts():
    rng = random.Random(1)
    small = {n: rng.randint(1, 5) for n in range(1, 2049)}
    large = {n: c * 10**9 + rng.randint(0, 9) for n, c in small.items()}
    assert len(packing.plan(large)) <= 20 * 2048
    assert sum(s.count for s in packing.plan(large)) == sum(large.values())


def test_pieces_and_places_of_documents(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "same text", "same text", "word " * 9000] + [" ".join(["tok"] * rng.randint(1, 200)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, length int, offset int")
    found = packing.pack_documents(docs, PATH, 64).collect()
    theirs, capacity = Tokenizer.from_file(PATH), 64
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 0]
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids)
        assert all(r.length == capacity for r in rows[1:]) and (len(rows) == 1 or len(ids) > capacity)
        start = 0
        for r in rows:
            assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(ids[start : start + r.length], "<u4").tobytes())
            start += r.length
    whole([(r.length, r.sequence_id, r.offset) for r in found], capacity)


def test_repeated_rows_empty_table_and_other_columns(spark):
    rows = spark.createDataFrame([(3, 7, "n"), (3, 7, "n"), (3, 7, "n"), (9, None, None)], "length int, rank long, run string")
    found = packing.pack(rows, 10).collect()
    assert whole([(r.length, r.sequence_id, r.offset) for r in found], 10) == 2
    assert found[0].asDict().keys() == {"length", "rank", "run", "sequence_id", "offset"}
    assert packing.pack(rows.limit(0), 10).count() == 0


def test_the_plan_goes_to_spark_without_python_workers(spark, monkeypatch):
    given, real = [], type(spark).createDataFrame
    cut = spark.range(50).selectExpr("id as doc_id", "0 as piece", "0L as start", "id * 40 + 1 as length")
    empty = cut.where("doc_id < 0")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *rest, **named: given.append(data) or real(self, data, *rest, **named))
    rows = packing.pack(cut, 2048).collect()
    assert given and all(isinstance(x, pa.Table) for x in given)
    whole([(r.length, r.sequence_id, r.offset) for r in rows], 2048)
    assert sorted(r.length for r in rows) == [i * 40 + 1 for i in range(50)] and packing.pack(empty, 2048).count() == 0
