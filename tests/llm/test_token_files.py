import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestor.llm import queries, token_files, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    ours, theirs = token_ids.load(path), Tokenizer.from_file(path)
    texts = ["", None, " ", "a b  c", " a", "a ", "a\nb \n c", "x\x1cy z", "<|endoftext|> a<|endoftext|>", "it's we'll", "é漢字 😀 1234", "a b " * 5000, "a\xa0b c", "tab \t end", "w" * 3000]
    for text in [*texts, *texts]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text or "", add_special_tokens=False).ids


def check(found, docs, theirs):
    start = 0
    found = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in found] == [d for d, _ in docs]
    for r, (_, text) in zip(found, docs, strict=True):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("most", [10_000, 5])
def test_round_trip_over_many_parts(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(token_files, "PART_DOCS", 3)
    monkeypatch.setattr(token_files, "MOST_PARTS", most)
    monkeypatch.setattr(token_files, "READ_DOCS", 2)
    docs = [(i * 7 - 20, t) for i, t in enumerate([None, "", "one two", "! !", "x " * 4000, "é", "same", "same", *(f"doc {k}" for k in range(300))])]
    rows = spark.createDataFrame([(*d, 1) for d in reversed(docs)], "doc_id long, text string, start int").repartition(5)
    parts = token_files.write(rows, str(tmp_path), PATH)
    assert parts.count() > 64
    check(token_files.read(spark, str(tmp_path), parts).collect(), docs, Tokenizer.from_file(PATH))
    assert token_files.document(str(tmp_path), 0, 1).tolist() == [0]
    ranges = token_files.IdRanges(*token_files._store(str(tmp_path)), 0)
    whole = ranges[0:4].tolist()
    ranges.whole, ranges.file = None, open(ranges.path, "rb")  # noqa: SIM115
    ranges.file = type("File", (), {"read_at": lambda self, n, at, f=ranges.file: (f.seek(at), f.read(n))[1]})()
    assert ranges[0:4].tolist() == whole and ranges[1:3].tolist() == whole[1:3]


def test_repeated_null_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(5, "b"), (5, "b"), (None, "c"), (5, None)], "doc_id long, text string")
    found = token_files.read(spark, str(tmp_path / "a"), token_files.write(rows, str(tmp_path / "a"), PATH)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 2), (5, 1), (5, 2), (5, 2)]
    assert sorted(r.start for r in found) == [0, 2, 3, 5]
    assert token_files.read(spark, str(tmp_path / "b"), token_files.write(rows.limit(0), str(tmp_path / "b"), PATH)).count() == 0


def test_query_on_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    check(queries.op6_token_files(spark, d).collect(), docs, Tokenizer.from_file(PATH))
