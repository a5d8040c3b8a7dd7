import corpus_pipeline as pipeline
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm import langid, pii, queries, toxicity

D = "/root/testdata/sf0.001"


def simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def leads(texts):
    fps = {i: simhash(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {i for i in texts if root[i] == i}


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = [{r.doc_id: r.text for r in docs.collect()}]
    for i, (_, step) in enumerate(pipeline.STAGES[:-1]):
        out = step(spark, docs, D)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        texts.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(texts[-1])
    start = spark.read.parquet(f"{D}/documents.parquet")
    near = {r.doc_id for r in langid.predict(start, queries.language_model(start)).collect() if not r.rejected}
    assert texts[1] == {i: t for i, t in texts[0].items() if i in near} and len(texts[1]) >= 0.98 * len(texts[0])
    first = spark.read.parquet(f"{tmp_path}/0")
    scores = toxicity.predict(first, queries.toxicity_model(first, spark.read.parquet(f"{D}/labels.parquet"))).collect()
    assert texts[2] == {r.doc_id: r.text for r in scores if r.score < 0.7}
    assert texts[3] == {i: t for i, t in texts[2].items() if i in leads(texts[2])}
    assert texts[4] == {i: pii.mask_text(t) for i, t in texts[3].items()}
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pipeline.STAGES[-1][1](spark, docs, D).collect()
    length, used = {}, {}
    for r in rows:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert length == {i: len(theirs.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts[4].items()}
    for content in used.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 2048


def test_run_gives_the_same_rows_as_the_stages(spark):
    found = pipeline.run(spark, D)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(found.columns) and found.count() > 150


def test_edge_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "the thing was there " * 5000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, "and the other was here", "en", None, 2), (None, "this is what the thing was", "en", "s", 3)]
    docs = spark.createDataFrame(rows, schema)
    for _, step in pipeline.STAGES:
        before, docs = docs, step(spark, docs, D)
        assert docs.count() >= 1 and before.limit(0).count() == 0
    empty = spark.createDataFrame([], schema)
    for _, step in pipeline.STAGES:
        empty = step(spark, empty, D)
        assert empty.count() == 0


def test_near_duplicates_leave_one_row_of_each_text_whatever_the_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two, three, four, five = ("red green blue", "sun moon stars", "tea milk sugar", "iron steel copper", "oak elm ash")
    rows = [(None, one), (None, two), (None, two), (None, three), (1, three), (2, four), (2, five), (2, five), (4, one), (5, five)]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], schema)
    out = pipeline.drop_near_duplicates(spark, docs, D)
    assert out.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([(None, two), (1, three), (2, four), (2, five), (4, one)], key=key)
    mixed = spark.createDataFrame([(6, one, "en", None, 1), (6, one, None, "en", 1), (6, one.upper(), "en", None, 1)], schema)
    kept = [pipeline.drop_near_duplicates(spark, mixed.repartition(n), D).collect() for n in (1, 3)]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_columns_of_any_name_stay_as_they_are(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = ("score", "rejected", "sentences", "lang_pred", "_mark", "_lead", "_rows", "mark", "lead", "rows", "c0", "row")
    odd = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names}).withColumn("m", F.create_map("lang", "doc_id"))
    odd = odd.unionByName(odd.where("doc_id < 5"))
    for i, (_, step) in enumerate(pipeline.STAGES[:-1]):
        out = step(spark, odd, D)
        assert out.dtypes == odd.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        odd = spark.read.parquet(f"{tmp_path}/{i}")
    rows = odd.collect()
    assert len(rows) == len({r.doc_id for r in rows}) > 100
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names) and all(list(r.m.values()) == [r.doc_id] for r in rows)
    assert pipeline.STAGES[-1][1](spark, odd, D).count() >= len(rows)
