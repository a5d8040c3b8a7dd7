import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from attestor.llm import grams, langid, queries

WORDS = {"aa": "lorem ipsum dolor sit amet", "bb": "zwei drei vier funf acht", "cc": "quick brown foxes jumped over"}


def rows(spark):
    made = [(i, " ".join(w.split()[(i * 7 + k * k) % 5] for k in range(3 + i % 9)), lang) for i, (lang, w) in enumerate(list(WORDS.items()) * 30)]
    return spark.createDataFrame(made, "id long, text string, lang string")


def test_known_languages_and_edge_cases(spark):
    model = langid.fit(rows(spark), per_language=2)
    assert sorted(set(model.langs)) == ["aa", "bb", "cc"] and len(model.langs) == 6
    texts = ["Lorem IPSUM dolor", "drei vier", "foxes jumped", None, "", "12 !? 34", "ж" * 500, "acht " * 60000]
    docs = spark.createDataFrame([(t, 1.5, None) for t in texts], "body string, score double, c0 string")
    found = langid.predict(docs, model, "body").collect()
    assert [r.lang_pred for r in found[:3]] == ["aa", "bb", "cc"] and found[7].lang_pred == "bb"
    assert [(r.lang_pred, r.score, r.rejected) for r in found[3:6]] == [("und", 0.0, True)] * 3
    assert found[6].rejected and found[6].lang_pred != "und" and not found[0].rejected
    assert found[0].asDict().keys() == {"body", "c0", "lang_pred", "score", "rejected"}


def test_counts_match_a_plain_loop():
    texts = ["ab  c", "", "d", "é-é"]
    data = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, data)])
    counts = langid._counts(*langid._folded(np.frombuffer(b"".join(data), "u1"), at))
    sizes = [[max(0, n - k + 1) for k in langid.SIZES] for n in (4, 0, 1, 5)]
    assert counts.sum(1).tolist() == [sum(s) for s in sizes]


def test_nothing_learned_and_empty_table(spark):
    model = langid.fit(spark.createDataFrame([(1, None, "aa"), (2, "1", "bb"), (3, "x", None)], "id long, text string, lang string"))
    assert model.langs == []
    docs = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert langid.predict(docs, model).first().lang_pred == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    found = queries.op7_language_id(spark, d).toPandas()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{d}/documents.parquet'").fetchall())
    assert len(found) == len(lang) and (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() >= 0.95


def plain_score(text, model):
    """The nearest centroid's language and cosine, n-gram by n-gram."""
    letters = re.sub(rb"[^a-zA-Z\x80-\xff]+", b" ", text.lower().encode())
    counts = Counter()
    for size in langid.SIZES:
        for i in range(len(letters) - size + 1):
            code = size
            for b in letters[i : i + size]:
                code = (code * 257 + b) % (1 << 64)
            counts[code * int(grams.MULT) % (1 << 64) >> (64 - langid.BITS)] += 1
    v = np.zeros(1 << langid.BITS)
    for g, n in counts.items():
        v[g] = math.log1p(n) * model.idf[g]
    cosine = model.centroids.astype("f8") @ (v / max(1e-12, np.linalg.norm(v)))
    return model.langs[int(cosine.argmax())], float(cosine.max())


def test_scores_equal_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = queries.language_model(docs)
    for r in langid.predict(docs.where("doc_id < 120").select("doc_id", "text"), model).collect():
        lang, score = plain_score(r.text or "", model)
        assert abs(r.score - max(0.0, score)) < 1e-5 and (r.lang_pred == lang or r.lang_pred == "und")


def test_other_languages_are_rejected_and_short_texts_kept(spark):
    model = queries.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert all(model.langs.count(lang) >= 2 for lang in set(model.langs)), model.langs
    other = ["Suomen kieli on itämerensuomalaisten kielten ryhmään kuuluva uralilainen kieli, jota puhuvat pääosin suomalaiset.", "Русский язык является одним из восточнославянских языков", "汉语是世界上使用人数最多的语言之一而且有很长的历史", "Η ελληνική γλώσσα είναι μία από τις αρχαιότερες"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[a-z]{3}'")
    found = langid.predict(spark.createDataFrame([(t,) for t in other], "text string"), model).collect()
    assert sum(r.rejected for r in found) >= 2
    short = docs.selectExpr("substring_index(text, ' ', 6) as text").where("length(text) > 15")
    assert langid.predict(short, model).where("rejected").count() <= 0.02 * short.count()
    assert langid.predict(docs, model).where("rejected").count() <= 0.005 * docs.count()
