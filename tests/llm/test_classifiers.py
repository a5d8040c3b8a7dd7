import itertools
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from attestor.llm import grams, langid, quality, queries, toxicity

D = "/root/testdata/sf0.01"


def learned_rows(spark, label):
    made = []
    for i in range(200):
        bad = i % 4 == 0
        text = " ".join(f"w{(i * 7 + k) % 23}" for k in range(12)) + ". "
        if label == "quality":
            made.append((i, text + ("##!! " * 3 if bad else "end"), int(not bad)))
        else:
            made.append((i, text + ("You nasty fool. " if bad else "") + text, int(bad)))
    return spark.createDataFrame(made, "id long, text string, y int")


def edge_rows(spark):
    texts = [None, "", " ", "x", "é" * 9, "word " * 200000, "same same same", "same same same"]
    return spark.createDataFrame([(t, "keep", None) for t in texts], "text string, score string, y string")


def test_quality_learns_and_takes_any_text(spark):
    model = quality.fit(learned_rows(spark, "quality"))
    rows = spark.createDataFrame([("w1 w2 w3. end",), ("w1 w2 w3. ##!! ##!!",)], "text string")
    good, bad = (r.score for r in quality.predict(rows, model).collect())
    assert good > 0.8 and bad < 0.2
    found = quality.predict(edge_rows(spark), model).collect()
    assert all(0 <= r.score <= 1 for r in found) and found[6].score == found[7].score and found[0].score == found[1].score
    assert quality.predict(rows.limit(0), model).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0, 0.5, 0] + rng.normal(size=60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.5)
    w = quality.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, cost, rounds=2000, tolerance=1e-9)
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(primal(w) <= primal(w + rng.normal(size=5) * 0.01) for _ in range(300))


def test_quality_without_both_classes(spark):
    rows = learned_rows(spark, "quality")
    texts = spark.createDataFrame([("a",)], "text string")
    assert quality.predict(texts, quality.fit(rows.where("y = 1"))).first().score > 0.99
    assert quality.predict(texts, quality.fit(rows.limit(0))).first().score == 0.5


def test_toxicity_scores_and_sentences(spark):
    model = toxicity.fit(learned_rows(spark, "toxic"))
    text = "É w1 w2. Nasty FOOL! w3"
    rows = spark.createDataFrame([(text,), ("w1 w2. w5",)], "text string")
    bad, good = toxicity.predict(rows, model).collect()
    assert bad.score > 0.7 and good.score < 0.2
    assert [text[s.start : s.stop] for s in bad.sentences] == ["Nasty FOOL! "] and good.sentences == []
    found = toxicity.predict(edge_rows(spark), model).collect()
    assert found[0].score == found[1].score == found[2].score == 0 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.predict(rows.limit(0), model).count() == 0
    assert toxicity.predict(rows, toxicity.fit(learned_rows(spark, "toxic").limit(0))).first().score < 1e-6


def truth(column, n):
    rows = duckdb.sql(f"select doc_id, {column} from '{D}/labels.parquet'").fetchall()
    return dict(rows)


def test_held_out_quality(spark):
    found = queries.op1_quality_classifier(spark, D).toPandas()
    y = truth("quality", 5)
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    held = found[found.held_out & found.doc_id.isin(list(y))]
    assert (held.predicted == held.doc_id.map(y)).mean() >= 0.95
    assert len(found) == 1000 and found.score.between(0, 1).all()


def test_held_out_toxicity(spark):
    found = queries.op5_toxicity(spark, D).toPandas()
    y = truth("toxic", 3)
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = found[found.held_out & found.doc_id.isin(list(y))]
    y = held.doc_id.map(y)
    assert y[held.predicted == 1].mean() >= 0.9 and (held.predicted[y == 1] == 1).mean() >= 0.6
    assert found.score.between(0, 1).all()
    assert (found.sentences.map(len)[found.predicted == 0] <= 2).all() and (found.sentences.map(len)[found.predicted == 1] > 0).mean() > 0.9


def plain_toxicity(text, model):
    """The score, sentence by sentence and word by word, from the model's weights."""
    weights = dict(zip(model.known.tolist(), model.weights.tolist(), strict=True))
    mult, mask = int(grams.MULT), (1 << 64) - 1

    def feature(word, whole):
        total = sum((b + 1) * pow(mult, i, 1 << 64) for i, b in enumerate(word))
        return (total + (0 if whole else len(word))) * mult & mask

    bags = []
    for part in re.split("(?<=[.!?\n。！？｡؟۔।…])", text or ""):
        found = re.findall(r"[A-Za-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub("[。！？｡؟۔।…]", ".", part)))
        if found:
            of = [w.encode() for w in found]
            told = [weights[f] for w in of for f in [feature(w, True), *(feature(w[:n], False) for n in toxicity.PREFIXES if len(w) > n)] if f in weights]
            if told:
                bags.append(1 / (1 + math.exp(-model.bias - sum(told))))
    offending = [p for p in bags if p >= 0.5]
    return 1 - math.prod(1 - p for p in offending) if offending else max(bags, default=0.0)


def test_toxicity_scores_equal_a_plain_computation(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert len(model.known) > 5
    found = toxicity.predict(docs.where("doc_id < 300").select("doc_id", "text"), model).collect()
    assert all(abs(r.score - plain_toxicity(r.text, model)) < 1e-9 for r in found)


def test_long_clean_texts_are_not_toxic(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet").dropDuplicates(["doc_id"])
    model = queries.toxicity_model(docs, labels)
    clean = toxicity.predict(docs.join(labels.where("toxic = 0"), "doc_id", "left_semi"), model).where("score < 0.5").orderBy("doc_id").select("text").collect()
    joined = "\n".join(r.text for r in clean)
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").select("text").first().text
    texts = [joined * (1 + 1_000_000 // len(joined)), joined * (1 + 8_000_000 // len(joined)), "This is a fine day. " * 10_000, clean[0].text * 500, "word" * 1_000_000, (toxic + " ") * 300]
    scores = [toxicity.predict(spark.createDataFrame([(t,)], "text string"), model).first().score for t in texts]
    assert max(scores[:5]) < 0.7 and scores[5] >= 0.7
    monkeypatch.setattr(toxicity, "WINDOW", 5000)  # windows change nothing
    raw = np.frombuffer(joined.encode(), "u1")
    small = toxicity._scored(model, raw, np.array([0, len(raw)]))
    monkeypatch.undo()
    whole = toxicity._scored(model, raw, np.array([0, len(raw)]))
    assert all(np.allclose(a, b) for a, b in zip(small, whole, strict=True))


def test_clean_text_around_hides_nothing(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet").dropDuplicates(["doc_id"])
    model = queries.toxicity_model(docs, labels)
    clean = toxicity.predict(docs.join(labels.where("toxic = 0"), "doc_id", "left_semi"), model).where("score < 0.5").orderBy("doc_id").select("text").collect()
    padding = "\n".join(r.text for r in clean)
    toxic = toxicity.predict(docs.join(labels.where("toxic = 1"), "doc_id", "left_semi"), model).where("score >= 0.7").orderBy("doc_id").limit(40).collect()
    assert len(toxic) > 10
    for size in (20_000, 200_000, 5_000_000):
        around = (padding * (1 + size // len(padding)))[:size]
        some = toxic if size < 1_000_000 else toxic[:3]
        texts = [(i, around[: size // 2] + "\n" + r.text + "\n" + around[size // 2 :]) for i, r in enumerate(some)]
        found = {r.i: r for r in toxicity.predict(spark.createDataFrame(texts, "i int, text string"), model).collect()}
        for i, r in enumerate(some):
            assert found[i].score >= 0.7 and len(found[i].sentences) >= len(r.sentences)


def test_sentences_end_in_other_scripts(spark):
    model = toxicity.fit(learned_rows(spark, "toxic"))
    text = "w1 w2。nasty fool！w3 w4।w5"
    found = toxicity.predict(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [text[s.start : s.stop] for s in found.sentences] == ["nasty fool！"]


def plain_quality(text, model):
    """The score, n-gram by n-gram, from the model's weights."""
    mult, mask = int(grams.MULT), (1 << 64) - 1
    data = re.sub(rb"[0-9]", b"0", (text or "").encode())
    found = set()
    for size in quality.SIZES:
        for i in range(len(data) - size + 1):
            code = size
            for b in data[i : i + size]:
                code = (code * 257 + b) & mask
            found.add((code * mult & mask) >> (64 - quality.BITS))
    hashes = [sum((b + 1) * pow(mult, i, 1 << 64) for i, b in enumerate(w)) * mult & mask for w in re.split(rb"[\t-\r ]+", data) if w]
    pairs = [(a * 3 + b) * mult & mask for a, b in zip(hashes, hashes[1:], strict=False)]
    found |= {(1 << quality.BITS) + (h >> (64 - quality.WORD_BITS)) for h in hashes + pairs}
    runs = [len(list(g)) for _, g in itertools.groupby(hashes)]
    found |= {quality.WIDTH - len(quality.RUNS) + i for i, n in enumerate(quality.RUNS) if max(runs, default=0) >= n}
    w, norm = model.weights
    at = sorted(found)
    margin = (w[at].sum() + model.bias) / max(1.0, math.sqrt(norm[at].sum()))
    return 1 / (1 + math.exp(-(model.slope * margin + model.shift)))


def test_quality_scores_equal_a_plain_computation(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet").where("doc_id % 5 > 0")
    model = quality.fit(queries.labelled(docs, labels, "doc_id", "text", "quality"))
    for r in quality.predict(docs.where("doc_id < 200").select("doc_id", "text"), model).collect():
        assert abs(r.score - plain_quality(r.text, model)) < 1e-9


def test_work_on_texts_needs_little_memory_beside_its_batch():
    text = "This one is a plain sentence of words. " * 200
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 500)], names=["text"])
    grams._powers.cache_clear()
    tracemalloc.start()
    rows = sum(len(part) for part, raw, at in langid._chunks([batch]) if langid._counts(raw, at).any() and len(toxicity._instances(raw, at)[1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 500 and peak < 40 << 20, peak
