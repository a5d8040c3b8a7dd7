"""Hard negatives against all pairs in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import hard_negatives as H
from attestor.llm import queries
from tests.oracle import difference, engine

SCHEMA = "vec_id long, embedding array<float>, label int, n string, score int"


def plain(rows, every=10):
    held = []
    for n, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((n, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    order = lambda x: (-x[0], x[1] is None, x[1])
    out = []
    for n, i, v, label in held:
        if i is None or i % every:
            continue
        near = sorted(((dot(v, w), j) for m, j, w, other in held if m != n and other == label and len(w) == len(v)), key=order)[:5]
        far = sorted(((dot(v, w), j) for m, j, w, other in held if other != label and len(w) == len(v)), key=order)
        for score, j in near:
            inside = [(s, k) for s, k in far if 30 * score <= 100 * s <= 90 * score][:10]
            out += [(i, j, rank, k, score, s) for rank, (s, k) in enumerate(inside, 1)]
    return sorted(out, key=str)


def found(spark, rows, every=10):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % every == 0, F.col("label")).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_random_vectors(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD", 40), ("LEAF", 4), ("BLOCK", 3)):
            monkeypatch.setattr(H, name, value)
    rnd = np.random.default_rng(1)
    middle = rnd.normal(size=(4, 8))
    rows = [(int(i), [float(x) for x in np.float32(middle[i % 4] + 0.7 * rnd.normal(size=8))], int(rnd.integers(0, 3))) for i in range(300)]
    assert found(spark, rows) == plain(rows) != []


def test_odd_rows(spark):
    v = [1.0, 2.0, 0.5]
    rows = [(0, v, 1), (0, v, 1), (10, [0.0, 0.0, 0.0], 1), (1, v, 2), (1, v, 2), (2, None, 1), (3, [1.0, None, 2.0], 1), (4, [1.0, float("nan"), 1.0], 2), (5, [float("inf"), 0.0, 0.0], 2), (20, v, None), (None, [0.5, 1.0, 0.25], 2), (None, v, 1)]
    rows += [(30, [1.0], 1), (31, [0.5], 1), (32, [0.25], 2), (40, [], 1), (41, [], 1), (42, [], 2), (50, [-1.0, -2.0, 0.0], 1), (6, [0.6, 1.2, 0.3], 3), (7, [0.6, 1.2, 0.3], 3)]
    assert found(spark, rows) == plain(rows) != []
    assert found(spark, []) == []


def test_whole_numbers_beyond_doubles(spark):
    rows = [(i, [1000.0 + i * 0.37, 90000.0 - i, 3.0], i % 2) for i in range(20)]
    assert found(spark, rows, 5) == plain(rows, 5)


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(2)
    x = np.floor(256 * np.repeat(rnd.normal(size=(40, 16)), 50, 0) + 8 * rnd.normal(size=(2000, 16)))
    root = H.tree(x)
    q = x[::200]
    norm, leaves, todo = np.sqrt((q * q).sum(1)), [], [root]
    while todo:
        node = todo.pop()
        least, most = node.bounds(q, norm)
        score = q @ x[node.at].T
        assert (score.max(1) <= most).all() and (score.min(1) >= least).all()
        todo += node.children
        leaves += [] if node.children else [node]
    assert sorted(np.concatenate([n.at for n in leaves]).tolist()) == list(range(2000))
    looked = []
    search = H.Search(x, np.arange(2000), q, np.full(10, -(1 << 60)), np.full(10, 1 << 60), 5, lambda a, b: np.ones((len(a), len(b)), bool))
    look = search.look
    search.look = lambda rows, asked: (looked.append(len(rows) * len(asked)), look(rows, asked))
    search.begin(root, np.arange(10))
    search.run(root, np.arange(10))
    assert sum(looked) < 0.5 * 2000 * 10  # most leaves are never looked at
    assert (search.score == -np.sort(-(q @ x.T), 1)[:, :5]).all()


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(spark, queries.op13_hard_negatives, queries.NEGATIVES_SQL, folder, engine(folder)) is None
