import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import ann, queries, vector_dedup

NAN, INF = float("nan"), float("inf")
BAD = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [NAN] + [1.0] * 5, [INF] + [1.0] * 5]


def made(n=260, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(n // 2, n - 20):
        base[i] = base[rng.integers(0, n // 2)] * rng.uniform(0.5, 2) + rng.normal(size=dim) * 0.08
    base[-20:] = base[3]
    return [[float(np.float32(c)) for c in r] for r in base]


def classes(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def links(rows, threshold):
    def good(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)

    unit = [np.array(v) / np.linalg.norm(v) if good(v) else None for _, v, _ in rows]
    return [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and rows[a][2] == rows[b][2] is not None and unit[a] @ unit[b] >= threshold
    ]


@pytest.mark.parametrize("block", [2048, 40])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    vectors = made()
    rows = [(i, v, i % 3 if i < 250 else None) for i, v in enumerate([*vectors[:250], *vectors[250:255], *BAD, [1.0, 2.0], [2.0, 4.0]])]
    rows[-2:] = [(r[0], r[1], 7) for r in rows[-2:]]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    found = {r.id: r for r in vector_dedup.near_duplicates(frame).collect()}
    pairs = links(rows, 0.98)
    count, root = [0] * len(rows), classes(len(rows), pairs)
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    assert len(found) == len(rows) and len(pairs) > 50
    for i in range(len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (count[i], root[i], root[i] == i), i


def test_probes_and_tables_lose_nothing():
    x = vector_dedup._unit(made(400, 16, 2))
    model = vector_dedup.Model(vector_dedup._means(x, 12), [vector_dedup._means((x - x.mean(0))[:, i : i + 4], 8) for i in range(0, 16, 4)], 0.6)
    own = model.nearest(x)
    probes = model.probes(x, own)
    codes, error = model.encode(x, own)
    for i in range(len(x)):
        for j in np.flatnonzero(np.sqrt(((x - x[i]) ** 2).sum(1)) <= 0.6):
            assert own[j] in probes[i]
            assert model.distances(x[i : i + 1], own[j], codes[j : j + 1])[0, 0] <= 0.6 + error[j] + 1e-9


def test_repeated_rows_null_ids_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>, label int"
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    frame = spark.createDataFrame([(4, v, 1), (4, v, 1), (9, v, 1), (None, v, 1), (5, w, 1), (6, w, None)], schema)
    found = sorted(((r.id or -1), r.n_links, r.component_id or -1, r.kept) for r in vector_dedup.near_duplicates(frame).collect())
    assert found == [(-1, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (5, 0, 5, True), (6, 0, 6, True), (9, 3, 4, False)]
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0
    near = [1.0, 0.01, 0.5]  # two vectors of one id link with each other and with a third
    shared = spark.createDataFrame([(7, v, 1), (7, near, 1), (3, near, 1), (7, w, 1)], schema)
    found = sorted((r.id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(shared).collect())
    assert found == [(3, 2, 3, True), (7, 0, 7, True), (7, 2, 3, False), (7, 2, 3, False)]
    assert vector_dedup.near_duplicates(frame.where("vec_id = 6")).first().kept
    assert ann.search(frame.limit(0), frame.vec_id > 0).count() == 0


def test_null_ids_alone(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [2.0, -1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(frame).collect()) == [(0, None, True), (1, None, True), (1, None, True)]


def test_search_among_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [rows[5]] * 3 + [(0, rows[7][1]), (0, rows[0][1]), (None, rows[0][1]), (10, rows[9][1])] + [rows[20]] * 15
    found = ann.search(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, key string"), F.col("vec_id") % 10 == 0).collect()
    got, hit, total = {}, 0, 0
    for r in found:
        got.setdefault(r.query_id, Counter())[r.id, round(r.score, 9)] += 1
    for q in {i for i, _ in rows if i is not None and i % 10 == 0}:
        want, there = Counter(), Counter()
        for n, (i, v) in enumerate(rows):
            if i == q:
                near = sorted(((math.dist(v, w), j is None, j) for m, (j, w) in enumerate(rows) if m != n), key=lambda x: (x[0], x[1], x[2] or 0))
                there.update((j, round(d, 9)) for d, _, j in near)
                want.update((j, round(d, 9)) for d, _, j in near[:10])
        assert got[q].total() == want.total() and got[q] <= there  # no row comes more often than it is there
        assert {x: n for x, n in got[q].items() if x[1] == 0} == {x: n for x, n in want.items() if x[1] == 0}
        hit, total = hit + (got[q] & want).total(), total + want.total()
    assert hit >= 0.95 * total


def nearest(rows, k=10, every=5):
    good = [(i, np.array(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    return {i: sorted((math.dist(v, w), j) for j, w in good if j != i and len(v) == len(w))[:k] for i, v in good if i % every == 0}


@pytest.mark.parametrize("shard", [8192, 50])
def test_search_against_brute_force(spark, monkeypatch, shard):
    """Odd vectors take no part, well-formed ones of other lengths are compared among themselves; some queries have few candidates."""
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", shard)
    rows = list(enumerate([*made(), *BAD, [1.0, 2.0], [2.0, 4.0], [3.0, 3.0], [0.5], [5.0, 5.0]]))
    rows[-1] = (270, rows[-1][1])
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found, hits, total = {}, 0, 0
    for r in ann.search(frame, frame.vec_id % 5 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.id))
    want = {i: best for i, best in nearest(rows).items() if best}
    assert found.keys() == want.keys() and 270 in found
    by_id = dict(rows)
    for i, best in want.items():
        assert len(found[i]) == len(best) and found[i] == sorted(found[i])
        hits += len({j for _, j in best} & {j for _, j in found[i]})
        total += len(best)
        assert all(abs(d - math.dist(by_id[i], by_id[j])) < 1e-12 for d, j in found[i])
    assert hits / total >= 0.95


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(i, [1.0, 2.0, 3.0 + i / 1000]) for i in range(400, 440)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(frame, frame.vec_id % 100 == 0).collect()
    want = nearest(rows, every=100)
    assert len(found) == 50 and all(want[r.query_id][r["rank"] - 1][1] == r.id for r in found)


def test_fewer_candidates_than_asked(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    found = [(r.rank, r.id) for r in ann.search(frame, frame.vec_id == 0).collect()]
    assert found == [(1, 1), (2, 2)]


def test_probing_finds_every_code_within_the_radius(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 24)) + rng.normal(size=(500, 1))
    model = ann.Model(np.zeros(24), rng.normal(size=(24, 72)), 8, 8, 2, 72)
    bits = (x @ model.directions > 0).astype(int)[:, :64]
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows = ann.candidates(index, index.where("id < 20").withColumnRenamed("id", "key"), model).collect()
    found = {(r.key, r.id) for r in rows}
    assert len(found) == len(rows)
    apart = np.abs(bits[:20, None] - bits[None]).sum(2)
    within = {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= model.radius), strict=True)}
    by_table = np.abs(bits[:20, None] - bits[None]).reshape(20, 500, 8, 8).sum(3).min(2) <= model.near
    assert model.radius == 23 and len(within) > 1000 and within <= found == {(int(a), int(b)) for a, b in zip(*np.nonzero(by_table), strict=True)}


def test_few_rows_are_candidates_where_vectors_lie_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 32)).repeat(20, 0) + 0.3 * rng.normal(size=(6000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, plain = [], ann.candidates
    monkeypatch.setattr(ann, "candidates", lambda *a: seen.append(plain(*a)) or seen[-1])
    found = ann.search(frame, frame.vec_id % 100 == 0).collect()
    assert seen[0].count() < 0.05 * 60 * 6000
    hits = sum(r.id in set(np.argsort(((x - x[r.query_id]) ** 2).sum(1))[1:11]) for r in found)
    assert len(found) == 600 and hits >= 540


def test_recall_on_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding).astype("f8")
    found = queries.op8_nearest_neighbours(spark, d).toPandas().groupby("query_id").vec_id.agg(set)
    hits = 0
    for q in found.index:
        i = int(np.flatnonzero(table.vec_id == q)[0])
        order = np.lexsort((table.vec_id, ((x - x[i]) ** 2).sum(1)))
        hits += len(found[q] & set(table.vec_id.to_numpy()[order[order != i][:10]]))
    assert hits / (10 * len(found)) >= 0.9
