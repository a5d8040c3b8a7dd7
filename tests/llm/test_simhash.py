import random

import numpy as np
import xxhash

from attestor.llm import graph, simhash


def plain(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_fingerprint_matches_plain_count():
    for text in ["", None, "One", "A b", "\tA B\x0bc", "é Éa à x x x x x", "a b c d " * 90000, "x" * 100000, "a\x1cb c d"]:
        assert simhash.fingerprint_of(text) == plain(text)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts = base + base[:40] + [None, "", " \n", "Z" * 5000] + [b + " q" for b in base[:40]]
    rows = [(i, t, 0.5) for i, t in enumerate(texts)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp double")).collect()
    fps = [plain(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = classes(range(len(texts)), pairs)
    assert {r.id: (r.fp % 2**64, r.component) for r in found} == {i: (fps[i], want[i]) for i in range(len(texts))}


def test_links_find_all_within_radius(spark):
    rng = np.random.default_rng(3)
    fps = {int(rng.integers(0, 2**63)) for _ in range(30)}
    for f in list(fps):
        for _ in range(4):
            f ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.add(f)
    fps = sorted(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    links = simhash.links(spark.createDataFrame(rows, "node long, fp long")).collect()
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert classes(range(len(fps)), [(r.a, r.b) for r in links]) == classes(range(len(fps)), pairs)
    assert {tuple(sorted(r)) for r in links} <= {tuple(sorted(p)) for p in pairs}


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = simhash.near_duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "zz")], schema)).collect()
    assert sorted((r.id or 0, r.component or 0) for r in found) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_components_on_paths_hubs_and_repeats(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(1000, 1400)]
    hub = [(5, n) for n in range(2000, 2600)]
    wild = [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    pairs = [*path, *hub, *wild, *wild[:50], (7, 7), (None, 3)]
    rng.shuffle(pairs)
    found = graph.components(spark.createDataFrame(pairs, "x long, y long").repartition(7), "x", "y").collect()
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    assert {r.node: r.root for r in found} == classes({n for p in real for n in p}, real)
    assert len(found) == len({r.node for r in found})


def test_fingerprints_without_an_id_link_and_repeated_ids_do_not(spark, monkeypatch):
    codes = {"a": 0, "b": 0b11, "c": 0b1111, "x": 0xFF << 40, "y": 0xFFFF << 20}
    rows = [(9, "c"), (None, "b"), (7, "a"), (None, "b"), (3, "x"), (3, "y"), (None, "y")]
    points = spark.createDataFrame([(codes[t], i) for i, t in rows], "fp long, id long").groupBy("fp").agg({"id": "min"})
    roots = {r.fp: r.root for r in simhash._rooted(points, 2).collect()}
    assert roots == {codes["a"]: 0, codes["b"]: 0, codes["c"]: 0, codes["x"]: codes["x"], codes["y"]: codes["y"]}
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame([(i, codes[t]) for i, t in rows], "id long, fp long"))
    found = simhash.near_duplicates(None).collect()
    assert sorted((r.component, r.fp) for r in found) == sorted((3 if t in "xy" else 7, codes[t]) for _, t in rows)
