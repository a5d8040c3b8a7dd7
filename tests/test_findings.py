"""Queries on small tables with keys and texts as they come in larger ones."""

import pytest

import __spark_entry__ as entry
from attestor.operators import layout, quality
from tests.oracle import difference, engine

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def same(spark, tmp_path):
    """Compare a query with its SQL on the small tables, some of them replaced by SQL over them."""

    def check(name: str, **tables: str) -> str | None:
        small = engine(SMALL)
        for table in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
            small.execute(f"COPY ({tables.get(table, f'SELECT * FROM {table}')}) TO '{tmp_path}/{table}.parquet'")
        return difference(spark, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path), engine(str(tmp_path)))

    return check


def test_a_resource_cap_goes_by_score_whatever_the_keys(same):
    assert same("resource_cap", part="SELECT * REPLACE (p_partkey * 1000003 AS p_partkey) FROM part") is None


def test_anchors_are_found_whole(same):
    # the anchor at 700 of document 0 ends in a heading with a number, which stands on the first page as well
    text = "rpad(rpad('see 12 method of a', 700, ' lorem') || 'all of it in 12 method o', 1500, ' ipsum')"
    ends = "SELECT 7 AS doc_id, 'these are words and a line with other letters at its end' || chr(13) AS text"
    docs = f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text, 'en' AS lang, 'src' AS source, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT 0 AS doc_id, {text} AS text UNION ALL {ends})"
    assert same("anchors_of_documents", documents=docs) is None
    far = docs.replace("1500", "2900").replace("rpad('see 12 method of a', 700,", "rpad('see 12 method of a', 1400,")
    assert same("anchors_of_documents", documents=far) is None


def test_large_drawings_are_not_spread_into_cells(spark):
    kinds = "source_file string, page long, x0 long, top long, x1 long, bottom long"
    wide = [("f", p, 0, 0, 1_000_000, 1_000_000) for p in (1, 2)]
    boxes = spark.createDataFrame([*wide, ("f", 1, 1_000_010, 5, 1_000_100, 9), ("f", 1, 1_001_000, 5, 1_001_100, 9), ("f", 2, 5, 5, 9, 9)], kinds)
    found = layout.together(boxes, 12.0)
    assert "Generate" not in found._jdf.queryExecution().toString()
    rows = {(r.page, r.x0): r.root for r in found.collect()}
    assert len(rows) == 5 and rows[1, 0] == rows[1, 1_000_010] != rows[1, 1_001_000] and rows[2, 0] == rows[2, 5]


def test_figures_are_shuffled_by_page_alone(spark):
    # lines and regions once each, and pages, which is one shuffle that three read; joins on anything else would shuffle all again
    plan = entry.queries()["figures_from_drawings"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source_file") == plan.count("Exchange ") <= 5 and "Broadcast" not in plan


def test_regions_go_to_the_nearest_caption(spark):
    box = "source_file string, page int, x0 double, top double, x1 double, bottom double"
    drawings = spark.createDataFrame([("f", p, 100.0, 300.0, 200.0, 400.0, "image") for p in (1, 2, 3, 4)] * 2 + [("f", 4, 100.0, 405.0, 200.0, 450.0, "drawing")], f"{box}, kind string")
    above = [("f", 1, 100.0, 250.0, 200.0, 260.0, "Figure 2"), ("f", 1, 100.0, 250.0, 200.0, 260.0, "Figure 1"), ("f", 1, 100.0, 100.0, 200.0, 110.0, "Figure 0")]
    below = [("f", 2, 400.0, 500.0, 500.0, 510.0, "Figure 3"), ("f", 3, 100.0, 420.0, 200.0, 430.0, "b"), ("f", 3, 100.0, 450.0, 200.0, 460.0, "a"), ("f", 5, 0.0, 500.0, 9.0, 510.0, "none")]
    captions = spark.createDataFrame([*above, *below, *below], f"{box}, label string")
    pages = spark.createDataFrame([("f", p, 600.0, 800.0) for p in range(1, 6)], "source_file string, page int, width double, height double")
    found = layout.figure_regions(drawings, captions, pages)
    assert dict(found.dtypes)["page"] == "int"
    told = {(r.page, r.label): (r.drawings, r.bbox) for r in found.collect()}
    with_image = [72.0, 272.0, 228.0, 428.0]
    assert {k: v for k, v in told.items() if v[1][0] == 72.0} == {(1, "Figure 1"): (0, with_image), (2, "Figure 3"): (0, with_image), (3, "b"): (0, [72.0, 272.0, 228.0, 418.0])}
    assert {k: v for k, v in told.items() if v[1][0] != 72.0} == {(1, "Figure 2"): (0, [36.0, 36.0, 564.0, 246.0]), (3, "a"): (0, [36.0, 36.0, 564.0, 446.0]), (5, "none"): (0, [36.0, 80.0, 564.0, 496.0])}


@pytest.mark.parametrize("name", ["tables_from_words", "sources_with_names"])
def test_nothing_that_follows_the_data_is_sent_to_all(spark, name):
    # the small tables are below any bound for a broadcast
    found = entry.queries()[name](spark, SMALL)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["numeric_coercion", "table_shape", "strict_from_open_fields", "payload_contract"])
def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, name):
    assert "RepartitionByExpression [p_partkey" in entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_of_a_key_is_kept_with_one_timer():
    from types import SimpleNamespace

    from pyspark.sql import Row

    from attestor.streaming import steps

    kept, timers, opened = [], [], []
    waiting = SimpleNamespace(appendList=kept.extend, get=lambda: iter(list(kept)), clear=kept.clear)
    state = SimpleNamespace(get=lambda: opened[-1] if opened else None, update=opened.append)
    handle = SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: state, registerTimer=timers.append)
    one = steps._Steps(10**15, 1)
    one.init(handle)
    now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    # starts at even milliseconds and their ends at odd ones, the last first
    assert list(one.handleInputRows(("k",), iter([Row(at=i * 1000, start=i % 2 == 0) for i in reversed(range(2500))]), now(0))) == []
    assert timers == [0] and len(kept) == 3  # one for each event before
    first = list(one.handleExpiredTimer(("k",), now(1500), None))
    assert len(first) == 750 and tuple(first[0]) == ("k", 1, 0, 1000) and timers == [0, 1501]  # the start at 1500 is open
    rest = list(one.handleExpiredTimer(("k",), now(5000), None))
    assert len(rest) == 500 and tuple(rest[-1]) == ("k", 1250, 2_498_000, 2_499_000) and not kept and len(timers) == 2


@pytest.mark.parametrize("name", ["conflict_metric_groups", "conflict_cross_source"])
def test_values_in_conflict_meet_in_many_partitions(spark, name):
    # a whole split of the input was sorted by one task, and adaptive execution made few partitions of it
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.split("\n") if "RepartitionByExpression [l_partkey" in line and line.rstrip().endswith(", 96")]) >= 4 and "LeftSemi" not in plan


def test_conflicts_of_odd_rows(spark):
    rows = [("a", None, "1", "s"), ("a", None, "1", "s"), ("a", None, "2", None), (None, "x", "1", "s"), (None, "x", "3", "t"), ("b", "x", "1", "s"), ("b", "x", None, "t"), ("c", "x", "", "s"), ("c", "x", "0", "s")]
    found = lambda n: sorted(map(tuple, quality.conflicts(spark.createDataFrame(rows, "k string, c string, value string, source string"), ["k", "c"], n).collect()), key=str)
    assert found(2) == [(None, "x", 2, 2, 2, "1,3")]
    assert found(1) == [("a", None, 2, 1, 3, "1,2"), ("c", "x", 2, 1, 2, ",0"), (None, "x", 2, 2, 2, "1,3")]


def test_lines_are_not_shuffled_to_meet_their_ranges(spark, tmp_path, monkeypatch):
    from attestor.sources import delimited

    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfk,n\n1,"two\nlines"\n\n2,"a ""b"", c"\n3,NA\n4\n5,x,y\n')
    (tmp_path / "b.tsv").write_bytes("k\tn\r\n材料\tx\r\n".encode("gb18030"))
    (tmp_path / "c.dat").write_bytes(b"# none\nk  n\n1 2 # of it\n\n")
    read = lambda: delimited.read_ranges(spark, str(tmp_path))
    told = lambda frame: sorted((r.source_file, r.row, r["values"] and r["values"].get("k"), r["values"] and r["values"].get("n"), r.error) for r in frame.collect())
    sent = read()
    found = told(sent)
    assert "Sort" not in sent._jdf.queryExecution().executedPlan().toString()
    assert found == [("a.csv", 1, "1", "two\nlines", None), ("a.csv", 2, "2", 'a "b", c', None), ("a.csv", 3, "3", None, None), ("a.csv", 4, "4", None, None), ("a.csv", 5, None, None, delimited.TOO_LONG), ("b.tsv", 1, "材料", "x", None), ("c.dat", 1, "1", "2", None)]
    monkeypatch.setattr(delimited, "SENT", 0)
    assert told(read()) == found


def test_a_batch_and_the_state_are_shuffled_once(spark, tmp_path):
    from attestor.operators import catalog

    kinds = "source_id string, url string, local_path string, artifact_type string, name string, status string, completed_operations array<string>"
    old = [("s", None, None, "csv", "a", "parsed", ["p"]), ("s", "u", "/at", "csv", "b", "downloaded", ["d"]), ("t", None, None, "csv", "a", "failed", None), (None, None, "", "csv", "n", "planned", []), ("w", "only", None, "csv", "c", "inspected", ["i"])]
    new = [("s", None, "", "csv", "a", "inspected", ["z", "a"]), ("s", None, None, "csv", "a", "planned", ["b"]), ("s", "u", None, "pdf", "x", "inspected", ["i", "d"]), ("t", None, None, "csv", "a", "parsed", []), (None, None, None, "csv", "n", "downloaded", []), ("v", "new", None, "csv", "d", "planned", None)]
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / name))
    found = catalog.upsert_state(spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("s", None, None, "csv", "a", "parsed", ["a", "b", "z", "p"]), ("s", "u", "/at", "pdf", "x", "downloaded", ["d", "i"]), ("t", None, None, "csv", "a", "failed", []), (None, None, "", "csv", "n", "downloaded", []),
        ("v", "new", None, "csv", "d", "planned", None), ("w", "only", None, "csv", "c", "inspected", ["i"]),
    ], key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.upsert_state(spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
