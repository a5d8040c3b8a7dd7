from pyspark.sql import functions as F

from attestor.operators import planning


def test_requests_for_every_group(spark):
    groups = spark.createDataFrame([("g1", "Curves", "peak_mag", 1), ("g1", "Curves", "redshift", 2), ("g2", "Hosts", "host_type", 1)], "group_id string, label string, field string, ordinal int")
    asked = spark.createDataFrame([(1, "arxiv", "peak mag of x", None, None, None), (2, "arxiv", "redshift and host type", None, None, None), (3, "arxiv", "q", None, "G1 ", ["host_type"])], "request_id int, connector string, query string, purpose string, group_id string, fields array<string>")
    met = planning.assign_groups(asked, groups)
    assert {r.request_id: r.group_id for r in met.collect()} == {1: "g1", 2: None, 3: "g1"}
    [more] = planning.missing_requests(met, groups, "why  so").collect()
    assert (more.group_id, more.query, more.fields) == ("g2", "why so Hosts host type", ["host_type"])
    merged = planning.merge_requests([asked.select("connector", "query", "group_id"), spark.createDataFrame([("ArXiv", "Q", "g1 "), ("zenodo", "q", None)], "connector string, query string, group_id string")])
    assert merged.count() == 4


def test_ingestion(spark):
    decisions = spark.createDataFrame([("a", "t", "zenodo", "download_pdf", "u"), ("b", "t", "zenodo", "download_pdf", None), ("c", "t", "arxiv", "download_pdf", "u"), ("d", "t", "github", "read_readme", "u"), ("e", "t", "x", "skip", "u")], "source_id string, title string, provider string, action string, url string")
    texts = spark.createDataFrame([("d", "readme", "x" * 5000), ("a", "readme", "not its route")], "source_id string, insight_type string, text string")
    insights, blocks = planning.ingest(decisions, texts)
    assert sorted((r.source_id, r.insight_type) for r in insights.collect()) == [("a", "metadata"), ("b", "ingestion_error"), ("b", "metadata"), ("c", "metadata"), ("d", "metadata"), ("d", "readme")]
    assert sorted(len(r.text) for r in blocks.where("source_file = 'd.insight'").collect())[-2:] == [500, 4500]


def test_titles_and_captions(spark):
    lines = [("a", "untitled", "arXiv:2401.00001 [cs]", 20.0, 1), ("a", "untitled", "A Study of Many  Things", 18.0, 2), ("a", "untitled", "Another Line of Text", 18.0, 3), ("b", "The Real Title Here", "x y z long enough", 30.0, 1), ("c", None, "short", 9.0, 1)]
    found = planning.document_titles(spark.createDataFrame(lines, "source_file string, metadata_title string, text string, font_size double, top int"))
    assert {r.source_file: r.title for r in found.collect()} == {"a": "A Study of Many Things", "b": "The Real Title Here", "c": None}
    given = spark.createDataFrame([(i, t) for i, t in enumerate(["Figure 3: Peak", "TABLE 2a Results", "In Figure 3 we", "Fig. 4. x"])], "i int, t string")
    assert [tuple(r.c) if r.c else None for r in given.select("i", planning.caption(F.col("t")).alias("c")).orderBy("i").collect()] == [("figure", "3", "Peak"), ("table", "2a", "Results"), None, ("figure", "4", "x")]
    items = spark.createDataFrame([("t1", "a", 1, 100.0, 200.0), ("t2", "a", 2, 10.0, 20.0)], "item_id string, source_file string, page int, top double, bottom double")
    captions = spark.createDataFrame([("a", 1, 90.0, "near above"), ("a", 1, 50.0, "far above"), ("a", 1, 201.0, "below"), ("a", 2, 25.0, "only below")], "source_file string, page int, y double, caption string")
    assert {r.item_id: r.caption for r in planning.nearest_captions(items, captions).collect()} == {"t1": "near above", "t2": "only below"}
    rows = planning.source_rows(spark.createDataFrame([("s", "t", "paper", "u", 0.5, {"DOI": '"10.1/x"', "year": "2024", "authors": "[]", "creators": '["A"]'})], "source_id string, title string, source_type string, url string, confidence double, metadata map<string,string>")).first()
    assert (rows.doi, rows.year, rows.authors, rows.provider) == ("10.1/x", "2024", '["A"]', None)
