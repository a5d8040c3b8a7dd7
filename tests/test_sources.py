import html
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.sources import connectors, files, guards, sinks


def test_mixed_table_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Paper,PCE (%)\nx,21.3\ny,\n".encode())
    (tmp_path / "b.tsv").write_text("m\tv\nq\t1\n")
    (tmp_path / "c.dat").write_text("# survey\nra dec\n1.5 2\n")
    (tmp_path / "d.csv").write_bytes("材料,值\n钙钛矿,1\n".encode("gb18030"))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "f.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "g.bin").write_bytes(b"x")
    by = {r.source_file: r for r in files.read_tables(spark, str(tmp_path)).collect()}
    assert by["a.csv"].columns == ["Paper", "PCE (%)"] and by["a.csv"].rows == [{"Paper": "x", "PCE (%)": "21.3"}, {"Paper": "y", "PCE (%)": None}]
    assert by["b.tsv"].rows == [{"m": "q", "v": "1"}] and by["c.dat"].rows == [{"ra": "1.5", "dec": "2"}] and by["d.csv"].rows == [{"材料": "钙钛矿", "值": "1"}]
    assert by["f.xlsx"].error and "g.bin" not in by and "e.csv" not in by
    assert files.read_whitespace(spark, str(tmp_path / "c.dat"), ["ra", "dec"]).where("ra = '1.5'").count() == 1
    assert files.read_delimited(spark, str(tmp_path / "b.tsv"), "\t").columns == ["m", "v"]
    routed = files.gate(spark.createDataFrame([("x/a.PDF",), ("b.fits",), ("c.csv",), ("d",)], "path string")).collect()
    assert [(r.route, r.skip_reason) for r in routed] == [("text", None), ("skip", "FITS image or table"), ("table", None), ("skip", "unsupported format")]


def test_html_blocks_against_the_standard_library(spark):
    texts = ["<p>&eacute;&#233;&#xe9; &amp; x</p>", "plain", "<script>no</script>a &copy; b", None]
    found = files.html_blocks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string")).orderBy("i").collect()
    assert [r.text for r in found] == [html.unescape("&eacute;&#233;&#xe9; & x"), "plain", "a © b", None]


def test_pdf_pages_by_any_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one|two")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def extract(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return content[5:].decode().split("|")

    found = {(r.page, r.text, r.error) for r in files.read_pdf_pages(spark, str(tmp_path), extract).collect()}
    assert found == {(1, "one", None), (2, "two", None), (None, None, "ValueError: no PDF")}


@pytest.mark.parametrize(
    ("url", "ok"),
    [("https://example.org/a", True), ("http://8.8.8.8/", True), ("ftp://example.org", False), ("https://user@example.org", False), ("http://localhost:8080/", False), ("http://10.0.0.1", False), ("http://172.20.1.1", False), ("http://[::1]/", False), ("http://2130706433/", False), ("http://x.internal/", False), ("https://", False), ("http://192.168.1.1.example.org/", True)],
)
def test_url_guard(spark, url, ok):
    assert (spark.createDataFrame([(url,)], "u string").select(guards.url_problem(F.col("u"))).first()[0] is None) is ok


def test_contents_and_uploads(spark):
    given = [("a.pdf", b"%PDF-1.7"), ("b.pdf", b"<html>"), ("c.xlsx", b"PK\x03\x04.."), ("d.csv", b"a,b"), ("e.txt", b""), ("f.png", b"\x89PNG\r\n")]
    rows = spark.createDataFrame([("q", i, p, len(c), bytearray(c)) for i, (p, c) in enumerate(given)], "request_id string, ordinal int, path string, length long, content binary")
    assert [r.problem for r in guards.admit(rows).orderBy("ordinal").collect()] == [None, "content is html, not pdf", None, None, "empty file", None]
    assert [r.problem for r in guards.admit(rows, count=2, total=10).orderBy("ordinal").collect()][1:3] == ["request too large", "too many files"]
    public = guards.public_row(spark.createDataFrame([("see /home/me/x.pdf now", "p")], "note string, local_path string"))
    assert public.columns == ["note"] and public.first().note == "see x.pdf now"


def test_connectors(spark):
    request = {"query": "q", "page": 1}
    asked = [{"request_id": "1", "connector": "openalex", "request": request}, {"request_id": "2", "connector": "broken", "request": request}]
    found = connectors.search(spark, asked, "tests.fetchers:answer").cache()
    assert {(r.request_id, r.status) for r in found.collect()} == {("1", "completed"), ("2", "failed")}
    [one] = connectors.map_all(found).collect()
    assert one.title == "A Title" and one["keys"] == ["doi:10.1/x", "url:openalex.org/W1", "title:a title|ann|2024"] and one.authors == ["Ann"]
    assert connectors.request_key('{"a": 1, "b": 2}') == connectors.request_key('{"b": 2, "a": 1}')
    replayed = connectors.replay(spark.createDataFrame([("1", "openalex", "k"), ("2", "arxiv", "none")], "request_id string, connector string, key string"), spark.createDataFrame([("openalex", "k", "{}")], "connector string, key string, payload string"))
    assert {(r.request_id, r.status) for r in replayed.collect()} == {("1", "completed"), ("2", "failed")}


def test_retries():
    waits, calls = [], []

    def flaky(_c, _r):
        calls.append(1)
        if len(calls) < 3:
            raise connectors.HttpError(503)
        return "ok"

    assert connectors.fetch_with_retry(flaky, "c", "r", sleep=waits.append) == "ok" and len(waits) == 2 and 1 <= waits[0] <= 1.25 <= 2 <= waits[1] <= 2.5
    with pytest.raises(connectors.HttpError):
        connectors.fetch_with_retry(lambda *_: (_ for _ in ()).throw(connectors.HttpError(404)), "c", "r", sleep=waits.append)
    assert len(waits) == 2 and connectors.pause(9, 0) == 8.0 and [connectors.zenodo_page(p) for p in (0, 5, 99)] == [1, 5, 25]


def test_payloads_of_all_providers(spark):
    payloads = {
        "crossref": json.dumps({"message": {"items": [{"DOI": "10.1/X", "URL": "https://doi.org/10.1/x", "title": ["T"], "author": [{"given": "A", "family": "B"}], "published": {"date-parts": [[2024, 3, 1]]}}]}}),
        "semantic_scholar": json.dumps({"data": [{"title": "T", "url": "u", "year": 2024, "externalIds": {"DOI": "10.1/x"}, "openAccessPdf": {"url": "p"}, "authors": [{"name": "A B"}]}]}),
        "zenodo": json.dumps({"hits": {"hits": [{"id": 7, "doi": "10.5/z", "links": {"html": "h"}, "metadata": {"title": "Z", "creators": [{"name": "C"}], "publication_date": "2023-01-01"}}]}}),
        "figshare": json.dumps([{"id": 9, "title": "F", "doi": "10.6/f", "url_public_html": "u"}]),
        "github": json.dumps({"items": [{"id": 3, "full_name": "a/b", "html_url": "https://github.com/a/b", "owner": {"login": "a"}}]}),
        "arxiv": "<feed><entry><id>http://arxiv.org/abs/2401.00001v1</id><title>An\n entry</title><published>2024-01-01T00:00:00Z</published><author><name>A B</name></author><author><name>C</name></author><link href='http://arxiv.org/pdf/2401.00001v1' title='pdf'/></entry></feed>",
        "openalex": "not json",
    }
    answers = spark.createDataFrame([(c, c, "completed", p, None) for c, p in payloads.items()], connectors.SCHEMA)
    by = {r.provider: r for r in connectors.map_all(answers).collect()}
    assert set(by) == set(payloads) - {"openalex"}
    assert by["crossref"].published == "2024-03-01" and by["crossref"]["keys"][0] == by["semantic_scholar"]["keys"][0] == "doi:10.1/x"
    assert by["arxiv"].title == "An entry" and by["arxiv"].pdf_url == "http://arxiv.org/pdf/2401.00001v1" and by["arxiv"]["keys"][0] == "arxiv:2401.00001v1" and by["arxiv"].authors == ["A B", "C"]
    assert "record:zenodo:7" in by["zenodo"]["keys"] and by["github"].kind == "repository"
    details = spark.createDataFrame([(9, "Full", None, "w")], "id long, title string, doi string, url string")
    assert connectors.map_figshare(answers, details).first().asDict()["title"] == "Full"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 5, ["a"]), ("plain, \"quoted\"", None, None), ("-x", 1, [])], "t string, n int, l array<string>")
    sinks.write_csv(rows, str(tmp_path / "c"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part*"))
    assert raw.startswith("﻿t,n,l".encode()) and b"'=1+1" in raw
    back = {tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "c")).collect()}
    assert back == {("=1+1", "5", '["a"]'), ('plain, "quoted"', None, None), ("-x", "1", "[]")}
    opened = spark.createDataFrame([("r", "t1", {"a": '"x"'})], "record_id string, table_name string, fields map<string,string>")
    written = sinks.write_tables(opened, {"t1": ["a", "b"], "empty": ["q"]}, str(tmp_path / "w"))
    assert pd.concat([pd.read_csv(p) for p in (tmp_path / "w" / "t1").glob("part*")]).columns.tolist() == ["record_id", "a", "b"]
    assert [pd.read_csv(p).columns.tolist() for p in (tmp_path / "w" / "empty").glob("part*")] == [["record_id", "q"]] and set(written) == {"t1", "empty"}
    assert sinks.union_tables([rows.select("t"), rows.select("n")]).columns == ["t", "n"]
    sinks.write_bundle({"rows": rows.select("t")}, str(tmp_path / "b"), ("rows",))
    assert spark.read.parquet(str(tmp_path / "b/rows")).count() == spark.read.json(str(tmp_path / "b/rows_json")).count() == 3
    text = sinks.report("R", rows.agg(F.count("*").alias("n")), {"Rows": rows.select(F.lit("a|b").alias("x"))})
    assert "- n: 3" in text and "a\\|b" in text
