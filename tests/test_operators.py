import json
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import browse, catalog, charts, clustering, coverage, crossmodal, evidence, extract, quality, records, review, sections, tables, triage, typing
from attestor.operators.extensions import as_of

OPEN = "record_id string, ordinal int, table_name string, fields map<string,string>, source_file string, source_type string, page int, evidence_text string, confidence double, warnings array<string>, paper_title string, origin string"
STRICT = "record_id string, ordinal int, paper_title string, material string, method string, metric_name string, metric_value double, unit string, condition string, source_file string, source_type string, page int, evidence_text string, confidence double, warnings array<string>"


def open_row(i, table, fields, file="a.pdf", evidence="text", confidence=0.9, warnings=(), page=1, origin=None, kind="pdf_text"):
    return (f"r{i}", i, table, {k: json.dumps(v) for k, v in fields.items()}, file, kind, page, evidence, confidence, list(warnings), None, origin)


def test_open_conflicts(spark):
    def found(*rows):
        return quality.open_conflicts(spark.createDataFrame(list(rows), OPEN)).collect()

    a = open_row(1, "results", {"method": "model-a", "dataset": "benchmark", "score": 0.80}, "paper-a.pdf")
    b = open_row(2, "results", {"method": "model-a", "dataset": "benchmark", "score": 0.84}, "paper-b.pdf")
    [one] = found(a, b)
    assert (one.table_name, one.field, one["values"], one.n_sources) == ("results", "score", "0.8,0.84", 2)
    assert not found(a, open_row(2, "results", {"method": "model-a", "dataset": "benchmark-b", "score": 0.84}, "paper-b.pdf"))
    assert not found(open_row(1, "r", {"method": "m", "score": 1}, "a"), open_row(2, "r", {"method": "m", "score": 2}, "b"))
    assert not found(a, open_row(2, "results", {"method": "model-a", "dataset": "benchmark", "score": 0.84}, "paper-a.pdf"))
    assert not found()


def strict_row(i, value, file="a.pdf", **more):
    row = {"paper_title": None, "material": "MAPbI3", "method": "spin coating", "metric_name": "PCE", "unit": "%", "condition": None, "source_type": "pdf_text", "page": 1, "evidence_text": f"PCE of {value} %", "confidence": 0.8, "warnings": []} | more
    return (f"r{i}", i, row["paper_title"], row["material"], row["method"], row["metric_name"], value, row["unit"], row["condition"], file, row["source_type"], row["page"], row["evidence_text"], row["confidence"], row["warnings"])


def test_metric_conflict_and_dedup(spark):
    rows = spark.createDataFrame([strict_row(1, 21.3, "paper_a.pdf"), strict_row(2, 19.8, "paper_b.pdf"), strict_row(3, 21.3, "Paper_A.pdf"), strict_row(4, 5.0, method=None)], STRICT)
    [one] = quality.metric_conflicts(rows).collect()
    assert (one.entity, one.metric, one.context, one.n_values) == ("mapbi3", "pce", "spin coating", 2)
    assert sorted(r.record_id for r in records.deduplicate(rows).collect()) == ["r1", "r2", "r4"]


def test_strict_from_open(spark):
    rows = [
        open_row(1, "t", {"metric_name": "PCE", "metric_value": "21.3%", "material": "MAPbI3", "method_name": "spin  coating", "value": 21.3}),
        open_row(2, "t", {"fid": 12.5, "accuracy": "n/a", "dataset": "d", "unit": "x"}),
        open_row(3, "t", {"score": 1}),
    ]
    found = {(r.derived_from, r.metric_name, r.metric_value, r.unit, r.material, r.method, r.condition) for r in records.strict_from_open(spark.createDataFrame(rows, OPEN)).collect()}
    assert found == {("r1", "PCE", 21.3, "%", "MAPbI3", "spin coating", None), ("r2", "fid", 12.5, "x", None, None, "d")}


def test_curation(spark):
    sources = spark.createDataFrame([("A Title", "http://arxiv.org/abs/2601.00001", ["Ann"], "2026-01-02T00:00", "dl/x.pdf", "arxiv", "paper", -1)], "title string, url string, authors array<string>, published string, downloaded_path string, provider string, source_type string, ordinal int")
    made = records.arxiv_metadata(sources)
    weak = open_row(1, "paper_metadata", {"title": "?", "authors": ["unknown"]}, "x.pdf", "from page")
    sized = open_row(2, "deployment_efficiency", {"model_size_mb": 1698.4, "fps": 3}, "y.pdf", "1698.4M parameters", warnings=["value should be null"])
    plain = open_row(3, "t", {"a": 1}, "z.pdf", None, page=None)
    curated = records.curate(spark.createDataFrame([weak, sized, plain], OPEN))
    by = {r.record_id: r for r in curated.collect()}
    assert "date or authors" in by["r1"].reasons[0]
    assert by["r2"].fields["model_size_mb"] == "null" and by["r2"].repaired["model_size_mb"] == "1698.4" and "values taken out" in by["r2"].reasons[0]
    assert by["r3"].confidence == 0.55 and by["r3"].reasons == ["values without evidence", "confidence below the review threshold", "comes from a PDF, but its page is not known"]
    merged = {r.source_file: r for r in records.merge_open(made.unionByName(curated.select(*made.columns))).collect()}
    paper = merged["x.pdf"]
    assert paper.confidence == 1.0 and json.loads(paper.fields["authors"]) == ["Ann"] and json.loads(paper.fields["publication_date"]) == "2026-01-02" and json.loads(paper.fields["title"]) == "A Title" and json.loads(paper.fields["venue"]) == "arXiv:2601.00001"
    members = {}
    for r in records.merged_members(made.unionByName(curated.select(*made.columns))).orderBy("ordinal").collect():
        members.setdefault(r.merge_id, []).append(r.record_id)
    assert paper.merged == 2 == len(members[paper.merge_id]) and members[merged["z.pdf"].merge_id] == ["r3"]


def test_checks_of_records(spark):
    rows = [strict_row(1, 21.3), strict_row(2, 5.0, evidence_text="no number"), strict_row(3, None, unit=None, metric_name="yield"), strict_row(4, 1.0, evidence_text=None, unit="", metric_name="FID")]
    by = {r.record_id: r for r in quality.check_strict(spark.createDataFrame(rows, STRICT)).collect()}
    assert by["r1"].issues == [] and by["r1"].confidence == 0.8
    assert by["r2"].confidence == 0.5 and {i.field for i in by["r2"].issues} == {"evidence_text", "confidence"}
    assert by["r3"].confidence == 0.55 and {(i.level, i.field) for i in by["r3"].issues} == {("warning", "metric_value"), ("info", "unit"), ("warning", "confidence")}
    assert by["r4"].confidence == 0.45 and by["r4"].unit == "dimensionless"
    plan = spark.createDataFrame([("t", "b", True), ("t", "c", False)], "table_name string, field string, required boolean")
    opened = [open_row(1, "t", {"a": 1}, warnings=["Required field without a value: b", "odd", "Odd."]), open_row(2, "u", {}, evidence=None, confidence=0.2)]
    found = {(r.record_id, r.field, r.message) for r in quality.check_open(spark.createDataFrame(opened, OPEN), plan).collect()}
    assert found == {("r1", "b", "required field without a value: b"), ("r1", "record_warning", "odd"), ("r2", "confidence", "Confidence is below the review threshold.")}


def matches(evidence, page):
    import re

    def squash(t):
        return "".join(c for c in t.lower() if c.isalnum())

    def tokens(t):
        return re.findall(r"\d+(?:\.\d+)*|[a-z]+[a-z0-9]*(?:-[a-z0-9]+)*|[㐀-鿿]+", t.lower())

    if len(squash(evidence)) < 8:
        return False
    if squash(evidence) in squash(page):
        return True
    want, have = tokens(evidence), tokens(page)
    if len(want) < 4 or (len(want) < 8 and not any(t[0].isdigit() for t in want)):
        return False
    at = 0
    for t in want:
        if t not in have[at:]:
            return False
        at = have.index(t, at) + 1
    return True


def test_evidence_on_a_page_against_a_loop(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "12.5", "gamma-2", "x", "7"]
    cases = [("Header one; row 2 12.5", "Header: one\nrow 1 3\nrow 2 12.5"), ("short", "short"), ("alpha beta gamma", "ALPHA-beta  gamma"), ("", "x")]
    cases += [(" ".join(rng.choices(words, k=rng.randint(1, 9))), " ".join(rng.choices(words, k=rng.randint(0, 25)))) for _ in range(300)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, p string")
    found = [r[0] for r in df.orderBy("i").select(quality.on_page(F.col("e"), F.col("p"))).collect()]
    assert found == [matches(e, p) for e, p in cases] and 20 < sum(found) < 280


def test_provenance(spark):
    blocks = spark.createDataFrame([("dir/A.pdf", 1, "first part", 1), ("dir/A.pdf", 1, "of the page", 2), ("b.pdf", None, "no page", 1)], "source_file string, page int, text string, ordinal int")
    tabular = spark.createDataFrame([("A.pdf", 2, "Cap", ["m", "v"], [{"m": '"PCE"', "v": "21.3"}], 1)], "source_file string, page int, caption string, columns array<string>, rows array<map<string,string>>, ordinal int")
    pages = quality.page_texts(blocks, tabular)
    assert {(r.file, r.page): r.text for r in pages.collect()} == {("dir/a.pdf", 1): "first part\nof the page", ("a.pdf", 2): 'Cap\nm v\nm: "PCE", v: 21.3'}
    rows = spark.createDataFrame([strict_row(1, 1.0, "other/a.PDF", evidence_text="part of the"), strict_row(2, 1.0, "dir/a.pdf", evidence_text="not on this page"), strict_row(3, 1.0, "a.pdf", evidence_text="first part of", page=None), strict_row(4, 1.0, "a.pdf", evidence_text="x", source_type="csv")], STRICT)
    located = quality.provenance(rows, pages)
    assert [(r.record_id, r.checked, r.located, r.confidence) for r in located.orderBy("record_id").collect()] == [("r1", True, True, 0.8), ("r2", True, False, 0.5), ("r3", True, False, 0.5), ("r4", False, False, 0.8)]
    assert {r.record_id: "not known" in r.message for r in quality.provenance_issues(located).collect()} == {"r2": False, "r3": True}


def test_evidence_lookups_and_traces(spark):
    rows = spark.createDataFrame([("r1", "in/a.pdf", "pdf_text", 2, "the evidence", 0.9, None), ("r2", "b.pdf", "csv", None, None, 0.9, "Some Title"), ("r3", "z.pdf", "csv", None, "x", 0.5, None)], "record_id string, source_file string, source_type string, page int, evidence_text string, confidence double, paper_title string")
    sources = spark.createDataFrame([("s1", "about a.pdf here", [], 1), ("s2", "some title", ["x/a.pdf"], 2)], "source_id string, title string, paths array<string>, ordinal int")
    met = evidence.match_sources(rows, sources)
    assert {(r.record_id, r.source_id, r.tier) for r in met.collect()} == {("r1", "s1", 3), ("r2", "s2", 1)}
    parts = spark.createDataFrame([("a.pdf", "c1", "A", "nothing", 1, 1, 1), ("a.pdf", "c2", "B", "has the  evidence in it", 3, 4, 2), ("a.pdf", "c3", "C", "", 2, 2, 3)], "source_file string, section_id string, section_title string, text string, page_start int, page_end int, ordinal int")
    found_sections = evidence.match_sections(rows, parts)
    assert {(r.record_id, r.section_id, r.tier) for r in found_sections.collect()} == {("r1", "c2", 1)}
    items = spark.createDataFrame([("x/a.pdf", 2, 5, "t5"), ("a.pdf", 2, 4, "t4"), ("b.pdf", 9, 1, "t9")], "source_file string, page int, ordinal int, table_id string")
    found_tables = evidence.match_on_page(rows, items, "table_id")
    assert {(r.record_id, r.table_id) for r in found_tables.collect()} == {("r1", "t4"), ("r2", "t9")}
    none = lambda schema: spark.createDataFrame([], schema)
    made = evidence.traces(rows, met, none("record_id string, artifact_id string"), found_sections, found_tables.withColumn("table_method", F.lit("lines")), none("record_id string, figure_id string"), none("figure_id string, extraction_method string"))
    by = {r.record_id: r for r in made.collect()}
    assert (by["r1"].evidence_type, by["r1"].locator_status, by["r1"].extraction_method) == ("table", "resolved", "lines")
    assert by["r2"].locator_status == "partial" and by["r3"].locator_status == "unresolved" and "No known source" in by["r3"].notes


def test_cross_modal(spark):
    subjects = spark.createDataFrame([("figure", "f1", "A.pdf", 1, True), ("figure", "f2", "A.pdf", 1, False), ("table", "t1", "a.pdf", 1, True), ("table", "t2", "a.pdf", 2, True), ("table", "t3", "a.pdf", 1, True)], "kind string, subject_id string, source_file string, page int, contains_data boolean")
    numbers = spark.createDataFrame([("f1", 1.0), ("f1", 0.80), ("t1", 0.8), ("t3", 500.0), ("t2", 1.0)], "subject_id string, value double")
    references = spark.createDataFrame([("figure", "a.pdf", 1, 0.8), ("figure", "a.pdf", 1, 0.805), ("table", "a.pdf", 1, 0.79)], "kind string, source_file string, page int, value double")
    near = spark.createDataFrame([("figure", "a.pdf", 1, "text"), ("figure", "a.pdf", 1, "table"), ("table", "a.pdf", 1, "text")], "kind string, source_file string, page int, modality string")
    by = {r.subject_id: r for r in crossmodal.checks(subjects, numbers, references, near).collect()}
    assert (by["f1"].status, by["f1"].matched, by["f1"].candidates, by["f1"].modalities) == ("supported", 1, 2, ["figure", "text", "table"]) and by["f1"].confidence == pytest.approx(0.8)
    assert [by[k].status for k in ("f2", "t1", "t2", "t3")] == ["not_comparable", "supported", "not_comparable", "partial"]


def test_band_matches_against_all_pairs(spark):
    rng = random.Random(2)
    draw = lambda: rng.choice([rng.uniform(-1, 1), rng.gauss(0, 50), 10 ** rng.uniform(-3, 6), 0.0, 0.65, 0.68, -0.667])
    mine = [(rng.randint(0, 3), i % 7, draw()) for i in range(400)]
    theirs = [(k, v * rng.uniform(0.95, 1.05) + rng.uniform(-0.03, 0.03)) for k, _, v in rng.sample(mine, 200)]
    found = crossmodal.band_matches(spark.createDataFrame(mine, "k int, id int, value double"), spark.createDataFrame(theirs, "k int, value double"), ["k"]).collect()
    want = {}
    for k, i, v in mine:
        n, m = want.get((k, i), (0, 0))
        want[k, i] = n + 1, m + any(k == q and abs(v - r) <= max(0.02, abs(v) * 0.03) for q, r in theirs)
    assert {(r.k, r.id): (r.candidates, r.matched) for r in found} == want


CHART = "figure_id string, chart_type string, contains_data boolean, confidence double, x_axis struct<unit:string,scale:string,range_min:double,range_max:double>, y_axis struct<unit:string,scale:string,range_min:double,range_max:double>, series array<struct<name:string,points:array<array<double>>>>, caption string"


def chart(points, caption="", confidence=0.9, x=(0.0, 10.0), unit="nm", figure="f"):
    return (figure, "line", True, confidence, (unit, "linear", *x), ("eV", "linear", 0.0, 1.0), [("s", points)] if points is not None else [], caption)


def test_chart_validation_and_arbitration(spark):
    def codes(*rows):
        return [[i.code for i in r.issues] for r in charts.validate(spark.createDataFrame(list(rows), CHART)).collect()]

    inside, outside = [[1.0, 0.5], [10.5, 1.0]], [[50.0, 0.5], [1.0, 0.5]]
    assert codes(chart(inside), chart(outside), chart(inside, "lasts 3 days"), chart(None), chart([]), chart(inside, confidence=0.3), chart(inside, x=(None, 1.0)), chart([[50.0, 0.5]] + inside * 3)) == [[], ["axis_range_mismatch"], ["unit_suspect"], ["no_series"], ["no_points"], ["low_confidence"], ["axis_range_missing"], ["points_near_axis_edge"]]

    def decide(a, b):
        v = lambda r: charts.validate(spark.createDataFrame([r], CHART))
        return charts.arbitrate(v(a), v(b)).first().decision

    assert decide(chart(outside), chart(inside)) == "accepted_second"
    assert decide(chart(inside), chart(None)) == "manual_review"
    assert decide(chart(inside), chart([[1.0, 0.5], [10.4, 1.0]])) == "kept_first"
    assert decide(chart(inside), chart([[9.0, 0.5], [10.5, 1.0]])) == "manual_review"
    fixed = charts.repair(spark.createDataFrame([chart([[1.0, float("nan")], [1.0], [2.0, 3.0]] + [[0.0, 0.0]] * 60)], CHART)).first()
    assert len(fixed.series[0].points) == 40 and fixed.series[0].points[0] == [2.0, 3.0]


def test_tables(spark):
    grid = [["Method", "FID ↓", ""], ["ours", "1,024", "N/A"], ["theirs", "12.50", "x"]]
    numeric = [["1", "2"], ["3", "4"]]
    raw = spark.createDataFrame([(1, grid), (2, numeric)], "i int, grid array<array<string>>")
    a, b = tables.shape(raw).orderBy("i").collect()
    assert a.columns == ["Method", "FID ↓", "column_3"] and a.rows == [{"Method": "ours", "FID ↓": "1024", "column_3": None}, {"Method": "theirs", "FID ↓": "12.5", "column_3": "x"}]
    assert b.columns == ["column_1", "column_2"] and len(b.rows) == 2
    ok = tables.shape(raw).select("i", tables.acceptable().alias("ok")).orderBy("i").collect()
    assert [r.ok for r in ok] == [True, True]
    boxes = spark.createDataFrame([("a", 1, [0.0, 0.0, 10.0, 10.0], 1), ("a", 1, [0.0, 0.0, 10.0, 9.0], 2), ("a", 1, [20.0, 0.0, 30.0, 9.0], 3)], "source_file string, page int, bbox array<double>, ordinal int")
    assert sorted(r.ordinal for r in tables.drop_overlapping(boxes).collect()) == [1, 3]


def test_table_extraction(spark):
    rows = [{"Paper Title": "P1", "Material": "MAPbI3", "Method": "spin coating", "PCE (%)": "21.3", "Condition": "AM 1.5", "FID": None}, {"Paper Title": "P2", "Material": "x", "Method": "y", "PCE (%)": "GPT-4", "Condition": None, "FID": "7.5"}]
    given = spark.createDataFrame([("t", "p.csv", "csv", None, list(rows[0]), rows)], "table_id string, source_file string, source_type string, page int, columns array<string>, rows array<map<string,string>>")
    found = {(r.paper_title, r.material, r.method, r.metric_name, r.metric_value, r.unit, r.condition) for r in extract.from_tables(given).collect()}
    assert found == {("P1", "MAPbI3", "spin coating", "PCE", 21.3, "%", "AM 1.5"), ("P2", "x", "y", "FID", 7.5, None, None)}


def test_text_extraction(spark):
    text = "Stable solar cells of today\nThe MAPbI3 film by spin coating reached a PCE of 21.3 % under AM 1.5G light. Nothing here to see at all, really."
    given = spark.createDataFrame([("a.pdf", 1, text, 1)], "source_file string, page int, text string, ordinal int")
    [one] = extract.from_text(given).collect()
    assert (one.material, one.method, one.metric_name, one.metric_value, one.unit, one.paper_title) == ("MAPbI3", "spin coating", "PCE", 21.3, "%", "Stable solar cells of today")
    assert one.condition == "under AM 1.5G light."


def test_extractor_interface(spark):
    def fragile(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[{"n": len(t)}] if t else [] for t in texts]

    given = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "three"), (4, "")], "i int, text string").coalesce(1)
    found = {(r.i, r.n, r.error) for r in extract.run_extractor(given, fragile, ["i"], "n long").collect()}
    assert found == {(1, 3, None), (2, None, "ValueError: bad text"), (3, 5, None)}


def test_sections(spark):
    pages = spark.createDataFrame([("a", 1, "Abstract\nwe do\n1 Intro-\nduction\nfirst"), ("a", 2, "more first\n2 Methods\nsecond")], "source_file string, page int, text string")
    plan = spark.createDataFrame([("Intro", "a", "introduction", 1, "1 Introduction", 0.9), ("Methods", "a", "method", 1, "2 methods", 0.9), ("Gone", "a", "other", 1, "3 Results", 0.9)], "section_title string, source_file string, section_type string, start_page int, start_anchor string, confidence double")
    cut = sections.cut_sections(sections.locate(plan, pages), pages).orderBy("section_title", "page").collect()
    assert [(r.section_title, r.page, r.text) for r in cut] == [("Intro", 1, "1 Intro-\nduction\nfirst"), ("Intro", 2, "more first"), ("Methods", 2, "2 Methods\nsecond")]
    blocks = spark.createDataFrame([("a", 1, "Some Plain Title Here\nbody text goes on and on, without an end\n1. Introduction\nFigure 3 shows\nReferences", 1)], "source_file string, page int, text string, ordinal int")
    found = sections.headings(blocks).orderBy("line").collect()
    assert [r.text for r in found] == ["Some Plain Title Here", "1. Introduction", "References"] and found[1].after == "Figure 3 shows References"
    assert [r.section_type for r in sections.section_plan(spark.createDataFrame(found)).orderBy("start_anchor").collect()] == ["introduction", "references"]
    long = spark.createDataFrame([("ab\n" * 10 + "x" * 30 + "\nend",)], "t string").select(sections.request_chunks(F.col("t"), 8)).first()[0]
    assert "".join(long) == "ab\n" * 10 + "x" * 30 + "\nend" and max(map(len, long)) <= 8


def test_headings_beyond_120_lines_of_a_block(spark):
    lines = [f"body number {i} goes on and on, without an end." for i in range(150)] + ["2. Methods", "what we did goes here, and on.", "References"]
    found = sections.headings(spark.createDataFrame([("a", 1, "\n\n".join(lines), 1)], "source_file string, page int, text string, ordinal int")).orderBy("line").collect()
    assert [(r.line, r.text) for r in found] == [(150, "2. Methods"), (152, "References")]
    assert found[0].before == " ".join(lines[148:150]) and found[0].after == " ".join(lines[151:]) and found[1].after == ""


def test_clustering(spark):
    schema = "source_id string, keys array<string>, ordinal int, provider string, confidence double, metadata map<string,string>"
    rows = [
        ("c", ["doi:1"], 1, "crossref", 0.5, {"published": '"2024-01-01"', "venue": "null"}),
        ("o", ["doi:1", "url:x"], 2, "openalex", 0.8, {"published": '"2025-01-01"', "venue": '"V"'}),
        ("p", ["title:q"], 3, "arxiv", 0.9, {}),
        ("b", ["url:x", "title:q"], 4, "zenodo", 0.1, {}),
        ("z", ["only"], 5, None, 0.2, {}),
    ]
    given = spark.createDataFrame(rows, schema)
    rooted = clustering.components(given)
    assert {r.id: r.root for r in rooted.collect()} == {"c": "b", "o": "b", "p": "b", "b": "b", "z": "z"}
    greedy = clustering.greedy_clusters(given, rooted)
    assert {r.id: r.cluster for r in greedy.collect()} == {"c": "c", "o": "c", "p": "p", "b": "c", "z": "z"}
    by = {r.cluster: r for r in clustering.merge_clusters(given, greedy).collect()}
    assert by["c"].providers == ["crossref", "openalex", "zenodo"] and by["c"].confidence == 0.8 and by["c"].metadata == {"published": '"2024-01-01"', "venue": '"V"'}
    assert [(r.cluster, r.field, r.kept) for r in clustering.value_conflicts(given, greedy).collect()] == [("c", "published", "2024-01-01")]


def test_greedy_clusters_equal_adding_records_one_by_one(spark):
    rng = random.Random(4)
    rows = [(i, [f"k{rng.randrange(900)}" for _ in range(rng.randrange(4))], o) for o, i in enumerate(rng.sample(range(3000), 1500))]
    rows += [(5000, ["left"], 2000), (5001, ["right"], 2001), (5002, ["left", "right"], 2002)] + [(6000 + i, [rng.choice(["left", "right"])], 3000 + i) for i in range(10000)]
    rows += [(20000 + i, [f"c{i - 1}", f"c{i}"], 20000 + i) for i in range(40)]
    led, want = {}, {}
    for own, keys, _ in sorted(rows, key=lambda r: r[2]):
        want[own] = next((led[k] for k in keys if k in led), own)
        for k in keys:
            led.setdefault(k, want[own])
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "source_id int, keys array<string>, ordinal int")
    found = clustering.greedy_clusters(given, clustering.components(given)).collect()
    assert len(found) == len(rows) and {r.id: r.cluster for r in found} == want and want[5002] == 5000 and want[5001] == 5001


def test_components_of_long_chains(spark):
    n = 200
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(n)] + [(1000 + i, ["hub"]) for i in range(50)]
    found = {r.id: r.root for r in clustering.components(spark.createDataFrame(rows, "source_id int, keys array<string>")).collect()}
    assert all(found[i] == 0 for i in range(n)) and all(found[1000 + i] == 1000 for i in range(50))


def test_triage_from_selections(spark):
    schema = "source_id string, ordinal int, title string, description string, reason string, url string, source_type string, confidence double, provider string, pdf_url string, files array<struct<name:string,type:string,size:bigint>>, size bigint"
    sources = [
        ("a", 1, "Perovskite cells", None, None, "u", "paper", 0.9, "arXiv ", "p", None, None), ("b", 2, "Perovskite two", None, None, "u", "paper", 0.8, "crossref", None, None, None), ("c", 3, "perovskite data", None, None, "u", "dataset", 0.7, "zenodo", None, [("t.csv", None, 100)], None),
        ("d", 4, "helium", None, None, "u", "paper", 0.9, "arxiv", "p", None, None), ("e", 5, "perovskite repo", None, None, "u", "repository", 0.9, "github", None, None, None), ("f", 6, "perovskite more", None, None, "u", "paper", 0.1, "arxiv", "p", None, None),
    ]
    picks = [(s, "deep_read", "high", 0.9 - i / 10, "primary_paper", ["paywall"] if s == "b" else []) for i, s in enumerate("abcdf")]
    found = triage.triage_selected(spark.createDataFrame(sources, schema), spark.createDataFrame(picks, "source_id string, decision string, priority string, priority_score double, source_role string, risk_notes array<string>"), "on perovskite", max_resources=2)
    by = {r.source_id: (r.action, r.ingest, r.risk, r.deferred) for r in found.collect()}
    assert by == {"a": ("download_pdf", True, "low", False), "b": ("read_metadata", False, "medium", False), "c": ("download_small_table", True, "low", False), "d": ("skip", False, "low", False), "e": ("skip", False, "low", False), "f": ("read_metadata", False, "low", True)}


def test_catalog_upkeep(spark):
    schema = "source_id string, url string, local_path string, artifact_type string, name string, status string, completed_operations array<string>"
    now = spark.createDataFrame([("s", "u", None, "pdf", "n", "planned", ["a"]), ("s", None, "C:\\x", "csv", "m", "downloaded", []), ("s", None, None, "csv", "k", "planned", [])], schema)
    old = spark.createDataFrame([("s", "u", "p", "html", "o", "inspected", ["b", "a"]), ("s", None, "c:/x", "csv", "m", "failed", [])], schema)
    by = {r.name: (r.status, r.local_path, r.completed_operations) for r in catalog.merge_state(now, old).collect()}
    assert by == {"n": ("inspected", "p", ["a", "b"]), "m": ("failed", "C:\\x", []), "k": ("planned", None, [])}
    assert catalog.entry_status(now).first().status == "downloaded"
    have = spark.createDataFrame([("a", 0, 1.0, "x")], "url string, warning_count int, confidence double, source_id string")
    past = spark.createDataFrame([("a", 0, 1.0, "x"), ("b", 1, 0.9, "y"), ("c", 0, 0.1, "z"), ("d", 0, 0.5, "w")], have.schema)
    assert sorted(r.url for r in catalog.fill_from_history(have, past, 3).collect()) == ["a", "c", "d"]


def test_typed_payloads(spark):
    plan = spark.createDataFrame([("t", "score", "number", True, 1), ("t", "tags", "list[string]", False, 2), ("t", "ok", "boolean", False, 3), ("t", "setting", "string", False, 4), ("t", "n", "integer", True, 5)], "table_name string, field string, type string, required boolean, ordinal int")
    given = spark.createDataFrame([("t", {"score": '"0.9"', "tags": '"one"', "ok": '"Yes"', "condition": "5", "odd": "1"}, []), ("t", {"tags": '"[\\"a\\"]"', "n": '"12"'}, []), ("u", {"a": "1"}, [])], "table_name string, fields map<string,string>, warnings array<string>")
    a, b = sorted(typing.conform(given, plan).collect(), key=lambda r: len(r.fields), reverse=True)
    assert a.fields == {"score": "0.9", "tags": '["one"]', "ok": "true", "setting": '"5"'} and a.extra == {"odd": "1"} and a.warnings == ["required field without a value: n"]
    assert {(e.field, e.event) for e in a.events} == {("score", "numeric_string_to_float"), ("tags", "scalar_to_list"), ("ok", "string_to_bool"), ("setting", "value_to_string")}
    assert b.fields == {"tags": '["a"]', "n": "12"}
    contract = typing.plan_contract(spark.createDataFrame([("m", "metric", "string", True, True, 1), ("m", "paper_url", "string", True, True, 2), ("m", "page", "int", True, True, 3)], "table_name string, field string, type string, required boolean, evidence_required boolean, ordinal int"))
    assert {(r.field, r.required) for r in contract.collect()} == {("metric", True), ("paper_url", False), ("condition", False)}


def test_review_and_browse(spark):
    rows = spark.createDataFrame([("a", 0.9, [], "pdf_text", 1, "x", 1.0, 1), ("b", 0.9, ["w"], "pdf_text", None, "", None, 2), ("c", 0.5, [], "csv", None, "x", 1.0, 3)], "record_id string, confidence double, warnings array<string>, source_type string, page int, evidence_text string, metric_value double, ordinal int")
    assert [(r.record_id, r.risk) for r in review.validation_sample(rows, 2).collect()] == [("b", 10), ("c", 2)]
    assert [r.record_id for r in browse.search(rows, "W", only_warnings=True).collect()] == ["b"]
    assert [r.ordinal for r in browse.tail(rows, 2, ["ordinal"]).collect()] == [2, 3]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, at int, x string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 6, 60)], "k int, at int, v int")
    assert {(r.x, r.v, r.seen) for r in as_of(left, right, ["k"], "at", {"v": "v", "at": "seen"}).collect()} == {("a", 50, 5), ("b", None, None), ("c", None, None)}


def test_coverage_of_events_and_measurements(spark):
    plan = spark.createDataFrame([("events", "event_id", "string", True, True, 1), ("measurements", "value", "number", True, True, 2)], "table_name string, field string, type string, required boolean, evidence_required boolean, ordinal int")
    rows = spark.createDataFrame([("events", {"event_id": '"e"'})] + [("measurements", {"value": "1"})] * 3, "table_name string, fields map<string,string>")
    items = coverage.requirement_coverage(plan, rows)
    assert {r.name: r.status for r in items.collect()} == {"event_id": "covered", "value": "covered"}
    none = lambda schema: spark.createDataFrame([], schema)
    gaps = coverage.gaps(items, none("evidence string"), none("evidence string, covered boolean, unavailable boolean"), none("artifact_id string"))
    assert gaps.count() == 0 and coverage.stop_decision(gaps).first().decision == "allow_stop"


def test_provenance_passes_over_parts_of_pages(spark, monkeypatch):
    import random

    from attestor.operators import quality

    rnd = random.Random(3)
    words = ["alpha", "beta-2", "3.5", "gamma", "delta", "7", "mu", "钙钛矿"]
    parts = [(rnd.choice(["in/a.pdf", "b.pdf", "x/c.pdf"]), rnd.randint(1, 3), i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(60)]
    parts += [("b.pdf", 1, 1000 + i, "alpha") for i in range(3000)]  # a page with most of all parts
    blocks = spark.createDataFrame(parts, "source_file string, page int, ordinal long, text string")
    asked = [(i, rnd.choice(["in/a.pdf", "B.pdf", "c.pdf", "none.pdf"]), rnd.choice([1, 2, 3, None]), " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(300)]
    rows = spark.createDataFrame(asked, "record_id int, source_file string, page int, evidence_text string").selectExpr("*", "'pdf_text' as source_type", "0.9D as confidence", "array('w') as warnings")
    whole = {(r.file, r.page): r.text for r in quality.page_texts(blocks).collect()} | {(r.base, r.page): r.text for r in quality.page_texts(blocks).collect()}
    text = spark.createDataFrame([(i, e, whole.get((f.lower(), p)) or whole.get((f.lower().rsplit("/", 1)[-1], p))) for i, f, p, e in asked], "record_id int, e string, t string")
    want = {r.record_id: r.on for r in text.select("record_id", quality.on_page(F.col("e"), F.col("t")).alias("on")).collect()}
    for questions in (20_000, 7):
        monkeypatch.setattr(quality, "QUESTIONS", questions)
        found = {r.record_id: r.located for r in quality.provenance(rows, quality.page_parts(blocks)).collect()}
        assert found == want and 20 < sum(found.values()) < 280


def test_calls_stay_in_order_and_bounded():
    import threading
    import time

    now, most, lock = 0, 0, threading.Lock()

    def call(i):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.001 * (i % 5))
        with lock:
            now -= 1
        return i

    drawn = []
    items = (drawn.append(i) or i for i in range(200))
    out = []
    for i in extract.in_turn(call, items, 3):
        out.append(i)
        assert len(drawn) - len(out) <= 6
    assert out == list(range(200)) and most <= 3
    slept = []
    assert extract.attempted(lambda t: [{"n": 1}], "x", 2, 0.0) == ([{"n": 1}], 1, None)

    def late(text):
        slept.append(text)
        raise TimeoutError("no")

    assert extract.attempted(late, "x", 2, 0.0) == ([], 3, "TimeoutError: no") and len(slept) == 3
