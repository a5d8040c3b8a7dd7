import pytest
from pyspark.sql import functions as F

from attestor.operators import records
from attestor.plans import engine, manifest, registry


def test_engine_over_a_folder_and_blocks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Paper Title,Material,Method,PCE (%),Condition,FID\nP1,MAPbI3,spin coating,21.3,AM 1.5,\nP1,MAPbI3,spin coating,19.8,AM 1.5,\nP2,FAPbI3,annealing,,dark,7.5\n")
    schema = "record_id string, ordinal int, table_name string, fields map<string,string>, source_file string, source_type string, page int, evidence_text string, confidence double, warnings array<string>, paper_title string, origin string"
    opened = spark.createDataFrame([("o1", 1, "results", {"metric_name": '"accuracy"', "value": '"91%"'}, "a.pdf", "pdf_text", 1, "accuracy of 91", 0.9, [], None, None)], schema)
    plan = spark.createDataFrame([("results", "dataset", "string", True, True, 1)], "table_name string, field string, type string, required boolean, evidence_required boolean, ordinal int")
    result = engine.run_folder(spark, str(tmp_path), opened, plan)
    found = {(r.metric_name, r.metric_value) for r in result.records.collect()}
    assert found == {("PCE", 21.3), ("PCE", 19.8), ("FID", 7.5), ("accuracy", 91.0)}
    assert [(r.metric, r.n_values) for r in result.conflicts.collect()] == [("pce", 2)]
    row = result.report.first()
    assert row.record_count == 4 and row.conflict_count == 1 and row.dynamic_record_count == 1
    assert {r.subject_type for r in result.review.collect()} == {"record", "conflict", "coverage_gap"}
    assert {r.field for r in result.issues.collect()} >= {"dataset", "page"}
    assert {r.source_file: r.record_count for r in result.survey.collect()} == {"m.csv": 3, "a.pdf": 1}
    assert {"records", "sections", "traces", "checks", "coverage", "gaps", "decision"} <= set(result.tables())
    assert result.decision.first().decision == "continue" and [r.name for r in result.gaps.collect()] == ["dataset"]


def test_engine_over_every_route(spark, tmp_path):
    """HTML, text, tables and recorded pages become sections, records, traces, checks, coverage and a review queue."""
    (tmp_path / "t.csv").write_text("Material,PCE (%)\nTiO2,15.5\n")
    (tmp_path / "w.html").write_text("<html><script>x</script><p>The device has an accuracy of 91.5 % under AM 1.5.</p></html>")
    (tmp_path / "n.md").write_bytes("光电 recall of 80 % was seen on the test set.".encode("gb18030"))
    pages = spark.createDataFrame([("p.pdf", 1, "1 Introduction\nNothing is measured here, only told at length."), ("p.pdf", 2, "2 Results\nThe best bandgap of 1.55 eV was found in MAPbI3 films.\nA weak bandgap of 9.9 eV was seen on glass.")], "source_file string, page int, text string")
    schema = "record_id string, ordinal int, table_name string, fields map<string,string>, source_file string, source_type string, page int, evidence_text string, confidence double, warnings array<string>, paper_title string, origin string"
    opened = spark.createDataFrame([("o1", 1, "results", {"dataset": '"d"'}, "p.pdf", "pdf_text", 2, "films", 0.9, [], None, None)], schema)
    plan = spark.createDataFrame([("results", "dataset", "string", True, True, 1), ("results", "host", "string", True, True, 2)], "table_name string, field string, type string, required boolean, evidence_required boolean, ordinal int")
    sources = spark.createDataFrame([("s1", "On films", ["dl/p.pdf"], 1)], "source_id string, title string, paths array<string>, ordinal long")
    figures = spark.createDataFrame([("f1", "p.pdf", 2, 1)], "figure_id string, source_file string, page int, ordinal long")
    axis = ("eV", "linear", 0.0, 2.0)
    charts = spark.createDataFrame([("f1", "line", True, 0.3, axis, axis, [("s", [[1.0, 1.55], [None, 2.0]])], "Fig. 1", "axis reading")], engine.OPTIONAL["charts"])
    made = engine.run_folder(spark, str(tmp_path), opened, plan, pages, sources=sources, figures=figures, charts=charts)
    assert {(r.source_file, r.metric_name, r.metric_value) for r in made.records.collect()} == {("t.csv", "PCE", 15.5), ("w.html", "accuracy", 91.5), ("n.md", "recall", 80.0), ("p.pdf", "bandgap", 1.55), ("p.pdf", "bandgap", 9.9)} - {("n.md", "recall", 80.0)}
    assert {r.metric_name for r in made.rejected.collect()} == {"recall"}
    assert {(r.section_title, r.page) for r in made.sections.where("source_file = 'p.pdf'").collect()} == {("1 Introduction", 1), ("2 Results", 2)}
    traces = {(r.source_file, r.section_title, r.source_id, r.figure_id, r.evidence_type) for r in made.traces.collect()}
    assert ("p.pdf", "2 Results", "s1", "f1", "figure") in traces and ("t.csv", None, None, None, "text") in {(a, b, c, d, "text") for a, b, c, d, _ in traces}
    assert [(r.subject_id, r.status, r.matched) for r in made.checks.collect()] == [("f1", "supported", 1)]
    assert [r.needs_review for r in made.charts.collect()] == [True]
    assert {r.name: r.status for r in made.coverage.collect()} == {"dataset": "covered", "host": "missing"}
    assert {"figure", "coverage_gap", "record"} <= {r.subject_type for r in made.review.collect()}
    assert made.decision.first().decision == "continue" and made.report.first().record_count == 4


def test_registry(spark):
    r = registry.Registry()
    r.register("fields", records.explode_fields, ("open",))
    with pytest.raises(ValueError):
        r.register("fields", records.explode_fields)
    r.register("far", lambda t: t, ("open", "none"), remote=True)
    opened = spark.createDataFrame([("a", "t", {"x": "1"})], "record_id string, table_name string, fields map<string,string>")
    assert r.call("fields", {"open": opened}).count() == 1 and r.runnable({"open": opened}) == ["fields"]
    assert [d["name"] for d in r.describe()] == ["far", "fields"]
    actions = spark.createDataFrame([("parse_table", 1), ("parse_table", 2), ("parse_csv", 3)], "action string, artifact_id int")
    artifacts = spark.createDataFrame([(1, "csv", "downloaded", []), (2, "pdf", "downloaded", []), (3, "csv", "downloaded", ["parse_csv"])], "artifact_id int, artifact_type string, status string, completed_operations array<string>")
    assert [tuple(x) for x in registry.possible_actions(actions, artifacts).collect()] == [("parse_table", 1)]
    used = spark.createDataFrame([("parse_table", 2)], "action string, n int")
    assert {(x.artifact_id, x.problem) for x in registry.allowed(actions, {"parse_table": 2}, used).collect()} == {(1, "budget is used up"), (2, "budget is used up"), (3, None)}
    asked = spark.createDataFrame([("arxiv", "cells", ["new cells", "old cells"]), ("zenodo", "x", []), ("arxiv", "keep", [])], "connector string, query string, revised array<string>")
    assert {x.query for x in registry.search_requests(asked, ["arxiv"], ["OLD"]).collect()} == {"new cells", "keep"}


def test_manifest_and_stages(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    done = manifest.mark_done(manifest.changed(files, spark.createDataFrame([], manifest.MANIFEST), "parse", "content"), "parse")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "1")], files.schema)
    assert sorted(r.path for r in manifest.changed(now, done, "parse", "content").collect()) == ["b", "c"]
    assert manifest.changed(files, done, "other", "content").count() == 2
    calls = []

    def make():
        calls.append(1)
        return files.withColumn("n", F.length("content"))

    for source in (files, files.orderBy(F.desc("path")), now):
        manifest.staged(spark, str(tmp_path), "s", [source], make)
    assert len(calls) == 2 and manifest.staged(spark, str(tmp_path), "s", [files], make).count() == 2
    assert manifest.in_order(["a", "b"], {"a"}) == "b" and manifest.in_order(["a"], {"a"}) is None


def test_places_are_in_the_order_of_their_numbers(spark):
    from pyspark.sql import functions as F

    from attestor.plans.engine import _padded, _place

    given = [(1, 2, 999), (1, 2, 1000), (1, 10, 0), (1, 1000, 5), (2, 0, 0), (1000, 1, 1), (1_000_000, 0, 0)]
    rows = spark.createDataFrame(given, "a int, b int, c int").withColumns({"p": _place(F.col("a"), F.col("b"), F.col("c")), "j": _padded(F.to_json(F.struct("a", "b", "c")))})
    assert [tuple(r)[:3] for r in rows.orderBy("p").collect()] == given == [tuple(r)[:3] for r in rows.orderBy("j").collect()]
