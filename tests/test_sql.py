"""Table functions of SQL, and layout operators on odd rows."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import sql
from attestor.operators import containment, layout


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "a", 2, 0.5, None), (2, "b", None, 1.5, True)], "id int, name string, n int, x double, flag boolean").createOrReplaceTempView("wide")
    found = {tuple(r) for r in spark.sql("SELECT * FROM unpivot_metrics(TABLE(wide), 'id, name')").collect()}
    assert found == {(1, "a", "n", 2.0), (1, "a", "x", 0.5), (2, "b", "x", 1.5)}
    spark.range(7).selectExpr("id", "id % 2 as k").createOrReplaceTempView("rows")
    found = {tuple(r) for r in spark.sql("SELECT * FROM row_batches(TABLE(rows) PARTITION BY k ORDER BY (id), 'k, id', 2)").collect()}
    assert found == {(0, 0, 1, 1), (0, 2, 1, 2), (0, 4, 2, 1), (0, 6, 2, 2), (1, 1, 1, 1), (1, 3, 1, 2), (1, 5, 2, 1)}
    spark.createDataFrame([(1, "abcde"), (2, ""), (3, None)], "k int, t string").createOrReplaceTempView("texts")
    assert {tuple(r) for r in spark.sql("SELECT * FROM cut_texts(TABLE(texts), 'k', 't', 2)").collect()} == {(1, 0, "ab"), (1, 1, "cd"), (1, 2, "e")}
    for wrong in ("unpivot_metrics(TABLE(wide), 'none')", "row_batches(TABLE(rows), 'k', 0)", "cut_texts(TABLE(texts), 'k', 'k', 2)"):
        with pytest.raises(Exception, match="column|at least|no text"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_containment_against_all_pairs(spark):
    import random

    rnd = random.Random(1)
    make = lambda n: "".join(rnd.choices("abé ", k=n))
    needles = [make(rnd.randint(0, 16)) for _ in range(80)] + [None, "", "a", "a"]
    hays = [make(rnd.randint(0, 60)) for _ in range(60)] + [n + "x" for n in needles[:20]] + [None, ""]
    found = {tuple(r) for r in containment.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hays], "hay string")).collect()}
    assert found == {(n, h) for n in needles for h in hays if n and h and n in h} and len(found) > 100


WORD = "source_file string, page int, x0 double, top double, x1 double, bottom double, text string, extra int"


def test_layout_of_odd_rows(spark):
    rows = [("f", 1, 10.0, 10.0, 30.0, 20.0, "a", 1), ("f", 1, 200.0, 11.0, 220.0, 21.0, "b", 1), ("f", 1, 10.0, 30.0, 30.0, 40.0, "c", 1), ("f", 1, 200.0, 30.0, 220.0, 40.0, "d", 1), ("f", 1, 10.0, 30.0, 30.0, 40.0, "c", 1)]
    rows += [("f", 1, None, 30.0, 1.0, 40.0, "x", 1), (None, 1, 1.0, 1.0, 2.0, 2.0, "x", 1), ("f", None, 1.0, 1.0, 2.0, 2.0, "x", 1), ("f", 1, 1.0, 1.0, 2.0, 2.0, None, 1), ("g", 1, 1.0, 1.0, 9.0, 9.0, "alone", 1)]
    words = spark.createDataFrame(rows, WORD)
    [one] = layout.text_tables(words).collect()
    assert one.grid == [["a", "b"], ["c c", "d"]] and one.bbox == [10.0, 10.0, 220.0, 40.0] and one.source_file == "f"
    none = words.limit(0)
    assert layout.page_tables(none, none).count() == 0 and layout.text_lines(none).count() == 0
    box = "source_file string, page int, x0 double, top double, x1 double, bottom double, kind string"
    chain = spark.createDataFrame([("f", 1, 20.0 * i, 0.0, 20.0 * i + 15, 10.0, "drawing") for i in range(200)] + [("f", 1, 0.0, 500.0, 10.0, 510.0, "drawing"), ("f", 2, 0.0, 0.0, 10.0, 10.0, "drawing")] * 2, box)
    found = layout.together(layout._units(chain), 12.0).groupBy("page", "root").agg(F.count("*").alias("n")).collect()
    assert sorted((r.page, r.n) for r in found) == [(1, 2), (1, 200), (2, 2)]
