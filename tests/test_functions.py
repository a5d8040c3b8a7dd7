import re

import pytest
from pyspark.sql import functions as F

from attestor.functions import identity, labels, numbers, text, values


def column(spark, rows, kind, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_presence_of_json_values(spark):
    given = [None, "null", '""', "[]", "{}", "0", "false", '"x"', "0.0"]
    assert column(spark, given, "string", values.json_present) == [False, False, False, False, True, True, True, True, True]
    assert column(spark, given, "string", values.json_held) == [False, False, False, False, False, True, True, True, True]
    assert column(spark, ['"a\\"b"', "[1]", "1.5", "null", None], "string", values.json_plain) == ['a"b', "[1]", "1.5", "null", None]
    assert column(spark, ['["a", "b"]', '"a"', "null", None], "string", values.json_list) == [["a", "b"], ["a"], [], []]


def test_confidence(spark):
    assert column(spark, ["0.83", "0", "nan", "x", None, "7", "-1"], "string", lambda c: values.confidence(c, 0.5)) == [0.83, 0.0, 0.5, 0.5, 0.5, 1.0, 0.0]


def test_sentences_against_a_loop(spark):
    given = ["One two three four five six. Seven!\nEight nine ten eleven twelve", "", "短い。 これは長い文章です、二十文字を超えるはずの文です。", None, "x" * 2000]
    want = [[p.strip() for p in re.split(r"(?<=[.!?。！？])\s+", t) if 20 <= len(p.strip()) <= 900] if t is not None else None for t in given]
    assert column(spark, given, "string", text.sentences) == want


def pack(t, limit):
    if len(t) <= limit:
        return [t]
    out, now, size = [], [], 0
    for line in t.split("\n"):
        if now and size + len(line) + 1 > limit:
            out.append("\n".join(now))
            now, size = [], 0
        now.append(line)
        size += len(line) + 1
    return [*out, "\n".join(now)]


def test_chunks(spark):
    given = ["a\nbb\n\nccc\ndddddddddddd\ne", "short", "", "x" * 40, "a\n" * 30]
    assert column(spark, given, "string", lambda c: text.pack_lines(c, 10)) == [pack(t, 10) for t in given]
    assert column(spark, ["abcdefg", "", "abc"], "string", lambda c: F.transform(text.slices(c, 3), lambda s: s["text"])) == [["abc", "def", "g"], [""], ["abc"]]


def test_lenient_and_strict_numbers(spark):
    given = ["0.83", "1,024", "12 %", "1024×768", "1024x768", "3-5", "n/a", "about 7 km", "1 or 2", "word", None]
    found = column(spark, given, "string", numbers.lenient_number)
    assert [r.value for r in found] == [0.83, 1024.0, 12.0, None, None, None, None, 7.0, None, None, None]
    assert [r.warning for r in found] == ["read", "read", "read", "size", "size", "span", "blank", "mixed", "several", "words", None]
    assert column(spark, [" 1,200.5 % ", "+.5", "x 1", "1 2", ""], "string", numbers.strict_number) == [1200.5, 0.5, None, None, None]


def test_numbers_with_units_against_python(spark):
    pattern = re.compile(r"(?<![A-Za-z0-9])([-+]?\d+(?:\.\d+)?)\s*(" + "|".join(numbers.SENTENCE_UNITS) + ")?", re.IGNORECASE)
    given = ["PCE of 21.3 % under AM 1.5G in 2019", "at 550nm and -3 K, GPT4 got 5", "10 percent; 3.5 hours", "none", "x 12 ms 1999 2.0"]
    want = []
    for t in given:
        rows = [(float(v), {"percent": "%", "hours": "h", "days": "day"}.get(u, u) or None) for v, u in pattern.findall(t)]
        want.append([(v, u) for v, u in rows if not (u is None and v == int(v) and (v > 1900 or v < 0))])
    assert [[tuple(x) for x in r] for r in column(spark, given, "string", numbers.numbers_with_units)] == want


@pytest.mark.parametrize(("value", "evidence", "shown"), [(21.3, "PCE of 21.3 %", True), (21.3, "121.3", False), (21.3, "21.35", False), (5.0, "got 5.", True), (5.0, "got 5.1", False), (1200.0, "1,200 items", True), (0.5, "0.50", True), (0.5, None, False), (None, "1", False), (2.0, "12 2", True)])
def test_value_in_text(spark, value, evidence, shown):
    df = spark.createDataFrame([(value, evidence)], "v double, t string")
    assert df.select(numbers.value_in_text(F.col("v"), F.col("t"))).first()[0] is shown


def test_names(spark):
    assert column(spark, ["Power  Conversion efficiency", "ACC", " other "], "string", numbers.metric_name) == ["PCE", "accuracy", "other"]
    assert column(spark, ["Percent", "mA cm-2", "℃", "nm", None], "string", numbers.unit_name) == ["%", "mA/cm2", "degC", "nm", None]
    assert column(spark, ["12.5 nm", "GPT-4", "model_v2", "7", "x 3.1% y", None], "string", lambda c: numbers.cell_number(c)["value"]) == [12.5, None, None, 7.0, 3.1, None]


def test_identity(spark):
    assert column(spark, ["https://doi.org/10.1234/Example.", "DOI: 10.1/x", "", None], "string", identity.doi) == ["10.1234/example", "10.1/x", None, None]
    given = ["https://www.Example.org//a//b/?q=1#x", "http://arxiv.org/abs/2401.01234v2", "doi:10.1/X", "plain/", "https://doi.org/10.5/y"]
    assert column(spark, given, "string", identity.source_url) == ["example.org/a/b", "arxiv:2401.01234v2", "doi:10.1/x", "plain", "doi:10.5/y"]


def test_labels(spark):
    assert column(spark, ["DatasetName", "studies", "glass", "Model sizes"], "string", labels.label_tokens) == [["dataset", "name"], ["study"], ["glass"], ["model", "size"]]
    df = spark.createDataFrame([("peak magnitude", "magnitude error"), ("score", "scores"), ("a b", "c"), ("x y", "y z"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(labels.labels_match(labels.label_tokens(F.col("a")), labels.label_tokens(F.col("b")))).collect()] == [True, True, False, False, False]
    assert column(spark, ["Supplementary files", "GitHub repo", "weather"], "string", labels.evidence_kind) == ["supplementary_material", "code_repository", None]


def test_html_and_guard(spark):
    page = "<html><style>p{}</style><SCRIPT>x</SCRIPT ><p>a&nbsp;b &lt;c&gt; &amp; d</p></html>"
    assert column(spark, [page], "string", text.strip_html) == ["a b <c> & d"]
    assert column(spark, ["=1", "+a", "-b", "@c", "d", "\tx", None], "string", text.formula_guard) == ["'=1", "'+a", "'-b", "'@c", "d", "'\tx", None]
