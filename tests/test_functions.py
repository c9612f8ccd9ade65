"""Literal vectors of the scalar operators."""

import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import derive, judge, numbers, repetition, text, fixed
from tallyforge.operators import runlog, scores, vat


def column(spark, values, f, ddl="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r[0] for r in rows.orderBy("i").select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_parse_amount(spark):
    cases = {
        "1,200": 1200.0, "9,741 60": 9741.60, "1,731,118.40 51,933.55": None, "(814.71)": -814.71, "- 16,170.34": -16170.34, "-": None,
        "N/A": None, "abc": None, "0-5454-54545-54-5": None, "๑,๒๐๐": 1200.0, "Room 2": 2.0, "535 -": None, "(-5)": 5.0, "": None, "1.2.3": None, "  ": None,
    }
    assert column(spark, [*cases, None], numbers.parse_amount) == [*cases.values(), None]


def test_squash(spark):
    cases = {"0-1055-43041-88-7": "0105543041887", "สำนักงานใหญ่": "สานกงานใหญ", "Ａ１": "a1", "": "", "ﬁ": "fi"}
    assert column(spark, [*cases, None], text.squash) == [*cases.values(), ""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=["Cs"])), min_size=1, max_size=20))
def test_squash_is_what_python_makes_of_it(spark, values):
    values = [v.replace("\0", "") for v in values]
    fold = lambda t: "".join(filter(str.isalnum, unicodedata.normalize("NFKC", t).lower()))
    assert column(spark, values, text.squash) == [fold(v) for v in values]


def test_blank_and_nil(spark):
    values = ["", "  ", None, "0", "-", "N/A", "–", " ", "x"]
    assert column(spark, values, text.is_blank) == [True, True, True, False, False, False, False, True, False]
    assert column(spark, values, text.is_nil) == [False, False, False, False, True, True, True, False, False]


def test_content_only_and_normalise(spark):
    assert column(spark, ["a b​\tc\x1f"], text.content_only) == ["abc"]
    html = '<table><tr><td colspan="2">a</td><td>b</td></tr></table>'
    pipe = "| a | b |\n|---|:--:|"
    assert column(spark, [html, pipe, "--- page 2 ---\nx  y​z\n\n", "a<br/>b", "a \\| b"], text.normalise) == ["a b", "a b", "x yz", "a\nb", "a b"]


def test_fences_and_markup(spark):
    cases = {"```markdown\nX\n```": "X", "```python\nX\n```": "```python\nX\n```", " Y ": "Y", "```\nA\nB\n```\n": "A\nB", "```md\nopen": "```md\nopen"}
    assert column(spark, list(cases), text.strip_fence) == list(cases.values())
    assert column(spark, ["# Head\n<page_number> 3 </page_number><figure>x</figure> &amp;quot; &lt;"], text.normalise_output) == ['Head\n3x" &lt;']


def test_names(spark):
    assert column(spark, ["dir/Ab-1 c.tar.PDF", "x"], text.slug) == ["ab1ctar", "x"]
    assert column(spark, ["BS1234567890 F5550001234TINV bs12"], text.document_numbers) == [["bs1234567890", "f5550001234tinv"]]
    assert column(spark, [" host:1/ ", "https://a/", None], text.clean_url) == ["http://host:1", "https://a", ""]
    assert column(spark, ["abc  def ghi"], lambda c: text.clip(c, 6)) == ["abc d…"]


def test_printed_numbers(spark):
    assert [sorted(x) for x in column(spark, ["1,200.50 and 40 51,933", "", None], numbers.printed_numbers)] == [[40.0, 40.51, 1200.5, 51933.0], [], []]
    assert 40.51 in column(spark, ["40 51"], numbers.printed_numbers)[0]


@pytest.mark.parametrize(
    ("expected", "actual", "status"),
    [
        ("1,200", "1,200.00", "correct"), ("ABCD", "ABCDEF", "partial"), ("ABC", "ABCDEF", "wrong"), ("Room 2", "Room 3", "wrong"), ("0101", "101", "correct"),
        ("", "", "absent"), ("", "x", "spurious"), ("x", "", "missed"), ("-", "", "correct"), ("-", "-", "correct"), ("-", "5", "wrong"), (None, None, "absent"), ("a?", "A", "correct"),
    ],
)
def test_judge(spark, expected, actual, status):
    row = spark.createDataFrame([(expected, actual)], "e string, a string")
    assert row.select(judge.judge(F.col("e"), F.col("a"), text.squash)).first()[0] == status


def test_judge_best_prefers_the_first_of_equals(spark):
    row = spark.createDataFrame([(["ABCDE", "xyz", "XYZ"], "xyz"), ([], "x"), (["", "-"], "")], "r array<string>, a string")
    got = [tuple(r[0]) for r in row.select(judge.judge_best(F.col("r"), F.col("a"))).collect()]
    assert got == [("correct", "xyz"), ("absent", ""), ("correct", "-")]


def test_document_types(spark):
    cases = {"ใบเสร็จรับเงิน/ใบกำกับภาษี": "RECEIPT_TAX_INVOICE", "STATEMENT OF ACCOUNT": "INVOICE", "Credit Note for Invoice": "CREDIT_NOTE", "Quotation": "", "": ""}
    assert column(spark, [*cases, None], derive.document_type_code) == [*cases.values(), ""]


def test_branch_and_tax(spark):
    cases = {"สาขาที่ 226": "00226", "สำนักงานใหญ่": "00000", "สำนักงานใหญ่ สาขาที่ 00068": "00068", "(สาขาอำพัน แพร่)": "", "1234567890123": "", "00000": "00000", "๒๒๖": "00226"}
    assert column(spark, [*cases, None], lambda c: derive.branch_code(c, text.squash)) == [*cases.values(), ""]
    assert column(spark, ["0-5454-54545-54-5", "1"], derive.tax_id_digits) == ["0545454545545", "1"]
    assert column(spark, ["0-5454-54545-54-5", "1"], derive.tax_id_valid) == [True, False]


def test_period_and_electronic_tax(spark):
    assert [tuple(x) for x in column(spark, ["01/01/2026 - 31/01/2026", "1-Jan-26 to 31-Jan-26", "01/01/2026", None], derive.period_ends)] == [("01/01/2026", "31/01/2026"), ("1-Jan-26", "31-Jan-26"), ("", ""), ("", "")]
    assert column(spark, ["an e-Tax Invoice", "ส่งข้อมูลให้แก่กรมสรรพากร", "tax", None], derive.electronic_tax) == [True, True, False, False]


def test_references(spark):
    rows = spark.createDataFrame([("R 1", [("INV-1", "d"), ("inv 1", ""), ("", ""), ("R 1", None)])], "h string, r array<struct<number:string,date:string>>")
    got = rows.select(derive.references(F.col("h"), F.col("r"))).first()[0]
    assert [(x.type, x.number, x.source) for x in got] == [("REFERENCE", "R 1", "header"), ("INVOICE", "INV-1", "line_item"), ("INVOICE", "R 1", "line_item")]


def test_repetition(spark):
    body = "".join(f"line {i} of text {i * i} goes on\n" for i in range(60))
    counting = "intro " + " ".join(f"ปี {i}" for i in range(10, 90))
    values = ["x" * 10, body, body + "-" * 16, body + "same line\n" * 5, counting, None, body + " " * 700]
    assert column(spark, values, repetition.looks_repetitive) == [False, False, True, True, True, False, False]
    entry = '"label": "a long label text"'
    assert column(spark, [entry * 2, entry * 3], repetition.repeated_list) == [False, True]
    assert column(spark, ['```json\n{"natural_text": "', "{}"], repetition.is_envelope) == [True, False]


def test_json_repair(spark):
    cut = '{"a":"1","b":[{"x":"y"},{"x":"z'
    assert column(spark, [cut, '{"a": 1}', "none", '{"a":[1,2', None, '{"a'], repetition.salvage_json) == ['{"a":"1","b":[{"x":"y"}]}', None, None, '{"a":[1]}', None, None]
    assert column(spark, ['say {"a": "}{", "b": {}} x', "{"], repetition.first_json_object) == ['{"a": "}{", "b": {}}', None]


def test_vat_basis(spark):
    rows = [(100.0, 100.0, 7.0, 107.0, ""), (107.0, 100.0, 7.0, 107.0, "before VAT"), (None, None, None, None, "ราคา (รวมภาษี)"), (None, 5.0, 1.0, 5.0, "ยังไม่รวม VAT"), (None, None, None, None, "รวมภาษีมูลค่าเพิ่ม 672.30")]
    df = spark.createDataFrame(rows, "l double, s double, v double, i double, t string")
    got = [r[0] for r in df.select(vat.vat_basis(*(F.col(c) for c in "lsvit"))).collect()]
    assert [(g.basis, g.source.split(",")[0].split(" (")[0], g.subtotal_includes_vat) for g in got] == [
        ("exclusive", "inferred from the totals", False), ("inclusive", "inferred from the totals", False), ("inclusive", "stated on the document", False),
        ("exclusive", "stated on the document", True), ("exclusive", "assumed", False),
    ]
    assert got[1].evidence == "line amounts sum to 107.00, which is the VAT-inclusive total — but the page says “before VAT”"


def test_transcript_scores(spark):
    rows = spark.createDataFrame([("a b c", "a b c"), ("abc", ""), ("a b", "a x b y"), ("", "")], "expected string, actual string")
    got = scores.score_transcripts(rows).collect()
    assert [(r.char_accuracy, r.word_accuracy, r.char_accuracy_no_marks) for r in got] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 0.0, 1.0)]
    assert scores.score_transcripts(rows, 1).filter("not scored").count() == 3


def test_tally_rates(spark):
    statuses = ["correct"] * 2 + ["partial", "wrong", "missed", "spurious"] + ["absent"] * 9
    rows = spark.createDataFrame([("d", s) for s in statuses] + [("e", "absent")], "doc_id string, status string")
    got = {r.doc_id: r for r in scores.tally(rows, "doc_id").collect()}
    assert (got["d"].expected, got["d"].returned, got["d"].accuracy, got["d"].accuracy_loose, got["d"].precision) == (5, 5, 0.4, 0.6, 0.4)
    assert (got["e"].expected, got["e"].accuracy, got["e"].precision) == (0, None, None)


def test_extract_score_orders_unmeasured_below_zero(spark):
    rows = spark.createDataFrame([("14", "0", "90"), ("12", "0", "100"), ("", "", ""), ("0", "0", "")], "a string, b string, c string")
    ordered = rows.orderBy(runlog.extract_score(F.col("a"), F.col("b"), F.col("c"))).select("a").collect()
    assert [r.a for r in ordered] == ["", "0", "12", "14"]


def test_fit_pixels(spark):
    got = spark.createDataFrame([(2000, 1000, 500_000), (10, 10, None)], "w int, h int, b int").select(numbers.fit_pixels(F.col("w"), F.col("h"), F.col("b"))).collect()
    assert [tuple(r[0]) for r in got] == [(1000, 500), (10, 10)]


def test_fixed_values():
    assert len(fixed.SCALARS) == 14 and len(fixed.RUNLOG_COLUMNS) == 38 and len(fixed.EXTRACT_COLUMNS) == 14
