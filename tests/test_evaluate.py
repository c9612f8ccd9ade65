"""Whole evaluations over small cases."""

import json
import re

import pytest

from tallyforge import settings
from tallyforge.functions import fixed
from tallyforge.operators import evaluate, grounding
from tallyforge.sources import readers
from tests.test_operators import FIELDS, fields_row

PAGE = "Tax Invoice 17\n| Description | Amount |\n|---|---|\n| Room | 100.00 |\n| Meal | 20 |\n| Total | 120 |\nPrices include VAT"


@pytest.fixture(scope="module")
def fields(spark):
    items = [{"description": "meal", "amount": "20.00"}, {"description": "Room", "amount": "90"}]
    return spark.createDataFrame([(1, fields_row(document_type="tax invoice", document_number="71", subtotal="120", line_items=items))], FIELDS)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE)], "doc_id int, text string")


def test_fields_against_truth(spark, fields, pages):
    truth = spark.createDataFrame([(1, "document_type", ["Invoice", "Tax Invoice"]), (1, "document_number", ["17"]), (1, "currency", [""]), (2, "currency", ["THB"])], "doc_id int, key string, readings array<string>")
    judged, tallies = evaluate.score_fields(truth, fields, pages)
    got = {(r.doc_id, r.path): r.status for r in judged.collect()}
    assert (got[1, "document_type"], got[1, "document_number"], got[1, "currency"], got[2, "currency"]) == ("correct", "wrong", "absent", "missed")
    assert (got[1, "line_items[0].description"], got[1, "line_items[0].amount"], got[1, "line_items[1].amount"]) == ("correct", "wrong", "correct")
    row = {r.doc_id: r for r in tallies.collect()}[1]
    assert (row.correct, row.wrong, row.expected, row.checked) == (4, 2, 6, 3)
    text = evaluate.report(judged, 1)
    assert text.startswith("4 of 7 correct: 57.14 %") and text.endswith("and 2 more")


def test_exploded_values_are_never_broadcast(spark, fields):
    truth = spark.createDataFrame([(1, "document_type", ["Tax Invoice"])], "doc_id int, key string, readings array<string>")
    judged, tallies = evaluate.score_fields(truth, fields)
    for frame in (judged, tallies):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 1


def test_values_meet_their_truth_unexploded(spark, fields):
    truth = spark.createDataFrame([(1, "document_type", ["Tax Invoice"]), (1, "no such key", ["x"]), (77, "subtotal", ["5"])], "doc_id int, key string, readings array<string>")
    judged = evaluate.judge_scalars(truth, fields.unionByName(fields))
    assert "Generate" not in judged._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.path) for r in judged.collect()) == [(1, "document_type"), (1, "document_type"), (1, "no such key"), (77, "subtotal")]


def test_parts_where_values_meet_truth_are_not_put_together(spark, fields):
    truth = spark.createDataFrame([(1, "document_type", ["Tax Invoice"])], "doc_id int, key string, readings array<string>")
    plan = evaluate.judge_scalars(truth, fields)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and len(re.findall(rf"hashpartitioning\(\w+#\d+, {evaluate.PARTS}\)", plan)) == 2


def test_values_are_folded_before_they_meet_their_truth(spark):
    rows = [(1, fields_row(document_type="ＩＮＶＯＩＣＥ", document_number=None, subtotal="๑๒๐", currency="")), (2, fields_row(document_type="invoice"))]
    fields = spark.createDataFrame(rows, FIELDS)
    truth = spark.createDataFrame([(i, k, r) for i in (1, 2) for k, r in (("document_type", ["Invoice"]), ("document_number", ["17"]), ("subtotal", ["120"]), ("currency", [""]))], "doc_id int, key string, readings array<string>")
    judged, tallies = evaluate.score_fields(truth, fields)
    got = {(r.doc_id, r.path): (r.actual, r.status) for r in judged.collect()}
    assert [got[1, k] for k in ("document_type", "document_number", "subtotal", "currency")] == [("ＩＮＶＯＩＣＥ", "correct"), ("", "missed"), ("๑๒๐", "correct"), ("", "absent")]
    assert got[2, "document_type"] == ("invoice", "correct")
    plan = tallies._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("SortMergeJoin") < plan.index("ArrowEvalPython")


def test_whole_truth_files_against_extractions(spark, tmp_path):
    page = "| Charge | Amount |\n|---|---|\n| Room | 100.00 |\n"
    files = {
        "a": {"document_type": ["Invoice", "Tax Invoice"], "document_number": "17", "table_columns": {"Charge": "description"}, "other_fields": [{"label": "PO", "value": ["7", "8"]}]},
        "b": {"currency": "THB", "score_table": False, "odd": 1},
        "c": {"currency": "THB"},
        "d": None,
    }
    for name, truth in files.items():
        (tmp_path / f"{name}.fields.json").write_text("[" if truth is None else json.dumps(truth))
    row = fields_row(document_type="tax invoice", document_number="71", currency="THB", line_items=[{"description": "room", "amount": "90"}], other_fields=[{"label": "po", "value": "8"}])
    fields = spark.createDataFrame([(k, row) for k in "abcd"], FIELDS.replace("doc_id int", "id string"))
    transcripts = spark.createDataFrame([("a", page), ("b", page), ("c", "no table")], "id string, text string")
    judged, cases = evaluate.score_cases(readers.read_truth(spark, str(tmp_path)), fields, transcripts)
    status = {(r.id, r.path): (r.status, r.kind) for r in judged.collect()}
    assert status["a", "document_type"] == ("correct", "scalar") and status["a", "line_items[0].description"] == ("correct", "item") and status["a", "line_items[0].amount"] == ("wrong", "item")
    assert status["a", "other_fields[PO]"] == ("correct", "other") and ("b", "line_items[0].amount") not in status
    got = {r.id: r for r in cases.collect()}
    assert set(got) == set("abcd") and got["d"].error == "not JSON" and got["d"].expected is None and not got["d"].coverage.items_checked
    assert (got["a"].correct, got["a"].expected, got["a"].scalars.correct, got["a"].p1.expected, got["a"]["items"].wrong, got["a"].other_fields.correct) == (2, 4, 1, 2, 1, 1)
    assert tuple(got["a"].coverage) == (2, 14, True, True) and got["a"].columns == {"Charge": "description", "Amount": "amount"} and got["a"].warnings == []
    assert tuple(got["b"].coverage) == (1, 14, False, False) and got["b"].warnings[-1] == "table not scored: score_table is false" and len(got["b"].warnings) == 2
    assert got["c"].warnings == ["table not scored: no table"] and got["c"].accuracy == 1.0 and got["c"]["items"] is None


def test_audit_cells(spark, fields, pages):
    checked = grounding.check(fields, pages)
    truth = spark.createDataFrame([(1, "document_type", ["Tax Invoice"])], "doc_id int, key string, readings array<string>")
    row = evaluate.extract_cells(checked, fields, evaluate.score_fields(truth, fields)[1]).first()
    assert (row.p1_present, row.p1_absent, row.field_acc, row.field_expected, row.ungrounded) == (3, 11, 100.0, 1, 2)
    basis = evaluate.tax_bases(fields, pages).first()
    assert (basis.basis, basis.evidence) == ("inclusive", "Prices include VAT")
    values = spark.createDataFrame([(1, "a", "Room"), (1, "b", "Nobody"), (1, "c", "-"), (1, "d", "")], "doc_id int, key string, value string")
    assert [r.key for r in evaluate.ungrounded(values, grounding.index_transcripts(pages)).collect()] == ["b"]
    assert len(fields.select(evaluate.unfilled().alias("u")).first().u) == 10


def test_transcripts_against_truth(spark):
    truth = spark.createDataFrame([("a", "A.pdf", "| x | y |\n|---|---|\n")], "id string, pdf string, text string")
    read = spark.createDataFrame([("a", "<table><tr><td>x</td><td>y</td></tr></table>"), ("b", "")], "id string, text string")
    row = evaluate.evaluate_transcripts(truth, read).first()
    assert (row.pdf, row.char_accuracy, row.word_accuracy, row["diff"]) == ("A.pdf", 1.0, 1.0, [])


def test_replies_become_transcripts(spark):
    raw = [("plain", "```md\n# A\n```"), ("layout", '[{"text":"a"},{"text":""},{"text":"b"}]'), ("plain", None)]
    rows = evaluate.finish_pages(spark.createDataFrame(raw, "reply string, raw string")).select("text", "looped").collect()
    assert [tuple(r) for r in rows] == [("A", False), ("a\nb", False), ("", False)]


def test_step_schema():
    assert evaluate.step_schema(("currency", "other_fields"), ("other_fields",)).simpleString() == "struct<currency:string,other_fields:array<map<string,string>>>"
    assert set(fixed.MONEY_KEYS) < set(fixed.SCALARS)


def test_settings(monkeypatch):
    monkeypatch.setenv("TF_X", "9")
    assert settings.env_int("TF_X", 1) == 9 and settings.env_float("TF_X", 1.0) == 9.0 and settings.env_bool("TF_NONE", True)
    with pytest.warns(UserWarning):
        assert settings.env_int("TF_X", 1, most=5) == 5
    with pytest.warns(UserWarning):
        assert settings.env_bool("TF_X", False) is False
    with pytest.warns(UserWarning):
        assert settings.env_str("TF_X", "a", ("a", "b")) == "a"
    assert str(settings.env_path("TF_NONE", "/x")) == "/x"
