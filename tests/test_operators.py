"""Operators over small tables, against results worked out by hand."""

import json

from pyspark.sql import functions as F

from tallyforge.functions import fixed, repetition
from tallyforge.operators import grounding, match, runlog, scores, tables
from tallyforge.sources import readers
from tallyforge.streaming import events

RUNS = "seq long, case string, run_type string, status string, char_accuracy string, field_acc string, field_expected string, seconds string, extract_seconds string, tokens string, model string, backend string, detail string, ocr_profile string, extract_mode string, timestamp string"


def runs(spark, *rows):
    base = dict.fromkeys(["case", "run_type", "status", "char_accuracy", "field_acc", "field_expected", "seconds", "extract_seconds", "tokens", "model", "backend", "detail", "ocr_profile", "extract_mode", "timestamp"], "")
    return spark.createDataFrame([{**base, "seq": i, "status": "ok", **r} for i, r in enumerate(rows)], RUNS)


def test_by_case_keeps_the_first_of_equals(spark):
    log = runs(
        spark,
        {"case": "a", "char_accuracy": "90", "field_acc": "50", "seconds": "5", "model": "one"},
        {"case": "a", "char_accuracy": "90", "field_acc": "50", "seconds": "3", "extract_seconds": "1", "model": "two"},
        {"case": "a", "char_accuracy": "0", "seconds": "1", "extract_seconds": "1", "model": "three"},
        {"case": "a", "run_type": "extract", "field_acc": "50", "seconds": "1", "extract_seconds": "1", "model": "four"},
        {"case": "a", "status": "looped", "char_accuracy": "95", "seconds": "1", "extract_seconds": "0", "model": "five"},
        {"case": "", "char_accuracy": "99"},
        {"case": "b"},
    )
    got = {r.case: r for r in runlog.by_case(log).collect()}
    a = got["a"]
    assert (a.runs, a.extracts, a.best_char.char_accuracy, a.best_char.setting.model) == (4, 1, 95.0, "five")
    assert (a.best_field.setting.model, a.best_field.total_seconds) == ("four", 2.0)
    assert (a.fastest.setting.model, a.fastest.total_seconds) == ("two", 4.0)
    assert (got["b"].runs, got["b"].best_char, got["b"].best_field, got["b"].fastest) == (1, None, None, None)
    total = runlog.totals(log).first()
    assert (total.runs, total.extracts, total.scored, total.best_case, total.best_accuracy, total.seconds) == (6, 1, 5, "a", 95.0, 11.0)


def test_totals_of_an_empty_log(spark):
    row = runlog.totals(runs(spark, {}).limit(0)).first()
    assert (row.runs, row.scored, row.mean_accuracy, row.best_case, row.seconds, row.tokens) == (0, 0, None, None, 0.0, 0)


def test_upsert_replaces_only_what_is_strictly_worse(spark):
    ddl = "seq long, timestamp string, file string, run_type string, p1_present string, p2_present string, grounded_pct string, extract_mode string, extract_updated string"
    log = spark.createDataFrame([(0, "t", "f", "", "3", "0", "", "x", ""), (1, "t", "f", "", "5", "0", "50", "x", ""), (2, "t", "f", "extract", "", "", "", "x", ""), (3, "u", "f", "", "", "", "", "x", "")], ddl)
    offer = spark.createDataFrame([(0, "t", "f", "5", "0", "50", "same"), (0, "u", "f", "0", "0", "", "late")], "seq long, timestamp string, file string, p1_present string, p2_present string, grounded_pct string, extract_mode string")
    got = {r.seq: (r.extract_mode, r.extract_updated) for r in runlog.upsert_extracts(log, offer, F.lit("now")).collect()}
    assert got == {0: ("x", ""), 1: ("x", ""), 2: ("x", ""), 3: ("late", "now")}
    better = offer.withColumn("grounded_pct", F.lit("51"))
    assert {r.seq: r.extract_mode for r in runlog.upsert_extracts(log, better).collect()} == {0: "x", 1: "same", 2: "x", 3: "late"}


def test_widen_keeps_order_and_unknown_columns(spark):
    old = spark.createDataFrame([("x", "1")], "odd string, timestamp string")
    assert runlog.widen(old, ("timestamp", "file")).columns == ["odd", "timestamp", "file"]
    assert runlog.append(old, spark.createDataFrame([("2", "f")], "timestamp string, file string")).orderBy("timestamp").collect() == [("x", "1", ""), ("", "2", "f")]


def test_pages_and_summary(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, "only"), (3, 1, None)], "doc_id int, page int, text string")
    got = {r.doc_id: r.transcript for r in runlog.join_pages(pages).collect()}
    assert got == {1: "--- page 1 ---\na\n\n--- page 2 ---\nb", 2: "only", 3: ""}
    ddl = "doc_id int, page int, new_tokens int, truncated boolean, looped boolean, resolution string, prefill_seconds double, decode_seconds double, model string, url string, backend string, ocr_profile string"
    stats = spark.createDataFrame([(1, 1, 10, False, False, "a", 1.0, 2.0, "", "u", None, "p"), (1, 2, 30, True, None, "b", 1.0, 2.0, "m", "w", None, "q")], ddl)
    row = runlog.summarise(stats).first()
    assert (row.page_count, row.tokens, row.truncated, row.looped, row.tokens_per_second, row.model, row.url, row.backend, row.resolutions) == (2, 40, True, False, 10.0, "m", "u", None, ["a", "b"])


def fields_row(**values):
    scalars = {k: values.get(k, "") for k in fixed.SCALARS}
    items = [{k: i.get(k, "") for k in fixed.ITEM_KEYS} for i in values.get("line_items", [])]
    return {**scalars, "line_items": items, "other_fields": values.get("other_fields", [])}


FIELDS = "doc_id int, fields struct<" + ",".join(f"{k}:string" for k in fixed.SCALARS) + ",line_items:array<struct<" + ",".join(f"{k}:string" for k in fixed.ITEM_KEYS) + ">>,other_fields:array<struct<label:string,value:string>>>"


def test_grounding(spark):
    page = "Tax Invoice No. 17\nACME\n100.00\nvat 7 00"
    fields = spark.createDataFrame(
        [
            (1, fields_row(document_type="TAX-INVOICE", document_number="17", seller_name="Nobody", currency="-", subtotal="100", vat_total="7.00", amount_incl_vat="107.00", other_fields=[{"label": "a", "value": "acme"}])),
            (2, fields_row()),
        ],
        FIELDS,
    )
    pages = spark.createDataFrame([(1, page), (2, "  ")], "doc_id int, text string")
    checked = grounding.check(fields, pages)
    got = {r.path: r.status for r in checked.collect()}
    assert {r.doc_id for r in checked.collect()} == {1}
    assert (got["document_type"], got["document_number"], got["seller_name"], got["currency"], got["subtotal"], got["vat_total"], got["amount_incl_vat"]) == ("grounded", "grounded", "ungrounded", "nil", "grounded", "grounded", "computed")
    assert (got["line_items"], got["other_fields[0].value"], got["buyer_name"]) == ("missing", "grounded", "missing")
    row = grounding.rollup(checked, "doc_id").first()
    assert (row.grounded, row.ungrounded, row.computed, row.nil, row.checked, row.grounded_ratio, row.verdict) == (5, 1, 1, 1, 7, 0.7143, "flagged")
    tiers = fields.filter("doc_id = 1").select(*grounding.tier_counts(lambda k: F.col(f"fields.{k}"))).first()
    assert (tiers.p1_present, tiers.p1_absent, tiers.p2_present) == (7, 7, 0)


def test_case_matching(spark):
    cases = spark.createDataFrame(
        [(0, "s1", "Inv BS1234567890.pdf", None, "aa"), (1, "s2", "inv-bs1234567890 copy.pdf", ["Old One.pdf"], "bb"), (2, "s3", "other F5550001234TINV.pdf", [], "cc")],
        "pos int, id string, pdf string, aliases array<string>, sha256 string",
    )
    files = spark.createDataFrame(
        [("INV BS1234567890.PDF", ""), ("inv_bs1234567890.pdf", ""), ("old-one.PDF", ""), ("x.pdf", "CC"), ("new BS1234567890 x.pdf", ""), ("re F5550001234tinv.pdf", None), ("nothing.pdf", "")],
        "file string, sha256 string",
    )
    rows = match.match_cases(files.union(files.filter("file = 'x.pdf'")), cases).collect()
    got = {r.file: (r.case, r.how) for r in rows}
    assert len(rows) == 8 and sum(r.file == "x.pdf" for r in rows) == 2
    assert got == {
        "INV BS1234567890.PDF": ("s1", "filename"), "inv_bs1234567890.pdf": ("s1", "filename (normalised)"), "old-one.PDF": ("s2", "manifest alias"),
        "x.pdf": ("s3", "file contents"), "new BS1234567890 x.pdf": (None, None), "re F5550001234tinv.pdf": ("s3", "document number"), "nothing.pdf": (None, None),
    }


def test_row_pairs_and_spurious_cells(spark):
    item = lambda **v: {k: v.get(k, "") for k in fixed.ITEM_KEYS}
    truth = [item(description="Alpha room", amount="10.00"), item(description="Beta room", amount="20"), item(description="Gamma hall", amount="30")]
    actual = [item(description="Beta room", amount="20.00"), item(description="Alpha room", amount="11"), item(description="Other", amount="5")]
    ddl = "struct<" + ",".join(f"{k}:string" for k in fixed.ITEM_KEYS) + ">"
    docs = spark.createDataFrame([(1, truth, actual)], f"doc_id int, truth array<{ddl}>, actual array<{ddl}>")
    judged, counts = match.score_items(docs)
    row = counts.first()
    assert (row.rows_matched, row.rows_missed, row.rows_spurious, row.spurious_cells, row.in_order) == (2, 1, 1, 2, False)
    status = {r.path: r.status for r in judged.collect()}
    assert (status["line_items[0].description"], status["line_items[0].amount"], status["line_items[1].amount"], status["line_items[2].description"], status["line_items[0].vat"]) == ("correct", "wrong", "correct", "missed", "absent")


def test_greedy_pairs_break_ties_to_the_diagonal_then_to_larger_places(spark):
    rows = spark.createDataFrame([([(1.0, 0, 1), (1.0, 1, 0), (1.0, 0, 0), (0.5, 1, 1)],), ([(1.0, 0, 1), (1.0, 1, 0)],), ([],)], "c array<struct<sim:double,i:int,j:int>>")
    got = [[tuple(p) for p in r[0]] for r in rows.select(match.greedy_pairs(F.col("c"))).collect()]
    assert got == [[(0, 0), (1, 1)], [(0, 1), (1, 0)], []]


def test_other_fields(spark):
    ddl = "array<struct<label:string,value:string>>"
    docs = spark.createDataFrame([(1, [("Due date", "1/1"), ("PO", "7"), ("PO", "")], [("due", "1/1"), ("P.O. no", "8")])], f"doc_id int, truth {ddl}, actual {ddl}")
    got = [(r.path, r.status, r.label_found) for r in match.score_others(docs).collect()]
    assert got == [("other_fields[Due date]", "correct", True), ("other_fields[PO]", "wrong", True), ("other_fields[PO]", "missed", False)]
    accepted = spark.createDataFrame([(1, [("Due date", ["2/2", "1/1"])], [("due", "1/1")])], f"doc_id int, truth array<struct<label:string,readings:array<string>>>, actual {ddl}")
    assert [(r.expected, r.status) for r in match.score_others(accepted).collect()] == [("1/1", "correct")]


def test_resolve_model(spark):
    models = spark.createDataFrame([("alpha:7b",), ("alpha:3b",), ("beta",)], "model string")
    wanted = spark.createDataFrame([("Beta",), ("alpha",), ("alpha:3b",), ("none",)], "wanted string")
    got = {r.wanted: (r.model, r.error) for r in match.resolve_model(wanted, models).collect()}
    assert got == {"Beta": ("beta", None), "alpha": (None, "ambiguous"), "alpha:3b": ("alpha:3b", None), "none": (None, "no such model")}


TABLE = """# Receipt
| a | b |
|---|---|
| รายการ | จำนวน<br>Qty | จำนวนเงินรับ | | ภาษีมูลค่าเพิ่ม VAT |
|:--|---|--:|---|---|
| Room \\| one | 2 | 9,741 | 60 | 7.00 |
| Extra | | 535 | - | |
| note only | | | | |
| | | 12.00 | | |
| รวม | | 99 | 00 | |

| Name | x |
|---|---|
| only one key | 1 |
"""


def test_tables(spark):
    docs = spark.createDataFrame([(1, TABLE.replace("| a | b |\n|---|---|\n", "")), (2, "no table"), (3, None)], "doc_id int, text string")
    found = tables.find_tables(docs)
    assert [(r.doc_id, r.pos, len(r.rows)) for r in found.orderBy("pos").collect()] == [(1, 0, 5), (1, 1, 1)]
    assert found.filter("pos = 0").select(tables.heading_keys(F.col("header"))).first()[0] == ["description", "quantity", "amount", None, "vat"]
    rows = tables.item_rows(found).orderBy("row").collect()
    assert [(r.kept, r.why) for r in rows] == [(True, None), (True, None), (False, "no figure in any money column"), (False, "figures with no description"), (False, "totals row")]
    assert (rows[0].description, rows[0].amount, rows[0].vat, rows[0].unit_price, rows[1].amount) == ("Room | one", "9,741 60", "7.00", "", "535")


def test_table_outcomes(spark):
    head = "|{}|\n|---|---|---|\n|a|1|2|\n"
    docs = spark.createDataFrame([(1, head.format("Description|Amount| ")), (2, head.format("Description|Zimmer|Menge")), (3, "none"), (4, head.format("Description|Zimmer|Menge"))], "doc_id int, text string")
    wide = docs.withColumn("columns", F.when(F.col("doc_id") == 4, F.create_map(F.lit("zimmer"), F.lit("period"))))
    got = {r.doc_id: (r.columns, r.unmapped, r.error) for r in tables.table_outcomes(wide, overrides=F.col("columns")).collect()}
    assert got == {
        1: ({"Description": "description", "Amount": "amount"}, [], None), 2: (None, None, "no table whose headings name two or more item keys"),
        3: (None, None, "no table"), 4: ({"Description": "description", "Zimmer": "period"}, ["Menge"], None),
    }


def test_skeletons_are_read_and_never_overwritten(spark, tmp_path):
    cases = spark.createDataFrame([("a", "A.pdf", "k"), ("b", None, None)], "id string, pdf string, kind string")
    (tmp_path / "a.fields.json").write_text('{"currency": "THB"}')
    assert readers.write_truth_skeletons(cases, str(tmp_path)) == ["b.fields.json"]
    more = spark.createDataFrame([("a",), ("c",)], "id string")
    assert readers.write_truth_skeletons(more, str(tmp_path)) == ["c.fields.json"]
    got = {r.id: r for r in readers.read_truth(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].rows[0].readings == ["THB"]
    assert got["b"].rows == [] and got["b"].others is None and got["b"].warnings == [] and got["b"].error is None and got["b"].score_table


def test_steps_own_their_keys(spark):
    raw = ['{"currency": "THB", "subtotal": 5, "seller_name": {"a": 1}, "line_items": [{"description": "x"}, 3, "y", {"amount": 7}], "odd": 1}', '{"line_items": "none"}', "{}"]
    rows = spark.createDataFrame([(r,) for r in raw], "r string").select(readers.step_values(F.col("r"), ("currency", "subtotal", "seller_name"), ("line_items",)).alias("v")).collect()
    assert [tuple(r.v) for r in rows] == [("THB", "5", None, [{"description": "x"}, {"amount": "7"}]), (None, None, None, []), (None, None, None, None)]


def test_values_outside_the_schema_are_audited(spark):
    ddl = FIELDS.replace("fields struct<", "fields struct<iban:string,pages:int,").replace("net_amount:string>>", "net_amount:string,lot:string>>")
    row = fields_row(document_number="17", line_items=[{"description": "Room"}])
    row["line_items"][0]["lot"] = "L9"
    fields = spark.createDataFrame([(1, {**row, "iban": "DE00", "pages": 2}), (2, {**row, "iban": None, "pages": None})], ddl)
    pages = spark.createDataFrame([(1, "17 Room 2"), (2, "17 Room L9")], "doc_id int, text string")
    got = {(r.doc_id, r.path): (r.status, r.required) for r in grounding.check(fields, pages).collect()}
    assert got[1, "iban"] == ("ungrounded", False) and got[1, "pages"] == ("grounded", False) and got[1, "line_items[0].lot"] == ("ungrounded", False)
    assert (2, "iban") not in got and got[2, "line_items[0].lot"] == ("grounded", False) and got[2, "line_items[0].amount"] == ("missing", True)


def test_readers(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"cases": [{"id": "a", "pdf": "A.pdf", "pages": 1, "kind": "k"}, {"id": "b", "pdf": "B.pdf", "pages": 2, "kind": "k", "aliases": ["x"]}]}))
    (tmp_path / "a.md").write_text("md")
    (tmp_path / "a.txt").write_text("txt")
    (tmp_path / "a.fields.json").write_text(json.dumps({"document_type": ["X", "x", "Y"], "currency": "", "buyer_name": None, "subtotal": 5, "seller_name": ["a", " "], "odd": 1, "_note": 1, "table_columns": {"H": "vat", "J": "bad"}, "other_fields": [{"label": "l", "value": "v"}]}))
    cases = readers.read_manifest(spark, str(tmp_path / "manifest.json"))
    texts = readers.read_transcripts(spark, str(tmp_path))
    assert [(r.id, r.pdf, r.text) for r in readers.cases_with_truth(cases, texts).collect()] == [("a", "A.pdf", "md")]
    truth = readers.read_truth(spark, str(tmp_path)).first()
    assert {r.key: r.readings for r in truth.rows} == {"document_type": ["X", "Y"], "currency": [""], "subtotal": ["5"]}
    assert truth.columns == {"h": "vat"} and len(truth.warnings) == 3 and truth.others[0].label == "l"
    assert readers.list_files(spark, str(tmp_path), ("md",)).first().sha256 is not None


def test_runlog_csv_round_trip(spark, tmp_path):
    log = spark.createDataFrame([(0, "t", 'a "b", c', ""), (1, "u", "line\nbreak", "x")], "seq long, timestamp string, file string, error string")
    readers.write_runlog_csv(log.coalesce(1), str(tmp_path / "csv"))
    back = readers.read_runlog_csv(spark, str(tmp_path / "csv")).orderBy("seq").select("timestamp", "file", "error").collect()
    assert [tuple(r) for r in back] == [("t", 'a "b", c', ""), ("u", "line\nbreak", "x")]


def test_replies(spark):
    raw = ['[{"bbox":[1,2,3,4],"category":"Text","text":" a "},{"bbox":[1,true,3,4],"text":"b"},{"te', '{"blocks":[{"category":"P"}]}', "junk", None]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(readers.layout_blocks(F.col("raw")).alias("b"))
    got = [r.b for r in rows.collect()]
    assert [len(b) for b in got] == [2, 1, 0, 0] and got[0][1].bbox is None and got[0][0].bbox == [1.0, 2.0, 3.0, 4.0] and got[0][0].text == "a"
    bodies = ['{"choices":[{"message":{"content":" hi "},"finish_reason":"length"}],"usage":{"completion_tokens":7}}', '{"message":{"content":"yo"},"done_reason":"stop","eval_count":3}', "{}"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(readers.structured_reply(F.col("b"))).collect()]
    assert got == [("hi", True, 7), ("yo", False, 3), ("", False, 0)]
    stream = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: junk\ndata: {"choices":[{"delta":{"content":"b"}}],"usage":{"completion_tokens":2}}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"c"}}]}'
    row = readers.sse_deltas(spark.createDataFrame([("s", stream)], "stream string, value string")).first()
    assert (row.content, row.tokens) == ("ab", 2)


def test_streams(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    loop = "same words again " * 60
    lines = [{"event": "token", "job": "j", "page": 1, "text": loop}, {"event": "page_done", "job": "j", "page": 1, "new_tokens": 5, "seconds": 1.5}, {"event": "token", "job": "j", "page": 2, "text": "fine"}]
    (src / "a.json").write_text("\n".join(map(json.dumps, lines)))
    for frame, mode, name in ((events.watch_pages(events.read_events(spark, str(src))), "update", "watched"), (events.document_progress(events.read_events(spark, str(src))), "complete", "progress")):
        frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.page, r.looped) for r in spark.sql("select * from watched").collect()} == {(1, True), (2, False)}
    assert [(r.pages_done, r.tokens) for r in spark.sql("select * from progress").collect()] == [(1, 5)]


def test_loops_in_a_stream_are_those_of_whole_texts(spark):
    texts = ["same words again " * 60, "x" * 700, " " * 700, "ab\n" * 300, "long line\n" * 4 + "y" * 100, "".join(f"year {i} " for i in range(60)), "fine " + "".join(chr(97 + i * i % 26) for i in range(900)), "a b c", "", "tail\n\n" * 200 + "</end>"]
    texts += ["q" * 580 + "\n" + "row\n" * 5, "row with text\n\n" * 30 + "p" * 300, "".join(f"n{i}\n" for i in range(300))]
    told = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", repetition.looks_repetitive(F.col("t")).alias("looped")).collect()
    assert {r.i: r.looped for r in told} == {i: events.looped(t[-events.TAIL :]) for i, t in enumerate(texts)}
    assert [events.looped(t[-events.TAIL :]) for t in texts] == [True, True, False, True, False, True, True, False, False, True, True, True, False]


def test_truth_scores_itself_in_full(spark):
    rows = spark.createDataFrame([("d", "p1", v, v) for v in ("a", "1,200", "x y")], "doc_id string, tier string, e string, a string")
    from tallyforge.functions.judge import judge

    level = {r.level: r.accuracy for r in scores.tally_sets(rows.withColumn("status", judge(F.col("e"), F.col("a")))).collect()}
    assert level == {0: 1.0, 1: 1.0, 3: 1.0}


def test_late_extracts_and_hourly_counts(spark, tmp_path):
    ddl = "seq long, timestamp string, file string, run_type string, p1_present string, p2_present string, grounded_pct string, extract_mode string, extract_updated string"
    spark.createDataFrame([(0, "t", "f", "", "", "", "", "x", "")], ddl).write.parquet(f"{tmp_path}/log")
    batch = spark.createDataFrame([(0, "t", "f", "1", "0", "9", "late")], "seq long, timestamp string, file string, p1_present string, p2_present string, grounded_pct string, extract_mode string")
    apply = events.late_extracts(f"{tmp_path}/log", f"{tmp_path}/out")
    assert events.latest_log(spark, f"{tmp_path}/log", f"{tmp_path}/out").first().extract_mode == "x"
    apply(batch, 3)
    row = spark.read.parquet(f"{tmp_path}/out").first()
    assert (row.extract_mode, row.p1_present, row.extract_updated, row.batch) == ("late", "1", "batch 3", 3)
    spark.createDataFrame([(0, "t", "f", "", "", "", "", "x", ""), (1, "t", "g", "", "", "", "", "x", "")], ddl).write.parquet(f"{tmp_path}/log2")
    columns = "seq long, timestamp string, file string, p1_present string, p2_present string, grounded_pct string, extract_mode string"
    apply = events.late_extracts(f"{tmp_path}/log2", f"{tmp_path}/out2")
    for turn in (0, 1, 1):  # a batch that runs again starts from the same snapshot
        apply(spark.createDataFrame([(0, "t", "fg"[turn], "1", "0", "9", f"late {turn}")], columns), turn)
    rows = events.latest_log(spark, f"{tmp_path}/log2", f"{tmp_path}/out2").collect()
    assert {r.file: (r.extract_mode, r.extract_updated) for r in rows} == {"f": ("late 0", "batch 0"), "g": ("late 1", "batch 1")}
    assert events.snapshots(spark, f"{tmp_path}/out2") == [0, 1]
    source = "/root/testdata/sf0.001/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet("/root/testdata/sf0.001", pathGlobFilter="events.parquet")
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from hourly").first()[0] == spark.read.parquet(source).count()
