"""Registered queries over the standard tables, each with the SQL it must agree with where SQL can say it.

The tables stand in for the entities of the library: events for the run log, conversations for documents of several pages,
pages for raw replies, orders and line items for printed totals. A query runs over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import derive, fixed, judge, numbers, repetition, text
from tallyforge.operators import grounding, match, runlog, scores, tables, vat

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def registered(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return registered


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the run log, out of events --------------------------------------------------------------------------------------------


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k, v, kind = F.get_json_object("props", "$.k").cast("int"), F.floor(F.abs("value")).cast("int"), F.col("event_type")
    label = lambda name, n: F.concat(F.lit(name), n.cast("string"))
    cell = lambda when, value: F.when(when, value.cast("double"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(label("file", F.col("user_id") % 100), F.lit(".pdf")).alias("file"),
        label("case", F.col("user_id") % 100).alias("case"),
        label("m", F.col("event_id") % 3).alias("model"),
        label("b", F.col("event_id") % 2).alias("backend"),
        kind.alias("detail"),
        label("p", F.col("user_id") % 2).alias("ocr_profile"),
        F.when(k % 2 == 0, "single").otherwise("agentic").alias("extract_mode"),
        F.when(kind == "click", "extract").otherwise("").alias("run_type"),
        F.when(kind == "error", "error").when(kind == "signup", "looped").otherwise("ok").alias("status"),
        cell(kind.isin("view", "purchase", "signup"), v % 101).alias("char_accuracy"),
        cell(kind.isin("click", "purchase"), k % 11).alias("field_acc"),
        (k % 20).alias("field_expected"),
        cell(kind != "click", v % 60).alias("seconds"),
        cell(k % 3 != 0, k % 30).alias("extract_seconds"),
        (k * 7).alias("tokens"),
        cell(k % 4 != 0, k % 15).alias("p1_present"),
        F.lit(0.0).alias("p2_present"),
        cell(k % 2 == 0, v % 101).alias("grounded_pct"),
    )


RUNS = """
WITH raw AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(floor(abs(value)) AS INTEGER) AS v FROM events),
runs AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
  'file' || (user_id % 100) || '.pdf' AS file, 'case' || (user_id % 100) AS "case",
  'm' || (event_id % 3) AS model, 'b' || (event_id % 2) AS backend, event_type AS detail, 'p' || (user_id % 2) AS ocr_profile,
  CASE WHEN k % 2 = 0 THEN 'single' ELSE 'agentic' END AS extract_mode,
  CASE WHEN event_type = 'click' THEN 'extract' ELSE '' END AS run_type,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'looped' ELSE 'ok' END AS status,
  CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CAST(v % 101 AS DOUBLE) END AS char_accuracy,
  CASE WHEN event_type IN ('click', 'purchase') THEN CAST(k % 11 AS DOUBLE) END AS field_acc,
  k % 20 AS field_expected,
  CASE WHEN event_type <> 'click' THEN CAST(v % 60 AS DOUBLE) END AS seconds,
  CASE WHEN k % 3 <> 0 THEN CAST(k % 30 AS DOUBLE) END AS extract_seconds,
  k * 7 AS tokens,
  CASE WHEN k % 4 <> 0 THEN CAST(k % 15 AS DOUBLE) END AS p1_present,
  CAST(0 AS DOUBLE) AS p2_present,
  CASE WHEN k % 2 = 0 THEN CAST(v % 101 AS DOUBLE) END AS grounded_pct
  FROM raw)
"""


@query(RUNS + """, r AS (SELECT *, seconds + extract_seconds AS total, run_type = 'extract' AS ex FROM runs),
n AS (SELECT "case", count(*) FILTER (NOT ex) AS runs, count(*) FILTER (ex) AS extracts FROM r GROUP BY 1),
c AS (SELECT * FROM r WHERE char_accuracy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY char_accuracy DESC, seq) = 1),
f AS (SELECT * FROM r WHERE field_acc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY field_acc DESC, total ASC NULLS LAST, seq) = 1),
q AS (SELECT * FROM r WHERE NOT ex AND status = 'ok' AND char_accuracy <> 0 AND total IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY total, seq) = 1)
SELECT n."case", n.runs, n.extracts, c.char_accuracy AS best_char, c.model AS best_char_model, c."timestamp" AS best_char_at,
  f.field_acc AS best_field, f.total AS best_field_seconds, f."timestamp" AS best_field_at, f.field_expected AS best_field_expected,
  q.total AS fastest, q.char_accuracy AS fastest_char, q.model AS fastest_model, q."timestamp" AS fastest_at
FROM n LEFT JOIN c USING ("case") LEFT JOIN f USING ("case") LEFT JOIN q USING ("case")""")
def leaderboard_by_case(spark, sf_dir):
    out = runlog.by_case(runs_of(spark, sf_dir))
    return out.select(
        "case", "runs", "extracts",
        F.col("best_char.char_accuracy").alias("best_char"), F.col("best_char.setting.model").alias("best_char_model"), F.col("best_char.setting.timestamp").alias("best_char_at"),
        F.col("best_field.field_acc").alias("best_field"), F.col("best_field.total_seconds").alias("best_field_seconds"), F.col("best_field.setting.timestamp").alias("best_field_at"), F.col("best_field.field_expected").alias("best_field_expected"),
        F.col("fastest.total_seconds").alias("fastest"), F.col("fastest.char_accuracy").alias("fastest_char"), F.col("fastest.setting.model").alias("fastest_model"), F.col("fastest.setting.timestamp").alias("fastest_at"),
    )


@query(RUNS + """, best AS (SELECT "case", max(char_accuracy) AS a, min(seq) AS first FROM runs WHERE "case" <> '' GROUP BY 1)
SELECT count(*) FILTER (run_type <> 'extract') AS runs, count(*) FILTER (run_type = 'extract') AS extracts, count(char_accuracy) AS scored,
  round(avg(char_accuracy), 2) AS mean_accuracy, round(max(char_accuracy), 2) AS best_accuracy,
  (SELECT "case" FROM best WHERE a IS NOT NULL ORDER BY a DESC, first LIMIT 1) AS best_case,
  round(coalesce(sum(seconds), 0), 1) AS seconds, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM runs""")
def runlog_totals(spark, sf_dir):
    return runlog.totals(runs_of(spark, sf_dir))


@query(RUNS + 'SELECT seq, "timestamp", "case", status, char_accuracy, seconds FROM runs ORDER BY seq DESC LIMIT 50')
def runlog_recent(spark, sf_dir):
    return runlog.recent(runs_of(spark, sf_dir), 50).select("seq", "timestamp", "case", "status", "char_accuracy", "seconds")


@query(RUNS + """SELECT model, backend, detail, ocr_profile, extract_mode, CASE WHEN run_type = '' THEN 'ocr' ELSE run_type END AS run_type,
  count(*) AS n, max(char_accuracy) AS best_char, count(seconds + extract_seconds) AS timed, min(seconds + extract_seconds) AS fastest
FROM runs GROUP BY 1, 2, 3, 4, 5, 6""")
def setting_summary(spark, sf_dir):
    rows = runs_of(spark, sf_dir).select(runlog.setting().alias("s"), "char_accuracy", numbers.elapsed(F.col("seconds"), F.col("extract_seconds")).alias("total"))
    keys = [F.col(f"s.{c}").alias(c) for c in (*fixed.SETTING_COLUMNS, "run_type")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("char_accuracy").alias("best_char"), F.count("total").alias("timed"), F.min("total").alias("fastest"))


@query(RUNS + """, keyed AS (SELECT seq, "timestamp", file, run_type, extract_mode, p1_present, p2_present, grounded_pct, field_acc FROM runs),
offers AS (SELECT "timestamp", file, 'late' AS extract_mode, CAST(field_expected % 15 AS DOUBLE) AS p1, 0.0::DOUBLE AS p2, char_accuracy AS g, seconds AS fa, seq FROM runs WHERE run_type <> 'extract'),
best AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY "timestamp", file ORDER BY coalesce(p1, -1) DESC, coalesce(p2, -1) DESC, coalesce(g, -1) DESC, seq) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "timestamp", file, run_type = 'extract' ORDER BY seq DESC) AS rn FROM keyed),
j AS (SELECT r.*, b.extract_mode AS bm, b.p1, b.p2, b.g, b.fa,
  coalesce(r.run_type <> 'extract' AND rn = 1 AND (coalesce(p1, -1), coalesce(p2, -1), coalesce(g, -1)) > (coalesce(p1_present, -1), coalesce(p2_present, -1), coalesce(grounded_pct, -1)) AND b.seq IS NOT NULL, false) AS better
  FROM ranked r LEFT JOIN best b ON r."timestamp" = b."timestamp" AND r.file = b.file)
SELECT seq, "timestamp", file, run_type, CASE WHEN better THEN bm ELSE extract_mode END AS extract_mode, CASE WHEN better THEN p1 ELSE p1_present END AS p1_present,
  CASE WHEN better THEN p2 ELSE p2_present END AS p2_present, CASE WHEN better THEN g ELSE grounded_pct END AS grounded_pct, CASE WHEN better THEN fa ELSE field_acc END AS field_acc FROM j""")
def upsert_better_extract(spark, sf_dir):
    runs = runs_of(spark, sf_dir)
    log = runs.select("seq", "timestamp", "file", "run_type", "extract_mode", "p1_present", "p2_present", "grounded_pct", "field_acc")
    late = runs.filter("run_type <> 'extract'").select(
        "seq", "timestamp", "file", F.lit("late").alias("extract_mode"), (F.col("field_expected") % 15).cast("double").alias("p1_present"),
        F.lit(0.0).alias("p2_present"), F.col("char_accuracy").alias("grounded_pct"), F.col("seconds").alias("field_acc"),
    )
    return runlog.upsert_extracts(log, late)


@query(RUNS + """SELECT seq, "timestamp", "case", status, '' AS error, '' AS dry FROM runs
UNION ALL SELECT seq, "timestamp", "case", status, 'e' AS error, '' AS dry FROM runs WHERE status = 'error'""")
def widen_runlog_schema(spark, sf_dir):
    runs = runs_of(spark, sf_dir).select("seq", "timestamp", "case", "status")
    newer = runs.filter("status = 'error'").withColumn("error", F.lit("e"))
    return runlog.widen(runlog.append(runs, newer), ("timestamp", "case", "status", "error", "dry"))


# ---- canonical text --------------------------------------------------------------------------------------------------------

_SQUASH = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"


@query(f"SELECT doc_id, CAST(length({_SQUASH.format('text')}) AS INTEGER) AS n, md5({_SQUASH.format('text')}) AS digest FROM documents")
def squash_documents(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", text.squash(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query(r"SELECT page_id, md5(regexp_replace(html, '\s+', '', 'g')) AS digest FROM pages")
def content_only_pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(text.content_only(F.col("html"))).alias("digest"))


_NORMAL = r"""regexp_replace({0}, '(?im)^\s*-{{2,}}\s*page\s+\d+\s*-{{2,}}\s*$', '', 'g')"""
_NORMAL = rf"""regexp_replace({_NORMAL}, '(?i)<br\b[^>]*>', chr(10), 'g')"""
_NORMAL = rf"""regexp_replace({_NORMAL}, '(?i)</?(?:table|thead|tbody|tfoot|caption|colgroup|tr)\b[^>]*>', chr(10), 'g')"""
_NORMAL = rf"""regexp_replace({_NORMAL}, '(?i)</?(?:td|th|col)\b[^>]*>', ' ', 'g')"""
_NORMAL = rf"""regexp_replace({_NORMAL}, '(?m)^[|\-: \t]*-{{{{2,}}}}[|\-: \t]*$', '', 'g')""".replace("{{{{", "{{").replace("}}}}", "}}")
_NORMAL = rf"""replace(replace({_NORMAL}, '\|', '|'), '|', ' ')"""
_NORMAL = rf"""array_to_string(list_filter(list_transform(regexp_split_to_array({_NORMAL}, '\r\n|[\n\r\x0b\x0c]'), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"""


@query(f"SELECT page_id, md5({_NORMAL.format('html')}) AS digest FROM pages")
def normalise_pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(text.normalise(F.col("html"))).alias("digest"))


@query(r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<page_number>\s*(.*?)\s*</page_number>', '\1', 'g'),
  '(?i)</?figure>\s*', '', 'g'), '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), '&amp;', '&'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '^\s+|\s+$', '', 'g')) AS digest FROM pages""")
def decode_entities(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(text.normalise_output(F.col("html"))).alias("digest"))


def conversation_pages(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text")


_JOINED = """WITH p AS (SELECT conv_id AS doc_id, turn AS page, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
joined AS (SELECT doc_id, CAST(max(n) AS INTEGER) AS pages, coalesce(string_agg(CASE WHEN n = 1 THEN t ELSE '--- page ' || i || ' ---' || chr(10) || t END, chr(10) || chr(10) ORDER BY i) FILTER (n = 1 OR t <> ''), '') AS transcript FROM p GROUP BY doc_id)
"""


@query(_JOINED + "SELECT doc_id, pages, md5(transcript) AS digest FROM joined")
def page_join(spark, sf_dir):
    return runlog.join_pages(conversation_pages(spark, sf_dir)).select("doc_id", "pages", F.md5("transcript").alias("digest"))


# ---- numbers ---------------------------------------------------------------------------------------------------------------

_PRICES = """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
  WHEN 1 THEN '(' || CAST(floor(l_extendedprice) AS BIGINT) || ')' WHEN 2 THEN CAST(floor(l_extendedprice) AS BIGINT) || ' ' || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0')
  WHEN 3 THEN '- ' || CAST(floor(l_extendedprice) AS BIGINT) || '.50 baht' WHEN 4 THEN '-' ELSE 'Lot ' || l_linenumber END AS printed FROM lineitem"""


def printed_prices(spark, sf_dir) -> DataFrame:
    whole = F.floor("l_extendedprice").cast("long").cast("string")
    kind = (F.col("l_partkey") + F.col("l_linenumber")) % 6
    printed = (
        F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("("), whole, F.lit(")")))
        .when(kind == 2, F.concat(whole, F.lit(" "), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")))
        .when(kind == 3, F.concat(F.lit("- "), whole, F.lit(".50 baht"))).when(kind == 4, "-").otherwise(F.concat(F.lit("Lot "), F.col("l_linenumber").cast("string")))
    )
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", printed.alias("printed"))


_AMOUNT = r"""(CASE WHEN {0} IS NULL OR trim({0}) IN ('', '-', '--', '—', 'N/A', 'n/a') THEN NULL
 ELSE (CASE WHEN starts_with(trim({0}), '(') AND ends_with(trim({0}), ')') THEN -1 ELSE 1 END) * TRY_CAST(regexp_replace(
   CASE WHEN NOT contains({0}, '.') AND regexp_full_match(trim(trim({0}), '() '), '(\d{{1,3}}(,\d{{3}})*|\d+)\s+\d{{2}}') THEN regexp_replace(trim(trim({0}), '() '), '\s+', '.') ELSE trim(trim({0}), '() ') END,
   '[^0-9.\-]', '', 'g') AS DOUBLE) END)"""


@query(f"WITH p AS ({_PRICES}) SELECT l_orderkey, l_linenumber, printed, {_AMOUNT.format('printed')} AS amount FROM p")
def parse_amounts(spark, sf_dir):
    return printed_prices(spark, sf_dir).select("l_orderkey", "l_linenumber", "printed", numbers.parse_amount(F.col("printed")).alias("amount"))


@query(r"""SELECT page_id, CAST(len(list_distinct(list_transform(regexp_extract_all(url, '\d[\d,]*(?:\.\d+)?'), lambda s: round(CAST(replace(s, ',', '') AS DOUBLE), 2)))) AS INTEGER) AS n_numbers,
  list_max(list_transform(regexp_extract_all(url, '\d[\d,]*(?:\.\d+)?'), lambda s: round(CAST(replace(s, ',', '') AS DOUBLE), 2))) AS largest FROM pages""")
def number_inventory(spark, sf_dir):
    found = load(spark, sf_dir, "pages").select("page_id", numbers.printed_numbers(F.col("url")).alias("n"))
    return found.select("page_id", F.size("n").alias("n_numbers"), F.array_max("n").alias("largest"))


# ---- transcripts -----------------------------------------------------------------------------------------------------------


def turn_pairs(spark, sf_dir) -> DataFrame:
    """Each turn of a conversation beside the one after it."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7f]", "?").alias("expected"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("expected").alias("actual"))
    return turns.join(later, ["conv_id", "turn"])


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[^\x00-\x7f]', '?', 'g'), '\s+', '', 'g') AS c FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.c AS x, b.c AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)
SELECT conv_id, turn, CAST(length(x) AS INTEGER) AS expected_chars, CAST(length(y) AS INTEGER) AS actual_chars,
  round(greatest(0.0, 1 - levenshtein(x, y) / greatest(length(x), 1)), 4) AS char_accuracy FROM p""")
def char_accuracy(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select("conv_id", "turn", text.content_only(F.col("expected")).alias("x"), text.content_only(F.col("actual")).alias("y"))
    return rows.select("conv_id", "turn", F.length("x").alias("expected_chars"), F.length("y").alias("actual_chars"), scores.char_accuracy(F.col("x"), F.col("y"), 1 << 30).alias("char_accuracy"))


@query()
def word_accuracy(spark, sf_dir):
    return scores.score_transcripts(turn_pairs(spark, sf_dir)).drop("expected", "actual")


@query()
def transcript_diff(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select("conv_id", "turn", text.normalise(F.col("expected")).alias("a"), text.normalise(F.col("actual")).alias("b"))
    return rows.select("conv_id", "turn", scores.diff_lines(F.col("a"), F.col("b")).alias("diff"))


@query()
def json_salvage(spark, sf_dir):
    cut = F.concat(F.lit('{"id": "'), F.col("item_id").cast("string"), F.lit('", "rows": [{"description": "a"}, {"description": "'), F.regexp_replace("text", r'["\\\n]', " "))
    return load(spark, sf_dir, "benchmark").select("item_id", repetition.salvage_json(cut).alias("salvaged"), repetition.first_json_object(F.concat(cut, F.lit('"}]} tail'))).alias("whole"))


# ---- matching --------------------------------------------------------------------------------------------------------------


def upload_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as cases, suppliers' and customers' uploads as files under five kinds of names."""
    cases = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("c"), F.col("p_partkey")).alias("id"),
        F.concat(F.lit("Scan "), F.col("p_partkey"), F.lit(" BS"), F.lpad((F.floor(F.col("p_partkey") / 2)).cast("string"), 7, "0"), F.lit(".PDF")).alias("pdf"),
        F.array(F.concat(F.lit("old-"), F.col("p_partkey"), F.lit(".pdf"))).alias("aliases"),
        F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"),
    )
    k = F.col("c_custkey")
    base = F.concat(F.lit("scan "), k, F.lit(" bs"), F.lpad(F.floor(k / 2).cast("string"), 7, "0"), F.lit(".pdf"))
    name = (
        F.when(k % 5 == 0, base).when(k % 5 == 1, F.regexp_replace(base, " ", "_")).when(k % 5 == 2, F.concat(F.lit("OLD "), k, F.lit(".pdf")))
        .when(k % 5 == 3, F.concat(F.lit("x"), k, F.lit(".bin"))).otherwise(F.concat(F.lit("copy of BS"), F.lpad(F.floor(k / 2).cast("string"), 7, "0"), F.lit(".pdf")))
    )
    files = load(spark, sf_dir, "customer").select(name.alias("file"), F.when(k % 5 == 3, F.sha2(k.cast("string"), 256)).otherwise(F.lit("")).alias("sha256"))
    return files, cases


@query("""WITH cases AS (SELECT p_partkey AS k, 'c' || p_partkey AS id, lpad(CAST(p_partkey // 2 AS VARCHAR), 7, '0') AS doc FROM part),
docs AS (SELECT doc, CASE WHEN min(id) = max(id) THEN min(id) END AS id FROM cases GROUP BY doc),
files AS (SELECT c_custkey AS k, c_custkey % 5 AS kind, lpad(CAST(c_custkey // 2 AS VARCHAR), 7, '0') AS doc, CASE c_custkey % 5 WHEN 0 THEN 'scan ' || c_custkey || ' bs' || lpad(CAST(c_custkey // 2 AS VARCHAR), 7, '0') || '.pdf'
  WHEN 1 THEN 'scan_' || c_custkey || '_bs' || lpad(CAST(c_custkey // 2 AS VARCHAR), 7, '0') || '.pdf' WHEN 2 THEN 'OLD ' || c_custkey || '.pdf' WHEN 3 THEN 'x' || c_custkey || '.bin'
  ELSE 'copy of BS' || lpad(CAST(c_custkey // 2 AS VARCHAR), 7, '0') || '.pdf' END AS file FROM customer),
hit AS (SELECT files.file, CASE WHEN kind <= 3 AND cases.id IS NOT NULL THEN cases.id WHEN kind IN (0, 1, 4) THEN docs.id END AS "case",
  CASE WHEN kind <= 3 AND cases.id IS NOT NULL THEN ['filename', 'filename (normalised)', 'manifest alias', 'file contents'][kind + 1] WHEN kind IN (0, 1, 4) AND docs.id IS NOT NULL THEN 'document number' END AS how
  FROM files LEFT JOIN cases ON files.k = cases.k LEFT JOIN docs ON files.doc = docs.doc)
SELECT file, "case", how FROM hit""")
def match_cases(spark, sf_dir):
    files, cases = upload_files(spark, sf_dir)
    return match.match_cases(files, cases).select("file", "case", "how")


_GROUND = _JOINED + f""", users AS (SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS page FROM conversations WHERE role = 'user' GROUP BY 1),
g AS (SELECT c.conv_id AS doc_id, c.turn AS page, CASE WHEN trim(coalesce(c.text, '')) = '' THEN 'missing' WHEN {_SQUASH.format("c.text")} <> '' AND contains({_SQUASH.format("u.page")}, {_SQUASH.format("c.text")}) THEN 'grounded' ELSE 'ungrounded' END AS status
  FROM conversations c JOIN users u ON c.conv_id = u.doc_id)
"""


def grounded_turns(spark, sf_dir) -> DataFrame:
    """Turns as values, and what the user said in their conversation as the page."""
    pages = conversation_pages(spark, sf_dir)
    said = pages.filter("role = 'user'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p["t"]), "\n").alias("text"))
    index = grounding.index_transcripts(said).withColumnRenamed("page", "squashed")
    rows = pages.join(index, "doc_id")
    held = (text.squash_normalised(F.col("text")) != "") & F.contains(F.col("squashed"), text.squash_normalised(F.col("text")))
    return rows.select("doc_id", "page", F.col("text").alias("value"), grounding.value_status(F.col("text"), held, F.lit(False)).alias("status"))


@query(_GROUND + "SELECT doc_id, page, status FROM g")
def ground_phrases(spark, sf_dir):
    return grounded_turns(spark, sf_dir).select("doc_id", "page", "status")


@query(_GROUND + """, n AS (SELECT doc_id, count(*) FILTER (status = 'grounded') AS grounded, count(*) FILTER (status = 'ungrounded') AS ungrounded, count(*) FILTER (status = 'computed') AS computed,
  count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'nil') AS nil FROM g GROUP BY doc_id)
SELECT *, missing AS missing_required, grounded + ungrounded + computed AS checked, round(grounded / nullif(grounded + ungrounded + computed, 0), 4) AS grounded_ratio,
  CASE WHEN ungrounded + computed > 0 THEN 'flagged' WHEN grounded > 0 THEN 'grounded' ELSE 'empty' END AS verdict FROM n""")
def grounding_rollup(spark, sf_dir):
    return grounding.rollup(grounded_turns(spark, sf_dir).withColumn("required", F.lit(True)), "doc_id")


# ---- judging ---------------------------------------------------------------------------------------------------------------


def judged_parts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 8
    size = F.col("p_size").cast("string")
    expected = F.when(k == 3, "").when(k == 4, "-").when(k == 5, size).when(k == 7, "").otherwise(F.col("p_brand"))
    actual = (
        F.when(k == 0, F.lower("p_brand")).when(k == 1, F.concat(F.col("p_brand"), F.lit(" x"))).when(k == 2, "").when(k == 3, F.col("p_type"))
        .when(k == 4, F.when(F.col("p_size") > 25, "").otherwise("5")).when(k == 5, F.concat(size, F.lit(".00"))).when(k == 6, F.col("p_type")).otherwise("  ")
    )
    rows = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("doc_id"), F.concat(F.lit("p"), (F.col("p_partkey") % 2 + 1).cast("string")).alias("tier"), expected.alias("expected"), actual.alias("actual"))
    return rows.withColumn("status", judge.judge(F.col("expected"), F.col("actual"), text.squash_normalised))


_JUDGED = """WITH judged AS (SELECT p_partkey, p_brand AS doc_id, 'p' || (p_partkey % 2 + 1) AS tier, CASE p_partkey % 8 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'missed' WHEN 3 THEN 'spurious'
  WHEN 4 THEN CASE WHEN p_size > 25 THEN 'correct' ELSE 'wrong' END WHEN 5 THEN 'correct' WHEN 6 THEN 'wrong' ELSE 'absent' END AS status FROM part)
"""


@query(_JUDGED + "SELECT p_partkey, status FROM judged")
def judge_values(spark, sf_dir):
    return judged_parts(spark, sf_dir).select("p_partkey", "status")


_N = {s: f"count(*) FILTER (status = '{s}')" for s in fixed.STATUSES}
_EXPECTED = " + ".join(_N[s] for s in fixed.STATUSES[:4])
_RETURNED = " + ".join(_N[s] for s in ("correct", "partial", "wrong", "spurious"))
_TALLY = ", ".join(f"{n} AS {s}" for s, n in _N.items()) + f""", {_EXPECTED} AS expected, {_RETURNED} AS returned, round({_N['correct']} / nullif({_EXPECTED}, 0), 4) AS accuracy,
  round(({_N['correct']} + {_N['partial']}) / nullif({_EXPECTED}, 0), 4) AS accuracy_loose, round({_N['correct']} / nullif({_RETURNED}, 0), 4) AS "precision" """


@query(_JUDGED + f"SELECT doc_id, tier, CAST(grouping(doc_id, tier) AS INTEGER) AS level, {_TALLY} FROM judged GROUP BY GROUPING SETS ((doc_id, tier), (doc_id), ())")
def tally_by_tier(spark, sf_dir):
    return scores.tally_sets(judged_parts(spark, sf_dir))


@query(_JUDGED + f", t AS (SELECT doc_id, {_TALLY} FROM judged GROUP BY doc_id) SELECT CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(expected) AS BIGINT) AS expected, sum(correct) / sum(expected) AS accuracy FROM t")
def total_score(spark, sf_dir):
    return scores.total_score(scores.tally(judged_parts(spark, sf_dir), "doc_id"))


@query("SELECT l_orderkey AS doc_id, count(*) AS attempts, min(CAST(l_quantity AS BIGINT)) AS ungrounded FROM lineitem GROUP BY l_orderkey")
def select_attempts(spark, sf_dir):
    tries = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("ungrounded"), F.col("l_linenumber").alias("attempt"))
    n = tries.groupBy("doc_id").agg(F.count("*").alias("attempts"))
    return grounding.select_attempt(tries, "doc_id").join(n, "doc_id").select("doc_id", "attempts", "ungrounded")


@query()
def pair_rows_greedy(spark, sf_dir):
    row = F.struct(*(F.col("l_returnflag") if k == "description" else F.col("l_quantity").cast("string") if k == "quantity" else F.col("l_extendedprice").cast("string") if k == "amount" else F.lit("") for k in fixed.ITEM_KEYS))
    named = row.cast("struct<" + ",".join(f"{k}:string" for k in fixed.ITEM_KEYS) + ">")
    # an order's rows in two printings: by line, and by price
    docs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", named.alias("r")))).alias("a"))
    docs = docs.select("doc_id", F.transform("a", lambda x: x["r"]).alias("truth"), F.transform(F.array_sort(F.transform("a", lambda x: F.struct(x["l_extendedprice"].alias("p"), x["r"].alias("r")))), lambda x: x["r"]).alias("actual"))
    return match.score_items(docs)[1]


# ---- totals ----------------------------------------------------------------------------------------------------------------


def order_totals(spark, sf_dir) -> DataFrame:
    """Orders with the sum of their lines, and as subtotal and total what the order's key decides."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(cents.alias("cents"))
    k = F.col("o_orderkey") % 4
    money = lambda c: (c / 100).cast("double")
    vat_cents = F.floor(F.col("cents") * 7 / 100)
    rows = load(spark, sf_dir, "orders").select("o_orderkey").distinct().join(lines, "o_orderkey")
    return rows.select(
        "o_orderkey", money(F.col("cents")).alias("line_total"), money(F.when(k == 1, F.col("cents") - vat_cents).when(k == 3, F.lit(None)).otherwise(F.col("cents"))).alias("subtotal"),
        money(vat_cents).alias("vat"), money(F.when(k == 1, F.col("cents")).when(k == 2, F.col("cents")).otherwise(F.col("cents") + vat_cents)).alias("incl"),
        F.when(F.col("o_orderkey") % 3 == 0, "Prices include VAT").when(F.col("o_orderkey") % 3 == 1, "All before VAT").otherwise("").alias("page"),
    )


_ORDERS = """WITH l AS (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1),
o AS (SELECT DISTINCT o_orderkey, cents, CAST(floor(cents * 7 / 100) AS BIGINT) AS vc, o_orderkey % 4 AS k, o_orderkey % 3 AS w FROM orders JOIN l USING (o_orderkey)),
t AS (SELECT *, CASE k WHEN 1 THEN cents - vc WHEN 3 THEN NULL ELSE cents END AS sub, CASE WHEN k IN (1, 2) THEN cents ELSE cents + vc END AS inc, CASE w WHEN 0 THEN 'inclusive' WHEN 1 THEN 'exclusive' END AS said FROM o),
b AS (SELECT *, CASE WHEN sub IS NOT NULL AND abs(sub - inc) > 2 AND (abs(cents - inc) <= 2) <> (abs(cents - sub) <= 2) THEN CASE WHEN abs(cents - inc) <= 2 THEN 'inclusive' ELSE 'exclusive' END END AS summed FROM t)
"""


@query(_ORDERS + """SELECT o_orderkey, coalesce(summed, said, 'exclusive') AS basis, CASE WHEN summed IS NOT NULL AND said <> summed THEN 'inferred from the totals, against the page''s wording'
  WHEN summed IS NOT NULL THEN 'inferred from the totals' WHEN said IS NOT NULL THEN 'stated on the document' ELSE 'assumed (the document does not say)' END AS source,
  coalesce(sub IS NOT NULL AND vc <> 0 AND abs(sub - inc) <= 2, false) AS subtotal_includes_vat FROM b""")
def vat_basis_orders(spark, sf_dir):
    rows = order_totals(spark, sf_dir)
    said = vat.vat_basis(F.col("line_total"), F.col("subtotal"), F.col("vat"), F.col("incl"), F.col("page"))
    return rows.select("o_orderkey", said.alias("v")).select("o_orderkey", "v.basis", "v.source", "v.subtotal_includes_vat")


@query(_ORDERS + "SELECT o_orderkey, coalesce(abs(sub - cents) <= 2 OR abs(sub - (inc - vc)) <= 2, false) AS subtotal_computed, coalesce(abs(inc - (sub + vc)) <= 2, false) AS total_computed FROM b")
def computed_totals(spark, sf_dir):
    rows = order_totals(spark, sf_dir)
    asked = lambda key, c: grounding.looks_computed(F.lit(key), F.col(c).cast("decimal(18,2)").cast("string"), F.col("line_total"), F.lit(None).cast("double"), F.col("subtotal"), F.col("vat"), F.col("incl"))
    return rows.select("o_orderkey", asked("subtotal", "subtotal").alias("subtotal_computed"), asked("amount_incl_vat", "incl").alias("total_computed"))


# ---- codes -----------------------------------------------------------------------------------------------------------------


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


_TITLES = ("Tax Invoice", "RECEIPT / TAX INVOICE", "Credit Note for Invoice", "Statement of Account", "Quotation", "Official Receipt", "debit-note", "Billing Note")
_CODES = ("TAX_INVOICE", "RECEIPT_TAX_INVOICE", "CREDIT_NOTE", "INVOICE", "", "RECEIPT", "DEBIT_NOTE", "INVOICE")
_LISTED = "[" + ", ".join(f"'{v}'" for v in _CODES) + "]"


@query(f"SELECT o_orderkey, {_LISTED}[CAST(o_orderkey % 8 AS INTEGER) + 1] AS code FROM orders")
def classify_headings(spark, sf_dir):
    title = _pick(F.col("o_orderkey"), _TITLES)
    return load(spark, sf_dir, "orders").select("o_orderkey", derive.document_type_code(title, text.squash_normalised).alias("code"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN '00000' WHEN 2 THEN '' ELSE '' END AS branch,
  '0' || lpad(CAST(c_custkey AS VARCHAR), 11, '0') || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '7' END AS digits, c_custkey % 3 <> 0 AS valid FROM customer""")
def branch_codes(spark, sf_dir):
    k = F.col("c_custkey")
    n = (k % 100000).cast("string")
    branch = F.when(k % 4 == 0, F.concat(F.lit("Head Office, branch "), n)).when(k % 4 == 1, "HEAD OFFICE").when(k % 4 == 2, "(Main road)").otherwise("1234567890123")
    digits = F.concat(F.lpad(k.cast("string"), 11, "0"), F.when(k % 3 == 0, "").otherwise("7"))
    tax = F.concat(F.lit("0-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 20))
    return load(spark, sf_dir, "customer").select("c_custkey", derive.branch_code(branch, text.squash_normalised).alias("branch"), derive.tax_id_digits(tax).alias("digits"), derive.tax_id_valid(tax).alias("valid"))


@query("""SELECT l_orderkey AS doc_id, CAST(count(DISTINCT l_partkey) + 1 AS INTEGER) AS n_references, 'R-' || l_orderkey AS first FROM lineitem GROUP BY l_orderkey""")
def references_dedup(spark, sf_dir):
    entry = F.struct(F.col("l_linenumber"), F.struct(F.concat(F.lit("INV "), F.col("l_partkey")).alias("number"), F.lit("").alias("date")).alias("r"))
    docs = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"]).alias("items"))
    found = docs.select("l_orderkey", derive.references(F.concat(F.lit("R-"), F.col("l_orderkey")), F.col("items")).alias("refs"))
    return found.select(F.col("l_orderkey").alias("doc_id"), F.size("refs").alias("n_references"), F.get("refs", F.lit(0))["number"].alias("first"))


@query(r"""WITH raw AS (SELECT conv_id, string_agg('"label": "' || regexp_replace(coalesce(text, ''), '["\\]', ' ', 'g') || '"', ',' ORDER BY turn, text) AS raw FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, unnest(regexp_extract_all(raw, '"(?:description|label)"\s*:\s*"([^"]{12,})"', 1)) AS entry FROM raw)
SELECT conv_id, md5(entry) AS entry, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY ALL""")
def repeated_entries(spark, sf_dir):
    part = F.concat(F.lit('"label": "'), F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\]', " "), F.lit('"'))
    raw = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), ",").alias("raw"))
    return raw.select("conv_id", F.explode(repetition.repeated_entries(F.col("raw"))).alias("e")).select("conv_id", F.md5("e.entry").alias("entry"), "e.n")


@query()
def table_rows(spark, sf_dir):
    """Orders printed as pipe tables, and the item rows read back out of them."""
    line = F.concat(F.lit("| Lot "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), F.col("l_extendedprice").cast("string"), F.lit(" |"))
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"), F.count("*").alias("n_lines"))
    docs = rows.select("doc_id", "n_lines", F.concat(F.lit("Invoice\n\n| Description | Quantity | Amount |\n|---|:--:|---:|\n"), F.col("body"), F.lit("\n| Total | | 1.00 |\n")).alias("text"))
    found = tables.item_rows(tables.find_tables(docs)).groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count_if(F.col("why") == "totals row").alias("totals"), F.sum(F.when(F.col("kept"), F.col("quantity").cast("long"))).alias("quantity"))
    return found


ORACLES["table_rows"] = "SELECT l_orderkey AS doc_id, count(*) AS kept, CAST(1 AS BIGINT) AS totals, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1"


# ---- sets and rollups ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def spurious_rows_anti(spark, sf_dir):
    return match.spurious_rows(load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT 'order' AS kind, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'line', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def status_union(spark, sf_dir):
    count = lambda name, c, kind: load(spark, sf_dir, name).groupBy(F.col(c).alias("status")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "status", "n")
    return count("orders", "o_orderstatus", "order").unionByName(count("lineitem", "l_linestatus", "line"))


@query("SELECT l_partkey AS key FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def token_intersect(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).intersect(load(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey"))


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS page, length(coalesce(text, '')) AS n, role FROM conversations)
SELECT doc_id, count(*) AS page_count, CAST(sum(n) AS BIGINT) AS tokens, bool_or(role = 'system') AS truncated, bool_or(n > 1000) AS looped, round(sum(n) / 10.0, 2)::DOUBLE AS decode_seconds,
  CASE WHEN sum(n) <> 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS tokens_per_second, min_by(role, page) AS model FROM p GROUP BY doc_id""")
def document_rollup(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit("")))
    none = F.lit(None).cast("string")
    pages = conversation_pages(spark, sf_dir).select(
        "doc_id", "page", n.alias("new_tokens"), (F.col("role") == "system").alias("truncated"), (n > 1000).alias("looped"), F.lit(0.0).alias("prefill_seconds"), (n / 10).alias("decode_seconds"),
        F.col("role").alias("model"), none.alias("url"), none.alias("backend"), none.alias("ocr_profile"), none.alias("resolution"),
    )
    return runlog.summarise(pages).select("doc_id", "page_count", "tokens", "truncated", "looped", "decode_seconds", "tokens_per_second", "model")


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS queued, CAST(0 AS BIGINT) AS running, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, CAST(0 AS BIGINT) AS cancelled, count(*) AS total FROM orders")
def queue_stats(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed")
    return runlog.queue_stats(load(spark, sf_dir, "orders").select(status.alias("status")))
