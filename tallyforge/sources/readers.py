"""Readers and writers: case manifests, transcripts, field truth, the run log, replies and event files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import fixed
from tallyforge.functions.text import squash_literal, strip

CASES_DDL = "cases array<struct<id:string,pdf:string,pages:int,kind:string,aliases:array<string>>>"
EVENTS_DDL = (
    "event string, job string, page int, total int, resolution string, text string, error string, new_tokens int, seconds double, "
    "prefill_seconds double, decode_seconds double, truncated boolean, looped boolean, model string, backend string, url string, "
    "ocr_profile string, step int, id string, title string, status string"
)
BLOCKS_DDL = "array<struct<bbox:array<double>,category:string,text:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, pdf, pages, kind, aliases) in the manifest's order."""
    return spark.read.schema(CASES_DDL).json(path, multiLine=True).select(F.posexplode("cases").alias("pos", "case")).select("pos", "case.*")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) from <id>.md, or <id>.txt where there is none."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,txt}").select(F.col("_metadata.file_name").alias("name"), "value")
    named = files.select(F.regexp_replace("name", r"\.(md|txt)\z", "").alias("id"), F.struct((~F.col("name").endswith(".md")).alias("rank"), F.col("value").alias("text")).alias("file"))
    return named.groupBy("id").agg(F.min_by("file.text", "file.rank").alias("text"))


def cases_with_truth(manifest: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Cases that have a transcript; of cases with one id the last."""
    last = manifest.groupBy("id").agg(F.max_by(F.struct("pos", "pdf", "pages", "kind", "aliases"), "pos").alias("case"))
    return last.join(transcripts, "id").select("id", "case.*", "text")


def _truth_rows(raw: str | None) -> dict:
    """One truth file as rows (key, readings), the other fields, and warnings."""
    rows, warnings, others = [], [], None
    try:
        truth = json.loads(raw or "")
    except ValueError:
        return {"rows": [], "others": None, "score_table": True, "columns": {}, "warnings": ["not JSON"], "error": "not JSON"}
    if not isinstance(truth, dict):
        return {"rows": [], "others": None, "score_table": True, "columns": {}, "warnings": ["not an object"], "error": "not an object"}
    columns = truth.get("table_columns") if isinstance(truth.get("table_columns"), dict) else {}
    bad = [h for h, k in columns.items() if k not in fixed.ITEM_KEYS]
    warnings += [f"table_columns: {h} names no item key" for h in bad]
    columns = {squash_literal(h): k for h, k in columns.items() if h not in bad}

    def readings(key: str, value) -> list[str] | None:
        if value is None:
            return None
        kept, seen = [], set()
        for one in value if isinstance(value, list) else [value]:
            if not isinstance(one, (str, int, float)) or isinstance(one, bool) or (isinstance(value, list) and not str(one).strip()):
                warnings.append(f"{key}: not a reading")
                return None
            if (folded := squash_literal(str(one))) not in seen or not folded:
                seen.add(folded)
                kept.append(str(one))
        if not kept:
            warnings.append(f"{key}: no reading")
            return None
        return kept

    for key, value in truth.items():
        if key in fixed.SCALARS:
            if (found := readings(key, value)) is not None:
                rows.append({"key": key, "readings": found})
        elif key == "other_fields":
            others = None if value is None else [{"label": str(e.get("label") or ""), "readings": readings(key, e.get("value")) or [""]} for e in value if isinstance(e, dict)]
        elif key not in ("table_columns", "score_table", "line_items") and not key.startswith("_"):
            warnings.append(f"{key}: unknown key")
    return {"rows": rows, "others": others, "score_table": truth.get("score_table", True) is not False, "columns": columns, "warnings": warnings, "error": None}


TRUTH_DDL = (
    "rows array<struct<key:string,readings:array<string>>>, others array<struct<label:string,readings:array<string>>>, "
    "score_table boolean, columns map<string,string>, warnings array<string>, error string"
)


def parse_truth(raw: Column) -> Column:
    """A truth file as struct(rows, others, score_table, columns, warnings, error). A null value is not checked and has no row; an empty
    one is a reading."""

    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_truth_rows(t) for t in texts], columns=["rows", "others", "score_table", "columns", "warnings", "error"])

    return F.pandas_udf(parsed, TRUTH_DDL)(raw)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.fields.json")
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.fields\.json\z", "").alias("id"), parse_truth(F.col("value")).alias("truth")).select("id", "truth.*")


def truth_skeleton(case: str, pdf: str = "", kind: str = "") -> dict:
    """What an unfilled truth file says: nothing is checked yet. Keys with an underscore are notes, which the reader passes over."""
    return {
        "_case": case,
        "_source": pdf,
        "_kind": kind,
        "_notes": ["null: not checked", '"": the document does not print it', "a list: any of these readings"],
        **dict.fromkeys(fixed.SCALARS),
        "_other_fields_template": [{"label": "", "value": ""}],
        "other_fields": None,
        "table_columns": None,
        "score_table": True,
    }


def write_truth_skeletons(cases: DataFrame, path: str) -> list[str]:
    """Writes <id>.fields.json for each case that has none, and returns their names; what is there is never overwritten. Cases are files that
    people fill in: the driver takes them one at a time."""
    spark = cases.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    note = lambda c: F.col(c) if c in cases.columns else F.lit("").alias(c)
    written = []
    for case in cases.select("id", note("pdf"), note("kind")).dropDuplicates(["id"]).orderBy("id").toLocalIterator():
        place = hadoop.Path(f"{path}/{case.id}.fields.json")
        if not files.exists(place):
            out = files.create(place, False)
            out.write(bytearray(json.dumps(truth_skeleton(case.id, case.pdf or "", case.kind or ""), ensure_ascii=False, indent=2).encode() + b"\n"))
            out.close()
            written.append(place.getName())
    return written


def read_runlog_csv(spark: SparkSession, path: str) -> DataFrame:
    """The exported log, all strings, blanks as empty strings, with seq for the order of the file.

    The order of rows is that of one file's bytes, so an export is read from a single file; the log itself is Parquet.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in rows.columns))
    return rows.fillna("").withColumn("seq", F.monotonically_increasing_id())


def write_runlog_csv(runs: DataFrame, path: str) -> None:
    ordered = runs.select("seq", *(c for c in runs.columns if c != "seq")).orderBy("seq")
    ordered.drop("seq").write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def append_runlog(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("mergeSchema", "true").parquet(path)


def write_by_case(rows: DataFrame, path: str, case: str = "case") -> None:
    """The last result of each case: only the cases at hand are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(case).parquet(path)


def list_files(spark: SparkSession, path: str, suffixes=("pdf", "png", "jpg", "jpeg", "webp", "tif", "tiff")) -> DataFrame:
    """(file, size_bytes, sha256) of a folder's documents, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    return files.select(F.regexp_replace("path", r"\A.*/", "").alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).orderBy("file")


def looks_like_pdf(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.regexp_replace(head, r"\A[\s\x00]+", "").startswith("%PDF-")


def layout_blocks(raw: Column) -> Column:
    """Blocks of a layout reply: a JSON array, one cut off after its last whole block, or an object's first list. A box of anything but
    four numbers is null; the category is cut to 40 characters."""

    def parsed(texts: pd.Series) -> pd.Series:
        def load(text):
            text = (text or "").strip()
            try:
                return json.loads(text) if text else []
            except ValueError:
                try:
                    return json.loads(text[: text.rindex("},") + 1] + "]")
                except ValueError:
                    return []

        def number(n) -> bool:
            return isinstance(n, (int, float)) and not isinstance(n, bool)

        def blocks(text):
            found = load(text)
            if isinstance(found, dict):
                found = next((v for v in found.values() if isinstance(v, list)), [])
            out = []
            for b in found if isinstance(found, list) else []:
                if isinstance(b, dict):
                    box = b.get("bbox")
                    whole = isinstance(box, list) and len(box) == 4 and all(map(number, box))
                    out.append({"bbox": [float(n) for n in box] if whole else None, "category": str(b.get("category") or "")[:40], "text": str(b.get("text") or "").strip()})
            return out

        return texts.map(blocks)

    return F.pandas_udf(parsed, BLOCKS_DDL)(raw)


def layout_text(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"] != ""), lambda b: b["text"]), "\n")


def structured_reply(body: Column) -> Column:
    """struct(text, truncated, tokens) of a reply in either dialect."""
    at = lambda path: F.get_json_object(body, path)
    chat = at("$.choices").isNotNull()
    number = lambda *paths: F.coalesce(*(F.nullif(at(p).try_cast("double").cast("int"), F.lit(0)) for p in paths), F.lit(0))
    text = F.when(chat, at("$.choices[0].message.content")).otherwise(at("$.message.content"))
    why = F.when(chat, at("$.choices[0].finish_reason")).otherwise(at("$.done_reason"))
    tokens = F.when(chat, number("$.timings.predicted_n", "$.usage.completion_tokens")).otherwise(number("$.eval_count"))
    return F.struct(strip(F.coalesce(text, F.lit(""))).alias("text"), F.coalesce(why == "length", F.lit(False)).alias("truncated"), tokens.alias("tokens"))


def step_values(reply: Column, keys: tuple[str, ...], lists: tuple[str, ...] = ()) -> Column:
    """Only the keys that a step owns: scalars as strings, null if they are none, and lists as array<map<string,string>> of their objects,
    empty if they are none and null if they are missing."""
    at = lambda k: F.get_json_object(reply, f"$.{k}")
    plain = lambda k: F.when(~F.coalesce(at(k), F.lit("")).rlike(r"\A[\[{]"), at(k))
    objects = lambda k: F.transform(F.filter(F.coalesce(F.from_json(at(k), "array<string>"), F.array().cast("array<string>")), lambda e: e.startswith("{")), lambda e: F.from_json(e, "map<string,string>"))
    return F.struct(*(plain(k).alias(k) for k in keys), *(F.when(at(k).isNotNull(), objects(k)).alias(k) for k in lists))


def sse_deltas(streams: DataFrame, text: str = "value") -> DataFrame:
    """(stream, content, tokens) of server-sent events: data lines joined up to the end mark, bad JSON skipped, the last usage."""
    data = F.filter(F.split(text, r"\r?\n"), lambda s: s.rlike(r"\Adata:"))
    bodies = F.transform(data, lambda s: F.ltrim(F.substring(s, 6, 1 << 30)))
    end = F.array_position(bodies, "[DONE]")
    live = F.when(end > 0, F.slice(bodies, F.lit(1), (end - 1).cast("int"))).otherwise(bodies)
    content = F.array_join(F.transform(live, lambda b: F.coalesce(F.get_json_object(b, "$.choices[0].delta.content"), F.lit(""))), "")
    counts = F.array_compact(F.transform(live, lambda b: F.coalesce(F.get_json_object(b, "$.timings.predicted_n"), F.get_json_object(b, "$.usage.completion_tokens"))))
    return streams.select("stream", content.alias("content"), F.when(F.size(counts) > 0, F.element_at(counts, -1)).cast("int").alias("tokens"))
