"""The run log: leaderboards by case, totals, recent rows, schema widening and the replacement of worse extractions.

Rows carry ``seq``, their order in the log: the first row wins every tie, and no result depends on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions import fixed
from tallyforge.functions.numbers import elapsed, measured, percent, ranked


def row_status(error: Column, looped: Column, truncated: Column) -> Column:
    told = F.coalesce(error, F.lit("")) != ""
    return F.when(told, "error").when(F.coalesce(looped, F.lit(False)), "looped").when(F.coalesce(truncated, F.lit(False)), "truncated").otherwise("ok")


def is_extract(run_type: Column) -> Column:
    return F.coalesce(run_type, F.lit("")) == "extract"


def extract_score(p1: Column, p2: Column, grounded: Column) -> Column:
    """How good an extraction is, as a struct that sorts; unmeasured is below zero."""
    return F.struct(ranked(p1).alias("p1"), ranked(p2).alias("p2"), ranked(grounded).alias("grounded"))


def setting(prefix: str = "") -> Column:
    """What a row was run with; a row without a run type is a read."""
    at = lambda c: F.col(f"{prefix}{c}")
    kind = F.when(F.coalesce(at("run_type"), F.lit("")) == "", "ocr").otherwise(at("run_type"))
    return F.struct(*(at(c).alias(c) for c in fixed.SETTING_COLUMNS), at("timestamp").alias("timestamp"), kind.alias("run_type"))


def field_cells(expected: Column, accuracy: Column) -> Column:
    """Field accuracy in percent and its denominator; both null where nothing was expected."""
    known = F.coalesce(expected, F.lit(0)) > 0
    return F.struct(F.when(known, percent(accuracy)).alias("field_acc"), F.when(known, expected).alias("field_expected"))


def by_case(runs: DataFrame) -> DataFrame:
    """A row a case: its numbers of runs and extractions, and the rows that were best by character accuracy, by field accuracy
    and by time, as structs of their settings and figures.

    One aggregation: each best row is the largest of structs that order rows by figure, then time, then the earliest.
    So the plan has a single shuffle on the case, and a hot case is combined before it.
    """
    row = runs.filter(F.coalesce("case", F.lit("")) != "").select(
        "case",
        F.col("seq"),
        is_extract(F.col("run_type")).alias("extract"),
        F.col("status"),
        measured(F.col("char_accuracy")).alias("char"),
        measured(F.col("field_acc")).alias("field"),
        elapsed(F.col("seconds"), F.col("extract_seconds")).alias("total"),
        F.col("field_expected"),
        setting().alias("setting"),
    )
    figures = F.struct(F.col("setting"), F.col("total").alias("total_seconds"), F.col("char").alias("char_accuracy"), F.col("field").alias("field_acc"), F.col("field_expected"))
    first = -F.col("seq")
    known_total = F.coalesce(-F.col("total"), F.lit(float("-inf")))
    finished = ~F.col("extract") & (F.col("status") == "ok") & (F.coalesce("char", F.lit(0.0)) != 0) & F.col("total").isNotNull()
    best = lambda when, *order: F.max_by(F.when(when, figures), F.when(when, F.struct(*order)))
    return row.groupBy("case").agg(
        F.count_if(~F.col("extract")).alias("runs"),
        F.count_if(F.col("extract")).alias("extracts"),
        best(F.col("char").isNotNull(), F.col("char"), first).alias("best_char"),
        best(F.col("field").isNotNull(), F.col("field"), known_total, first).alias("best_field"),
        best(finished, -F.col("total"), first).alias("fastest"),
    )


def totals(runs: DataFrame) -> DataFrame:
    """One row over the whole log. A row whose seconds are no number adds no tokens either. The best case is the one whose first run
    stands earliest among those with the best accuracy."""
    seconds, tokens = F.coalesce(F.col("seconds").cast("string"), F.lit("")), F.coalesce(F.col("tokens").cast("string"), F.lit(""))
    number = lambda c: F.when(c == "", 0.0).otherwise(measured(c))
    rows = runs.select(
        "seq",
        F.coalesce("case", F.lit("")).alias("case"),
        is_extract(F.col("run_type")).alias("extract"),
        measured(F.col("char_accuracy")).alias("char"),
        number(seconds).alias("seconds"),
        F.when(number(seconds).isNotNull(), number(tokens)).cast("long").alias("tokens"),
    )
    # a row a case before the row of all: nothing but partial sums goes to the last task
    cases = rows.groupBy("case").agg(
        F.count_if(~F.col("extract")).alias("runs"),
        F.count_if(F.col("extract")).alias("extracts"),
        F.count("char").alias("scored"),
        F.sum("char").alias("char_sum"),
        F.max("char").alias("best"),
        F.min("seq").alias("first"),
        F.sum("seconds").alias("seconds"),
        F.sum("tokens").alias("tokens"),
    )
    named = F.when((F.col("case") != "") & F.col("best").isNotNull(), F.struct("best", -F.col("first")))
    return cases.agg(
        F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"),
        F.coalesce(F.sum("extracts"), F.lit(0)).alias("extracts"),
        F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"),
        F.round(F.try_divide(F.sum("char_sum"), F.sum("scored")), 2).alias("mean_accuracy"),
        F.round(F.max(F.when(F.col("case") != "", F.col("best"))), 2).alias("best_accuracy"),
        F.max_by(F.when(named.isNotNull(), F.col("case")), named).alias("best_case"),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 1).alias("seconds"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )


def recent(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The last rows, newest first; no limit for zero. Taken by each task before they meet."""
    ordered = runs.orderBy(F.desc("seq"))
    return ordered.limit(limit) if limit else ordered


def widen(old: DataFrame, columns=fixed.RUNLOG_COLUMNS) -> DataFrame:
    """The log with all columns it should have: its own first, in their order, unknown ones kept, missing ones added as blank."""
    missing = [c for c in columns if c not in old.columns]
    return old.select("*", *(F.lit("").alias(c) for c in missing))


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under the columns of both."""
    out = old.unionByName(new, allowMissingColumns=True)
    return out.fillna("", subset=[f.name for f in out.schema if f.dataType.simpleString() == "string"])


def upsert_extracts(runs: DataFrame, extracts: DataFrame, stamp: Column | None = None) -> DataFrame:
    """The log after extractions came in late: for each (timestamp, file) the last row that is a read takes the cells of the best
    extraction if that is strictly better than its own; other rows stay as they are.

    extracts: timestamp, file, the extraction's columns, and seq for the order in which they came.
    """
    cells = [c for c in fixed.EXTRACT_COLUMNS if c in runs.columns]
    key = ["timestamp", "file"]
    score = lambda p: extract_score(F.col(f"{p}p1_present"), F.col(f"{p}p2_present"), F.col(f"{p}grounded_pct"))
    best = extracts.groupBy(*key).agg(F.max_by(F.struct(*cells), F.struct(score(""), -F.col("seq"))).alias("_new"), F.max(score("")).alias("_score"))
    last = Window.partitionBy(*key, is_extract(F.col("run_type"))).orderBy(F.desc("seq"))
    rows = runs.withColumn("_last", F.row_number().over(last)).join(best, key, "left")
    better = ~is_extract(F.col("run_type")) & (F.col("_last") == 1) & (F.col("_score") > score(""))
    better = F.coalesce(better, F.lit(False))
    replaced = {c: F.when(better, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in cells}
    if "extract_updated" in runs.columns:
        replaced["extract_updated"] = F.when(better, F.lit("") if stamp is None else stamp).otherwise(F.col("extract_updated"))
    return rows.select(*(replaced.get(c, F.col(c)).alias(c) for c in runs.columns))


def summarise(pages: DataFrame) -> DataFrame:
    """Statistics of pages rolled up to documents: sums, flags, and of names the first page's that has one."""
    named = lambda c: F.min_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)), F.when(F.coalesce(c, F.lit("")) != "", F.col("page"))).alias(c)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "resolution"))), lambda x: x["resolution"])
    tokens, decode = F.sum("new_tokens"), F.sum("decode_seconds")
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.coalesce(tokens, F.lit(0)).alias("tokens"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
        F.coalesce(F.bool_or("looped"), F.lit(False)).alias("looped"),
        F.round(F.coalesce(F.sum("prefill_seconds"), F.lit(0.0)), 2).alias("prefill_seconds"),
        F.round(F.coalesce(decode, F.lit(0.0)), 2).alias("decode_seconds"),
        F.when((decode != 0) & (tokens != 0), F.round(tokens / decode, 2)).otherwise(0.0).alias("tokens_per_second"),
        *(named(c) for c in ("model", "url", "backend", "ocr_profile")),
        listed.alias("resolutions"),
    )


def join_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """One transcript a document: pages in order under numbered markers; empty pages leave out their text but keep their number.
    A document of one page has no marker."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.col(text).alias("text"))))
    filled = lambda p: F.coalesce(p["text"], F.lit("")) != ""
    marked = F.transform(F.col("_pages"), lambda p, i: F.struct(p["text"].alias("text"), F.concat(F.lit("--- page "), (i + 1).cast("string"), F.lit(" ---\n"), p["text"]).alias("marked")))
    joined = F.when(F.size("_pages") == 1, F.coalesce(F.get("_pages", F.lit(0))["text"], F.lit(""))).otherwise(F.array_join(F.transform(F.filter(marked, filled), lambda p: p["marked"]), "\n\n"))
    return pages.groupBy("doc_id").agg(ordered.alias("_pages")).select("doc_id", F.size("_pages").alias("pages"), joined.alias("transcript"))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Numbers of jobs by status, all statuses named."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.agg(*map(count, ("queued", "running", "done", "failed", "cancelled")), F.count("*").alias("total"))


def job_times(now: Column) -> list[Column]:
    """Seconds that a job waited, and that it has run."""
    span = lambda a, b: F.round((b.cast("double") - a.cast("double")), 1)
    return [
        span(F.col("created"), F.coalesce("started", "finished", now)).alias("queued_for"),
        F.when(F.col("started").isNotNull(), span(F.col("started"), F.coalesce("finished", now))).alias("elapsed"),
    ]


def newest(jobs: DataFrame, keep: int) -> DataFrame:
    """The jobs that stay when only so many are kept: those that came last."""
    return jobs.orderBy(F.desc("seq")).limit(keep)
