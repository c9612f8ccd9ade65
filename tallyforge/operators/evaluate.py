"""Whole evaluations: transcripts and extractions of cases against their truth, from readers' replies to the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyforge.functions import fixed
from tallyforge.functions.judge import judge_best
from tallyforge.functions.numbers import percent
from tallyforge.functions.repetition import looks_repetitive
from tallyforge.functions.text import clip, is_blank, nfkc_each, normalise, normalise_output, squash_normalised, strip_fence
from tallyforge.operators import grounding, match, scores, tables, vat
from tallyforge.sources.readers import layout_blocks, layout_text

#: Rows of a report that are shown.
SHOWN = 40
#: Parts, at least, that truth and values are dealt to where they meet.
PARTS = 200


def finish_pages(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies as transcripts: layout replies (reply = 'layout') are joined blocks, others lose their fence and markup. The raw reply and
    the blocks stay beside the text; looped says whether its end cycles."""
    blocks = F.when(F.col("reply") == "layout", layout_blocks(F.col(raw)))
    plain = normalise_output(strip_fence(F.coalesce(F.col(raw), F.lit(""))))
    out = pages.withColumn("layout", blocks)
    return out.withColumn("text", F.when(F.col("reply") == "layout", layout_text(F.col("layout"))).otherwise(plain)).withColumn("looped", looks_repetitive(F.col(raw)))


def evaluate_transcripts(truth: DataFrame, read: DataFrame, ignore_tables: bool = True) -> DataFrame:
    """truth(id, text, ...) and read(id, text): both normalised, scored and compared line by line."""
    pairs = truth.withColumnRenamed("text", "_truth").join(read.select("id", F.col("text").alias("_read")), "id")
    pairs = pairs.withColumn("expected", normalise(F.coalesce("_truth", F.lit("")), ignore_tables)).withColumn("actual", normalise(F.coalesce("_read", F.lit("")), ignore_tables))
    scored = scores.score_transcripts(pairs.drop("_truth", "_read"))
    return scored.withColumn("diff", scores.diff_lines(F.col("expected"), F.col("actual"))).drop("expected", "actual")


def judge_scalars(truth: DataFrame, fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """truth(doc, key, readings) beside the value that was extracted for the key: (doc, path, expected, actual, status, tier). A key without
    a truth row is not checked; a document without an extraction has missed everything. A truth row meets the document's values as one
    array and takes its own, so values are never exploded. The planner takes a small file's rows to be few and would broadcast them, so the join is named.
    Values are folded before they meet their truth: fewer rows cross to Python, and what follows by document needs no further shuffle.
    Shuffled rows are packed, and parts that are put together by their packed size can be too large to sort in little memory, so their number is fixed."""
    scalars = [F.col(f"fields.{k}") for k in fixed.SCALARS]
    values = fields.select(F.col(doc).alias("_doc"), F.array(*scalars).alias("_values"), nfkc_each(*scalars).alias("_forms"))
    own = lambda name: F.coalesce(F.get(name, F.array_position(F.array(*map(F.lit, fixed.SCALARS)), F.col("key")) - 1), F.lit(""))
    parts = max(PARTS, int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = truth.join(values.repartition(parts, "_doc").hint("merge"), (F.col(doc) == F.col("_doc")) & F.col("key").isin(*fixed.SCALARS), "left")
    best = judge_best(F.col("readings"), own("_forms"))
    tier = F.when(F.col("key").isin(*fixed.SCALARS), "p1").otherwise("p3")
    return rows.select(doc, F.col("key").alias("path"), best.alias("b"), own("_values").alias("actual"), tier.alias("tier")).select(doc, "path", F.col("b.reading").alias("expected"), "actual", F.col("b.status").alias("status"), "tier")


_ITEMS = "array<struct<" + ",".join(f"{k}:string" for k in fixed.ITEM_KEYS) + ">>"
_OTHERS = "array<struct<label:string,value:string>>"


def score_fields(truth: DataFrame, fields: DataFrame, transcripts: DataFrame | None = None, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(judged rows, tallies by document): the truth's scalars and, where transcripts of the truth are given, the cells of their charge
    table. Other fields are never part of it. ``overall`` counts both; ``checked`` says on how many scalars it stands."""
    judged = judge_scalars(truth, fields, doc).withColumn("kind", F.lit("scalar"))
    if transcripts is not None:
        judged = judged.unionByName(judge_items(tables.find_tables(transcripts, doc), fields, doc))
    overall = judged.groupBy(doc).agg(*scores.tally_columns(F.col("status")), F.count_if(F.col("kind") == "scalar").alias("checked"))
    return judged, overall


def judge_items(found: DataFrame, fields: DataFrame, doc: str = "doc_id", overrides: Column | None = None) -> DataFrame:
    """The cells of the charge tables among ``found`` against the extracted items, as judged rows."""
    row = F.struct(*fixed.ITEM_KEYS)
    rows = tables.item_rows(found, squash_normalised, doc, overrides).filter("kept")
    wanted = rows.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", row.alias("r")))), lambda x: x["r"]).alias("truth"))
    none = F.array().cast(_ITEMS)
    docs = wanted.join(fields.select(doc, F.col("fields.line_items").alias("_items")), doc, "left").withColumn("actual", F.coalesce("_items", none))
    cells = match.score_items(docs.select(doc, "truth", "actual"), squash_normalised, doc)[0]
    return cells.select(doc, "path", "expected", "actual", "status", F.lit("item").alias("tier"), F.lit("item").alias("kind"))


def score_cases(truth: DataFrame, fields: DataFrame, transcripts: DataFrame, doc: str = "id") -> tuple[DataFrame, DataFrame]:
    """(judged rows, one row a case) of whole truth files, as read_truth gives them, against extractions.

    A judged row is a scalar's, an item cell's or another field's (kind); item cells are judged where the truth scores the table, under the
    headings that its table_columns name. A case's row has the overall tally of scalars and item cells, as a struct each those
    of the scalars and of their first tier, of the items and of the other fields, the coverage, and the truth's warnings with the
    reason for a table that was not scored. Truth files that could not be read have their error and no tally.
    """
    good = truth.filter("error is null")
    readings = good.select(doc, F.explode("rows").alias("r")).select(doc, "r.*")
    judged = judge_scalars(readings, fields, doc).withColumn("kind", F.lit("scalar"))
    scored = good.filter("score_table").select(doc, F.col("columns").alias("_columns")).join(transcripts.select(doc, "text"), doc)
    found = tables.find_tables(scored, doc).join(scored.select(doc, "_columns"), doc)
    judged = judged.unionByName(judge_items(found, fields, doc, F.col("_columns")))
    extracted = fields.select(doc, F.coalesce(F.col("fields.other_fields").cast(_OTHERS), F.array().cast(_OTHERS)).alias("actual"))
    others = good.filter("others is not null").select(doc, F.col("others").alias("truth")).join(extracted, doc, "left").withColumn("actual", F.coalesce("actual", F.array().cast(_OTHERS)))
    other_rows = match.score_others(others, squash_normalised, doc)
    judged = judged.unionByName(other_rows.select(doc, "path", "expected", "actual", "status", F.lit("other").alias("tier"), F.lit("other").alias("kind")))

    tallied = lambda rows, name: rows.groupBy(doc).agg(F.struct(*scores.tally_columns(F.col("status"))).alias(name))
    scalar, item = judged.filter("kind = 'scalar'"), judged.filter("kind = 'item'")
    overall = scores.tally(judged.filter("kind <> 'other'"), doc)
    parts = [tallied(scalar, "scalars"), tallied(scalar.filter("tier = 'p1'"), "p1"), tallied(item, "items"), tallied(judged.filter("kind = 'other'"), "other_fields")]
    outcome = tables.table_outcomes(scored, squash_normalised, doc, "text", F.col("_columns")).select(doc, F.lit(True).alias("_asked"), F.col("error").alias("_why"), "columns", "unmapped")
    rows = truth.select(doc, "error", "warnings", "score_table", F.size(F.coalesce("rows", F.array().cast("array<struct<key:string,readings:array<string>>>"))).alias("checked"), F.col("others").isNotNull().alias("others_checked"))
    rows = rows.join(outcome, doc, "left")
    why = F.when(F.col("error").isNotNull(), F.lit(None)).when(~F.col("score_table"), "score_table is false").when(F.col("_asked").isNull(), "no transcript").otherwise(F.col("_why"))
    told = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(why.isNotNull(), F.array(F.concat(F.lit("table not scored: "), why))).otherwise(F.array().cast("array<string>")))
    coverage = F.struct(F.col("checked").alias("scalars_checked"), F.lit(len(fixed.SCALARS)).alias("scalars_total"), (F.col("error").isNull() & why.isNull()).alias("items_checked"), F.col("others_checked").alias("other_fields_checked"))
    out = rows.select(doc, "error", told.alias("warnings"), coverage.alias("coverage"), "columns", "unmapped").join(overall, doc, "left")
    for part in parts:
        out = out.join(part, doc, "left")
    return judged, out


def ungrounded(values: DataFrame, index: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Answers (doc, key, value) that their page does not hold; blank and nil ones are not asked."""
    rows = values.join(index, doc)
    status = grounding.value_status(F.col("value"), grounding.holds(F.col("page"), F.col("numbers"), F.col("value")), F.lit(False))
    return rows.withColumn("status", status).filter("status = 'ungrounded'").select(doc, "key", "value")


def tax_bases(fields: DataFrame, transcripts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """vat_basis of each document, from its fields and its transcript."""
    from tallyforge.functions.numbers import parse_amount

    rows = fields.join(transcripts.select(doc, "text"), doc, "left")
    text = vat.haystack(F.col("text"), F.col("fields.line_items"), F.col("fields.other_fields"))
    money = (parse_amount(F.col(f"fields.{k}")) for k in fixed.MONEY_KEYS)
    return rows.select(doc, vat.vat_basis(grounding.sum_of(F.col("fields.line_items"), "amount"), *money, text).alias("v")).select(doc, "v.*")


def extract_cells(checked: DataFrame, fields: DataFrame, tallies: DataFrame, doc: str = "doc_id") -> DataFrame:
    """What a run log row says of an extraction: grounded share, ungrounded and missing values, filled keys, field accuracy. Unmeasured is
    null, never zero."""
    audit = grounding.rollup(checked, doc).select(doc, percent(F.col("grounded_ratio")).alias("grounded_pct"), (F.col("ungrounded") + F.col("computed")).alias("ungrounded"), F.col("missing_required").alias("fields_missing"))
    tiers = fields.select(doc, *grounding.tier_counts(lambda k: F.col(f"fields.{k}")))
    known = F.col("expected") > 0
    field = tallies.select(doc, F.when(known, percent(F.col("accuracy"))).alias("field_acc"), F.when(known, F.col("expected")).alias("field_expected"))
    return tiers.join(audit, doc, "left").join(field, doc, "left")


def step_schema(keys: tuple[str, ...], lists: tuple[str, ...] = ()) -> T.StructType:
    """The schema of one extraction step: its scalars as strings, its lists as arrays of maps."""
    row = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    return T.StructType([T.StructField(k, row if k in lists else T.StringType()) for k in keys])


def report(judged: DataFrame, shown: int = SHOWN, doc: str = "doc_id") -> str:
    """A printable report: rates, then the first rows that are not correct. Only ``shown`` rows and one total reach the driver."""
    total = scores.tally(judged).first()
    rate = lambda x: "n/a" if x is None else f"{100 * x:.2f} %"
    bad = judged.filter(~F.col("status").isin("correct", "absent")).orderBy(doc, "path")
    rows = bad.limit(shown).select(doc, "path", "status", clip(F.col("expected"), 40).alias("e"), clip(F.col("actual"), 40).alias("a")).collect()
    lines = [f"{total.correct} of {total.expected} correct: {rate(total.accuracy)}, with parts {rate(total.accuracy_loose)}, precision {rate(total.precision)}"]
    lines += [f"{r[0]}  {r.path:<28} {r.status:<9} {r.e!r} | {r.a!r}" for r in rows]
    hidden = total.partial + total.wrong + total.missed + total.spurious - len(rows)
    return "\n".join(lines + [f"and {hidden} more"] * (hidden > 0))


def unfilled() -> Column:
    """Names of the required scalars that are blank."""
    return F.array_compact(F.array(*(F.when(is_blank(F.col(f"fields.{k}")), F.lit(k)) for k in fixed.SCALARS if k not in fixed.OPTIONAL_SCALARS)))
