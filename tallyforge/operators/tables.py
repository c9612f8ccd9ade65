"""Pipe tables in transcripts: finding them, naming their columns, and reading the item rows out of the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions import fixed
from tallyforge.functions.lets import bound
from tallyforge.functions.text import SPACE, is_blank, lines, squash_literal, squash_normalised, strip

_NO_CELLS = "array<string>"


def cells(line: Column) -> Column:
    """Cells of a row: outer pipes dropped, breaks as spaces, escaped pipes plain."""
    parts = F.split(strip(line), r"(?<!\\)\|")
    head = lambda p: F.when(is_blank(F.get(p, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
    tail = lambda p: F.when((F.size(p) > 0) & is_blank(F.get(p, F.size(p) - 1)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
    return F.transform(bound(bound(parts, head), tail), lambda c: strip(F.replace(F.regexp_replace(c, r"<br\s*/?>", " "), F.lit("\\|"), F.lit("|"))))


def find_tables(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, header, rows) of each table: three or more lines that begin with a pipe, the second a rule. All of it within a
    document's row: no shuffle."""
    piped = lambda ls: F.transform(ls, lambda line: line.rlike(rf"(?U)\A{SPACE}*\|"))

    def cut(ls: Column) -> Column:
        """Runs of piped lines, from the places where one begins and where one ends."""

        def runs(p: Column) -> Column:
            at, on = F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.coalesce(F.get(p, i), F.lit(False))
            begins, ends = F.filter(at, lambda i: on(i) & ~on(i - 1)), F.filter(at, lambda i: on(i) & ~on(i + 1))
            return F.zip_with(begins, ends, lambda a, b: F.slice(ls, a + 1, b - a + 1))

        return bound(piped(ls), runs)

    blocks = bound(lines(F.coalesce(F.col(text), F.lit(""))), cut)
    # a rule has at least one cell, and every cell that is not empty is dashes
    dashes = lambda cs: (F.size(cs) > 0) & F.forall(cs, lambda c: (c == "") | c.rlike(r"\A:?-{2,}:?\z"))
    ruled = lambda b: (F.size(b) >= 3) & bound(cells(F.get(b, F.lit(1))), dashes)
    found = docs.select(doc, F.posexplode(F.filter(blocks, ruled)).alias("pos", "block"))
    body = F.transform(F.slice("block", 3, F.greatest(F.size("block") - 2, F.lit(0))), cells)
    return found.select(doc, "pos", cells(F.get("block", F.lit(0))).alias("header"), body.alias("rows"))


def heading_keys(header: Column, overrides: Column | None = None, fold=squash_normalised) -> Column:
    """array<string>: the item key of each column, or null. Overrides (a map of squashed headings) go first; each key is taken by the
    leftmost column that may have it."""
    needle = lambda w: F.lit(squash_literal(w))

    def fits(text: Column, key: str, words: tuple[str, ...]) -> Column:
        some = F.exists(F.array(*map(needle, words)), lambda w: F.contains(text, w))
        blockers = fixed.HEADING_BLOCKERS.get(key, ())
        return some & ~F.exists(F.array(*map(needle, blockers)), lambda w: F.contains(text, w)) if blockers else some

    def step(taken: Column, heading: Column) -> Column:
        text = fold(heading)
        free = lambda key: ~F.coalesce(F.array_contains(taken, key), F.lit(False))
        named = F.when(text == "", F.lit(None).cast("string"))
        if overrides is not None:
            override = F.element_at(overrides, text)
            named = named.when(override.isNotNull() & free(override), override)
        for key, words in fixed.HEADINGS:
            named = named.when(free(F.lit(key)) & fits(text, key, words), key)
        return F.concat(taken, F.array(named))

    return F.aggregate(header, F.array().cast(_NO_CELLS), step)


def charge_tables(tables: DataFrame, fold=squash_normalised, doc: str = "doc_id", overrides: Column | None = None) -> DataFrame:
    """(doc, header, keys, rows) of each document's charge table: the one with the most named columns, then the most rows, then the first;
    under two named columns there is none."""
    named = bound(heading_keys(F.col("header"), overrides, fold), lambda k: F.struct(k.alias("keys"), F.size(F.array_compact(k)).alias("n")))
    # the outer explode keeps the filter from working the keys out again
    keyed = tables.select("*", F.explode_outer(F.array(named)).alias("k")).select("*", "k.keys", "k.n").drop("k").filter("n >= 2")
    best = Window.partitionBy(doc).orderBy(F.desc("n"), F.desc(F.size("rows")), "pos")
    return keyed.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").select(doc, "header", "keys", "rows")


def _is_halves(header: Column, keys: Column, at: Column, fold) -> Column:
    """The heading at a place is blank and right of money: it is that money's hundredths."""
    return (at > 0) & (fold(F.get(header, at)) == "") & F.coalesce(F.get(keys, at - 1).isin(*fixed.MONEY_CELLS), F.lit(False))


def table_outcomes(docs: DataFrame, fold=squash_normalised, doc: str = "doc_id", text: str = "text", overrides: Column | None = None) -> DataFrame:
    """(doc, columns, unmapped, error) for every row of docs: which heading stands for which item key, headings that stand for none, and why
    there is no charge table to read."""
    tables = find_tables(docs, doc, text)
    if overrides is not None:
        tables = tables.join(docs.select(doc, overrides.alias("_overrides")), doc)
        overrides = F.col("_overrides")
    charge = charge_tables(tables, fold, doc, overrides)
    pairs = F.zip_with("header", "keys", lambda h, k: F.struct(h.alias("heading"), k.alias("key")))
    columns = F.map_from_entries(F.array_sort(F.filter(F.array_distinct(pairs), lambda p: p["key"].isNotNull())))
    loose = F.filter(F.transform("header", lambda h, i: F.when(F.get("keys", i).isNull() & (fold(h) != "") & ~_is_halves(F.col("header"), F.col("keys"), i, fold), h)), lambda h: h.isNotNull())
    told = charge.select(doc, columns.alias("columns"), loose.alias("unmapped"))
    some = tables.groupBy(doc).agg(F.count("*").alias("_tables"))
    error = F.when(F.col("_tables").isNull(), "no table").when(F.col("columns").isNull(), "no table whose headings name two or more item keys")
    return docs.select(doc).distinct().join(some, doc, "left").join(told, doc, "left").select(doc, "columns", "unmapped", error.alias("error"))


def item_rows(tables: DataFrame, fold=squash_normalised, doc: str = "doc_id", overrides: Column | None = None) -> DataFrame:
    """(doc, row, kept, why, and a column for each item key) from each document's charge table. Rows that total others, have figures
    without a description, or no figure at all are not kept."""
    charge = charge_tables(tables, fold, doc, overrides)
    rows = charge.select(doc, "header", "keys", F.posexplode("rows").alias("row", "cells"))
    out = {}
    for key in fixed.ITEM_KEYS:
        at = (F.array_position("keys", key) - 1).cast("int")
        value = F.coalesce(F.get("cells", at), F.lit(""))
        if key in fixed.MONEY_CELLS:  # a blank heading after money is its hundredths
            tail = strip(F.coalesce(F.get("cells", at + 1), F.lit("")))
            halves = (at + 1 < F.size("header")) & (fold(F.get("header", at + 1)) == "") & tail.rlike(r"\A[0-9]{2}\z")
            value = F.when(F.coalesce(halves, F.lit(False)), F.concat(value, F.lit(" "), tail)).otherwise(value)
        out[key] = F.when(F.array_contains(F.array_compact("keys"), key), value).otherwise("")
    rows = rows.select(doc, "row", "keys", "cells", *(c.alias(k) for k, c in out.items()))
    label = F.when(F.col("description") != "", F.col("description")).otherwise(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    figures = sum((F.when(is_blank(F.col(k)), 0).otherwise(1) for k in (*fixed.MONEY_CELLS, "quantity")), F.lit(0))
    why = (
        F.when(label.rlike(fixed.TOTAL_ROW), "totals row")
        .when(F.array_contains(F.array_compact("keys"), "description") & is_blank(F.col("description")), "figures with no description")
        .when(figures == 0, "no figure in any money column")
    )
    return rows.select(doc, "row", why.isNull().alias("kept"), why.alias("why"), *fixed.ITEM_KEYS)
