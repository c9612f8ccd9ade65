"""Standard codes read off printed fields, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyforge.functions import fixed
from tallyforge.functions.lets import bound
from tallyforge.functions.text import ascii_digits, squash, squash_literal, squash_normalised, strip


def document_type_code(title: Column, fold=squash) -> Column:
    """The first document type whose words the heading has; empty if none."""
    text = fold(title)
    has = lambda words: [F.contains(text, F.lit(squash_literal(w))) for w in words]
    code = F.when(text == "", "")
    for name, every, some in fixed.DOCUMENT_TYPES:
        tests = has(every) + ([reduce(lambda a, b: a | b, has(some))] if some else [])
        code = code.when(reduce(lambda a, b: a & b, tests), name)
    return code.otherwise("")


def branch_code(branch: Column, fold=squash) -> Column:
    """Five digits: the first printed number that is not zero; 00000 for a head office or for zeros alone; empty if neither."""
    text = strip(F.coalesce(branch, F.lit("")))
    runs = F.filter(F.split(ascii_digits(text), r"[^0-9]+"), lambda r: (F.length(r) >= 1) & (F.length(r) <= fixed.BRANCH_WIDTH))
    number = F.get(F.filter(runs, lambda r: r.rlike("[1-9]")), F.lit(0))
    squashed = fold(text)
    head = reduce(lambda a, b: a | b, [F.contains(squashed, F.lit(squash_literal(w))) for w in fixed.HEAD_OFFICE])
    return (
        F.when(number.isNotNull(), F.lpad(number, fixed.BRANCH_WIDTH, "0")).when(head | (F.size(runs) > 0), fixed.HEAD_OFFICE_CODE).otherwise("")
    )


def tax_id_digits(value: Column) -> Column:
    return F.regexp_replace(ascii_digits(F.coalesce(value, F.lit(""))), "[^0-9]", "")


def tax_id_valid(value: Column) -> Column:
    return F.length(tax_id_digits(value)) == fixed.TAX_ID_DIGITS


def period_ends(period: Column) -> Column:
    """struct(start, end) of a printed period; both empty unless it has two ends."""
    text = strip(ascii_digits(F.coalesce(period, F.lit(""))))
    return F.struct(F.regexp_extract(text, fixed.PERIOD, 1).alias("start"), F.regexp_extract(text, fixed.PERIOD, 2).alias("end"))


def electronic_tax(transcript: Column) -> Column:
    text = F.coalesce(transcript, F.lit(""))
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in fixed.ELECTRONIC_TAX])


def references(header: Column, items: Column, fold=squash_normalised) -> Column:
    """Documents that this one cites: the header's, then the rows' (structs with number and date), each type and number once, in order."""
    entry = lambda kind, number, date, source: F.struct(
        F.lit(kind).alias("type"),
        strip(F.coalesce(number, F.lit(""))).alias("number"),
        strip(F.coalesce(date, F.lit(""))).alias("date"),
        F.lit(source).alias("source"),
    )
    rows = F.transform(F.coalesce(items, F.array().cast("array<struct<number:string,date:string>>")), lambda r: entry("INVOICE", r["number"], r["date"], "line_item"))
    every = F.transform(F.concat(F.array(entry("REFERENCE", header, F.lit(""), "header")), rows), lambda e, i: F.struct(fold(e["number"]).alias("number"), e["type"].alias("type"), i.alias("i"), e.alias("e")))
    in_order = F.array_sort(F.filter(every, lambda p: p["number"] != ""))
    again = lambda s, p, k: F.coalesce((F.get(s, k - 1)["number"] == p["number"]) & (F.get(s, k - 1)["type"] == p["type"]), F.lit(False))
    firsts = bound(in_order, lambda s: F.filter(s, lambda p, k: ~again(s, p, k)))
    return F.transform(F.array_sort(F.transform(firsts, lambda p: F.struct(p["i"].alias("i"), p["e"].alias("e")))), lambda p: p["e"])


def derive(fields, transcript: Column, items: Column | None = None) -> Column:
    """All derived values of an extraction; fields(name) is the column of a scalar."""
    none = F.lit(None).cast("array<struct<number:string,date:string>>")
    return F.struct(
        document_type_code(fields("document_type")).alias("document_type_code"),
        branch_code(fields("seller_branch")).alias("seller_branch_code"),
        branch_code(fields("buyer_branch")).alias("buyer_branch_code"),
        tax_id_digits(fields("seller_tax_id")).alias("seller_tax_id_digits"),
        tax_id_digits(fields("buyer_tax_id")).alias("buyer_tax_id_digits"),
        tax_id_valid(fields("seller_tax_id")).alias("seller_tax_id_valid"),
        tax_id_valid(fields("buyer_tax_id")).alias("buyer_tax_id_valid"),
        electronic_tax(transcript).alias("electronic_tax"),
        references(fields("reference_document"), none if items is None else items).alias("references"),
    )
