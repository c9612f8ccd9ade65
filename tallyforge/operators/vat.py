"""Whether line amounts include the tax: from the totals, from the page's words, or by assumption."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyforge.functions import fixed
from tallyforge.functions.lets import bound
from tallyforge.functions.numbers import close
from tallyforge.functions.text import SPACE


def wording_basis(text: Column) -> Column:
    """struct(basis, phrase): what the page says, exclusive wordings asked first; nulls if it says nothing."""
    tidy = lambda found: F.regexp_replace(F.regexp_replace(found, rf"(?U){SPACE}+", " "), r"\A[()\[\]（） ]+|[()\[\]（） ]+\z", "")

    def told(page: Column) -> Column:
        first = lambda patterns: F.coalesce(*(F.regexp_substr(page, F.lit(p)) for p in patterns))
        return F.struct(first(fixed.EXCLUSIVE_WORDING).alias("exclusive"), first(fixed.INCLUSIVE_WORDING).alias("inclusive"))

    def basis(found: Column) -> Column:
        named = F.when(found["exclusive"].isNotNull(), "exclusive").when(found["inclusive"].isNotNull(), "inclusive")
        return F.struct(named.alias("basis"), tidy(F.coalesce(found["exclusive"], found["inclusive"])).alias("phrase"))

    return bound(bound(text, told), basis)


def haystack(transcript: Column, items: Column, others: Column) -> Column:
    """All text in which the page may say it, one part a line."""
    parts = F.concat(
        F.array(transcript),
        F.flatten(F.transform(items, lambda r: F.array(r["description"], r["period"]))),
        F.flatten(F.transform(others, lambda e: F.array(e["label"], e["value"]))),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def vat_basis(line_total: Column, subtotal: Column, vat: Column, incl: Column, text: Column) -> Column:
    """struct(basis, inclusive, source, evidence, subtotal_includes_vat). The figures win over the words; a conflict is told."""
    known = {"line_total": line_total, "subtotal": subtotal, "vat": vat, "incl": incl, "told": wording_basis(text)}
    return bound(F.struct(*(v.alias(k) for k, v in known.items())), lambda x: _decided(*(x[k] for k in known)))


def _decided(line_total: Column, subtotal: Column, vat: Column, incl: Column, told: Column) -> Column:
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in (line_total, subtotal, incl)])
    hits_incl, hits_sub = close(line_total, incl), close(line_total, subtotal)
    summed = F.when(known & ~close(subtotal, incl) & (hits_incl != hits_sub), F.when(hits_incl, "inclusive").otherwise("exclusive"))
    basis = F.coalesce(summed, told["basis"], F.lit("exclusive"))
    against = summed.isNotNull() & told["basis"].isNotNull() & (told["basis"] != summed)
    source = (
        F.when(against, "inferred from the totals, against the page's wording")
        .when(summed.isNotNull(), "inferred from the totals")
        .when(told["basis"].isNotNull(), "stated on the document")
        .otherwise("assumed (the document does not say)")
    )
    sums = F.concat(F.lit("line amounts sum to "), F.format_number(line_total, 2), F.lit(", which is the "), F.when(hits_incl, "VAT-inclusive total").otherwise("subtotal"))
    said = F.when(against, F.concat(F.lit(" — but the page says “"), told["phrase"], F.lit("”"))).when(told["basis"].isNotNull(), F.concat(F.lit(" · the page says “"), told["phrase"], F.lit("”"))).otherwise("")
    evidence = F.when(summed.isNotNull(), F.concat(sums, said)).otherwise(told["phrase"])
    by_lines = (basis == "inclusive") & F.coalesce(close(line_total, subtotal), F.lit(False))
    both = subtotal.isNotNull() & (F.coalesce(vat, F.lit(0.0)) != 0) & F.when(incl.isNotNull(), close(subtotal, incl)).otherwise(by_lines)
    return F.struct(basis.alias("basis"), (basis == "inclusive").alias("inclusive"), source.alias("source"), evidence.alias("evidence"), F.coalesce(both, F.lit(False)).alias("subtotal_includes_vat"))
