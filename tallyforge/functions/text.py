"""Canonical forms of text, as Column expressions. Unicode normalisation is the one thing the JVM functions lack."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from tallyforge.functions import fixed

#: White space as Python's str.strip and \\s have it: Java's class lacks the four separators.
SPACE = r"[\s\x1c-\x1f]"
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _form(kind: str):
    """Only texts beyond ASCII cross to Python; the others are in every form already."""

    def normalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(kind, t) if isinstance(t, str) else None)

    made = F.pandas_udf(normalised, "string")
    return lambda col: F.coalesce(made(F.when(col.rlike(r"[^\x00-\x7f]"), col)), col)


def nfkc(col: Column) -> Column:
    return _form("NFKC")(col)


def nfkc_each(*texts: Column) -> Column:
    """An array of the texts, each in nfkc; null stays null. A row crosses to Python only if one of its texts goes beyond ASCII, and then
    as columns: Spark measures an array's whole batch anew for each row that it writes."""

    def normalised(*columns: pd.Series) -> pd.Series:
        folded = lambda row: [unicodedata.normalize("NFKC", t) if isinstance(t, str) else None for t in row]
        return pd.Series([folded(row) if any(isinstance(t, str) for t in row) else None for row in zip(*columns)], dtype=object)

    made, beyond = F.pandas_udf(normalised, "array<string>"), F.concat_ws("", *texts).rlike(r"[^\x00-\x7f]")
    return F.coalesce(made(*(F.when(beyond, t) for t in texts)), F.array(*texts))


def nfc(col: Column) -> Column:
    return _form("NFC")(col)


def strip(col: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(col, F.lit(_WHITE))


def ascii_digits(col: Column) -> Column:
    return F.translate(col, fixed.THAI_DIGITS, fixed.ASCII_DIGITS)


def squash_normalised(col: Column) -> Column:
    """squash for a text that is in NFKC already, but for the Thai vowel that NFKC takes apart. Stays in generated code, and is the one
    that can stand inside a lambda."""
    return F.regexp_replace(F.replace(F.lower(ascii_digits(F.coalesce(col, F.lit("")))), F.lit("\u0e33"), F.lit("\u0e32")), r"[^\p{L}\p{N}]", "")


def squash(col: Column) -> Column:
    """Letters and digits only: compatibility forms folded, Thai digits as ASCII, lower case, no marks; null is empty."""
    return squash_normalised(nfkc(col))


def squash_literal(text: str) -> str:
    """squash of a constant, on the driver."""
    folded = unicodedata.normalize("NFKC", text).translate(str.maketrans(fixed.THAI_DIGITS, fixed.ASCII_DIGITS)).lower()
    return "".join(filter(str.isalnum, folded))


def is_blank(col: Column) -> Column:
    """Nothing but white space, or null. A zero is not blank."""
    return strip(F.coalesce(col, F.lit(""))) == ""


def is_nil(col: Column) -> Column:
    """A printed dash or a word for nothing, which is not blank."""
    return F.lower(strip(F.coalesce(col, F.lit("")))).isin(*fixed.NIL)


def content_only(col: Column) -> Column:
    """Without any character that a reader cannot see."""
    return F.regexp_replace(col, r"(?U)[\s\x1c-\x1f\u00ad\u200b-\u200f\u202a-\u202e\u2060\ufeff]+", "")


def strip_marks(col: Column) -> Column:
    return F.regexp_replace(col, fixed.THAI_MARKS, "")


def lines(col: Column) -> Column:
    """Lines as Python's splitlines cuts them."""
    return F.split(col, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def normalise_composed(col: Column, ignore_tables: bool = True) -> Column:
    """normalise for a text that is in NFC already."""
    out = F.regexp_replace(col, fixed.PAGE_MARKER, "")
    if ignore_tables:
        out = F.regexp_replace(out, fixed.LINE_BREAK, "\n")
        out = F.regexp_replace(out, fixed.TABLE_BLOCK, "\n")
        out = F.regexp_replace(out, fixed.TABLE_CELL, " ")
        out = F.regexp_replace(out, fixed.PIPE_RULE, "")
        out = F.replace(F.replace(out, F.lit("\\|"), F.lit("|")), F.lit("|"), F.lit(" "))
    tidy = lambda line: strip(F.regexp_replace(F.regexp_replace(line, fixed.ZERO_WIDTH, ""), rf"(?U){SPACE}+", " "))
    return F.array_join(F.filter(F.transform(lines(out), tidy), lambda line: line != ""), "\n")


def normalise(col: Column, ignore_tables: bool = True) -> Column:
    """The form in which transcripts are compared: table markup and page markers gone, one space between words, no empty lines."""
    return normalise_composed(nfc(col), ignore_tables)


def strip_fence(col: Column) -> Column:
    """The text inside a code fence that wraps the whole of it, if the fence names no language but a markup one."""
    bare = strip(col)
    head = F.regexp_extract(bare, r"\A```([^\n]*)\n", 1)
    rest = F.regexp_replace(F.regexp_replace(bare, r"\A[^\n]*\n", ""), rf"(?U){SPACE}+\z", "")
    wrapped = bare.rlike(r"\A```[^\n]*\n") & rest.endswith("```") & F.lower(strip(head)).isin("", "markdown", "md", "html")
    return F.when(wrapped, F.regexp_replace(rest, rf"(?U){SPACE}*```\z", "")).otherwise(bare)


def normalise_output(col: Column) -> Column:
    """Without the structural markup that a reader of pages adds: page numbers unwrapped, headings bare, five entities decoded in turn."""
    out = F.regexp_replace(col, r"(?isU)<page_number>\s*(.*?)\s*</page_number>", "$1")
    out = F.regexp_replace(out, r"(?iU)</?figure>\s*", "")
    out = F.regexp_replace(out, r"(?mdU)^\s{0,3}#{1,6}\s+", "")
    for entity, char in fixed.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def slug(name: Column) -> Column:
    """A file's name without its last extension, letters and digits only."""
    base = F.regexp_replace(name, r"\A.*/", "")
    return F.regexp_replace(F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]*\z", "")), "[^a-z0-9]+", "")


def document_numbers(name: Column) -> Column:
    """Reference numbers in a file's name, lower-cased, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(fixed.DOCUMENT_NUMBER), F.lit(1)), F.lower))


def clean_url(col: Column) -> Column:
    bare = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"/+\z", "")
    return F.when((bare == "") | bare.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.\-]*://"), bare).otherwise(F.concat(F.lit("http://"), bare))


def same_model(a: Column, b: Column) -> Column:
    """Equal names, where no tag means the latest."""
    full = lambda c: F.when(c.contains(":"), c).otherwise(F.concat(c, F.lit(":latest")))
    return full(a) == full(b)


def clip(col: Column, width: int) -> Column:
    """White space collapsed, cut to width with an ellipsis."""
    flat = strip(F.regexp_replace(col, rf"(?U){SPACE}+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)
