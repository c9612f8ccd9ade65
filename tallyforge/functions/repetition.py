"""Runaway repetition and broken JSON in the replies of text generators."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

from tallyforge.functions import fixed
from tallyforge.functions.lets import bound
from tallyforge.functions.text import SPACE, lines, strip


def ends_in_cycle(text: Column, most: int, repeats: int) -> Column:
    """The text ends with a block of 4 to ``most`` characters, not all white space, so many times over. ``text`` is named several times:
    bind it."""

    def cycles(size: Column) -> Column:
        block = F.right(text, size)
        return (F.right(text, size * repeats) == F.repeat(block, F.lit(repeats))) & (strip(block) != "")

    return F.exists(F.sequence(F.lit(4), F.lit(most)), cycles)


def counter_loop(text: Column) -> Column:
    """A long line, near the end, that counts on: its end is one unit six times over once digits are alike."""
    last = F.filter(lines(F.right(text, F.lit(2 * fixed.LOOP_TAIL))), lambda line: F.length(line) >= fixed.COUNTER_MIN_LINE)
    hidden = F.transform(last, lambda line: F.regexp_replace(line, r"(?U)\d+", "#"))
    return F.exists(hidden, lambda line: ends_in_cycle(line, fixed.COUNTER_MAX_UNIT, fixed.COUNTER_REPEATS))


def line_run(tail: Column, repeats: int) -> Column:
    """As many equal lines of over three characters one after the other, blank lines apart."""
    kept = F.filter(F.transform(lines(tail), strip), lambda line: line != "")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(1).alias("run"), F.lit(1).alias("most"))

    def step(state: Column, line: Column) -> Column:
        run = F.when((line == state["last"]) & (F.length(line) > 3), state["run"] + 1).otherwise(F.lit(1))
        return F.struct(line.alias("last"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    return F.aggregate(kept, start, step)["most"] >= repeats


def looks_repetitive(text: Column, tail: int = fixed.LOOP_TAIL, repeats: int = fixed.LOOP_REPEATS) -> Column:
    """The end of the text cycles: it counts on, or repeats a line, or is one block several times over."""
    end = F.when(F.length(text) >= tail, F.right(text, F.lit(tail)))
    return F.coalesce(counter_loop(text), F.lit(False)) | F.coalesce(bound(end, lambda e: line_run(e, repeats) | ends_in_cycle(e, tail // repeats, repeats)), F.lit(False))


def repeated_entries(raw: Column) -> Column:
    """array<struct(entry, n)>: long descriptions and labels, in the order in which they come, and how often each is in the reply. Entries are
    counted as runs of a sorted array."""
    found = F.regexp_extract_all(raw, F.lit(rf'"(?:description|label)"\s*:\s*"([^"]{{{fixed.ENTRY_MIN_CHARS},}})"'), F.lit(1))
    in_order = lambda f: F.array_sort(F.transform(f, lambda e, i: F.struct(e.alias("entry"), i.alias("i"))))

    def counted(s: Column) -> Column:
        placed = F.transform(s, lambda p, k: F.struct(p["i"].alias("i"), p["entry"].alias("entry"), k.alias("k")))
        firsts = F.filter(placed, lambda p: (p["k"] == 0) | (F.get(s, p["k"] - 1)["entry"] != p["entry"]))
        sized = lambda f: F.array_sort(F.transform(f, lambda p, j: F.struct(p["i"].alias("i"), p["entry"].alias("entry"), (F.coalesce(F.get(f, j + 1)["k"], F.size(s)) - p["k"]).alias("n"))))
        return F.transform(bound(firsts, sized), lambda p: F.struct(p["entry"].alias("entry"), p["n"].alias("n")))

    return bound(bound(found, in_order), counted)


def repeated_list(raw: Column, threshold: int = fixed.ENTRY_REPEATS) -> Column:
    return F.coalesce(F.exists(repeated_entries(raw), lambda e: e["n"] >= threshold), F.lit(False))


def is_envelope(raw: Column) -> Column:
    """A reply in the reader's own wrapping instead of the fields asked for."""
    return F.coalesce(raw.rlike(rf'(?U)\A{SPACE}*[`json \n]*\{{"natural_text"'), F.lit(False))


def why_unparsable(raw: Column, truncated: Column, looped: Column | None = None) -> Column:
    """The first reason that fits. ``looped`` is looks_repetitive(raw), where that is known already."""
    return (
        F.when(looks_repetitive(raw) if looped is None else looped, "looped")
        .when(is_envelope(raw), "envelope")
        .when(repeated_list(raw), "repeated list")
        .when(F.coalesce(truncated, F.lit(False)), "truncated")
        .otherwise("invalid")
    )


class _Reader:
    """Follows a JSON text's containers, character by character, outside its strings."""

    def __init__(self, text: str):
        self.text, self.start = text, text.find("{")

    def marks(self):
        quoted = skip = False
        for at in range(self.start, len(self.text)):
            c = self.text[at]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}[],":
                yield at, c


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text; braces in strings don't count."""
    if not text or (reader := _Reader(text)).start < 0:
        return None
    depth = 0
    for at, c in reader.marks():
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c == "}" and depth == 0:
            return text[reader.start : at + 1]
    return None


def salvage(text: str | None) -> str | None:
    """A cut-off object up to its last whole element, closed; null if it is whole, or nothing whole is in it."""
    if not text or (reader := _Reader(text)).start < 0:
        return None
    open_, whole = "", None
    for at, c in reader.marks():
        if c in "{[":
            open_ += c
        elif c == ",":
            whole = (at, open_) if open_ else whole
        else:
            if not open_:
                break
            open_ = open_[:-1]
            whole = at + 1, open_
    if not open_ or not whole or not whole[1]:
        return None
    closed = text[reader.start : whole[0]] + "".join("}" if c == "{" else "]" for c in reversed(whole[1]))
    try:
        return closed if isinstance(json.loads(closed), dict) else None
    except ValueError:
        return None


def _strings(f):
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t) if isinstance(t, str) else None)

    return F.pandas_udf(each, "string")


def first_json_object(raw: Column) -> Column:
    return _strings(first_object)(raw)


def salvage_json(raw: Column) -> Column:
    return _strings(salvage)(raw)
