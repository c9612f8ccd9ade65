"""Removes passages that another document has too: a count-min sketch finds the windows that may repeat, an exact pass judges them."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyforge.llm.common import batch_of, binary_cells, named, plain, stored, table, tidied, unused

WIDTH = 13
#: Words of the grams by whose counts windows are estimated.
GRAM = 5
#: The sketch has ROWS rows, one for each of a window's two keys; cells of a row: a power of two of about this many for each window.
ROWS, CELLS_PER_WINDOW, LEAST_CELLS = 2, 0.5, 1 << 16
#: Cells of a row up to which a sketch is held by every task and broadcast; a larger one stays in parts, and the windows ask there.
BROADCAST_CELLS = 1 << 29
#: Cells of a part of the sketch.
PART = 1 << 21
#: For a sketch in parts: bytes of text of a group of documents, and chunks whose windows ask at once.
GROUP_BYTES, CHUNKS = 64 << 20, 8
#: Words that a task hashes at once.
CHUNK = 1 << 16
#: Words whose hashes a task remembers, and documents whose texts it unpacks at a time.
MEMORY, ROWS_AT_ONCE = 1 << 16, 256
#: Bits for each row with repeats, of the filter that tells which rows may have some; how many in all, at most.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 30
#: Bits of a text's checksum that tell rows of one doc_id apart.
MARK = (1 << 30) - 1
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


@lru_cache(maxsize=8)
def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor^i and factor^-i modulo 2^64, for i below n."""
    up, down = np.full(n, factor, dtype=np.uint64), np.full(n, pow(factor, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _rolling(words: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, from differences of one running sum."""
    up, down = _powers(factor, 1 << max(10, len(words).bit_length()))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return _mixed((sums[width:] - sums[:-width]) * down[: len(words) - width + 1])


class Chunk:
    """Words of several documents one after the other, and which positions begin a window that lies in one document."""

    def __init__(self, parts: list[tuple[int, int, int, list[bytes]]], known: dict[bytes, int], width: int):
        """parts: document id, mark of its text, place of the first word, words."""
        sizes = np.array([len(p[-1]) for p in parts], dtype=np.int64)
        ends = np.cumsum(sizes)
        hashes = [known[w] for p in parts for w in p[-1]]
        self.words, self.width = np.array(hashes, dtype=np.uint64), width
        which = np.repeat(np.arange(len(parts)), sizes)
        n = max(0, len(hashes) - width + 1)
        at = np.arange(n)
        self.at = at[at + width <= ends[which[:n]]]
        self.doc, self.mark, start = (np.array([p[k] for p in parts], dtype=np.int64)[which[self.at]] for k in range(3))
        self.place = self.at - (ends - sizes)[which[self.at]] + start

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the least and the greatest hash of its grams: equal windows have equal keys, and neighbours often share
        theirs, so there are far fewer keys to count than windows."""
        gram = min(GRAM, self.width)
        h = _rolling(self.words, gram, _M3)
        n = len(self.words) - self.width + 1
        least, most = h[:n].copy(), h[:n].copy()
        for i in range(1, self.width - gram + 1):
            np.minimum(least, h[i : i + n], out=least)
            np.maximum(most, h[i : i + n], out=most)
        return least[self.at], most[self.at]


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes | None]]:
    """(doc_id, text) of batches that have these first."""
    for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
        yield from zip(batch.column(0).to_pylist(), binary_cells(batch.column(1)))


def chunks(rows: Iterable[tuple[int, bytes | None]], width: int, size: int) -> Iterator[Chunk]:
    """Chunks of about ``size`` words from rows of (doc_id, text). A longer text is cut into parts that overlap by a window."""
    known: dict[bytes, int] = {}
    parts, n = [], 0
    digest = xxhash.xxh3_64_intdigest
    for doc_id, text in rows:
        words = text.split() if text else []
        if len(words) < width:
            continue
        for w in set(words).difference(known):
            known[w] = digest(w)
        for start in range(0, len(words) - width + 1, size):
            part = words[start : start + size + width - 1] if len(words) > size else words
            parts.append((doc_id, zlib.crc32(text) & MARK, start, part))
            n += len(part)
            if n >= size:
                yield Chunk(parts, known, width)
                parts, n = [], 0
        if len(known) > MEMORY:
            if parts:
                yield Chunk(parts, known, width)
            parts, n = [], 0
            known.clear()
    if parts:
        yield Chunk(parts, known, width)


def _cells(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Cell of each key in its row of the sketch. The keys are minima and maxima: they are mixed again."""
    return (_mixed(keys * np.uint64(_M1 if row else _M2)) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def counted_cells(chunk: Chunk, k: int, keys: np.ndarray, cells: int) -> np.ndarray:
    """Cells of the chunk's windows in row k of the sketch, each key once a document, so that what a text repeats by itself doesn't look repeated."""
    if not len(keys):
        return np.empty(0, dtype=np.int64)
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (chunk.doc[1:] != chunk.doc[:-1])])
    keys, doc = keys[fresh], chunk.doc[fresh]
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    return _cells(keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])], k, cells)


class Counters:
    """A row of a count-min sketch whose counters stop at two: bits ``one`` and ``two`` say that so many were counted."""

    def __init__(self, cells: int):
        self.one, self.two = np.zeros(cells // 8, dtype=np.uint8), np.zeros(cells // 8, dtype=np.uint8)

    @staticmethod
    def _set(bits: np.ndarray, cells: np.ndarray) -> None:
        """cells: sorted and different."""
        if len(cells):
            byte = cells >> 3
            first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            bits[byte[first]] |= np.bitwise_or.reduceat((128 >> (cells & 7)).astype(np.uint8), first)

    @staticmethod
    def has(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (bits[cells >> 3] & (128 >> (cells & 7)).astype(np.uint8)) > 0

    def add(self, cells: np.ndarray) -> None:
        cells, counts = np.unique(cells, return_counts=True)
        self._set(self.two, cells[(counts > 1) | self.has(self.one, cells)])
        self._set(self.one, cells)


def sketch(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """For each row of the sketch, a bit a cell: whether it counts two or more.

    A window is counted by its keys, once a document (a long one that is hashed in parts: once a part), so either row's estimate is
    never below the number of documents that the window is in. Partitions' counters are added up by the shuffle, part by part; what reaches the
    driver, and is broadcast, is ROWS * BROADCAST_CELLS bits at most, whatever the corpus.
    """
    part = min(PART, cells)
    schema = pa.schema([("part", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [Counters(cells) for _ in range(ROWS)]
        for chunk in chunks(texts(batches), width, CHUNK):
            for k, (row, keys) in enumerate(zip(rows, chunk.keys())):
                row.add(counted_cells(chunk, k, keys, cells))
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, row in enumerate(rows):
            for at in range(0, cells // 8, part // 8):
                if (one := row.one[at : at + part // 8]).any():
                    yield batch_of(schema, ([(k * cells + 8 * at) // part], [pack(one.tobytes())], [pack(row.two[at : at + part // 8].tobytes())]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack = lambda b: np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = unpack(a), unpack(b)
                if k in held:
                    one, two = held[k]
                    a, b = one | a, two | b | (one & a)
                held[k] = a, b
        for k, (_, two) in held.items():
            if two.any():
                yield batch_of(schema, ([k], [b""], [zstandard.compress(two.tobytes(), 1)]))

    ddl = "part int, one binary, two binary"
    parts = docs.select("doc_id", "text").mapInArrow(tidied(counted), ddl).repartition("part").mapInArrow(tidied(merged), ddl).select("part", "two")
    bits = np.zeros(ROWS * cells // 8, dtype=np.uint8)
    for row in parts.collect():
        bits[row.part * part // 8 : (row.part + 1) * part // 8] = np.frombuffer(zstandard.decompress(row.two), dtype=np.uint8)
    return bits.reshape(ROWS, cells // 8)


def _runs(doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, mark, first position, number) of the runs of consecutive positions."""
    order = np.lexsort((at, mark, doc))
    doc, mark, at = doc[order], mark[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)]))
    return doc[first], mark[first], at[first], np.diff(np.append(first, len(at)))


WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
WINDOWS_DDL = "h1 long, h2 int, doc_id long, at int, n int"


def open_windows(chunk: Chunk, maybe: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of ``maybe``, which may be in another chunk too, of the smallest document of the chunk that has it: n is the
    text's mark, as -1 - mark. Larger documents are settled here, as runs of n windows with the mark in h2. So a
    window's rows are one a chunk, however often it is copied."""
    if not len(maybe):
        return
    at = chunk.at[maybe]
    h1, h2 = _rolling(chunk.words, width, _M1)[at], (_rolling(_mixed(chunk.words), width, _M2)[at] >> np.uint64(32)).astype(np.uint32)
    doc, mark, place = chunk.doc[maybe], chunk.mark[maybe], chunk.place[maybe]
    order = np.lexsort((doc, h2, h1))
    s1, s2, sorted_doc = h1[order], h2[order], doc[order]
    fresh = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
    open_ = np.empty(len(doc), dtype=bool)  # rows stay in the order of the text: what neighbours share packs well
    open_[order] = sorted_doc == sorted_doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    yield batch_of(WINDOWS, (h1[open_].view(np.int64), h2[open_].view(np.int32), doc[open_], place[open_].astype(np.int32), (-1 - mark[open_]).astype(np.int32)))
    if not open_.all():
        doc, mark, first, n = _runs(doc[~open_], mark[~open_], place[~open_])
        yield batch_of(WINDOWS, (_mixed(doc.view(np.uint64)).view(np.int64), mark.astype(np.int32), doc, first.astype(np.int32), n.astype(np.int32)))


def windows_by_broadcast(docs: DataFrame, width: int, cells: int) -> DataFrame:
    """Windows that the sketch, which every task has, estimates repeated."""
    held = docs.sparkSession.sparkContext.broadcast(sketch(docs, width, cells))  # ROWS * BROADCAST_CELLS bits at most

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for chunk in chunks(texts(batches), width, CHUNK):
            seen = [Counters.has(bits[k], _cells(keys, k, cells)) for k, keys in enumerate(chunk.keys())]
            yield from open_windows(chunk, np.flatnonzero(np.logical_and.reduce(seen)), width)

    return docs.select("doc_id", "text").mapInArrow(tidied(estimated), WINDOWS_DDL)


def windows_by_parts(docs: DataFrame, n_bytes: int, width: int, cells: int) -> DataFrame:
    """Windows that the sketch estimates repeated, of a sketch that no task holds whole.

    Documents are dealt to groups by hash, and in a group they come in order, so that a group's chunks are the same each time. The
    cells of CHUNKS chunks go to the parts of the sketch that they are in, each cell once and with what the chunks count of it; a
    part's task adds these up and answers with a bit for each cell that it was asked about; and the answers meet the group again.
    What a task holds is CHUNKS chunks, or the cells that one part was asked about: a hot cell is asked about once by CHUNKS chunks.
    """
    part, n_parts = min(PART, cells), max(1, cells // PART)
    order = F.xxhash64("text")
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", order), F.lit(max(1, n_bytes // GROUP_BYTES))).alias("group"), F.lit(1).alias("kind"), F.col("doc_id").alias("a"), order.alias("b"), F.col("text").cast("binary").alias("data"))

    def asks(batches: list[Chunk]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of the sketch, the different cells of the chunks in order, and how often they are counted."""
        keys = [chunk.keys() for chunk in batches]
        return [np.unique(np.concatenate([counted_cells(chunk, k, own[k], cells) for chunk, own in zip(batches, keys)]), return_counts=True) for k in range(ROWS)]

    def runs(rows: Iterator[tuple]) -> Iterator[list[Chunk]]:
        found = (row for row in rows)
        last, different = None, []

        def once() -> Iterator[tuple[int, bytes]]:
            nonlocal last
            for row in found:
                if (row[2], row[4]) != last:  # rows that are equal in both follow one another
                    last = row[2], row[4]
                    yield last

        for chunk in chunks(once(), width, CHUNK):
            different.append(chunk)
            if len(different) == CHUNKS:
                yield different
                different = []
        if different:
            yield different

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    asked = pa.schema([("part", pa.int64()), ("group", pa.int64()), ("turn", pa.int64()), ("cells", pa.binary()), ("two", pa.binary())])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in itertools.groupby(rows_of(batches), lambda row: row[0]):
            for turn, held in enumerate(runs(rows)):
                out = []
                for k, (found, n) in enumerate(asks(held)):
                    first = np.flatnonzero(np.concatenate([[True], found[1:] // part != found[:-1] // part])) if len(found) else []
                    for a, b in zip(first, [*first[1:], len(found)]):
                        out.append((k * n_parts + int(found[a]) // part, group, turn, (found[a:b] % part).astype("<u4").tobytes(), np.packbits(n[a:b] > 1).tobytes()))
                if out:
                    yield batch_of(asked, zip(*out))

    answers = pa.schema([("group", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, rows in itertools.groupby(rows_of(batches), lambda row: row[0]):
            counters, held = Counters(max(8, part)), []
            for _, group, turn, found, two in rows:
                held.append((group, turn, found))
                own = np.frombuffer(found, dtype="<u4").astype(np.int64)
                counters.add(own)
                counters.add(own[np.unpackbits(np.frombuffer(two, dtype=np.uint8), count=len(own)).astype(bool)])
            for at in range(0, len(held), 1000):
                some = held[at : at + 1000]
                bits = [np.packbits(Counters.has(counters.two, np.frombuffer(found, dtype="<u4").astype(np.int64))).tobytes() for _, _, found in some]
                yield batch_of(answers, ([g for g, _, _ in some], [0] * len(some), [t for _, t, _ in some], [one] * len(some), bits))

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in itertools.groupby(rows_of(batches), lambda row: row[0]):
            told: dict[int, list[tuple[int, bytes]]] = {}
            first = None
            for row in rows:
                if row[1]:
                    first = row
                    break
                told.setdefault(row[2], []).append((row[3], row[4]))
            for turn, held in enumerate(runs(itertools.chain([first] if first else [], rows))):
                bits = dict(told.get(turn, ()))
                seen = []
                for k, (found, _) in enumerate(asks(held)):
                    where = k * n_parts + found // part
                    first_at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(found) else np.empty(0, dtype=np.int64)
                    flags = [np.unpackbits(np.frombuffer(bits[int(where[a])], dtype=np.uint8), count=b - a).astype(bool) for a, b in zip(first_at, [*first_at[1:], len(found)])]
                    seen.append(found[np.concatenate(flags)] if flags else found)
                for chunk in held:
                    maybe = np.logical_and.reduce([np.isin(_cells(keys, k, cells), seen[k]) for k, keys in enumerate(chunk.keys())])
                    yield from open_windows(chunk, np.flatnonzero(maybe), width)

    columns = "`group` long, kind int, a long, b long, data binary"
    sorted_ = lambda df, *by: df.repartition(by[0]).sortWithinPartitions(*by)
    wanted = sorted_(dealt, "group", "a", "b").mapInArrow(tidied(asking), "part long, `group` long, turn long, cells binary, two binary")
    replies = sorted_(wanted, "part", "group", "turn").mapInArrow(tidied(answering), columns)
    return sorted_(dealt.unionByName(replies), "group", "kind", "a", "b").mapInArrow(tidied(estimated), WINDOWS_DDL)


def repeated_windows(docs: DataFrame, width: int = WIDTH, cells: int | None = None, most: int = BROADCAST_CELLS) -> DataFrame:
    """(doc_id, mark, spans): the windows of each document whose word sequence also starts in a document with a smaller doc_id, as
    arrays of (first position, number of windows). Windows that the sketch counts once are in no other document; all others
    are grouped exactly, by 96 bits of two hashes. A sketch of over ``most`` cells a row is not broadcast; results are the same."""
    # a word takes six bytes or so; a wrong guess costs time, never a window
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cells = cells or max(LEAST_CELLS, 1 << int(CELLS_PER_WINDOW * n_bytes / 6).bit_length())
    rows = windows_by_broadcast(docs, width, cells) if cells <= most else windows_by_parts(docs, n_bytes, width, cells)
    first = F.min(F.when(F.col("n") < 0, F.col("doc_id"))).over(Window.partitionBy("h1", "h2"))
    later = rows.withColumn("first", first).filter("n > 0 or doc_id > first")
    spans = F.collect_list(F.struct("at", F.greatest("n", F.lit(1)).alias("n")))  # as many as the document has windows, at most
    return later.groupBy("doc_id", F.when(F.col("n") < 0, -1 - F.col("n")).otherwise(F.col("h2")).alias("mark")).agg(spans.alias("spans"))


def kept_words(words: list[bytes], at: np.ndarray, n: np.ndarray, width: int = WIDTH) -> list[bytes]:
    """The words that no window covers, where n windows begin one after the other at each place of ``at``."""
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, np.minimum(at, len(words)), 1)
    np.add.at(depth, np.minimum(at + n + width - 1, len(words)), -1)
    return [w for w, covered in zip(words, np.cumsum(depth).tolist()) if not covered]


def _maybe_found(found: DataFrame):
    """A test of (key, mark), as a column, that holds for all rows of ``found`` and for one in FILTER_BITS others or so: a bitmap of hashes, of
    MOST_FILTER_BITS at most. Beyond that more others pass; none is lost."""
    bits = max(1 << 16, min(MOST_FILTER_BITS, 1 << (FILTER_BITS * found.count()).bit_length()))
    place = lambda key, mark: F.xxhash64(key, mark).bitwiseAND(F.lit(bits - 1))
    at = found.select(place(F.col("key"), F.col("mark")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    held = found.sparkSession.sparkContext.broadcast(bitmap)

    def has(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    asked = F.pandas_udf(has, "boolean")
    return lambda key, mark: asked(place(key, mark))


def _with_spans(docs: DataFrame, width: int, cells: int | None, most: int) -> DataFrame:
    """docs, with plain names, and a last column, the repeated windows of the row's text. Only rows that may have some are shuffled to meet them."""
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(repeated_windows(known, width, cells, most).select(F.col("doc_id").alias("key"), "mark", "spans"), "zstd")
    own = F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(MARK)).cast("int")
    maybe = _maybe_found(found)
    rows = docs.withColumn("key", F.col("doc_id").cast("long")).withColumn("mark", own).withColumn("maybe", maybe(F.col("key"), F.col("mark")))
    none = F.lit(None).cast(found.schema["spans"].dataType)
    with_some = rows.filter("maybe").join(found, ["key", "mark"], "left").select(*docs.columns, "spans")
    return rows.filter("not maybe").select(*docs.columns, none.alias("spans")).unionByName(with_some)


def _judged(batch: pa.RecordBatch, text_at: int, spans_at: int, width: int) -> Iterator[tuple[bytes | None, list[bytes], list[bytes]]]:
    """(text, words, kept words) of each row."""
    spans = batch.column(spans_at)
    ends, (at, n) = spans.offsets.to_numpy(), (x.to_numpy().astype(np.int64) for x in spans.values.flatten())
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        for k, text in enumerate(binary_cells(batch.column(text_at).slice(first, ROWS_AT_ONCE)), first):
            words = text.split() if text else []
            start, end = ends[k], ends[k + 1]
            yield text, words, kept_words(words, at[start:end], n[start:end], width) if end > start else words


def without_repeats(docs: DataFrame, width: int = WIDTH, cells: int | None = None, most: int = BROADCAST_CELLS, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """docs with the text's kept words joined by single spaces where a word was removed, and the columns ``counts``: how many words the text had, and how
    many were removed; columns of these names are replaced. A text that loses no word is left as it is. Every row stays.

    A word is removed if a window of ``width`` words covers it whose word sequence also starts in a document with a smaller
    doc_id; windows are judged on the input. Null and empty texts, and those of under ``width`` words, have no window.
    Rows with the same doc_id take no words from one another, whether their texts are equal or not. A null doc_id is neither
    smaller nor larger than another, so its rows keep their words and take none from others. Columns of docs other than
    doc_id and text pass through, whatever their names.
    """
    docs = docs.select(*(named(c) for c in docs.columns if c.lower() not in counts))
    rows = _with_spans(plain(docs, "doc_id", "text"), width, cells, most)
    text_at, spans_at = docs.columns.index("text"), len(docs.columns)
    schema = StructType([*rows.schema.fields[:spans_at], StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, words, kept in _judged(batch, text_at, spans_at, width):
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(text if len(kept) == len(words) else b" ".join(kept))
            columns = list(batch.columns[:spans_at])
            columns[text_at] = pa.array(texts, type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=schema.names)

    return rows.mapInArrow(tidied(cleaned), schema).toDF(*docs.columns, *counts)


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs after ``without_repeats``, without the rows that lost every word. Where a text lost words, n_chars, if there is such a
    column, is counted again. All columns pass through, whatever their names."""
    n_words, n_removed = unused(docs.columns, "n_words", "n_removed")
    cut = without_repeats(docs, width, counts=(n_words, n_removed)).filter((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(n_removed) > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return cut.select(*map(named, docs.columns))


def digests_of_kept(docs: DataFrame, width: int = WIDTH, cells: int | None = None, most: int = BROADCAST_CELLS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row, where without_repeats gives the text."""
    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, cells, most)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for _, words, kept in _judged(batch, 1, 2, width)]
            if found:
                yield batch_of(schema, (batch.column(0).to_pylist(), *zip(*found)))

    return rows.mapInArrow(tidied(digested), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_of_kept(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: {{'k': i, 's': array_to_string(w[i:i + {WIDTH - 1}], ' ')}}), recursive := true) FROM split),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + {WIDTH})) AS p FROM windows JOIN firsts USING (s) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL), '') AS t FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)"""
