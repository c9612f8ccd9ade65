"""Packs tokenised documents into sequences of bounded length by the sum-of-squares rule."""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm.common import batch_of, give_back, named, stored, table, tidied

LENGTH, END = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that one task packs together. What a group leaves open at its end is a few sequences at most.
GROUP = 5_000
#: Length of a run of white space from which a text goes to ``tokenizers``: ``tiktoken`` fails at a million.
RUN = 100_000
#: Documents that a task takes at a time.
ROWS_AT_ONCE = 500
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("group", pa.int64())])
PACKED = pa.schema([*(f for f in PIECES if f.name not in ("ids", "group")), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, `group` long"


def special_names(path: str) -> list[str]:
    """Texts of the tokens that a tokenizer's file adds to its vocabulary, which stands after them and is not read."""
    with open(path, encoding="utf-8") as f:
        head = f.read(1 << 16)
    at = head.index("[", head.index('"added_tokens"'))
    return [token["content"] for token in json.JSONDecoder().raw_decode(head, at)[0]]


class Encoder:
    """Token ids of a text as ``tokenizers`` gives them, as little-endian unsigned 32-bit numbers. Names of special tokens are those tokens.

    ``tiktoken`` has the same vocabulary as ranks and takes a whole text in less time than it takes to look its words up among remembered
    ones, so it is asked for texts; those with a special token, with odd white space or with a run of white space that is too long for it go to ``tokenizers``.
    """

    _odd = "\x1c\x1d\x1e\x1f\u180e"  # white space to one side only
    _run = re.compile(rf"\s{{{RUN}}}")

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken

        self.path = path
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special_names(path))) or r"(?!)")

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in self._odd) or self.special.search(text):
            return self.whole(text)
        if len(text) > RUN and self._run.search(text):
            return self.whole(text)
        ids = self.encoding.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    import public_tokenizers

    path = name if "/" in name else public_tokenizers.path(name)
    return Encoder(path, path.removesuffix(".json") + ".tiktoken", public_tokenizers.PATTERN)


def planes(ids: bytes) -> bytes:
    """All first bytes of the ids, then all second ones and so on: the high ones are zeros, which a shuffle packs to next to nothing."""
    return np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> bytes:
    return np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T.tobytes()


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens. Only over ``length`` they are more than one, and the first is the short one."""
    first = n if n <= length else n % length or length
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def token_pieces(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END, groups: int = 1, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, group) for each piece of each row; ids, as ``planes``, are null unless asked for."""
    tail = np.array([end], dtype="<u4").tobytes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, turn = encoder(vocabulary), None
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                if turn is None:  # groups are dealt in turn, from a place that follows from the rows
                    turn = zlib.crc32(ids)
                for piece, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    part = ids[4 * start : 4 * (start + n)]
                    turn += 1
                    rows.append((doc_id, piece, start, n, zlib.crc32(part), planes(part) if keep_ids else None, turn % groups))
            if rows:
                yield batch_of(PIECES, zip(*rows))
        encoder.cache_clear()  # the worker outlives its task

    return docs.select(F.col("doc_id").cast("long"), named(text)).mapInArrow(tidied(made), PIECES_DDL)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed one by one where the sum over all gaps of the squared number of open bins that have
    this gap becomes smallest. A full bin is no longer open. Of equally good places the smallest gap is taken."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # a bin of gap g moves to gap g - size: (N(g)-1)^2 - N(g)^2 + (N(g-size)+1)^2 - N(g-size)^2; gap 0 counts for nothing
        old, new = counts[size:], counts[: capacity + 1 - size]
        change = 2 * (new - old) + 2
        change[0] -= 1 + 2 * new[0]
        change[old == 0] = np.iinfo(np.int64).max
        at = int(change.argmin())
        fresh = 2 * int(counts[capacity - size]) + 1 if size < capacity else 0
        if old[at] and change[at] <= fresh:
            gap = at + size
            one = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, one, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = one, capacity - gap
        if gap > size:
            stacks[gap - size].append(one)
            counts[gap - size] += 1
    return bins, offsets


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The rule is run on the items as they come and on the items from long to short; the result with fewer bins is taken."""
    falling = np.argsort(-lengths, kind="stable")
    as_is = sum_of_squares(lengths, capacity)
    bins, offsets = sum_of_squares(lengths[falling], capacity)
    if len(lengths) and bins.max() < as_is[0].max():
        back = np.empty(len(falling), dtype=np.int64)
        back[falling] = np.arange(len(falling))
        return bins[back], offsets[back]
    return as_is


def packed_group(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The pieces of one group with their places, a few rows at a time. Only what places follow from is sorted, so the ids, which are nearly all
    of a group, are held once."""
    held = list(batches)
    keys = pa.Table.from_batches([b.select([n for n in b.schema.names if n != "ids"]) for b in held])
    order = pc.sort_indices(keys, sort_keys=[(n, "ascending") for n in ("doc_id", "piece", "ids_crc32", "start")]).to_numpy()
    bins, offsets = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    bins[order], offsets[order] = pack_lengths(keys.column("length").to_numpy()[order], length)
    bins += keys.column("group")[0].as_py() << 32
    at = 0
    while held:
        batch = held.pop(0)
        for rows in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
            here = slice(at, at := at + rows.num_rows)
            ids = pa.array((unplaned(x.as_py()) if x.is_valid else None for x in rows.column("ids")), pa.binary())
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in PACKED.names[:5]), pa.array(bins[here]), pa.array(offsets[here]), ids], schema=PACKED)
    batch = rows = ids = None
    give_back()


def pack(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END, group: int = GROUP, keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if asked for.

    A document is its token ids and then ``end``; only one of over ``length`` tokens is cut. A null or empty text is the
    end token alone. Pieces are dealt in turn to groups of about ``group`` pieces, as many as the texts' bytes let expect, and each group is packed
    by itself, so no task's memory grows with the corpus. Repeated rows are packed once each; null ids are carried along. Columns other
    than doc_id and the text are not read, so none can clash. An empty table gives an empty result.
    """
    # no more than a document and a piece for each `length` bytes: a token has a byte at least
    n = docs.agg(F.count("*") + F.coalesce(F.sum(F.floor(F.octet_length(named(text)) / length)), F.lit(0))).first()[0]
    groups = max(1, -(-n // group))
    pieces = token_pieces(docs, text, vocabulary, length, end, groups, keep_ids)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed_group(batches, length)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
    out = pieces.groupBy("group").applyInArrow(packed, ddl)
    return out if keep_ids else out.drop("ids")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The columns of the contract, of packed sequences that are written out, ids and all."""
    out = stored(pack(docs), compression="zstd")
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
