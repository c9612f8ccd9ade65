"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm.common import batch_of, named, plain, remainder, smallest_hashed, table, tidied

SEED = 3
#: The bounds of the sample that is learnt from: documents a language, documents and bytes of dictionaries in all, and bytes a dictionary.
SAMPLE, ROWS, BYTES, DICTIONARY = 60, 15_360, 12 << 20, 48 << 10
#: A long text teaches by pieces of so many bytes, spread evenly over the whole of it.
PIECE = 512
#: Texts are encoded in blocks, so that a long text's own words don't outweigh the dictionary.
BLOCK = 1 << 11
#: (level, strategy): the first decides, the second, slower and closer, decides again where the lead is under UNSURE.
QUICK, CLOSE = (6, zstandard.STRATEGY_GREEDY), (12, zstandard.STRATEGY_BTLAZY2)
UNSURE = 0.015
#: Share of the text's bytes by which the best language must lead, or the text is rejected.
NARROW = 0.0025
UNKNOWN = "und"
_others = re.compile(r"[\W\d_]+")
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def letters_of(text: str) -> bytes:
    """Lower-cased, with one space for each run of anything but letters: marks and digits say nothing about the language."""
    return _others.sub(" ", text.lower()).encode()


def spread(letters: bytes, room: int, piece: int = PIECE) -> bytes:
    """The text, or pieces spread evenly over all of it where it is longer than there is room for."""
    if len(letters) <= room:
        return letters
    n = max(1, room // piece)
    size = room // n
    return b" ".join(letters[at : at + size] for at in (round(i * (len(letters) - size) / max(1, n - 1)) for i in range(n)))


def shares(sizes: list[int], room: int) -> int:
    """The largest size to which all are cut for their sum to fit the room."""
    left, open_ = room, len(sizes)
    for size in sorted(sizes):
        if size * open_ > left:
            return left // open_
        left, open_ = left - size, open_ - 1
    return max(sizes, default=0)


def dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = DICTIONARY, rows: int = ROWS, total: int = BYTES, seed: int = SEED) -> dict[str, bytes]:
    """A raw-content dictionary for each language of docs, of the letters of a bounded sample of documents: ``sample`` a language and ``rows`` in
    all, and ``size`` bytes a language and ``total`` in all. The more languages there are, the less each gets; only if there are
    more than ``rows`` do the rarest teach nothing. Documents of a language share its room evenly, and what one leaves is the
    others'; a longer text gives pieces from all over it. Of rows with one doc_id and language the text with the smallest hash teaches.
    """
    known = docs.select("doc_id", named(lang).alias("lang"), named(text).alias("text")).filter("doc_id is not null and lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows)
    n_langs = counts.count()
    size, sample = min(size, total // max(1, n_langs)), max(1, min(sample, rows // max(1, n_langs)))
    chosen = smallest_hashed(known.join(F.broadcast(counts.select("lang")), "lang"), ["doc_id"], "lang", sample, seed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "text", pa.array([spread(letters_of(t), size) for t in batch.column(2).to_pylist()], pa.binary()))

    # at most `rows` broadcast; one text a doc_id and language, cut where it lies, is collected
    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found: dict[str, list[bytes]] = {}
    for row in sorted(texts.select("doc_id", "lang", "text").mapInArrow(tidied(cut), "doc_id long, lang string, text binary").collect(), key=lambda r: (r.lang, r.doc_id)):
        found.setdefault(row.lang, []).append(bytes(row.text))
    made = {}
    for name, held in found.items():
        share = shares([len(h) + 1 for h in held], size)
        made[name] = b"\n".join(spread(h, share - 1) for h in held)[:size]
    return made


class Classifier:
    """Encodes a text once for each language and compares the sizes."""

    def __init__(self, made: dict[str, bytes], block: int = BLOCK):
        self.block, self.langs = block, sorted(made)
        self.quick, self.close = ([self._encoder(made[k], *how) for k in self.langs] for how in (QUICK, CLOSE))

    def _encoder(self, held: bytes, level: int, strategy: int) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=self.block, dict_size=len(held), strategy=strategy, min_match=4 if strategy == QUICK[1] else 3, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        content = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=content)

    def _sizes(self, text: bytes, encoders: list) -> np.ndarray:
        blocks = [text[at : at + self.block] for at in range(0, len(text), self.block)]
        return np.array([sum(len(e.compress(b)) for b in blocks) for e in encoders], dtype=np.float64)

    def judge(self, text: str | None, narrow: float = NARROW) -> tuple[str, float, bool]:
        """(language, score, accepted). The score is the share of the best language when each size stands for a likelihood;
        equal sizes go to the first language in the alphabet, and such a text is rejected."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        letters = letters_of(text)
        for encoders, enough in ((self.quick, UNSURE * len(letters) + 2), (self.close, 0)):
            sizes = self._sizes(letters, encoders)
            best = int(sizes.argmin())
            rest = np.delete(sizes, best)
            lead = float(rest.min() - sizes[best]) if len(rest) else np.inf
            if lead > enough:
                break
        score = float(1 / np.exp(np.maximum((sizes[best] - sizes) / 3.0, -700)).sum())
        return self.langs[best], score, lead > narrow * len(letters)


def identify(docs: DataFrame, learn_from: DataFrame, text: str = "text", lang: str = "lang", narrow: float = NARROW) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (0 to 1) and accepted.

    ``learn_from`` has doc_id, text and lang; rows without any of these teach nothing. A null text, one without a letter, and
    every text if nothing was learnt, is ``und`` with score 0 and not accepted. A text is not accepted if the best language's
    lead is narrow. Repeated rows are judged alike; other columns of docs are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries(learn_from, lang=lang))  # BYTES at most

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(held.value)
        for batch in batches:
            rows = [known.judge(t, narrow) for t in batch.column(1).to_pylist()]
            if rows:
                yield batch_of(OUT, (batch.column(0).to_pylist(), *zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), named(text)).mapInArrow(tidied(judged), "doc_id long, lang_pred string, score double, accepted boolean")


def drop_unidentified(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """docs without the rows whose text is not accepted. The verdict is made where the row is, so nothing is shuffled. All columns pass
    through, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries(learn_from))  # BYTES at most
    at, rows = docs.columns.index("text"), plain(docs)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(held.value)
        for batch in batches:
            yield batch.filter(pa.array([known.judge(t.as_py())[2] for t in batch.column(at)], type=pa.bool_()))

    return rows.mapInArrow(tidied(judged), rows.schema).toDF(*docs.columns)


def op3_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    teaching = docs.filter(remainder(F.col("doc_id"), 3) != 1)
    out = identify(docs, teaching)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
