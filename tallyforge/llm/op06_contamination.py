"""Benchmark decontamination: short test items are found inside long documents by MinHash sketches of the items, partitioned by
size, and verified by exact shingle containment. DataFrame operations only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.common import WORD_BREAK, ascii_lower, stored, table, unused

WORDS, SIMILARITY = 5, 0.8
#: Sketch hashes that are compared inside each document's row; a benchmark with more of them is joined by hash instead.
INLINE = 4096
#: Bytes up to which the sketch or the items are broadcast.
BROADCAST = 64 << 20


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row: a column named twice would be worked out wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """A-Z lower-cased, cut at ASCII white space; null has no words."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _runs(words: Column, n: int, made: Callable[..., Column]) -> Column:
    """made(word, ...) of each run of n words, repeats included; of fewer words nothing."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: made(*(F.get(words, i + k) for k in range(n))))


def shingles_of(words: Column, n: int = WORDS) -> Column:
    return _runs(words, n, lambda *w: F.concat_ws(" ", *w))


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    return _runs(words, n, lambda *w: F.xxhash64(*w))


def by_width(width: Column, widths: list[int], made: Callable[[int], Column]) -> Column:
    """made(n) of the row's own width n."""
    out = F.lit(None)
    for n in widths:
        out = F.when(width == n, made(n)).otherwise(out)
    return out


def item_sketches(items: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(item_id, width, shingles, n, least, band, sketch) for each item that has a word.

    Shingles have ``words`` words; those of an item with fewer words have as many as it has. An item of n different shingles is in a
    document if at least ``least`` = ceil(similarity * n) of them are. So one of any n - least + 1 of them is: the sketch is the
    so many smallest hashes, and no item can be in a document that has none of them. Items whose numbers of shingles have as
    many binary digits form a band.
    """
    split = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(words)))
    made = lambda n: F.struct(F.array_distinct(shingles_of(F.col("words"), n)).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), n))).alias("hashes"))
    known = split.select("item_id", "width", by_width(F.col("width"), list(range(1, words + 1)), made).alias("both")).select("item_id", "width", "both.shingles", "both.hashes")
    n = F.size("shingles")
    known = known.withColumn("n", n).withColumn("least", F.ceil(F.round(F.lit(similarity) * n, 9)).cast("int"))
    known = known.withColumn("band", F.floor(F.log2("n")).cast("int"))
    return known.withColumn("sketch", F.slice("hashes", F.lit(1), F.col("n") - F.col("least") + 1)).drop("hashes")


def _candidates(words: Column, bands: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]) -> Column:
    """Items of which the document has a sketch hash. A document with fewer shingles than the band's least is passed over."""
    none = F.array().cast("array<bigint>")

    def of_band(hashes: Column, least: int, pairs: list[tuple[int, int]]) -> Column:
        # constants that the optimizer reads once; thousands of literals would take the driver long to build
        sketch = F.from_json(F.lit(json.dumps(sorted({h for h, _ in pairs}))), "array<bigint>")
        named = F.from_json(F.lit(json.dumps([{"hash": h, "item": i} for h, i in pairs])), "array<struct<hash:bigint,item:bigint>>")
        items = lambda hits: F.transform(F.filter(named, lambda x: F.array_contains(hits, x.hash)), lambda x: x.item)
        return F.when(F.size(hashes) >= least, bound(F.array_intersect(hashes, sketch), lambda hits: F.when(F.size(hits) > 0, items(hits)).otherwise(none))).otherwise(none)

    of_width = lambda n: bound(shingle_hashes(words, n), lambda hashes: F.concat(none, *(of_band(hashes, *band) for (width, _), band in bands.items() if width == n)))
    return F.array_distinct(F.concat(none, *map(of_width, sorted({width for width, _ in bands}))))


def _held(docs: DataFrame, items: DataFrame, similarity: float, words: int, inline: int) -> DataFrame:
    """(doc_id, mark, item_id, n_found, n_shingles) of rows of docs(doc_id, text) and the items that they hold; mark is the text's hash."""
    docs = docs.withColumn("mark", F.xxhash64("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    known = stored(item_sketches(items, similarity, words))
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n_hashes, n_bytes, widths = known.agg(summed(F.size("sketch")), summed(F.octet_length(F.array_join("shingles", "  ")) + 16 * F.size("shingles")), F.collect_set("width")).first()  # widths: 1 to `words`
    small = F.broadcast if n_bytes <= BROADCAST else lambda df: df
    sketches = known.select("width", "band", "least", "item_id", F.explode("sketch").alias("hash")).distinct()
    if n_hashes <= inline:
        bands: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        for r in sorted(sketches.collect(), key=lambda r: (r.width, r.band, r.hash, r.item_id)):  # `inline` rows at most
            least, pairs = bands.get((r.width, r.band), (r.least, []))
            bands[r.width, r.band] = min(least, r.least), [*pairs, (r.hash, r.item_id)]
        # the candidates are found beside the words, and an outer explode keeps the optimizer from finding them twice
        both = bound(words_of(F.col("text")), lambda w: F.struct(w.alias("words"), _candidates(w, bands).alias("items")))
        found = docs.select("doc_id", "mark", both.alias("both")).select("doc_id", "mark", "both.words", F.explode_outer("both.items").alias("item_id"))
        pairs = found.filter("item_id is not null")
    else:
        split = docs.select("doc_id", "mark", words_of(F.col("text")).alias("words"))
        of_width = lambda w, n: F.transform(F.array_distinct(shingle_hashes(w, n)), lambda h: F.struct(F.lit(n).alias("width"), h.alias("hash")))
        hashes = lambda w: F.concat(*(of_width(w, n) for n in sorted(widths)))
        hashed = docs.select("doc_id", "mark", F.explode_outer(bound(words_of(F.col("text")), hashes)).alias("h")).select("doc_id", "mark", "h.*")
        named = hashed.join(small(sketches.select("width", "hash", "item_id")), ["width", "hash"]).select("doc_id", "mark", "item_id").distinct()
        named = named.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "item_id")
        pairs = named.join(split, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("mark").eqNullSafe(F.col("_mark"))).select("doc_id", "mark", "item_id", "words")
    exact = pairs.join(small(known.select("item_id", "width", "shingles", "n", "least")), "item_id")
    found = F.size(F.array_intersect(F.col("shingles"), by_width(F.col("width"), sorted(widths) or [words], lambda n: shingles_of(F.col("words"), n))))
    return exact.select("doc_id", "mark", "item_id", found.alias("n_found"), F.col("n").alias("n_shingles"), "least").filter("n_found >= least").drop("least")


def contaminations(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, text: str = "text", inline: int = INLINE) -> DataFrame:
    """(doc_id, item_id, n_found, n_shingles, containment): documents that hold ``similarity`` or more of an item's different shingles.

    Texts are compared as lower-cased words. An item of fewer than ``words`` words is one shingle of its own length, which a
    document has where these words follow one another. Items without words match nothing, nor do documents without, nor null texts.
    Rows with a null item_id are left out; a document's row with a null doc_id is searched and named null. Repeated items and
    repeated documents give one row for each different pair of ids; n_found is then the largest. An empty table on either side gives
    no rows. No other columns are read.
    """
    held = _held(docs.select("doc_id", F.col(text).alias("text")), items, similarity, words, inline)
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_found", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_found", "best.n_shingles", (F.col("best.n_found") / F.col("best.n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, inline: int = INLINE) -> DataFrame:
    """docs without the rows whose text holds an item. Rows are known by doc_id, null or not, and text, so of rows with one doc_id
    those with other texts stay. All columns pass through, whatever their names."""
    held = _held(docs.select("doc_id", "text"), items, similarity, words, inline)
    gone = stored(held.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct())
    gone = gone.toDF(*(names := unused(docs.columns, "doc", "mark")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[names[0]]) & F.xxhash64(docs["text"]).eqNullSafe(gone[names[1]]), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    split = lambda name: f"""SELECT {name}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w"""
    return f"""
WITH split AS ({split("doc_id")} FROM documents),
item_split AS (SELECT *, least(len(w), {WORDS}) AS width FROM ({split("item_id")} FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
shingles AS (
  SELECT DISTINCT doc_id, width, s FROM (
    SELECT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s FROM split, (SELECT DISTINCT width FROM item_split))),
item_shingles AS (
  SELECT DISTINCT item_id, width, s FROM (SELECT item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s FROM item_split)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
found AS (SELECT doc_id, item_id, count(*) AS k FROM shingles JOIN item_shingles USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(k AS INTEGER) AS n_found, CAST(n AS INTEGER) AS n_shingles, k / n AS containment
FROM found JOIN sizes USING (item_id) WHERE k >= ceil(round({SIMILARITY} * n, 9))"""


ORACLE = _oracle()
