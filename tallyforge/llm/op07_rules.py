"""Quality rules: statistics of each text, hard limits on some, and an isolation forest over all of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.llm.common import batch_of, binary_cells, forget, named, one_label, stored, table, tidied

SEED = 7
#: Bits of a number that are counted in one pass over the rows, to find the one of a given rank.
DIGIT = 11
TREES, SUBSAMPLE = 100, 256
#: The share of the good labelled documents that the threshold must keep.
KEEP_GOOD, MARGIN = 0.996, 0.005
MIN_WORDS, MAX_REPEATED = 50, 50
STATS = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
FEATURES = 7
_symbols = re.compile(rb"[#*$%&|<>]")
_space = b" \t\n\x0b\x0c\r"


def failed(n_words: int, n_repeat_words: int, min_words: int, max_repeated: int) -> bool:
    return n_words < min_words or 100 * n_repeat_words > max_repeated * n_words


def covered_by_repeats(words: list, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first find included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + width - max(i, end)
            end = i + width
    return n


def base_statistics(text: bytes | None) -> tuple[list[bytes], int, int, int, int]:
    """The words; code points in them, symbols, lines equal to an earlier line, words in repeated windows."""
    words = text.split() if text else []
    if not words:
        return words, 0, 0, 0, 0
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip(_space)]
    return words, len(joined.decode("utf-8")), len(_symbols.findall(joined)), len(lines) - len(set(lines)), covered_by_repeats(words)


def features(words: list[bytes], word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, text: bytes | None) -> list[float]:
    """What the forest splits on: ratios, so that a long text is not odd for its length."""
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    joined = b"".join(words)
    n_lines = text.count(b"\n") + 1
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(joined) - len(joined.translate(None, b"0123456789"))
    marks = len(joined) - len(joined.translate(None, b".,;:!?'\"()-"))
    # roots spread small shares, where ordinary and odd texts lie close, over more of the range
    return [np.log1p(word_chars / n), *np.sqrt([n_symbols / n, n_dup_lines / n_lines, n_repeat_words / n, upper / n, digits / n, marks / n])]


class IsolationForest:
    """Random splits until a row stands alone; rows that are isolated early are anomalous (Liu, Ting and Zhou, 2008). Cuts
    are drawn over the box from ``low`` to ``high`` and its parts, not over the rows' own range: else no tree would split on what
    all of these rows have in common, as good documents have no symbols."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        self._plant((rows[rng.choice(len(rows), size, replace=False)] for _ in range(trees * (size > 0))), size, low, high, rng)

    @classmethod
    def of_samples(cls, samples: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = SEED) -> IsolationForest:
        """A tree for each sample; the samples are of one size."""
        forest = cls.__new__(cls)
        forest._plant(samples, len(samples[0]) if samples else 0, low, high, np.random.default_rng(seed))
        return forest

    def _plant(self, samples: Iterable[np.ndarray], size: int, low: np.ndarray, high: np.ndarray, rng) -> None:
        self.size = size
        depth = int(np.ceil(np.log2(max(2, size))))
        self.trees = [self._grow(rows, low, high, depth, rng) for rows in samples]

    @staticmethod
    def _expected(n: int) -> float:
        """Mean path length of an unsuccessful search in a binary search tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng) -> tuple[np.ndarray, ...]:
        """Arrays feature, cut, left, right, length; a leaf has feature -1 and the length of its path."""
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, at: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, at + self._expected(len(rows))])
            if at < depth and len(rows) > 1 and len(open_ := np.flatnonzero(high > low)):
                f = int(rng.choice(open_))
                cut = rng.uniform(low[f], high[f])
                side = rows[:, f] < cut
                nodes[me][:2] = f, cut
                below, above = high.copy(), low.copy()
                below[f] = above[f] = cut
                nodes[me][2], nodes[me][3] = grow(rows[side], low, below, at + 1), grow(rows[~side], above, high, at + 1)
            return me

        grow(rows, low, high, 0)
        f, cut, left, right, length = (np.array(x) for x in zip(*nodes))
        return f.astype(np.int64), cut, left.astype(np.int64), right.astype(np.int64), length

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; about 0.5 for ordinary rows, towards 1 for rows with short paths."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for f, cut, left, right, length in self.trees:
            at, open_ = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
            while len(open_ := open_[f[at[open_]] >= 0]):
                here = at[open_]
                at[open_] = np.where(rows[open_, f[here]] < cut[here], left[here], right[here])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self._expected(self.size), 1e-9))


MEASURED = pa.schema([*STATS, ("base_failed", pa.bool_()), ("x", pa.list_(pa.float64()))])
MEASURED_DDL = ", ".join(f"{n} long" for n in STATS.names) + ", base_failed boolean, x array<double>"


def measured(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """(doc_id, the five statistics, base_failed, x: the features) of each row of docs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in binary_cells(batch.column(1)):
                words, *counts = base_statistics(t)
                n = len(words)
                rows.append((n, *counts, failed(n, counts[3], min_words, max_repeated), features(words, *counts, t)))
            if rows:
                yield batch_of(MEASURED, (batch.column(0).to_pylist(), *zip(*rows)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), named(text).alias("text")).mapInArrow(tidied(made), MEASURED_DDL)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def ranked_values(rows: DataFrame, wanted: list[tuple[int, int]]) -> list[float]:
    """Of ``rows(x array<double>)``, none below zero, the value of each (place in x, rank from 0) in ascending order. Such numbers are in the order of
    their bits, so DIGIT bits more of each are known after each pass that counts the rows by them. The driver gets
    2 ** DIGIT counts for each of ``wanted`` at most, whatever the number of rows."""
    found, left = [0] * len(wanted), [rank for _, rank in wanted]
    schema = pa.schema([("k", pa.int64()), ("digit", pa.int64()), ("n", pa.int64())])
    for shift in range((63 // DIGIT) * DIGIT, -1, -DIGIT):
        asked = sorted({(place, prefix) for (place, _), prefix in zip(wanted, found)})

        def counted(batches: Iterator[pa.RecordBatch], shift=shift, asked=asked) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(asked), 1 << DIGIT), dtype=np.int64)
            for batch in batches:
                # zero is added so that a zero with a sign loses it
                digits = (_matrix(batch.column(0)) + 0.0).view(np.uint64) >> np.uint64(shift)
                for k, (place, prefix) in enumerate(asked):
                    own = digits[:, place]
                    own = own[own >> np.uint64(DIGIT) == np.uint64(prefix)] & np.uint64((1 << DIGIT) - 1)
                    counts[k] += np.bincount(own.astype(np.int64), minlength=1 << DIGIT)
            k, digit = np.nonzero(counts)
            yield batch_of(schema, (k, digit, counts[k, digit]))

        totals = np.zeros((len(asked), 1 << DIGIT), dtype=np.int64)
        for row in rows.select("x").mapInArrow(tidied(counted), "k long, digit long, n long").groupBy("k", "digit").agg(F.sum("n").alias("n")).collect():
            totals[row.k, row.digit] = row.n
        for i, (place, _) in enumerate(wanted):
            upto = np.cumsum(totals[asked.index((place, found[i]))])
            digit = int(np.searchsorted(upto, left[i], side="right"))
            left[i] -= int(upto[digit - 1]) if digit else 0
            found[i] = found[i] << DIGIT | digit
    return np.array(found, dtype=np.uint64).view(np.float64).tolist()


def quantiles(rows: DataFrame, n: int, wanted: list[tuple[int, float]]) -> np.ndarray:
    """np.quantile of all n rows, for each (place in x, share)."""
    at = [share * (n - 1) for _, share in wanted]
    ranks = [(place, rank) for (place, _), a in zip(wanted, at) for rank in (int(a), min(int(a) + 1, n - 1))]
    values = np.array(ranked_values(rows, ranks)).reshape(-1, 2)
    return np.array([np.quantile(pair, a - int(a)) for pair, a in zip(values, at)])


def samples_of_trees(rows: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> list[np.ndarray]:
    """For each tree its own ``subsample`` of all the rows (doc_id, x): those whose ids have the smallest hashes under the tree's number."""
    schema = pa.schema([("tree", pa.int64()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    salts = np.random.default_rng(seed).integers(0, 1 << 63, trees, dtype=np.uint64)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty((0, FEATURES)))] * trees
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for t, salt in enumerate(salts):
                h = (ids.view(np.uint64) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                few = np.argpartition(h, subsample)[:subsample] if len(h) > subsample else slice(None)
                rank, own, xs = (np.concatenate([a, b[few]]) for a, b in zip(held[t], (h, ids, x)))
                order = np.lexsort((own, rank))[:subsample]
                held[t] = rank[order], own[order], xs[order]
        for t, (rank, own, xs) in enumerate(held):
            yield batch_of(schema, (np.full(len(own), t), rank.view(np.int64) ^ np.int64(-1 << 63), own, xs.tolist()))

    order = Window.partitionBy("tree").orderBy("rank", "doc_id")
    chosen = rows.select("doc_id", "x").mapInArrow(tidied(drawn), "tree long, rank long, doc_id long, x array<double>").withColumn("turn", F.row_number().over(order))
    out: list[list[tuple[int, list[float]]]] = [[] for _ in range(trees)]
    for row in chosen.filter(F.col("turn") <= subsample).select("tree", "turn", "x").collect():  # trees * subsample rows at most
        out[row.tree].append((row.turn, row.x))
    return [np.array([x for _, x in sorted(drawn)]) for drawn in out]


def fit_measured(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> tuple[IsolationForest, float]:
    """``fit`` of documents as ``measured`` gives them."""
    # of texts with one doc_id the one with the least features
    one = docs.filter("not base_failed and doc_id is not null").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = stored(one.join(one_label(labels), "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), "x"))
    good = rows.filter("good")
    n, n_good = rows.agg(F.count("*"), F.count_if("good")).first()
    if not n_good:
        forget(rows)
        return IsolationForest.of_samples([], np.zeros(FEATURES), np.zeros(FEATURES)), 1.0
    low, high = quantiles(rows, n, [(f, share) for share in (0.002, 0.998) for f in range(FEATURES)]).reshape(2, FEATURES)
    forest = IsolationForest.of_samples(samples_of_trees(good, seed=seed), low, high, seed)
    held = docs.sparkSession.sparkContext.broadcast(forest)
    schema = pa.schema([("x", pa.list_(pa.float64()))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [[[s] for s in held.value.score(_matrix(batch.column(0))).tolist()]])

    scores = stored(good.select("x").mapInArrow(tidied(scored), "x array<double>"))
    limit = float(quantiles(scores, n_good, [(0, KEEP_GOOD)])[0]) + MARGIN
    for spent in (rows, scores):
        forget(spent)
    return forest, limit


def fit(docs: DataFrame, labels: DataFrame, seed: int = SEED, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> tuple[IsolationForest, float]:
    """The forest, and the score above which a document is rejected: the one that keeps KEEP_GOOD of the good documents. Both come from
    all labelled documents but those that fail the base rules: the box and the threshold are exact quantiles over all of them, and each tree
    draws its SUBSAMPLE, as the method has it, from all the good ones."""
    return fit_measured(stored(measured(docs, min_words=min_words, max_repeated=max_repeated)), labels, seed)


def judge_rules(docs: DataFrame, labels: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """One row for each row of docs: doc_id, the five statistics, base_failed, anomaly (0 to 1) and kept.

    base_failed: fewer than ``min_words`` words, or over ``max_repeated`` percent of them in repeated windows. Of the others
    the forest rejects those whose path lengths are shorter than calibrated on the good labelled documents. Null and empty
    texts have no words and fail. Without labelled rows nothing but the base rules rejects; of labels that disagree the smaller holds.
    Texts are measured once; the forest is fitted on, and judges, what was measured.
    Repeated rows are judged alike, null ids are carried along, and other columns are not read.
    """
    rows = stored(measured(docs, text, min_words, max_repeated))
    forest, limit = fit_measured(rows, labels)
    held = docs.sparkSession.sparkContext.broadcast(forest)  # TREES trees over SUBSAMPLE rows each
    schema = pa.schema([*STATS, ("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *columns, x = batch.columns
                scores = held.value.score(_matrix(x))
                kept = ~columns[-1].to_numpy(zero_copy_only=False).astype(bool) & (scores <= limit)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array(kept)], schema=schema)

    return rows.mapInArrow(tidied(judged), ", ".join(f"{n} long" for n in STATS.names) + ", base_failed boolean, anomaly double, kept boolean")


def op7_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
