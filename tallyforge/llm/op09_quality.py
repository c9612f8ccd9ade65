"""Quality of documents by a linear-chain conditional random field over their lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm.common import batch_of, binary_cells, named, one_label, remainder, smallest_hashed, table, tidied

SEED = 9
#: The bounds of the sample that the field is fitted on: labelled documents, those whose hashed ids are smallest, and lines in all.
SAMPLE, LINES = 3000, 200_000
#: Lines whose features are worked out at once.
BLOCK = 1 << 12
STEPS, RATE, PENALTY = 120, 0.15, 1e-3
THRESHOLD = 0.3
#: Lines of a padded block that are labelled at once.
CELLS = 1 << 16
OWN = 13
FEATURES = 3 * OWN + 3
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_upper, _digits, _symbols, _stops = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:?"


def _line(line: bytes, seen: set[int]) -> list[float]:
    words = line.split()
    n = len(words)
    if not n:
        return [0.0] * (OWN - 1) + [1.0]
    joined = b"".join(words)
    c = len(joined)
    share = lambda marks: ((c - len(joined.translate(None, marks))) / c) ** 0.5
    mark = hash(line)
    again = mark in seen
    seen.add(mark)
    return [
        np.log1p(n) / 5, np.log1p(c / n) / 3, share(_upper), share(_digits), share(_symbols), share(b"!"), share(_stops), share(b"|"),
        1 - len(set(words)) / n, float(joined[-1:] == b"."), float(b"A" <= joined[:1] <= b"Z" or joined[0] >= 0xC3), float(again), 0.0,
    ]


def own_features(text: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, lengths) of each line by itself, a block of lines at a time. A null or empty text is one empty line. What is
    kept of the lines before is a hash of each that is new."""
    rest, seen, rows, sizes, at = text or b"", set(), [], [], 0
    while True:
        end = rest.find(b"\n", at)
        line = rest[at:] if end < 0 else rest[at:end]
        rows.append(_line(line, seen))
        sizes.append(len(line) + 1.0)
        if len(rows) == BLOCK or end < 0:
            yield np.array(rows, dtype=np.float64), np.array(sizes)
            rows, sizes = [], []
        if end < 0:
            return
        at = end + 1


def with_neighbours(own: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """A row for each line: its own features, those of the line before and of the line after, whether it is first or last, and 1.
    ``before`` and ``after`` are the lines around these, if there are any."""
    x = np.zeros((len(own), FEATURES))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[:, -1] = 1.0
    if before is None:
        x[0, -3] = 1.0
    else:
        x[0, OWN : 2 * OWN] = before
    if after is None:
        x[-1, -2] = 1.0
    else:
        x[-1, 2 * OWN : 3 * OWN] = after
    return x


def line_scores(text: bytes | None, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of the label good, length) of each line: two numbers a line, so that a text of many lines takes little more memory than itself."""
    scores, sizes, held, before = [], [], None, None
    for own, n in own_features(text):
        sizes.append(n)
        if held is not None:
            scores.append(with_neighbours(held, before, own[0]) @ w)
            before = held[-1]
        held = own
    scores.append(with_neighbours(held, before) @ w)
    return np.concatenate(scores), np.concatenate(sizes)


class LineField:
    """p(labels | lines) ~ exp(sum of w.x over good lines + sum of t over neighbouring labels); label 1 is good."""

    def __init__(self):
        self.w, self.t = np.zeros(FEATURES), np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def marginals(self, u: np.ndarray, lengths: np.ndarray, learning: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """u: scores of the label good, a row a document, padded. Returns p(good) of each line, and, for learning, the expected label pairs
        of each document's neighbours, and the log partition; forward and backward, all documents at once."""
        n, most = u.shape
        e = np.exp(self.t - self.t.max())
        inside = np.arange(most)[None, :] < lengths[:, None]
        shift = np.maximum(u, 0)
        local = np.stack([np.exp(-shift), np.exp(u - shift)], axis=2)
        local[~inside] = 1.0
        ahead, scale = np.empty((n, most, 2)), np.empty((n, most))
        now = local[:, 0]
        for i in range(most):
            if i:
                now = np.where(inside[:, i, None], (now @ e) * local[:, i], now)
            scale[:, i] = now.sum(axis=1)
            now = now / scale[:, i, None]
            ahead[:, i] = now
        back = np.ones((n, most, 2))
        for i in range(most - 2, -1, -1):
            step = (back[:, i + 1] * local[:, i + 1]) @ e.T
            step /= step.sum(axis=1, keepdims=True)
            back[:, i] = np.where(inside[:, i + 1, None], step, 1.0)
        both = ahead * back
        p = both[:, :, 1] / both.sum(axis=2)
        pairs = np.zeros((n, 2, 2))
        for i in range(most - 1 if learning else 0):
            joint = ahead[:, i, :, None] * e[None] * (local[:, i + 1] * back[:, i + 1])[:, None, :]
            pairs += np.where(inside[:, i + 1, None, None], joint / joint.sum(axis=(1, 2), keepdims=True), 0.0)
        partition = (np.where(inside, np.log(scale) + shift, 0.0)).sum(axis=1) + self.t.max() * (lengths - 1)
        return np.where(inside, p, 0.0), pairs, partition

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = STEPS, rate: float = RATE) -> LineField:
        """Ascends the likelihood of labels that are a document's own on each of its lines, then fits a logistic curve from the
        documents' aggregated marginals to their labels, so that a score is the probability of label 1."""
        if not len(docs) or good.all() or not good.any():
            self.shift = 50.0 if len(docs) and good.all() else -50.0 if len(docs) else 0.0
            return self
        blocks = [(np.array(rows), x, lengths) for rows, x, lengths in padded([d[0] for d in docs])]
        n_lines = sum(int(lengths.sum()) for _, _, lengths in blocks)
        weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))  # either label counts the same
        moments = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
        for step in range(1, steps + 1):
            gradient = np.zeros(FEATURES + 4)
            for rows, x, lengths in blocks:
                p, pairs, _ = self.marginals(x @ self.w, lengths)
                inside = np.arange(x.shape[1])[None, :] < lengths[:, None]
                gradient[:FEATURES] += np.einsum("nl,nlf->f", np.where(inside, good[rows, None] - p, 0.0) * weight[rows, None], x)
                held = np.zeros_like(pairs)
                held[np.arange(len(rows)), good[rows].astype(int), good[rows].astype(int)] = lengths - 1
                gradient[FEATURES:] += ((held - pairs) * weight[rows, None, None]).sum(axis=0).ravel()
            gradient = gradient / n_lines - PENALTY * np.concatenate([self.w, self.t.ravel()])
            moments[0] = 0.9 * moments[0] + 0.1 * gradient
            moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
            move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
            self.w += move[:FEATURES]
            self.t += move[FEATURES:].reshape(2, 2)
        raw = self.raw([(x @ self.w, sizes) for x, sizes in docs])
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's method on two numbers
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            r, v = good - p, p * (1 - p) + 1e-9
            hessian = np.array([[np.sum(v * raw * raw) + 1.0, np.sum(v * raw)], [np.sum(v * raw), np.sum(v) + 1e-3]])
            da, db = np.linalg.solve(hessian, [np.sum(r * raw) - (a - 1.0), np.sum(r) - 1e-3 * b])
            a, b = float(np.clip(a + da, 0.05, 20)), b + float(db)
        self.slope, self.shift = a, b
        return self

    def raw(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """docs: scores and lengths of each document's lines. Log odds of the marginals, averaged by the lines' lengths."""
        out = np.zeros(len(docs))
        for rows, u, lengths in padded([d[0] for d in docs]):
            p, _, _ = self.marginals(u, lengths, learning=False)
            for row, line_p, n in zip(rows, p, lengths):
                mean = float(np.average(line_p[:n], weights=docs[row][1]))
                out[row] = np.log((mean + 1e-3) / (1 - mean + 1e-3))
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        raw = self.raw([line_scores(t, self.w) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -50, 50)))


def padded(docs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places, values, lengths) of blocks of documents of like length, so that little is padding. docs have a value, or a row of them, a line."""
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    while order:
        most, rows = len(docs[order[0]]), []
        limit = most + most // 4 + 1
        for i in order:
            n = len(docs[i])
            if n > limit or rows and (len(rows) + 1) * n > CELLS:
                break
            rows.append(i)
        order = order[len(rows) :]
        lengths = np.array([len(docs[i]) for i in rows])
        x = np.zeros((len(rows), lengths.max(), *docs[rows[0]].shape[1:]))
        for k, i in enumerate(rows):
            x[k, : lengths[k]] = docs[i]
        yield rows, x, lengths


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, seed: int = SEED) -> LineField:
    """The field, from a bounded sample of labelled documents; labels has doc_id and quality (0 or 1).

    At most ``sample`` // 2 of either label are drawn. Of these, as many teach, with all their lines, as have ``lines`` // 2 lines between
    them; one that would go beyond is passed over. A doc_id with labels that disagree has the smaller, with several texts the
    one with the smallest hash.
    """
    known = one_label(labels).filter("quality in (0, 1)")
    chosen = smallest_hashed(known, ["doc_id"], "quality", sample // 2, seed)  # at most `sample` rows of two numbers
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    drawn: dict[int, int] = {}
    left = [lines // 2, lines // 2]
    sizes = texts.select("doc_id", "quality", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    for row in sorted(sizes.collect(), key=lambda r: (r.h, r.doc_id)):
        if row.n <= left[row.quality]:
            left[row.quality] -= row.n
            drawn[row.doc_id] = row.quality
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.binary()), ("sizes", pa.binary())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_cells(batch.column(1))):
                if doc_id in drawn:
                    own, n = (np.concatenate(x) for x in zip(*own_features(text)))
                    yield batch_of(schema, ([doc_id], [own.tobytes()], [n.tobytes()]))

    # at most `lines` lines of OWN + 1 numbers
    rows = sorted(texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(described), "doc_id long, own binary, sizes binary").collect(), key=lambda r: r.doc_id)
    teaching = [(with_neighbours(np.frombuffer(r.own).reshape(-1, OWN)), np.frombuffer(r.sizes)) for r in rows]
    return LineField().fit(teaching, np.array([drawn[r.doc_id] == 1 for r in rows], dtype=bool))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs: 0 to 1, higher where label 1 is likelier.

    ``labels`` are the rows to learn from. Without labels of both kinds all documents score alike. Null and empty texts are
    one empty line and score as such; repeated rows score alike; null ids are carried along; other columns are not read. A text
    takes some 200 bytes of memory a line.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # FEATURES + 6 numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield batch_of(OUT, (part.column(0).to_pylist(), held.value.score(binary_cells(part.column(1)))))

    return docs.mapInArrow(tidied(scored), "doc_id long, score double")


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    teaching = labels.filter(remainder(F.col("doc_id"), 5) != 0)
    out = score_quality(docs, teaching)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
