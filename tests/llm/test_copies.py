"""The pipeline's near copies against a brute-force Jaccard similarity."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tallyforge.llm import op02_simhash as op

VOCABULARY = [a + b for a in "ka lo mi nu re sa te vo".split() for b in "ba di fu go he".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_kept(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return {i for i in range(len(texts)) if top(i) == i}


def edited(text, rng, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = rng.choice(VOCABULARY)
    return " ".join(words)


def edited_texts():
    rng = random.Random(5)
    bases = [" ".join(rng.choices(VOCABULARY, k=rng.randrange(60, 400))) for _ in range(40)]
    texts = bases + [edited(b, rng, k) for b in bases for k in (1, 2, 3, 4, 6, 8)]
    return texts + [edited(texts[i], rng, 2) for i in range(40, 120)] + [None, "", "Ka ba", "ka  BA", bases[0].upper()]


@pytest.mark.parametrize("limit", [op.GROUP_LIMIT, 2])
def test_near_copies_are_those_of_brute_force(spark, limit):
    texts = edited_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    expected = brute_kept(texts)
    assert 60 < len(expected) < len(texts) - 100
    assert {r.doc_id for r in op.drop_near_duplicates(docs, limit=limit).collect()} == expected
    if limit == op.GROUP_LIMIT:
        assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()} == expected


def test_rows_without_an_id_give_way(spark):
    text = " ".join(VOCABULARY)
    docs = spark.createDataFrame([(None, text, "en", "s", 0), (7, text + " end", "en", "s", 0), (3, text.upper(), "en", "s", 0)], DOCS)
    assert [r.doc_id for r in op.drop_near_duplicates(docs).collect()] == [3]


def test_a_row_of_each_group_stays_whatever_its_id(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choices(VOCABULARY, k=80)) for _ in range(3))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "y"), (7, c, "x"), (7, c, "x"), (None, None, "z"), (None, "", "z")]
    docs = spark.createDataFrame([(*r, 1, 2, {"k": 1}) for r in rows], "doc_id long, text string, key string, mark int, `id.one` int, tags map<string,int>")
    kept = op.drop_near_duplicates(docs)
    got = kept.collect()
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (5, b), (7, c), (0, got[[r.doc_id for r in got].index(None)].text or "")])
    again = op.drop_near_duplicates(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert op.drop_near_duplicates(docs.limit(0)).count() == 0


def test_links_through_chains():
    chain = [(i, op.majority(h), h) for i in range(30) for h in [np.unique(op._rng.__class__(np.random.PCG64(1)).integers(0, 1 << 63, 400, dtype=np.uint64)[i * 3 : i * 3 + 100])]]
    random.Random(1).shuffle(chain)
    assert len(op.copy_links(chain)) == 29 and not op.copy_links(chain[:1])


def test_similar_texts_are_within_the_radius():
    rng = np.random.default_rng(3)
    for n in (5, 10, 40, 200):
        for _ in range(200):
            shared, spare = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, max(1, n // 4), dtype=np.uint64)
            assert (op.majority(shared) ^ op.majority(np.concatenate([shared, spare]))).bit_count() <= op.COPY_RADIUS
