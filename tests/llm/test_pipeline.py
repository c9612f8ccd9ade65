"""The pipeline over planted documents, and what the entry point makes of missing parts."""

import os
import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline

REPO = Path(__file__).resolve().parents[2]
SYLLABLES = {"aa": "ka la mu ri to sa ve ne ra mi".split(), "bb": "schtr brun klotz werf zwang dorf igkeit ung".split()}


def prose(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(n))


def write(spark, tmp_path):
    passage, item = prose("aa", "passage", 70), prose("aa", "item", 25)
    texts = [(i, prose("ab"[i % 2] * 2, i, 150), "ab"[i % 2] * 2) for i in range(60)]
    texts += [(100, texts[3][1], "bb"), (101, texts[4][1].upper().replace(" ", "\n"), "aa"), (102, prose("aa", 102, 80) + " " + passage + " " + prose("aa", 103, 80), "aa"), (104, prose("aa", 104, 80) + " " + passage, "aa")]
    texts += [(105, prose("aa", 105, 200) + " " + item + " " + prose("aa", 106, 100), "aa"), (106, "12 34 !!", "aa"), (107, None, "aa"), (108, "", None)]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, passage, item


def test_stages_do_what_they_say(spark, tmp_path):
    docs, passage, item = write(spark, tmp_path)
    now = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{len(seen)}")
        now = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id: r.text for r in now.collect()})
    languages, copies, passages, leaks = seen
    assert set(range(60)) <= set(languages) and not {106, 107, 108} & set(languages)
    assert not {100, 101} & set(copies) and set(range(60)) <= set(copies)
    assert passage in passages[102] and passage not in passages[104] and passages[104] == prose("aa", 104, 80)
    assert 105 in passages and 105 not in leaks and set(range(60)) <= set(leaks)
    assert [passages[i] for i in range(60)] == [t for i, t in sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id < 60)]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(leaks)


def test_an_empty_corpus(spark, tmp_path):
    docs, _, _ = write(spark, tmp_path)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_the_entry_point_without_these_operators(tmp_path):
    for part in ("__spark_entry__.py", "tallyforge"):
        subprocess.run(["cp", "-r", str(REPO / part), str(tmp_path)], check=True)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"]
    apart = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # a path to this repository would bring the missing parts back
    run = lambda: subprocess.run(ask, cwd=tmp_path, env=apart, capture_output=True, text=True, check=True).stdout.split()
    assert run()[1:] == ["True", "False", "True"]
    subprocess.run(["rm", "-r", str(tmp_path / "tallyforge/llm")], check=True)
    assert run()[1:] == ["False", "False", "True"]


def test_queries_are_registered_once_an_operator():
    from tallyforge.llm.queries import ORACLES, QUERIES

    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_queries_agree_with_their_sql(spark):
    import duckdb

    from tallyforge.llm.queries import ORACLES, QUERIES

    data, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in ORACLES.items():
        ours, theirs = QUERIES[name](spark, data).toPandas(), db.execute(sql).df()
        order = sorted(ours.columns)
        assert order == sorted(theirs.columns)
        rows = lambda f: sorted(f[order].astype(object).where(f[order].notna(), None).itertuples(index=False, name=None), key=repr)
        assert rows(ours) == rows(theirs), name
