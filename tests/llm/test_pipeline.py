"""The stages by hand on a small table, and every stage on an empty one."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark, tmp_path):
    rnd = random.Random(3)
    words = ["thing", "whand", "erthe", "onthe", "ingth", "thest", "andth", "reion"]
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    item = text(30)
    texts = [text(60) for _ in range(40)]
    texts += [texts[0], texts[1], None, "12 34", item + " " + text(10)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(seen[name], docs.schema)
    ids = lambda name: sorted(r[0] for r in seen[name])
    assert ids("language_id") == [i for i in range(45) if i not in (42, 43)]
    assert ids("simhash_near_dedup") == [*range(40), 44]
    assert ids("benchmark_decontamination") == list(range(40))
    assert set(ids("source_mixing")) <= set(range(40)) and 1.4 * 2400 < 60 * len(ids("source_mixing")) < 1.6 * 2400
    assert ids("token_output") == ids("source_mixing")
    before = len(corpus_pipeline.written)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids("token_output"))
    assert len(corpus_pipeline.written) == before + len(corpus_pipeline.STAGES)  # results only


@pytest.fixture()
def bench_dir(spark, tmp_path):
    spark.createDataFrame([(1, "item " * 3 + " ".join(f"z{i}" for i in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_empty(spark, bench_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, bench_dir).count() == 0, name


def test_odd_rows_and_clashing_columns(spark, bench_dir):
    """Nulls everywhere, an empty and a very long text, repeated rows and ids, and columns named as the stages name their own."""
    long = "thing and where " * 100_000
    rows = [(1, "the thing where", "en", "a"), (1, "the thing where", "en", "a"), (1, "other words here now", None, None), (None, None, None, None), (2, "", "en", "b"),
        (3, long, "en", "b"), (None, "der hund und die katze", "de", "a"), (None, "der hund und die katze", "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["size", "n_words", "score", "lang_pred", "spans", "items", "n_hit", "contaminated", "rate", "target", "taken", "_key", "_copy", "key", "b", "bound", "whole", "component_id", "fp", "column_0_of_docs", "h"]
    for i, name in enumerate(clash):
        docs = docs.withColumn(name, F.lit(f"own {i}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, bench_dir)
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert got and all(r[4:] == tuple(f"own {i}" for i in range(len(clash))) for r in got) and {r[:4] for r in got} <= set(rows), name
        if name == "language_id":
            assert sorted(str(r[:4]) for r in got) == sorted(str(r) for r in rows if r[1])
        if name == "simhash_near_dedup":
            assert sorted((r[1] or "") for r in got) == sorted({r[1] or "" for r in rows})
        if name == "benchmark_decontamination":
            assert sorted(str(r[:4]) for r in got) == sorted(map(str, rows))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, bench_dir).count() == len(rows)
