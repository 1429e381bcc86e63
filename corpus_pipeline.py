"""A training corpus from ``documents``: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes that as Parquet to the shared folder and reads it as the next
stage's docs. All but the last return the columns of docs, unchanged whatever they are called: a stage gives columns that it does not read
a name of its own meanwhile. Null, empty and very long texts, repeated rows and ids, ties and empty tables have the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontamination, language_id, mixing, simhash, token_output
from tallymark.llm.common import clean, lean, materialize, with_key, written
from tallymark.llm.queries import read_table, tokenizer


def aside(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but those that are ``read`` renamed by its place, and the columns that undo it."""
    names = [c if c in read else f"column_{i}_of_docs" for i, c in enumerate(docs.columns)]
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns, strict=True)]), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from their own labels.

    A text that is null, empty or without a letter goes, and all go if no row with a text has a label to learn from. Repeated rows are judged alike."""
    lean(spark)
    rows, back = aside(docs, "text")
    found = language_id.identify(rows, language_id.train(docs.select("doc_id", "text", "lang")))
    return found.where("lang_pred <> 'und'").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, or any one where ids are missing or repeat.

    Texts without words are copies of each other."""
    lean(spark)
    rows, back = aside(docs, "doc_id", "text")
    rows = with_key(rows, key="key")
    found = simhash.near_duplicates(rows, doc_id="key")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return rows.join(keep.hint("shuffle_hash"), "key", "left_semi").select(*back)  # texts are streamed past the keys, not sorted


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, unchanged; those without words stay, and all do if the benchmark is empty. Repeated rows are judged alike."""
    rows, back = aside(docs, "text")
    return decontamination.judge(rows, read_table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice; a null source is a source, and of equal rows any may be the ones taken."""
    lean(spark)
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, read back: doc_id, start, n_tokens, ids_crc32 of every row. A null or empty text has the end id alone; equal ids are told apart by row, null ids come first."""
    lean(spark)
    return token_output.token_output(docs, tokenizer())


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("source_mixing", mix), ("token_output", tokens)]

#: language ID and fingerprints have no SQL; tests/llm hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = len(written)
        docs = materialize(stage(spark, docs, sf_dir), name)
        clean(spark, before, keep=1)  # the stage's result stands; what it was made of goes
    return docs
