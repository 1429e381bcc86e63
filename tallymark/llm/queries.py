"""The registered queries of this package, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, class_lm, decontamination, embedding_dedup, language_id, mixing, simhash, substring_dedup, token_counts, token_output
from .common import lean
from .common import read_table as whole_table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return whole_table(lean(spark), sf_dir, name)


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.judge(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: the one tool that op6 knows: a reply to a prompt
REPLY = {
    "reply": {
        "required": ["prompt", "options"],
        "properties": {
            "prompt": "string", "n": "integer", "after": "string",
            "options": {"type": "object", "required": ["lang"], "properties": {"lang": {"type": "string", "enum": ["de", "en"]}, "tags": {"type": "array", "items": "string"}}},
        },
    }
}


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has prompts and replies but no tool calls, so each user turn is put as a call and each assistant turn as a result.

    By conversation and turn, calls refer to the next call (every other one), to each other in rings, name an unknown tool, give a number as
    text, leave out a required field, hold a value outside an enumeration or an item of the wrong type; results answer the call before, one that has
    its answer already, or one that is still to come.
    """
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    number = lambda c: F.col(c).cast("string")
    second = (F.expr("turn div 2") % 2 == 1)
    after = F.when(~second, (F.col("turn") + 2).cast("string")).when(F.col("conv_id") % 7 == 3, (F.col("turn") - 2).cast("string"))
    options = F.when(F.col("conv_id") % 6 == 2, '{"lang":"xx"}').when(F.col("conv_id") % 6 == 3, "{}").when(F.col("conv_id") % 6 == 4, '{"tags":["b",1],"lang":"de"}').otherwise('{"tags":["b"],"lang":"de"}')
    n = F.when(F.col("conv_id") % 5 == 1, F.concat(F.lit('"'), number("turn"), F.lit('"'))).otherwise(number("turn"))
    prompt = chat_format.quoted(F.concat(F.when(F.col("text").startswith("$"), "$").otherwise(""), F.col("text")))
    call = F.concat(
        F.lit('{"tool_calls":[{"id":"'), number("turn"), F.when(F.col("conv_id") % 8 == 5, '","name":"other"').otherwise('","name":"reply"'), F.lit(',"arguments":{"prompt":'), prompt,
        F.lit(',"n":'), n, F.coalesce(F.concat(F.lit(',"after":"$'), after, F.lit('"')), F.lit("")), F.lit(',"options":'), options, F.lit("}}]}"),
    )
    answers = F.when(F.col("conv_id") % 9 == 4, F.col("turn") + 1).when((F.col("conv_id") % 4 == 1) & (F.expr("(turn + 1) div 2") % 2 == 0), F.col("turn") - 3).otherwise(F.col("turn") - 1)
    result = F.to_json(F.struct(answers.cast("string").alias("tool_call_id"), F.col("text").alias("content")))
    put = rows.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"),
    )
    out = chat_format.link_tool_calls(put, REPLY, typed=True)
    ord_of = lambda c: F.col(f"ord.{c}").cast("long").alias(f"ord_{c}")
    return out.select("conv_id", "turn", "kind", "call_id", "linked", F.coalesce("valid", F.lit(False)).alias("valid"), ord_of("at"), ord_of("depth"), ord_of("result"), "json")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read_table(spark, sf_dir, "documents"), tokenizer())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_mixing, op3_substring_dedup, op4_class_lm, op5_decontamination, op6_chat_format, op7_language_id, op8_token_output, op9_simhash, op10_embedding_dedup, pipeline]
    return {f.__name__: f for f in found}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: windows are lists here, so equal means equal words
OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 34) AS x FROM starts),
again AS (SELECT md5(array_to_string(x, ' ')) AS h FROM windows GROUP BY 1 HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows SEMI JOIN again ON md5(array_to_string(x, ' ')) = h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hits),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {FOLDED} AS w FROM benchmark),
iw AS (
  SELECT item, 13 AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS x FROM (SELECT item, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)
  UNION ALL SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
sizes AS (SELECT DISTINCT n FROM iw),
pos AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM pos),
hits AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN iw USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: a call needs the next one (every other call does), or both need each other
OP6 = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (SELECT DISTINCT conv_id, turn FROM c WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
results AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN conv_id % 9 = 4 THEN turn + 1 WHEN conv_id % 4 = 1 AND (turn + 1) // 2 % 2 = 0 THEN turn - 3 ELSE turn - 1 END AS id
  FROM c WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
answered AS (SELECT r.conv_id, r.id, min(r.turn) AS answer FROM results r JOIN calls k ON k.conv_id = r.conv_id AND k.turn = r.id WHERE r.turn > k.turn GROUP BY ALL),
ranked AS (
  SELECT k.conv_id, k.turn, conv_id % 7 = 3 AND (k.turn // 2 % 2 = 0 AND EXISTS (FROM calls n WHERE n.conv_id = k.conv_id AND n.turn = k.turn + 2) OR k.turn // 2 % 2 = 1 AND EXISTS (FROM calls n WHERE n.conv_id = k.conv_id AND n.turn = k.turn - 2)) AS ring,
    conv_id % 7 <> 3 AND k.turn // 2 % 2 = 0 AND EXISTS (FROM calls n WHERE n.conv_id = k.conv_id AND n.turn = k.turn + 2) AS waits FROM calls k),
j AS (
  SELECT c.*, CASE role WHEN 'user' THEN c.turn WHEN 'assistant' THEN CASE WHEN conv_id % 9 = 4 THEN turn + 1 WHEN conv_id % 4 = 1 AND (turn + 1) // 2 % 2 = 0 THEN turn - 3 ELSE turn - 1 END END AS id FROM c),
l AS (
  SELECT j.*, k.turn AS k_turn, k.ring, k.waits, coalesce(role = 'user' AND a.answer IS NOT NULL OR role = 'assistant' AND a.answer = j.turn, false) AS linked
  FROM j LEFT JOIN ranked k ON k.conv_id = j.conv_id AND k.turn = j.id LEFT JOIN answered a ON a.conv_id = j.conv_id AND a.id = j.id)
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, id::VARCHAR AS call_id, linked,
  coalesce(role = 'user' AND NOT coalesce(ring, false) AND NOT coalesce(conv_id % 8 = 5 OR conv_id % 5 = 1 OR conv_id % 6 IN (2, 3, 4), false), false) AS valid,
  CASE WHEN linked OR (role = 'user' AND k_turn IS NOT NULL) THEN CASE WHEN waits THEN k_turn + 2 ELSE k_turn END ELSE turn END AS ord_at,
  CASE WHEN waits THEN 1 ELSE 0 END::BIGINT AS ord_depth, CASE role WHEN 'assistant' THEN 1 ELSE 0 END::BIGINT AS ord_result,
  CASE role WHEN 'user' THEN '{"arguments":{'
      || CASE WHEN turn // 2 % 2 = 0 THEN '"after":"$' || (turn + 2) || '",' WHEN conv_id % 7 = 3 THEN '"after":"$' || (turn - 2) || '",' ELSE '' END
      || '"n":' || CASE WHEN conv_id % 5 = 1 THEN '"' || turn || '"' ELSE turn::VARCHAR END
      || ',"options":' || CASE conv_id % 6 WHEN 2 THEN '{"lang":"xx"}' WHEN 3 THEN '{}' WHEN 4 THEN '{"lang":"de","tags":["b",1]}' ELSE '{"lang":"de","tags":["b"]}' END
      || ',"prompt":' || to_json(CASE WHEN text LIKE '$%' THEN '$' || text ELSE text END) || '},"id":"' || turn || '","name":"' || CASE WHEN conv_id % 8 = 5 THEN 'other' ELSE 'reply' END || '","role":"assistant"}'
    WHEN 'assistant' THEN '{"content":' || to_json(text) || ',"id":"' || id || '","role":"tool"}'
    ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
FROM l
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT DISTINCT a, a AS c FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a),
least AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN least ON a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """The others use a tokenizer, a trained model, an iterative solution or a seeded hash that SQL lacks; tests hold them against brute force."""
    return {"op3_substring_dedup": OP3, "op5_decontamination": OP5, "op6_chat_format": OP6, "op10_embedding_dedup": OP10}
