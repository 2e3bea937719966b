"""One query for each operator, over its whole table with production parameters, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, exact, html, language, lm, simhash, sst, token_counts, toxicity

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "token_ids")
    shards = sst.write(common.table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), folder, END_ID)
    return sst.read(spark, folder, shards).drop("end_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model, beta = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, beta, keep=["doc_id"]).select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), keep=["doc_id"], with_ids=False)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    names, probabilities = language.fit(docs, vocabulary(PIECES), common.fold("doc_id", 4) != 2)
    return language.predict(docs, vocabulary(PIECES), names, probabilities, keep=["doc_id"]).select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(common.table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(common.table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(common.table(spark, sf_dir, "documents"), vocabulary(PIECES), keep=["doc_id"])


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scores = lm.scored(docs, vocabulary(TOKENIZER), common.fold("doc_id", 10) != 0)
    return scores.select("doc_id", (common.fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "group_size")


QUERIES = {f.__name__: f for f in (op1_token_id_output, op2_decontaminate, op3_toxicity, op4_bpe, op5_language, op6_exact_dedup, op7_html_text, op8_token_counts, op9_lm_score, op10_simhash)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_FOLDED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, item, grams.k AS k, i FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r""",
}
