"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slink.llm import (
    bpe_fragments,
    licence_index,
    mixing,
    permutation_index,
    pii_boost,
    quality_mil,
    quality_rules,
    secret_layers,
    simhash_pivots,
    token_alignment,
    token_records,
    toxicity_neighbours,
    whitening,
)
from slink.plans.bindings import table
from slink.plans.registry import query
from slink.sources.shared import new_path


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_mil.score(docs, quality_mil.fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", quality_mil.held_out().alias("held_out"), "score", "predicted")


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_boost.find(docs, pii_boost.fit(docs), ["doc_id"])


_STOP_WORDS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_MEASURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / d",
    "symbols_per_word": "n_symbols / d",
    "shouts_per_word": "n_shouts / d",
    "stop_word_share": "n_stop_words / d",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / d",
}
_FAILED = " OR ".join(f"{_MEASURES[name]} {comparison} {threshold}" for name, comparison, threshold in quality_rules.RULES)

OP3_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
),
m AS (
  SELECT r, doc_id, len(words) AS n_words, greatest(len(words), 1)::DOUBLE AS d,
         length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(array_to_string(words, ''), '[#*$%&|<>]')) AS n_symbols,
         len(regexp_extract_all(array_to_string(words, ''), '!')) AS n_shouts,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP_WORDS}))) AS n_stop_words,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM w
),
g AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
),
marked AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (
  SELECT r, sum(coalesce(least(8, i - before), 8))::BIGINT AS n_repeat_words
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM marked) GROUP BY r
),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN covered USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_FAILED}) AS kept
FROM j
"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draws(table(spark, sf_dir, "documents")).drop("_h")


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_layers.find(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op6_token_records")
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "records")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_records.write(table(spark, sf_dir, "documents"), folder, path, end_id=2)
    return token_records.read_back(spark, folder)


@query("op7_permutation_index")
def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_fragments.encode(table(spark, sf_dir, "documents"), path, ["doc_id"])


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_neighbours.score(docs, toxicity_neighbours.fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", quality_mil.held_out().alias("held_out"), "score", "predicted", "evidence")


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.components(table(spark, sf_dir, "documents"))


@query("op11_licences")
def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licence_index.scan(docs, licence_index.build(docs), ["doc_id"])
    base = F.filter("matches", lambda m: m["exact"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = whitening.fit(vectors)
    rows = whitening.whiten(vectors, found, ["vec_id"])
    shares = [float(e / found.trace) for e in found.eigenvalues] if found else []
    numbered = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return numbered.select(
        "vec_id",
        (F.col("_i") + 1).alias("component"),
        F.lit(found.n if found else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(shares).cast("array<double>"), F.col("_i")).alias("explained"),
        F.lit(found.identity_error if found else 0.0).alias("identity_error"),
    )


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.Alignment(docs, *paths, ["doc_id"]).documents()
