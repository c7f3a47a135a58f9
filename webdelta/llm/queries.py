"""The thin queries opN_<name> over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from webdelta.llm import bpe, exact_dedup, jpeg, licenses, minhash, mixing, sharding, suffix_dedup, token_files, toxicity
from webdelta.llm.common import documents


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir), 200).drop("spans", "kept")


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(documents(spark, sf_dir))
    return found.select("doc_id", F.size("sentences").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def _licenses_sql() -> str:
    """The same tables, as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(t)}, {quote(name)})" for name, texts in licenses.SENTENCES.items() for t in texts)
    left, steps, names = "'|' || sentences_run || '|'", [], []
    for i, (name, sequence) in enumerate(licenses.RULES):
        run = quote("|" + "||".join(sequence) + "|")
        steps.append(f"s{i} AS (SELECT *, contains({left if i == 0 else f'l{i - 1}'}, {run}) AS r{i}, replace({left if i == 0 else f'l{i - 1}'}, {run}, '#') AS l{i} FROM {'ids' if i == 0 else f's{i - 1}'})")
        names.append(f"CASE WHEN r{i} THEN {quote(name)} END")
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
lines AS (
  SELECT doc_id, k, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '[\n\r]+')) AS s,
         generate_subscripts(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '[\n\r]+'), 1) AS place
  FROM (SELECT *, row_number() OVER () AS k FROM documents)),
plain AS (
  SELECT k, place, regexp_replace(regexp_replace(regexp_replace(
    translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ"“”''‘’`', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0b\x0c]+', ' ', 'g'), '^[ #*/>-]+', ''), '[ .!?;]+$', '') AS s
  FROM lines),
met AS (SELECT k, string_agg(name, '||' ORDER BY place) AS run, count(*) AS n FROM plain JOIN known ON s = sentence GROUP BY k),
ids AS (
  SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(run, '') AS sentences_run
  FROM (SELECT *, row_number() OVER () AS k FROM documents) LEFT JOIN met USING (k)),
{", ".join(steps)}
SELECT doc_id, CAST(n_sentences AS INTEGER) AS n_sentences, replace(sentences_run, '||', ',') AS sentences,
       array_to_string(list_filter([{", ".join(names)}], lambda x, i: x IS NOT NULL AND NOT list_contains([{", ".join(names)}][1:i - 1], x)), ',') AS licenses
FROM s{len(licenses.RULES) - 1}
"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.read_media(jpeg.with_media(documents(spark, sf_dir)))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir), 3, "0.85")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), _tokenizer())


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("text_hash")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), _tokenizer(), end_id=2).drop("ids")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(documents(spark, sf_dir), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_mixing, op2_token_files, op3_suffix_dedup, op4_exact_dedup, op5_toxicity, op6_licenses, op7_media, op8_minhash, op9_bpe, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_licenses": _licenses_sql()}
