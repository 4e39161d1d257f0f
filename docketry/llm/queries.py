"""The operators' queries with production parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, decontam, langid, line_dedup, minhash, oracles, quality, secret_scan, simhash, spelling, tokenfile, toxicity, warc, whitening
from docketry.llm.common import read_table

END_ID = 2


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejected depends on the order that the sample gave; the verdict doesn't
    return quality.judge(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_predict(read_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.match(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), with_matches=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, digest=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, added_tokens=True)
    return tokenfile.read(spark, files)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_toxicity, op4_secrets, op5_langid, op6_minhash, op7_decontam, op8_bpe, op9_warc, op10_token_ids, op11_spelling, op12_simhash, op13_whitening)}

#: The other operators are compared with brute force, exact round trips or held-out labels in tests/llm.
ORACLE_SQL = {"op1_line_dedup": oracles.LINE_DEDUP, "op2_quality": oracles.QUALITY, "op6_minhash": oracles.NEAR_DUPLICATES, "op7_decontam": oracles.CONTAMINATION, "op9_warc": oracles.WARC, "op11_spelling": oracles.SPELLING}
