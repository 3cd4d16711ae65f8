"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import byte_cnn, exact_dedup, line_quality, packing, pieces, simhash, suffix_dedup, token_files, toxic_crf, url_rules
from textveil.llm.common import table
from textveil.llm.labelled import fold

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_cnn.learn(docs, table(spark, sf_dir, "labels"), byte_cnn.learnable())
    return byte_cnn.score_documents(docs, net).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"), window=400)


#: The contract's host rules.
HOST_RULES = (
    url_rules.host_rule("allow", "org", "/"),
    url_rules.host_rule("block", "example.org", "/es/"),
    url_rules.host_rule("block", "example.org", "/en/1"),
    url_rules.host_rule("allow", "com", "/fr/"),
    url_rules.host_rule("block", "com", "/de/"),
)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), HOST_RULES)


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge_documents(table(spark, sf_dir, "documents")).drop("cleaned")


def op9_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = toxic_crf.learn(docs, table(spark, sf_dir, "labels"), toxic_crf.learnable())
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return toxic_crf.score_documents(docs, crf).select("doc_id", held_out, "score", "predicted", "spans")


def op10_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_byte_cnn, op3_exact_dedup, op4_simhash, op5_packing, op6_suffix_dedup, op7_url_rules, op8_line_quality,
        op9_toxic_crf, op10_piece_coding,
    )
}

EXACT_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

URL_SQL = """
WITH s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM s
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' END AS rule,
    CASE
    WHEN regexp_matches(path, '/wp-admin([/?#]|$)') THEN 'administration page'
    WHEN regexp_matches(path, '^/tag/[^/]+/page/[0-9]+') THEN 'tag listing'
    WHEN regexp_matches(path, '^/search([/?#]|$)') THEN 'search results'
    WHEN regexp_matches(path, '/checkout([/?#.]|$)') THEN 'checkout'
    WHEN regexp_matches(path, '/signin([/?#.]|$)') THEN 'sign-in page'
    WHEN regexp_matches(path, '/login([/?#.]|$)') THEN 'login page'
    WHEN regexp_matches(path, '/cart([/?#.]|$)') THEN 'shopping cart'
    WHEN regexp_matches(host, '(^|[.-])casino[.-]') THEN 'casino host'
    WHEN regexp_matches(host, '(^|[.-])betting[.-]') THEN 'betting host'
    WHEN regexp_matches(host, '(^|[.-])porn[.-]') THEN 'adult host'
    WHEN regexp_matches(host, '(^|[.-])xxx([.-]|$)') THEN 'adult label' END AS pattern
  FROM h
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN pattern END AS pattern_rule
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": EXACT_SQL, "op7_url_rules": URL_SQL}
