"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import attribution, decontam, maxscore, mixing, ngram, quality, simhash, token_output, toxicity, warc
from trawl.llm.cluster import new_path, table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer_file(), added=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, width=3, seed=42)


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"), least=0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.scores(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), added=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.found_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_simhash": op2_simhash,
    "op3_maxscore": op3_maxscore,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_ngram": op7_ngram,
    "op8_mixing": op8_mixing,
    "op9_attribution": op9_attribution,
    "op10_decontamination": op10_decontamination,
}

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS top FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS digest FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""

#: Water-filling: the first level, in the order of limits, at which the next source stays under its own.
_MIX = r"""
WITH sized AS (SELECT {docs}, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source),
named AS (SELECT source, source_size, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM totals),
ordered AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM named),
final AS (SELECT max(level) FILTER (level * w <= cap) AS level FROM ordered),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM final), 0) * w) AS target FROM named),
rated AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                 CAST('0x' || substr(md5('mix-0-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_maxscore": _OP3,
    "op5_warc": _OP5,
    "op8_mixing": _MIX.format(docs="doc_id, source, text")
    + "SELECT doc_id, size, source_size, target, size * CAST(least(3, floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated",
}
