"""The queries op1 to op10 and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, ship_package
from . import byte_cnn, host_rules, huffman, min_max, multi_index, packing, pieces, url_rules, warc
from .shards import ShardStore

#: Fixed by op10's contract: (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; the file is on every machine, as the libraries are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_huffman_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "tokens")
    huffman.write_tokens(docs, path, tokenizer("word_bpe_49k.json"), end_id=2)
    return huffman.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_cnn.quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), threshold=0.7)


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return host_rules.judge(docs).select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer("piece_bpe_32k.model")
    drawn = pieces.sample(docs, model, k=3).withColumn("n_pieces", F.size("ids").cast("long")).withColumn("ids_hash", F.xxhash64("ids"))
    spelt = pieces.decode(drawn, model)
    return spelt.select("doc_id", "sample", "n_pieces", "ids_hash", "log_prob", "perturbed", "inclusion", (F.xxhash64("decoded") == F.col("text_hash")).alias("decodes"))


def op7_min_max_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return min_max.near_duplicates(docs, size=2, percent=80)


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "shards"), target_bytes=64 << 20, fan_in=4)
    store.append(docs, arrival=F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    store.compact()
    return store.read(schema=docs.schema).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_huffman_token_file, op3_byte_cnn_quality, op4_host_quality_rules, op5_warc_archive, op6_gumbel_segmentations, op7_min_max_near_duplicates, op8_inverted_multi_index, op9_size_tiered_shards, op10_url_rules)
}

SQL = {
    "op4_host_quality_rules": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs),
tri AS (SELECT doc_id, i, word, lead(word) OVER d AS w2, lead(word, 2) OVER d AS w3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS k FROM tri WHERE w3 IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, i + j AS i FROM rep, (VALUES (0), (1), (2)) v(j) WHERE k >= 2),
hits AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, source, CAST(coalesce(wc.n, 0) AS BIGINT) AS n_words, CAST(coalesce(wc.chars, 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN wc USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN hits USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS mean, var_pop(failed / n) AS v, avg(1 / n) AS chance FROM hosts),
s AS (SELECT mean, v - mean * (1 - mean) * chance AS spread FROM m),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce((failed + mean * weight) / (n + weight), 0) <= 0.5 AS kept
FROM judged LEFT JOIN hosts USING (source) CROSS JOIN p""",
    "op5_warc_archive": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)""",
    "op9_size_tiered_shards": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op10_url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
        FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN hit ON h.page_id = hit.page_id""",
}
