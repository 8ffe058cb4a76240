"""The registered queries of this package: thin uses of its operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest_neighbours
from .bpe_codec import round_trip
from .common import read_table
from .exact_dedup import exact_dedup
from .importance import importance_resample
from .license_scan import scan_licenses
from .ngram_lm import held_out_scores
from .packing import pack_documents
from .quality import quality_scores
from .repair import token_files
from .simhash import simhash_components
from .spelling import spelling_groups
from .toxicity import toxicity_scores
from .warc import archive_round_trip

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


@query("op1_byte_bpe_codec")
def op1_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN)


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          capacity=2048, end_id=0)


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"), least=0.8)


@query("op4_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


@query("op5_quality_discriminant")
def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality", threshold=0.3)


@query("op6_adaptive_ann")
def op6_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op7_kneser_ney_lm")
def op7_kneser_ney_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(read_table(spark, sf_dir, "documents"), order=3, folds=7, held_out_fold=2)


@query("op8_toxicity_ngrams")
def op8_toxicity_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "toxic", threshold=0.5)


@query("op9_repair_token_files")
def op9_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


#: DuckDB has no crc32: a table of the 256 bytes' remainders, and a fold over a string's bytes.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
        FROM range(256) bytes(i)))"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_transform(range(0, octet_length(encode({text}))),
            lambda k: CAST('0x' || hex(encode({text}))[2 * k + 1:2 * k + 2] AS BIGINT)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op11_spelling_variants", f"""
    WITH RECURSIVE {_CRC_TABLE},
    runs AS (SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), {_LOWER}) AS run FROM documents)
        WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (SELECT run, times, {_crc32("concat(doc_id, ':', run)")} AS h FROM runs, crc),
    v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
        FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
    gone AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM gone a JOIN v b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM gone a JOIN v b ON a.rest = b.word),
    ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near),
    forms AS MATERIALIZED (SELECT v.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
        CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM v LEFT JOIN ranked r ON v.word = r.word AND place = 1),
    roots AS (SELECT word, word AS root FROM forms WHERE form IS NULL
        UNION ALL SELECT f.word, r.root FROM forms f JOIN roots r ON f.form = r.word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents"), least_length=7, least_count=2, one_in=31, ratio=10)


def _features(table: str, key: str) -> str:
    """One row (key, feature) for each run of one to three words."""
    words = rf"regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT key, array_to_string(w[i:i + {k - 1}], ' ') AS feature FROM (SELECT key, w, unnest(range(1, len(w) + {2 - k})) AS i FROM w)"
                              for k in (1, 2, 3))
    return f"(WITH w AS (SELECT {key} AS key, {words} AS w FROM {table}) {runs})"


@query("op12_importance_resampling", f"""
    WITH {_CRC_TABLE},
    docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
    ours AS MATERIALIZED (SELECT key, {_crc32("feature")} % 10000 AS bucket FROM {_features("docs", "row")}, crc),
    theirs AS (SELECT {_crc32("feature")} % 10000 AS bucket FROM {_features("benchmark", "item_id")}, crc),
    s AS (SELECT bucket, count(*) AS s FROM ours GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM theirs GROUP BY bucket),
    gains AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM ours) + 10000)::DOUBLE)
        / ((s + 1)::DOUBLE * ((SELECT count(*) FROM theirs) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
    weights AS (SELECT key, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM ours JOIN gains USING (bucket) GROUP BY key),
    scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(
        -1000 * ln(-ln((CAST('0x' || left(sha256(concat('42:', doc_id)), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM docs LEFT JOIN weights ON row = key),
    -- m words make 3 m - 3 features if they are three or more
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 57 ORDER BY score DESC, doc_id) AS place,
        count(*) OVER (PARTITION BY n_features >= 57) AS size FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 57 AND place <= 5 * size // 100 THEN place END AS rank FROM placed""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), order=3, buckets=10_000,
                               seed=42, least_words=20, share=(5, 100)).drop("n_words")


@query("op13_warc_revisits", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
    q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS original FROM p)
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < original THEN original END AS refers_to FROM q""")
def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"), least_bytes=1000)
