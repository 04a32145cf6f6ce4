"""One query opN_<name> for each operator, over its whole table; SQL where DuckDB can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, warc
from .common import cut, ship
from .decontaminate import find_leaks
from .jaccard import jaccard_components
from .language_id import identify
from .lm_mixing import score_texts
from .packing import pack
from .quality import fit as fit_ratio
from .quality import resample, target_sample
from .toxicity import score_toxicity
from .webp import store_texts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keep what is at most e**2 times likelier as raw text than as target text: junk lies far below, short clean texts lie around 0.
QUALITY_CUTOFF = -2.0


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ratio = fit_ratio(docs, cut(target_sample(read(spark, sf_dir, "labels"))))
    return resample(docs, ratio, cutoff=QUALITY_CUTOFF)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), width=4, percent=85)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(read(spark, sf_dir, "pages"))).drop("headers", "status")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_records(chat.records_of(rows.unionByName(extra))))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_importance_resampling, op2_best_fit_packing, op3_lossless_webp, op4_jaccard_join, op5_warc_derivatives, op6_chat_format, op7_context_mixing, op8_toxicity, op9_template_leaks, op10_language_id)}

def _sql_uuid(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    return "concat('<urn:uuid:', " + ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ", '>')"


def _sql_decode(text: str) -> str:
    for old, new in warc.ENTITIES:
        text = f"replace({text}, '{old}', {'chr(34)' if new == chr(34) else 'chr(39)' if new == chr(39) else repr(new)})"
    return text


def _sql_plain(text: str) -> str:
    sub = lambda t, pattern, to: f"regexp_replace({t}, '{pattern}', {to}, 'g')"
    for name in warc.DROPPED:
        text = sub(text, f"(?is)<{name}(?:\\s[^>]*)?>.*?</{name}\\s*>", "' '")
    text = sub(text, "(?s)<!--.*?-->", "' '")
    text = sub(text, f"(?i)</?(?:{warc.BLOCKS})(?:\\s[^>]*)?/?>", "chr(10)")
    text = sub(_sql_decode(sub(text, "<[^>]*>", "''")), "[ \\t\\r\\f]+", "' '")
    return sub(sub(text, " ?\\n[ \\n]*", "chr(10)"), "^[ \\n]+|[ \\n]+$", "''")


def _warc_sql() -> str:
    title = "regexp_replace(" + _sql_decode("regexp_replace(regexp_extract(payload, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g')"
    line = lambda name, value: f"'{name}: ', {value}, chr(13), chr(10)"
    block = "concat(" + ", ".join([line("source-status", "'HTTP/1.1 200 OK'"), line("source-content-type", "'text/html; charset=utf-8'"), line("source-content-length", "strlen(payload)"), line("source-payload-digest", "payload_digest"), line("source-length", "strlen(payload)"), line("title", title), line("outlinks", "len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href'))"), line("conversion-id", "conversion")]) + ")"
    return f"""
    WITH r AS (SELECT page_id, {_sql_uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS record_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
    s AS (SELECT *, concat('sha256:', sha256(payload)) AS payload_digest, {_sql_uuid("'conversion'", "record_id", "target_uri")} AS conversion, {_sql_uuid("'metadata'", "record_id", "target_uri")} AS metadata FROM r),
    b AS (SELECT *, 'metadata' AS warc_type, metadata AS derived_id, 'application/warc-fields' AS content_type, {block} AS block FROM s
          UNION ALL SELECT *, 'conversion', conversion, 'text/plain; charset=utf-8', {_sql_plain("payload")} FROM s)
    SELECT page_id, record_id, target_uri, '2024-01-01T00:00:00Z' AS date, payload_digest, warc_type, derived_id, content_type, block, record_id AS refers_to, concat('sha256:', sha256(block)) AS block_digest, strlen(block) AS content_length FROM b"""


_CONTROL = chat.CONTROL.replace("'", "''")
_CHAT_SQL = f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v),
    d AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + {len(chat.OPEN) + len(chat.CLOSE) + 2} AS chars FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM d GROUP BY conv_id"""

#: For the others no SQL gives the rows: models, tokens, images and connected components; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_warc_derivatives": _warc_sql(), "op6_chat_format": _CHAT_SQL}
