"""The queries of this subpackage: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, byte_bpe, chat, conversation_repair, fingerprint, html_extract, language, ngram_join, packing, periodic_runs, quality, warc, word_table
from .common import table
from .folds import held_out


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.train()).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(tokens)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return byte_bpe.decode(ids, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    whole = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text"), language.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        F.col("conversation").alias("conv_id"), "speaker", "n_turns", "n_own", "trained_chars", F.char_length("rendered").cast("long").alias("n_chars"), "rendered", spans.alias("mask_spans")
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op11_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = word_table.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, packed=True)
    digest = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return word_table.decode(digest, word_table.pieces(spark, path)).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    out = periodic_runs.periodic_runs(docs, key="h", words=periodic_runs.planted).withColumn("best", periodic_runs.best())
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")), there="there")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_nearest": op9_nearest,
    "op10_fingerprint": op10_fingerprint,
    "op11_word_table_bpe": op11_word_table_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

#: CRC-32 of a text of ASCII characters, by the table of its 256 bytes.
_STEP = "list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, b: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op13_conversation_repair": f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {_STEP} AS v FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
r1 AS (SELECT conv_id, turn, role, text, {_CRC.format('key')} % 20 AS h FROM r0, crc),
r2 AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM r1 WHERE h <> 0),
r3 AS (
  SELECT *, rtrim(text, {_WHITE}) AS ended, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || substr(role, 1, 1) AS pair
  FROM r2),
r4 AS (SELECT *, ended = '' AS blank, ended <> '' AND seen AS dup, ended <> '' AND NOT seen AND right(ended, 1) NOT IN ('.', '!', '?') AS cut FROM r3),
k AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM r4 GROUP BY conv_id),
-- states: 0 nothing, 1 after a system turn, 2 after a user, 3 after an assistant; turns that can be put in between two states
go AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(a, i, b)),
ins AS (
  SELECT a, b, 5 AS cost, 'I' AS audit, [CASE i WHEN 'u' THEN 'user:' ELSE 'assistant:' END] AS said FROM go WHERE i <> 's'
  UNION ALL SELECT x.a, y.b, 10, 'II', ['user:', 'assistant:'] FROM go x JOIN go y ON x.b = y.a WHERE x.i = 'u' AND y.i = 'a' AND x.a <> y.b
  UNION ALL SELECT s, s, 0, '', [] FROM (VALUES (0), (1), (2), (3)) t(s)),
p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS rn, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM k
  UNION ALL
  SELECT conv_id, rn, st, best.cost, best.audit, best.said FROM (
    SELECT conv_id, rn, st, min({{'cost': cost, 'audit': audit, 'said': said}}) AS best FROM (
      SELECT r.conv_id, r.rn, w.st, CAST(p.cost + n.cost + w.cost AS BIGINT) AS cost, p.audit || n.audit || w.edit AS audit, list_concat(list_concat(p.said, n.said), w.said) AS said
      FROM p JOIN r4 r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.rn = p.rn + 1 JOIN ins n ON n.a = p.st,
      LATERAL (
        SELECT n.b AS st, 2 AS cost, 'D' AS edit, CAST([] AS VARCHAR[]) AS said
        UNION ALL SELECT b, CASE WHEN r.cut THEN 5 ELSE 0 END, 'K', [r.role || ':' || r.text] FROM go WHERE a = n.b AND i = substr(r.role, 1, 1) AND NOT r.blank AND NOT r.dup
        UNION ALL SELECT b, CASE WHEN r.cut THEN 6 ELSE 1 END, 'R', [CASE i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] FROM go WHERE a = n.b AND i <> 's' AND NOT r.blank AND NOT r.dup) w)
    GROUP BY conv_id, rn, st)),
f AS (
  SELECT k.conv_id, min({{'cost': p.cost + n.cost, 'audit': p.audit || n.audit, 'said': list_concat(p.said, n.said)}}) AS best
  FROM k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.rn = k.n JOIN ins n ON n.a = p.st AND n.b IN (0, 3) GROUP BY k.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op4_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM m
""",
    "op8_chat_formatting": """
WITH c AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
m AS (
  SELECT conv_id, alone, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS rn
  FROM c),
s AS (SELECT DISTINCT conv_id, alone, role AS speaker FROM m WHERE role <> 'system'),
r AS (
  SELECT s.conv_id, s.alone, s.speaker, m.rn, m.role = s.speaker AS own,
         '<|im_start|>' || CASE WHEN m.role = s.speaker THEN 'assistant' WHEN m.role = 'system' THEN 'system' ELSE 'user name=' || replace(replace(replace(replace(m.role, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), '<|', '<\\|') END || chr(10) AS head,
         regexp_replace(m.body, '<(\\\\*)\\|', '<\\1\\\\|', 'g') || '<|im_end|>' AS body
  FROM s JOIN m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.alone IS NOT DISTINCT FROM s.alone),
p AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, alone, speaker ORDER BY rn) - length(body) - 1 AS a,
         sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, alone, speaker ORDER BY rn) - 1 AS b
  FROM r)
SELECT conv_id, speaker, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
       CAST(sum(CASE WHEN own THEN b - a ELSE 0 END) AS BIGINT) AS trained_chars,
       CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
       string_agg(head || body || chr(10), '' ORDER BY rn) AS rendered,
       string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b AS BIGINT) AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE own) AS mask_spans
FROM p GROUP BY conv_id, alone, speaker
""",
}
