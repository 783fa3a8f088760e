"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkcatalog.llm import ann, chat, decontam, html, katz, langid, mix, pii, simhash, warc
from chunkcatalog.llm.common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages")))
    return found.select("record_id", "url_key", "target_id", "outcome", warc.header_text(F.col("headers")).alias("headers"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz.score(table(spark, sf_dir, "documents"), held_out)


def op4_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = F.col("id") == 0
    fields = {"conv_id": F.lit(-1), "turn": F.col("id"), "role": F.when(first, "user").otherwise("assistant"), "text": F.lit("</s>[INST] ok [/INST]")}
    planted = spark.range(2).select(*(x.cast(turns.schema[name].dataType).alias(name) for name, x in fields.items()))
    return chat.digests(chat.format_chats(turns.unionByName(planted)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.predict(docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_mix_sources": op2_mix_sources,
    "op3_katz": op3_katz,
    "op4_pii_sanitise": op4_pii_sanitise,
    "op5_chat_format": op5_chat_format,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_permutation_index": op8_permutation_index,
    "op9_language_id": op9_language_id,
    "op10_html_text": op10_html_text,
}

_OP1_SQL = r"""
WITH url_parts AS (
  SELECT page_id, html, v.kind, regexp_replace(regexp_replace(v.u, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages, LATERAL (VALUES ('response', url), ('revisit', url || CASE WHEN page_id % 11 = 0 THEN '/never' ELSE '#top' END)) AS v(kind, u)
), keyed AS (
  SELECT page_id, html, kind,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[0-9]*\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)='))), '&') AS query
  FROM url_parts
), records AS (
  SELECT page_id, html, kind, base || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key,
    page_id * 60 + CASE WHEN kind = 'revisit' THEN page_id * 7919 % 100000 * 60 + 30 ELSE 0 END AS ts,
    '"' || substr(md5(html), 1, 16) || '"' AS tag,
    CASE WHEN page_id % 3 <> 0 THEN 'day ' || CAST(page_id // 1000 AS VARCHAR) END AS dated
  FROM keyed
), joined AS (
  SELECT r.page_id, r.url_key, r.ts, p.page_id AS pid, length(p.html) AS size,
    CASE WHEN r.page_id % 5 = 0 THEN '"stale"' = p.tag WHEN r.page_id % 5 <> 1 THEN r.tag = p.tag ELSE r.dated = p.dated END AS checked
  FROM (SELECT * FROM records WHERE kind = 'revisit') r
  ASOF LEFT JOIN (SELECT * FROM records WHERE kind = 'response') p ON r.url_key = p.url_key AND r.ts > p.ts
), judged AS (
  SELECT *, CASE WHEN pid IS NULL THEN 'orphan' WHEN checked IS NULL THEN 'unverified' WHEN checked THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM joined
)
SELECT page_id * 2 + 1 AS record_id, url_key, pid * 2 AS target_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=' || CAST(page_id % 600 AS VARCHAR) || chr(10) || 'content-length: ' || CAST(size AS VARCHAR)
    || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || CAST(ts AS VARCHAR) || chr(10) || 'server: s' || CAST(pid % 7 AS VARCHAR) END AS headers
FROM judged
"""

_OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source
), caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights FROM sources
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (weights - coalesce(sum(weight) OVER before, 0)) AS level FROM caps
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, CASE WHEN top IS NULL OR ratio <= top THEN cap ELSE weight * top END AS target
  FROM (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS top FROM levels)
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized
)
SELECT doc_id, size, source_size, target,
  CAST(least(start + size, floor(target)) - least(start, floor(target)) + least(start + source_size + size, floor(target)) - least(start + source_size, floor(target)) AS BIGINT) AS taken
FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
"""

_OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), marked AS (
  SELECT *, regexp_matches(role || chr(1) || text, '<s>|</s>|\[INST\]|\[/INST\]|[<\[]\\+/?(s>|INST\])') AS conflict,
    regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS role2, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS text2
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(22) + CASE WHEN bool_or(conflict) THEN sum(length(role2) + length(text2)) ELSE sum(length(role) + length(text)) END AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, ws, len(ws) AS size, least(5, len(ws)) AS k
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0
), dg AS (
  SELECT doc_id, n, k, p, array_to_string(ws[p + 1:p + k], ' ') AS g FROM (SELECT doc_id, ws, len(ws) AS n, k, unnest(range(0, len(ws) - k + 1)) AS p FROM w, (SELECT DISTINCT k FROM i))
), ic AS (
  SELECT item_id, size, k, g, count(*) AS c FROM (SELECT item_id, size, k, array_to_string(ws[p + 1:p + k], ' ') AS g FROM (SELECT *, unnest(range(0, size - k + 1)) AS p FROM i)) GROUP BY ALL
), starts AS (
  SELECT DISTINCT doc_id, item_id, n, size, dg.k, greatest(least(p, n - size), 0) AS start FROM dg JOIN ic ON dg.k = ic.k AND dg.g = ic.g
), windows AS (
  SELECT s.doc_id, s.item_id, s.n, s.size, s.k, s.start, g, count(*) AS c FROM starts s JOIN dg ON dg.doc_id = s.doc_id AND dg.k = s.k AND p BETWEEN s.start AND s.start + s.size - s.k GROUP BY ALL
), shared AS (
  SELECT doc_id, v.item_id, v.size - v.k + 1 AS a, least(v.size, n - start) - v.k + 1 AS b, start, sum(least(v.c, ic.c)) AS common
  FROM windows v JOIN ic ON ic.item_id = v.item_id AND ic.g = v.g GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, CAST(common AS DOUBLE) / CAST(a + b - common AS DOUBLE) AS similarity FROM shared
)
SELECT doc_id, item_id, arg_max(start, (similarity, -start)) AS start, max(similarity) AS similarity FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""

#: SQL has no XXH64 and no components (6), trains no model (3, 9), searches by no index (8) and parses no HTML (10); the terms of 4
#: depend on patterns' places, which it does not give. tests/llm holds those against brute force.
ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": _OP1_SQL, "op2_mix_sources": _OP2_SQL, "op5_chat_format": _OP5_SQL, "op7_decontaminate": _OP7_SQL}
