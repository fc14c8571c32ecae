"""Registered queries of the operators, with SQL where SQL can state the whole result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import chat, warc
from trialspark.llm.common import shared_dir, table
from trialspark.llm.decontaminate import find_contamination
from trialspark.llm.mixing import mix_sources
from trialspark.llm.phrases import mine_collocations
from trialspark.llm.pii import KINDS, find_pii
from trialspark.llm.quality import quality_fold, score_quality
from trialspark.llm.sharding import kd_shards
from trialspark.llm.simhash import simhash_components
from trialspark.llm.spelling import spelling_forms
from trialspark.llm.substring import remove_repeats
from trialspark.llm.topk import top_k
from trialspark.llm.toxicity import score_toxicity, toxic_fold


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that overlap a benchmark item, one row for each such pair."""
    return find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("version")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), toxic_fold())
    return scored.select("doc_id", toxic_fold().alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A record per page, written to archives in the shared folder and read back from them."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
led AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS least FROM payloads)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM led
"""


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold the marks of another template."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    more = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{marks}'), (-7L, 1L, 'assistant', '{marks}') AS t(conv_id, turn, role, text)")
    return chat.conversation_digests(chat.format_conversations(turns.union(more)))


OP5_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(text, '<(\|+)', '<|', 'g')) AS text_chars,
    length(regexp_replace(role, '<(\|+)', '<|', 'g')) AS role_chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN 8 ELSE 9 + role_chars + 8 + 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = find_pii(table(spark, folder, "documents"))
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), quality_fold())
    return scored.select("doc_id", quality_fold().alias("held_out"), "score", "predicted")


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
WITH listed AS (
  SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings
), parts AS (
  SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS value FROM listed
), usable AS (
  SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(value IS NOT NULL AND isfinite(value))
), whole AS (
  SELECT vec_id, i, CAST(floor(256 * value) AS BIGINT) AS x FROM parts SEMI JOIN usable USING (vec_id)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, CAST(score AS BIGINT) AS score
FROM scored QUALIFY rank <= 5
"""

def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of each language."""
    return mine_collocations(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, range(1, 5) AS t(k) WHERE len(w) >= k) GROUP BY ALL
), whole AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), often AS (
  SELECT lang, k, phrase, n, string_split(phrase, ' ') AS w FROM grams WHERE n >= 30
), cuts AS (
  SELECT lang, k, phrase, n AS a, w, unnest(range(1, k)) AS c FROM often WHERE k > 1
), scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, l.n AS l, r.n AS r, CAST(2000000::HUGEINT * x.a // (l.n + r.n) AS BIGINT) AS score
  FROM cuts x JOIN often l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.c], ' ')
  JOIN often r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.c + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_ AS (
  SELECT lang, n AS longer, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, n, w, k, m, unnest(range(1, k - m + 2)) AS i FROM often, range(2, 4) AS t(m) WHERE m < k)
), held AS (
  SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank,
  s.phrase, s.a, s.l, s.r, whole.n, s.score
FROM lowest s JOIN whole ON whole.lang = s.lang LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
WHERE h.longer IS NULL OR 100 * h.longer < 80 * s.a
QUALIFY rank <= 2000
"""


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    return kd_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP12_SQL = """
WITH steps AS (
  SELECT list(r ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(4)),
    lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r FROM range(16) AS t(i))
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(x), 2), lambda p: [
    instr('0123456789ABCDEF', x[p + 1]) - 1, instr('0123456789ABCDEF', x[p]) - 1]))),
    lambda r, b: xor(r >> 4, steps[(xor(r, b) & 15) + 1])), 4294967295) AS crc
  FROM (SELECT doc_id, lang, source, n_chars, hex(encode(coalesce(text, ''))) AS x FROM documents), steps
), told AS (
  SELECT doc_id, CAST(length(x) // 2 + 1 AS BIGINT) AS size, crc,
    CAST('0x' || substr(md5(concat_ws(':', doc_id, crc)), 1, 10) AS BIGINT) AS h, CAST(n_chars AS DOUBLE) AS x2,
    CAST(CAST('0x' || rpad(hex(encode(substr(lang, 1, 6))), 12, '0') AS BIGINT) AS DOUBLE) AS x0,
    CAST(CAST('0x' || rpad(hex(encode(substr(source, 1, 6))), 12, '0') AS BIGINT) AS DOUBLE) AS x1 FROM summed
), level0 AS (
  SELECT doc_id, size, crc, h, 1 AS node, 0 AS first, 8 AS leaves,
    coalesce(CAST(floor((x0 - min(x0) OVER ()) / (max(x0) OVER () - min(x0) OVER ()) * 1048574) AS BIGINT) + 1, 0) AS c0,
    coalesce(CAST(floor((x1 - min(x1) OVER ()) / (max(x1) OVER () - min(x1) OVER ()) * 1048574) AS BIGINT) + 1, 0) AS c1,
    coalesce(CAST(floor((x2 - min(x2) OVER ()) / (max(x2) OVER () - min(x2) OVER ()) * 1048574) AS BIGINT) + 1, 0) AS c2 FROM told
), cells0 AS (
  SELECT node, max(first) AS first, max(leaves) AS leaves, sum(size) AS bytes, list_max([
    {'w': max(c0) - min(c0), 'i': 0}, {'w': max(c1) - min(c1), 'i': -1}, {'w': max(c2) - min(c2), 'i': -2}]).i AS dim FROM level0 GROUP BY node
), level1 AS (
  SELECT * EXCLUDE (node, first, leaves, bytes, dim, upto), leaves // 2 AS leaves,
    2 * node + CASE WHEN 2 * (bytes // 2 - upto + size) >= size THEN 0 ELSE 1 END AS node,
    first + CASE WHEN 2 * (bytes // 2 - upto + size) >= size THEN 0 ELSE leaves // 2 END AS first
  FROM (SELECT l.*, c.bytes, c.dim, sum(l.size) OVER (PARTITION BY l.node ORDER BY [l.c0, l.c1, l.c2][1 - c.dim], l.h, l.doc_id) AS upto
    FROM level0 l JOIN cells0 c USING (node))
), cells1 AS (
  SELECT node, max(first) AS first, max(leaves) AS leaves, sum(size) AS bytes, list_max([
    {'w': max(c0) - min(c0), 'i': 0}, {'w': max(c1) - min(c1), 'i': -1}, {'w': max(c2) - min(c2), 'i': -2}]).i AS dim FROM level1 GROUP BY node
), level2 AS (
  SELECT * EXCLUDE (node, first, leaves, bytes, dim, upto), leaves // 2 AS leaves,
    2 * node + CASE WHEN 2 * (bytes // 2 - upto + size) >= size THEN 0 ELSE 1 END AS node,
    first + CASE WHEN 2 * (bytes // 2 - upto + size) >= size THEN 0 ELSE leaves // 2 END AS first
  FROM (SELECT l.*, c.bytes, c.dim, sum(l.size) OVER (PARTITION BY l.node ORDER BY [l.c0, l.c1, l.c2][1 - c.dim], l.h, l.doc_id) AS upto
    FROM level1 l JOIN cells1 c USING (node))
), cells2 AS (
  SELECT node, max(first) AS first, max(leaves) AS leaves, sum(size) AS bytes, list_max([
    {'w': max(c0) - min(c0), 'i': 0}, {'w': max(c1) - min(c1), 'i': -1}, {'w': max(c2) - min(c2), 'i': -2}]).i AS dim FROM level2 GROUP BY node
), level3 AS (
  SELECT * EXCLUDE (node, first, leaves, bytes, dim, upto), leaves // 2 AS leaves,
    2 * node + CASE WHEN 2 * (bytes // 2 - upto + size) >= size THEN 0 ELSE 1 END AS node,
    first + CASE WHEN 2 * (bytes // 2 - upto + size) >= size THEN 0 ELSE leaves // 2 END AS first
  FROM (SELECT l.*, c.bytes, c.dim, sum(l.size) OVER (PARTITION BY l.node ORDER BY [l.c0, l.c1, l.c2][1 - c.dim], l.h, l.doc_id) AS upto
    FROM level2 l JOIN cells2 c USING (node))
)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(first AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY first ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM level3
"""


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words with the form that they are a variant of."""
    return spelling_forms(table(spark, folder, "documents"))


OP13_SQL = """
WITH runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), low AS (
  SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, id, count(*) AS c FROM runs GROUP BY ALL
), steps AS (
  SELECT list(r ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(4)),
    lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r FROM range(16) AS t(i))
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(x), 2), lambda p: [
    instr('0123456789ABCDEF', x[p + 1]) - 1, instr('0123456789ABCDEF', x[p]) - 1]))),
    lambda r, b: xor(r >> 4, steps[(xor(r, b) & 15) + 1])), 4294967295) AS h
  FROM (SELECT run, c, hex(encode(id || ':' || run)) AS x FROM low), steps
), told AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c
  FROM hashed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM told WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min({'m': -m, 'near': near}) AS best FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.near END AS form,
    CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE walk AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.next
  ) SELECT word, root FROM walk WHERE next IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_chat": op5_chat,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_substring": op8_substring,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
    "op11_phrases": op11_phrases,
    "op12_sharding": op12_sharding,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {
    "op4_warc": OP4_SQL, "op5_chat": OP5_SQL, "op10_topk": OP10_SQL, "op11_phrases": OP11_SQL, "op12_sharding": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
