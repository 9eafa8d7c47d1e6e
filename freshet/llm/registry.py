"""The corpus queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import chat, decontam, htmltext, langid, mixing, neardup, pii, quality, sharding, tokens
from freshet.llm.common import shared_dir

TOKENIZER = "byte_bpe_50k.json"
#: The setting that names the folder of a lasting cache of token counts.
TOKEN_CACHE = "freshet.tokenCache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    return chat.digest(chat.format_chats(chats.select("conv_id", "turn", "role", "text").unionByName(more)))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.fit(table(spark, sf_dir, "documents")))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A session that names a lasting cache finds its counts there; else every run begins with an empty one.
    return tokens.count_tokens(table(spark, sf_dir, "documents"), spark.conf.get(TOKEN_CACHE, None) or shared_dir(spark), TOKENIZER)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        quality_ablation,
        op2_decontaminate,
        op3_chat_format,
        op4_near_duplicates,
        op5_language,
        op6_personal_data,
        op7_mix_sources,
        op8_token_counts,
        op9_shard,
        op10_main_text,
    )
}

_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 5)) AS u(p) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaim,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN cov USING (doc_id)),
led AS (SELECT *, ((n_words < 10)::BIGINT * 1 + (100 * n_repeat_words > 20 * n_words)::BIGINT * 2
               + (100 * n_symbols > 20 * word_chars)::BIGINT * 4 + (100 * n_dup_lines > 50 * n_lines)::BIGINT * 8
               + (word_chars > 40 * n_words)::BIGINT * 16 + (n_exclaim > n_words)::BIGINT * 32)::BIGINT AS fail_bits FROM m)
"""

ORACLE = {
    "op1_quality_rules": _LEDGER
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, 3::INT AS policy, n_lines, n_exclaim FROM led""",
    "quality_ablation": _LEDGER
    + """, rules(rule, bit) AS (VALUES ('few_words', 1::BIGINT), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8),
       ('long_words', 16), ('exclamation', 32))
SELECT rule, bit, sum(((fail_bits & bit) <> 0)::BIGINT)::BIGINT AS n_failed, sum((fail_bits = bit)::BIGINT)::BIGINT AS n_only_this,
       sum(((fail_bits & ~bit) = 0)::BIGINT)::BIGINT AS n_kept_without FROM led, rules GROUP BY rule, bit""",
    "op3_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w - 1 AS k, lag(role) OVER w AS prev, lead(role) OVER w IS NULL AS final
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*(?:/?s>|</?SYS>>|</?ROLE>>))', '<\\\1', 'g'),
                       '\[(\\*(?:/?INST\]|OUT\]))', '[\\\1', 'g')) AS chars,
             NOT ((prev IS NULL AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user')
                  OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user')) AS bad FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + 7 + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 5 ELSE 17 + length(role) END)::BIGINT AS formatted_chars,
       NOT coalesce(bool_or(bad), false) AND bool_or(final AND role = 'assistant') AS valid,
       min(CASE WHEN bad THEN k END)::INT AS first_bad_turn
FROM e GROUP BY conv_id""",
    "op4_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 2 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS x, len(w) >= 2 AS pair FROM d, unnest(range(1, greatest(len(w), 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT n.doc_id, n.n, c.c FROM n JOIN (SELECT doc_id, md5(string_agg(x || CASE WHEN pair THEN '2' ELSE '1' END, chr(10) ORDER BY x, pair)) AS c FROM s GROUP BY doc_id) c USING (doc_id)),
one AS (SELECT c, min(doc_id) AS doc_id, any_value(n) AS n FROM sets GROUP BY c),
r AS (SELECT s.*, one.n FROM s JOIN one USING (doc_id)),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM r a JOIN r b ON a.x = b.x AND a.pair = b.pair AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM meet WHERE 100 * k >= 80 * (na + nb - k)), ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
lab(id, m) USING KEY (id) AS (SELECT a, a FROM ways GROUP BY a UNION SELECT w.b, min(l.m) FROM lab l JOIN ways w ON w.a = l.id JOIN recurring.lab o ON o.id = w.b WHERE l.m < o.m GROUP BY w.b)
SELECT documents.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(lab.m, one.doc_id, documents.doc_id)::BIGINT AS component_id, documents.doc_id = coalesce(lab.m, one.doc_id, documents.doc_id) AS kept, coalesce(one.doc_id, documents.doc_id)::BIGINT AS class_id
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN one ON one.c = sets.c LEFT JOIN lab ON lab.id = one.doc_id""",
    "op7_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level <= cap / weight)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
e AS (SELECT source, key, sum(size)::BIGINT AS entry FROM d GROUP BY source, key),
p AS (SELECT *, coalesce(sum(entry) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
c AS (SELECT p.source, max(key) AS cut_key FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
      WHERE before * 2 + entry <= (target - epochs * source_size) * 2 GROUP BY p.source)
SELECT doc_id, size, source_size, target, size * times AS taken, times, source FROM (
  SELECT d.doc_id, d.size, b.source_size, b.target, (epochs + coalesce(key <= cut_key, false)::INT)::BIGINT AS times, d.source
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source)""",
    # The given pages mark their article and hold only these blocks, inline tags and references.
    "op10_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c""",
}
