"""The queries of this subpackage: opN_<name>(spark, sf_dir), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.llm import ann, bpe_chunks, chat, mixing, ngram_lm, quality_classifier, quality_rules, simhash, token_orc, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the vocabulary file lies; it is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from two thirds of the ids."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth id."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all conversations and a planted one, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_windows(rows.unionByName(planted)))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document."""
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from four fifths of the ids."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets and checksums of the token ids of every document, from the files."""
    return token_orc.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bpe_chunks.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
             length('<s>[INST]  [/INST]</s>') + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
             + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS chars FROM c),
p AS (SELECT *, row_number() OVER o - 1 AS pos, sum(tokens) OVER o - tokens AS start, sum(tokens) OVER o AS stop FROM l
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
s AS (SELECT conv_id, min(pos) AS sys_pos, arg_min(tokens, pos) AS sys_tokens, arg_min(chars, pos) AS sys_chars FROM p WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT p.*, sys_pos, sys_chars, greatest(1024 - 192 - coalesce(sys_tokens, 0), 256) // 2 AS half FROM p LEFT JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (SELECT *, 2 * ((stop - 1) // half) + CASE WHEN tokens > half THEN 0 ELSE 1 END AS win FROM r),
h AS (SELECT conv_id, win, min(pos) AS head, min(start) AS begin, sum(chars) AS own, max(sys_chars) AS sys_chars, coalesce(max(CAST(pos = sys_pos AS INT)), 0) AS has_sys FROM w GROUP BY conv_id, win),
b AS (SELECT h.conv_id, sum(w.chars) AS back FROM h JOIN w ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos BETWEEN h.head - 4 AND h.head - 1
      WHERE w.start >= h.begin - 192 AND NOT coalesce(w.pos = w.sys_pos, false) GROUP BY h.conv_id),
f AS (SELECT conv_id, sum(own) + sum(CASE WHEN has_sys = 0 THEN coalesce(sys_chars, 0) ELSE 0 END) AS chars FROM h GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
             coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss FROM p GROUP BY conv_id)
SELECT g.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f.chars + coalesce(b.back, 0) AS BIGINT) AS formatted_chars
FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN b ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""

OP10_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 3 * source_size AS cap FROM s),
c AS (SELECT *, cap / w AS ratio,
             coalesce(sum(cap) OVER o, 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w, sum(source_size) OVER () AS total
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - before AS DOUBLE) / open_w AS level FROM c),
t AS (SELECT source, source_size,
             CASE WHEN level < ratio THEN max(CASE WHEN level < ratio THEN level END) OVER () * w ELSE CAST(cap AS DOUBLE) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
q AS (SELECT *, target - copies * source_size AS rest FROM p),
g AS (SELECT source, h, sum(size) AS n FROM r GROUP BY source, h),
u AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT u.source, u.h, u.n, u.upto, q.rest FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source
      WHERE q.rest > 0 AND u.upto >= q.rest AND u.upto - u.n < q.rest),
f AS (SELECT source, CASE WHEN n - (rest - (upto - n)) < rest - (upto - n) THEN h ELSE h - 1 END AS threshold FROM e)
SELECT r.doc_id, r.size, q.source_size, q.target,
       CAST(r.size * (q.copies + CASE WHEN q.rest > 0 AND r.h <= coalesce(f.threshold, 1152921504606846975) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_nnpu": op1_toxicity_nnpu,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_chat_windows": op3_chat_windows,
    "op4_bloom_lm": op4_bloom_lm,
    "op5_simhash_bktree": op5_simhash_bktree,
    "op6_quality_rff": op6_quality_rff,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_orc": op8_token_orc,
    "op9_bpe_chunks": op9_bpe_chunks,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op3_chat_windows": OP3_SQL, "op10_mixing": OP10_SQL}
