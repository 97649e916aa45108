"""The registered queries of the training-text operators, and their SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import (
    alignment,
    chat,
    decontaminate,
    html_text,
    language,
    lm_scoring,
    merkle,
    mixing,
    ngram_join,
    packing,
    quality,
    sharding,
    token_counts,
)
from plumbline.llm.shared import fold_of, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Of the mixing query: weights of the sources in turn, and the most that a source may be repeated.
MIX_WEIGHTS, MIX_MOST = (1.0, 2.0, 3.0), 3.0
#: Of the sharding query.
SHARDS = 16
#: Vocabulary of a public tokenizer, as ranks.
RANKS = os.environ.get("PLUMBLINE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Folder of the public tokenizer files; the driver reads them and sends their content to the tasks.
TOKENIZERS = Path(RANKS).parent


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


@register
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op2_mix_sources"] = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
limits AS (
  SELECT a.source, 3.0::DOUBLE * a.source_size / a.weight AS ratio,
         ((SELECT sum(source_size) FROM sources)::DOUBLE
          - (SELECT coalesce(sum(3.0::DOUBLE * b.source_size), 0) FROM sources b WHERE 3.0::DOUBLE * b.source_size / b.weight < 3.0::DOUBLE * a.source_size / a.weight))
         / (SELECT sum(b.weight)::DOUBLE FROM sources b WHERE 3.0::DOUBLE * b.source_size / b.weight >= 3.0::DOUBLE * a.source_size / a.weight) AS level
  FROM sources a),
targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * (SELECT level FROM limits WHERE level <= ratio ORDER BY ratio LIMIT 1)) AS target
  FROM sources),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM targets),
running AS (
  SELECT d.*, s.source_size, s.target, s.copies, s.target - s.copies * s.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running"""


def shard_columns(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by near equal bytes."""
    return shard_columns(sharding.shard(read(spark, sf_dir, "documents"), SHARDS))


@register
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark, keep=["doc_id"])


_WORDS = "regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')"
SQL["op4_decontaminate"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
found AS (
  SELECT r, i, m, item
  FROM docs, unnest(range(1, len(w) + 1)) AS u(i) JOIN (SELECT DISTINCT m FROM patterns) AS s ON i + s.m - 1 <= len(w)
  JOIN patterns AS q USING (m) WHERE q.p = array_to_string(w[i:i + m - 1], ' ')),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + m)) AS u(k) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


@register
def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    found = language.identify(docs, language.train(docs), keep=["doc_id"], spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


@register
def op3_rotate_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the perspective of each participant."""
    rotated = chat.rotate(read(spark, sf_dir, "conversations"))
    mask = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rotated.select("conv_id", "perspective", "part", "n_turns", "text", mask.alias("mask"), trained.alias("n_trained"))


SQL["op3_rotate_chat"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
heads AS (
  SELECT t.*, perspective, CAST(floor(turn / 64.0) AS BIGINT) AS part,
         CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, length(head) + length(text) + 7 AS n,
         sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text
           ROWS UNBOUNDED PRECEDING) - (length(head) + length(text) + 8) AS place
  FROM heads)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN role = perspective THEN CAST(place + length(head) AS VARCHAR) || '-' || CAST(place + n AS VARCHAR) END, ','
         ORDER BY turn NULLS FIRST, role, text), '') AS mask,
       CAST(sum(CASE WHEN role = perspective THEN length(text) + 7 ELSE 0 END) AS BIGINT) AS n_trained
FROM placed GROUP BY conv_id, perspective, part"""


@register
def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the rule cascade for every document."""
    return quality.quality(read(spark, sf_dir, "documents"))


@register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after personal data is replaced."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.read_ranks(RANKS))


@register
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by an attention model, and by word frequencies."""
    return lm_scoring.score(read(spark, sf_dir, "documents"), token_counts.read_ranks(RANKS))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@register
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, proof and a tampering check of every document."""
    columns = {c: F.col(c) for c in merkle.COLUMNS}
    original = merkle.leaf_digest(list(columns.values()))
    changed = merkle.leaf_digest([F.translate(c, _UPPER, _LOWER) if name == "text" else c for name, c in columns.items()])
    tampered = F.when(fold_of(columns["doc_id"]) == 0, changed).otherwise(original)
    rows = merkle.manifest(read(spark, sf_dir, "documents"), keep={"doc_id": columns["doc_id"], "tampered": tampered})
    folded = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.col("tampered"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op13_merkle_manifest"] = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
                CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head
  FROM documents),
leaves AS (
  SELECT r, doc_id, source, h, n, changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos
  FROM (SELECT r, doc_id, source, count(*) OVER (PARTITION BY source) AS n,
               sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS h,
               sha256(head || CASE WHEN lowered IS NULL THEN '-' ELSE strlen(lowered) || ':' || lowered END) AS changed FROM docs)),
nodes AS (
  SELECT source, 0 AS level, pos, h, n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16),
subroots AS (
  SELECT source, level AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, pos // 16),
steps AS (
  SELECT source, level, pos, coalesce(string_agg(h, '') OVER before, '') AS lefts, coalesce(string_agg(h, '') OVER after, '') AS rights
  FROM nodes WHERE n > 1
  WINDOW before AS (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
top_steps AS (
  SELECT level, pos, coalesce(string_agg(h, '') OVER before, '') AS lefts, coalesce(string_agg(h, '') OVER after, '') AS rights
  FROM tops WHERE n > 1
  WINDOW before AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
paths AS (
  SELECT r, level, lefts, rights FROM leaves l JOIN steps s
    ON l.source IS NOT DISTINCT FROM s.source AND s.pos = l.pos // CAST(power(16, s.level) AS BIGINT)
  UNION ALL
  SELECT r, height + level, lefts, rights FROM leaves l JOIN subroots t ON l.source IS NOT DISTINCT FROM t.source
    JOIN top_steps s ON s.pos = t.pos // CAST(power(16, s.level) AS BIGINT)),
sums AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END))) AS crc
  FROM leaves),
folded AS (
  SELECT r, 0 AS level, CASE WHEN coalesce(crc % 5 = 0, false) THEN changed ELSE h END AS h FROM sums
  UNION ALL
  SELECT f.r, f.level + 1, sha256(lefts || f.h || rights) FROM folded f JOIN paths p ON p.r = f.r AND p.level = f.level),
proofs AS (SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof, count(*) AS k FROM paths GROUP BY r)
SELECT doc_id, l.h AS leaf, t.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots t ON l.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT h AS root FROM tops WHERE n = 1)
LEFT JOIN proofs p ON p.r = l.r JOIN folded f ON f.r = l.r AND f.level = coalesce(k, 0)"""


@register
def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    model = (TOKENIZERS / "word_bpe_49k.json").read_text()
    pieces = packing.pack(read(spark, sf_dir, "documents"), model)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register
def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common groups of the tokens of two tokenizers in every document, and how usual their links are."""
    model_a, model_b = (TOKENIZERS / "byte_bpe_50k.json").read_text(), (TOKENIZERS / "piece_bpe_32k.model").read_bytes()
    rows = alignment.align(read(spark, sf_dir, "documents"), model_a, model_b)
    sums = alignment.link_sums(rows, alignment.pair_counts(rows))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    slim = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return slim.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *filled, "groups_sha256")
