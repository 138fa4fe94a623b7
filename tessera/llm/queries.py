"""Queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, crosspolytope, html_extract, lang_id, merkle, mixing, quality, simhash, suffix_dedup, topk, url_filter, variants
from tessera.llm.common import checkpointed, table

CONVERSATION = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONVERSATION).alias("text")
    )
    return chat_format.digest(chat_format.format_examples(rows.unionByName(own)))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, 22 + 1 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
            + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return m.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of each document, and whether its language and source keep it."""
    measured = checkpointed(quality.measures(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"]))
    judged = quality.judge(measured, quality.fences(measured))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"quality_{n}").alias(n) for n in names))


OP7_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words
  FROM documents
), wins AS (
  SELECT row_id, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, win) AS times FROM wins) WHERE times > 1
), covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY row_id
), lines AS (
  SELECT row_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY row_id
), m AS (
  SELECT w.row_id, doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM w LEFT JOIN covered USING (row_id) LEFT JOIN lines USING (row_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         [1000 * word_chars // greatest(n_words, 1), 1000 * n_symbols // greatest(n_words, 1),
          1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1)] AS vals
  FROM m
), x AS (
  SELECT row_id, lang, source, rule, vals[rule] AS v, greatest(length(bin(vals[rule])) - 6, 0)::INT AS k
  FROM b, range(1, 5) AS r(rule) WHERE NOT base_failed
), s AS (
  SELECT lang, source, rule, (v >> k) << k AS cell FROM x
), own AS (
  SELECT lang, source, rule, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3, count(*) AS docs FROM s GROUP BY ALL
), bylang AS (
  SELECT lang, rule, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3, count(*) AS docs FROM s GROUP BY ALL
), ofall AS (
  SELECT rule, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM s GROUP BY ALL
), f AS (
  SELECT own.lang, own.source, own.rule,
         CASE WHEN own.docs >= 100 THEN own.q1 WHEN bylang.docs >= 100 THEN bylang.q1 ELSE ofall.q1 END AS q1,
         CASE WHEN own.docs >= 100 THEN own.q3 WHEN bylang.docs >= 100 THEN bylang.q3 ELSE ofall.q3 END AS q3
  FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.rule = bylang.rule JOIN ofall ON ofall.rule = own.rule
), j AS (
  SELECT row_id, bool_or(vals[f.rule] < q1 - 3 * (q3 - q1) - [1500, 300, 300, 150][f.rule]
                         OR vals[f.rule] > q3 + 3 * (q3 - q1) + [1500, 300, 300, 150][f.rule]) AS outside
  FROM b JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source GROUP BY row_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(outside, false) AS kept
FROM b LEFT JOIN j USING (row_id)
"""


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; the trees learn from the urls that the rules decide."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that links reach from it."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash_fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 100, among all vectors."""
    coded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    asked = coded.where("id % 100 = 0").select(F.col("id").alias("query_id"), "code")
    return topk.top_k(coded, asked).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


OP6_SQL = r"""
WITH bits AS (
  SELECT vec_id, i, CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END AS bit
  FROM embeddings, range(0, 64) AS r(i) WHERE len(embedding) = 64
), codes AS (
  SELECT vec_id, string_agg(bit::VARCHAR, '' ORDER BY i)::BIT AS code FROM bits GROUP BY vec_id
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::BIGINT AS distance
  FROM codes q JOIN codes c ON q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", F.col("html_main").alias("text"), F.char_length("html_main").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes leave of every document."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = lang_id.train(docs.where("NOT held_out"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = lang_id.identify(docs, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", F.col("langid_pred").alias("lang_pred"), F.col("langid_score").alias("score"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return crosspolytope.neighbours(rows, asked).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether a copy of it, tampered with or not, leads to the root."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    docs = docs.withColumn("changed", F.when(picked & F.col("n_chars").isNotNull(), changed))
    m = merkle.manifest(docs, ["doc_id", "changed"])
    m = m.withColumn("folded_root", merkle.fold(F.coalesce("changed", "merkle_leaf"), F.col("merkle_path")))
    return m.select(
        "doc_id", F.col("merkle_leaf").alias("leaf"), F.col("merkle_subroot").alias("subroot"), F.col("merkle_root").alias("root"),
        F.sha2(merkle.siblings(F.col("merkle_path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("merkle_root")).alias("verified"),
    )


OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, lang, d || s || l || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || t AS plain,
         d || s || l || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || t AS tampered,
         coalesce(xor(crc, 4294967295) % 7 = 0, false) AS picked
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS d, coalesce(strlen(source) || ':' || source, '-') AS s,
               coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(text) || ':' || text, '-') AS t FROM docs)
), leaves AS (
  SELECT doc_id, lang, sha256(plain) AS leaf, CASE WHEN picked THEN sha256(tampered) ELSE sha256(plain) END AS start,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS pos
  FROM hashed
), below AS (
  SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (min(n) + 1) // 2
  FROM below WHERE n > 1 GROUP BY lang, level, pos // 2
), parts AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS part FROM below WHERE n = 1
), above AS (
  SELECT 0 AS level, part AS pos, subroot AS node, count(*) OVER () AS n FROM parts
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (min(n) + 1) // 2
  FROM above WHERE n > 1 GROUP BY level, pos // 2
), climb AS (
  SELECT doc_id, lang, pos AS leaf_pos, leaf, 0 AS level, pos, start AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf_pos, c.leaf, c.level + 1, c.pos // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(s.node, '') || c.folded ELSE c.folded || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
  FROM climb c JOIN below b ON b.lang IS NOT DISTINCT FROM c.lang AND b.level = c.level AND b.pos = c.pos AND b.n > 1
  LEFT JOIN below s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1)
), on_parts AS (
  SELECT doc_id, leaf, subroot, 0 AS level, part AS pos, folded, proof
  FROM (SELECT *, level = max(level) OVER (PARTITION BY lang, leaf_pos) AS last FROM climb) c JOIN parts p ON p.lang IS NOT DISTINCT FROM c.lang WHERE last
), climb_on AS (
  SELECT doc_id, leaf, subroot, level, pos, folded, proof, 1 AS n, row_number() OVER () AS id FROM on_parts
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.pos // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(s.node, '') || c.folded ELSE c.folded || coalesce(s.node, '') END), c.proof || coalesce(s.node, ''), 1, c.id
  FROM climb_on c JOIN above b ON b.level = c.level AND b.pos = c.pos AND b.n > 1
  LEFT JOIN above s ON s.level = c.level AND s.pos = xor(c.pos, 1)
), done AS (
  SELECT *, level = max(level) OVER (PARTITION BY id) AS last FROM climb_on
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM done, (SELECT node AS root FROM above WHERE n = 1) WHERE last
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, one run in 97 short of a letter, with its near words, its form and its root."""
    words = variants.count_words(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_every=97)
    return variants.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                                                           lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c) - 64] END))),
           lambda crc, byte: xor(t[(xor(crc, byte) & 255) + 1], crc >> 8)), 4294967295) AS h
  FROM counted, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, range(0, 100) AS r(i) WHERE i < length(word)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION
  SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
)
SELECT word, form, walk.root, n, n_near, form_n
FROM formed JOIN walk USING (word) JOIN (SELECT word AS w, form AS f FROM formed) AS ends ON ends.w = walk.root AND ends.f IS NULL
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_simhash": op5_simhash,
    "op6_top_k": op6_top_k,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extract": op8_html_extract,
    "op9_chat_format": op9_chat_format,
    "op10_bpe": op10_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_nearest": op12_nearest,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op6_top_k": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
