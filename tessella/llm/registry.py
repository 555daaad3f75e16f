"""Queries of the training-data operators, with production parameters over whole tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, chat, cross_tokenizer, decontaminate, language_mixture, license_scan, mixing, quality, simhash, spelling, substring_dedup, token_table, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.windows(turns))


def op2_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.tokenized(spark, _read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_mixture.fit(docs, learn=~quality.held_out())
    found = docs.select("doc_id", quality.held_out().alias("held_out"), language_mixture.infer(model).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang_pred").alias("lang_pred"), F.col("x.score").alias("score"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), learn=~quality.held_out())
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), learn=~quality.held_out("page_id")).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, _read(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).drop("spans")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return cross_tokenizer.align(_read(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_windows, op2_token_table, op3_mixing, op4_language_mixture, op5_simhash, op6_license_scan, op7_quality, op8_ball_tree, op9_url_filter, op10_decontaminate, op11_substring_dedup, op12_cross_tokenizer, op13_spelling_variants)
}

_OP1 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t0 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    greatest(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), ceil(length(text) / 8)::BIGINT) + 4 AS tokens FROM c),
t1 AS (SELECT *, CASE WHEN tokens <= 128 THEN text
    ELSE array_to_string(list_slice(list_filter(regexp_split_to_array(substr(text, 1, 984), '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1, 123), ' ') || ' [...]' END AS head FROM t0),
t AS (
  SELECT *, length(replace(role, '\', '\0')) + 8
      + CASE WHEN role = 'assistant' THEN 0 ELSE 13 END AS marks,
    length(replace(text, '\', '\0'))
      + (length(text) - length(replace(text, '<s>', ''))) // 3 * 2 + (length(text) - length(replace(text, '</s>', ''))) // 4 * 2
      + (length(text) - length(replace(text, '[INST]', ''))) // 6 * 2 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 * 2 AS body,
    length(replace(head, '\', '\0'))
      + (length(head) - length(replace(head, '<s>', ''))) // 3 * 2 + (length(head) - length(replace(head, '</s>', ''))) // 4 * 2
      + (length(head) - length(replace(head, '[INST]', ''))) // 6 * 2 + (length(head) - length(replace(head, '[/INST]', ''))) // 7 * 2 AS head_body
  FROM t1),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) AS e, min(CASE WHEN role = 'system' THEN n END) OVER (PARTITION BY conv_id) AS sys FROM t),
v AS (
  SELECT u.*, u.marks + u.body AS chars, e - u.tokens AS s, greatest(1, 384 - least(128, coalesce(y.tokens, 0))) AS step, y.marks + y.head_body AS sys_chars
  FROM u LEFT JOIN (SELECT conv_id, n, tokens, marks, head_body FROM t) y ON u.conv_id IS NOT DISTINCT FROM y.conv_id AND u.sys = y.n),
w AS (
  SELECT *, min(s) OVER (PARTITION BY conv_id, span) AS span_start FROM (
    SELECT *, 2 * (s // step) + CASE WHEN s // step = (e - 1) // step THEN 0 ELSE 1 END AS span FROM v)),
spans AS (SELECT conv_id, span, min(n) AS lo, max(n) AS hi, min(s) AS span_start, any_value(sys) AS sys, any_value(sys_chars) AS sys_chars FROM w GROUP BY conv_id, span),
heads AS (SELECT conv_id, sum(sys_chars) AS chars FROM spans WHERE sys < lo OR sys > hi GROUP BY conv_id),
past AS (
  SELECT w.conv_id, sum(w.chars) AS chars FROM w JOIN spans p ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND p.span > w.span AND p.span_start - w.s <= 128
  WHERE w.n IS DISTINCT FROM w.sys GROUP BY w.conv_id),
own AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '') AS loss, sum(chars) AS chars, count(DISTINCT span) AS n_windows
  FROM w GROUP BY conv_id)
SELECT own.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (own.chars + coalesce(heads.chars, 0) + coalesce(past.chars, 0))::BIGINT AS formatted_chars, n_windows
FROM own LEFT JOIN heads ON own.conv_id IS NOT DISTINCT FROM heads.conv_id LEFT JOIN past ON own.conv_id IS NOT DISTINCT FROM past.conv_id
"""

_ROUND = """r{n} AS (SELECT source, name, pass, blocks, CASE WHEN substr(md5('swap17.{r}|' || name || '|' || pass || '|' || greatest(block, other)), 1, 1) < '8' THEN block ELSE other END AS block
  FROM (SELECT *, (((('0x' || substr(md5('key17.{r}|' || name || '|' || pass), 1, 15))::BIGINT - block) % blocks) + blocks) % blocks AS other FROM r{r})),
"""
_OP3 = (
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s0),
s2 AS (SELECT *, 2 * source_size AS most, sum(source_size) OVER () AS all_size,
  coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s1
  WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source)),
s3 AS (SELECT *, max((1.5::DOUBLE * all_size - full_size) / open_weight) OVER () AS level FROM s2),
s4 AS (SELECT source, source_size, least(most::DOUBLE, level * weight) AS target, greatest(1, least(1024, source_size // 256))::BIGINT AS block_words FROM s3),
s5 AS (SELECT *, (source_size + block_words - 1) // block_words AS blocks, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM s4),
s6 AS (SELECT *, passes * blocks + least(blocks, floor((target - passes * source_size) / block_words + 0.5::DOUBLE)::BIGINT) AS slots FROM s5),
r0 AS (SELECT source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS name, slot // blocks AS pass, blocks, slot % blocks AS block
  FROM (SELECT *, unnest(range(slots)) AS slot FROM s6 WHERE slots > 0)),
"""
    + "".join(_ROUND.format(n=r + 1, r=r) for r in range(mixing.ROUNDS))
    + r"""times AS (SELECT source, block, count(*) AS times FROM r8 GROUP BY source, block),
e AS (SELECT *, ('0x' || substr(md5('slice|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 15))::BIGINT % (floor(sqrt((SELECT count(*) FROM d)))::BIGINT + 1) AS slice FROM d),
p AS (SELECT doc_id, source, size, row_number() OVER o AS row, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS start
  FROM e WINDOW o AS (PARTITION BY source ORDER BY slice, doc_id NULLS FIRST, size)),
q AS (SELECT p.*, s6.source_size, s6.target, block_words FROM p JOIN s6 ON p.source IS NOT DISTINCT FROM s6.source),
g AS (SELECT *, unnest(range((start // block_words)::BIGINT, ((start + size - 1) // block_words + 1)::BIGINT)) AS block FROM q WHERE size > 0),
k AS (SELECT g.source, row, sum((least(start + size, (g.block + 1) * block_words) - greatest(start, g.block * block_words)) * times) AS taken
  FROM g JOIN times ON g.source IS NOT DISTINCT FROM times.source AND g.block = times.block GROUP BY g.source, row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.row = k.row
"""
)

_OP6_KNOWN = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in license_scan.texts())


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{license_scan.COPYRIGHT_LINE}', ' ', 'g')"
    out = rf"' ' || trim(regexp_replace({out}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) || ' '"
    for old, new in license_scan.EQUIVALENT:
        out = f"replace({out}, '{old}', '{new}')"
    return f"sha256(trim({out}))"


_OP6 = f"""
WITH known AS (SELECT {_canonical_sql('text')} AS digest, min(license_id) AS license_id FROM (VALUES {_OP6_KNOWN}) v(license_id, text) GROUP BY 1),
d AS (SELECT doc_id, {_canonical_sql('text')} AS digest FROM documents)
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN known ON d.digest = known.digest AND d.digest <> sha256('')
"""

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM (
    SELECT query_id, vec_id, list_dot_product(q, v)::BIGINT AS score FROM q JOIN v ON query_id IS DISTINCT FROM vec_id AND len(q) = len(v)))
WHERE rank <= 10
"""

_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = rf"regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = f"""
WITH b AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, least(i + 9, len(w))), ' ') AS phrase, least(10, len(w)) AS n FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS_SQL}, []) AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, i, p.n, item_id FROM places p JOIN win USING (phrase, n)),
words AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS o FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(coalesce(item_id::VARCHAR, ''), ',' ORDER BY coalesce(item_id::VARCHAR, '')) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, r, i, array_to_string(list_slice(w, i, i + 12), ' ') AS seq FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT seq, min(doc_id) AS first FROM win GROUP BY seq HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + o AS i FROM (SELECT r, i, unnest(range(13)) AS o FROM win JOIN firsts USING (seq) WHERE first < doc_id)),
cuts AS (SELECT r, list(i ORDER BY i) AS cut FROM gone GROUP BY r),
words AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d JOIN cuts USING (r))),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed, sha256(CASE WHEN cut IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN cuts USING (r) LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_windows": _OP1,
    "op3_mixing": _OP3,
    "op6_license_scan": _OP6,
    "op8_ball_tree": _OP8,
    "op10_decontaminate": _OP10,
    "op11_substring_dedup": _OP11,
}
