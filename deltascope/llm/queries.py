"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import chat, decontaminate, langid, mixing, negatives, omh, quality, records, shallot, sharding, substring, suffix, toxicity
from deltascope.llm.common import table
from deltascope.llm.vectors import all_finite, scaled

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        LLM_QUERIES[name] = fn
        if oracle:
            LLM_ORACLES[name] = oracle
        return fn
    return keep


SUBSTRING_SQL = rf"""
WITH parts AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '\p{{Lu}}?[^\p{{Lu}}.!?\n]*[.!?\n]*') AS u FROM documents),
pieces AS (SELECT doc_id, unnest(u) AS raw, unnest(range(1, len(u) + 1)) AS i FROM parts),
placed AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) AS start,
                  trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS plain FROM pieces),
worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal,
                  row_number() OVER (PARTITION BY plain ORDER BY doc_id, i) AS nth,
                  length(plain) - length(replace(plain, ' ', '')) + 1 AS words FROM placed WHERE plain <> ''),
repeated AS (SELECT *, ordinal - row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS run FROM worded WHERE nth > 1),
runs AS (SELECT doc_id, min(start)::BIGINT AS a, max(start + length(raw))::BIGINT AS b, count(*) AS n
         FROM repeated GROUP BY doc_id, run HAVING sum(words) >= {substring.MIN_RUN_WORDS}),
whole AS (SELECT p.doc_id, p.i, p.raw, r.a IS NOT NULL AS gone FROM placed p
          LEFT JOIN runs r ON p.doc_id = r.doc_id AND p.start >= r.a AND p.start < r.b),
texts AS (SELECT doc_id, coalesce(string_agg(raw, '' ORDER BY i) FILTER (NOT gone), '') AS text FROM whole GROUP BY doc_id),
sums AS (SELECT doc_id, sum(n)::INT AS removed_units, sum(b - a)::BIGINT AS removed_chars,
                string_agg(a || '+' || (b - a), ',' ORDER BY a) AS removed FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(removed_units, 0)::INT AS removed_units, coalesce(removed_chars, 0) AS removed_chars,
       coalesce(removed, '') AS removed, coalesce(t.text, d.text) AS text
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN sums USING (doc_id)"""


@register("op1_line_dedup", SUBSTRING_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda r: F.concat_ws("+", r["start"], r["length"]))
    return out.withColumn("removed", F.array_join(spans, ","))


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_SQL = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
b AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM a),
starts AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM b),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM starts) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
c AS (SELECT b.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '\P{{L}}', '', 'g')) AS letters
      FROM b LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines >= n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * letters < word_chars) AS kept
FROM c"""


@register("op2_quality_cascade", QUALITY_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_quality(table(spark, sf_dir, "documents"))


@register("op3_hypergeometric_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(table(spark, sf_dir, "documents"))


@register("op4_bm25_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


def mixing_sql(margins=mixing.MARGINS, sweeps: int = mixing.SWEEPS, seed: int = 17) -> str:
    """The same raking with window sums over the cells, as a recursive query."""
    target = ", ".join(
        f"T * pow(sum(tokens) OVER (PARTITION BY {m.name}), {m.power}) / n_{m.name} AS t_{m.name}" for m in margins)
    norms = ", ".join(
        f"(SELECT sum(pow(s, {m.power})) FROM (SELECT sum(tokens) AS s FROM cells GROUP BY {m.name})) AS n_{m.name}" for m in margins)
    names = [m.name for m in margins]
    keys = ", ".join(names)
    targets = ", ".join(f"t_{n}" for n in names)
    step = "w"
    inner = "rake"
    for n in names:
        inner = f"(SELECT k, {keys}, tokens, {targets}, w * t_{n} / sum(w) OVER (PARTITION BY {n}) AS w FROM {inner})"
    return f"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, lang, {mixing.topic_sql()} AS topic,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens
  FROM documents),
cells AS (SELECT {keys}, sum(tokens)::DOUBLE AS tokens FROM f GROUP BY ALL HAVING sum(tokens) > 0),
start AS (SELECT {keys}, tokens, {target} FROM cells, (SELECT sum(tokens) AS T, {norms} FROM cells)),
rake AS (
  SELECT 0 AS k, {keys}, tokens, {targets}, tokens AS {step} FROM start
  UNION ALL
  SELECT k + 1, {keys}, tokens, {targets}, w FROM {inner} WHERE k < {sweeps}),
r AS (SELECT {keys}, tokens, w, w / tokens AS ratio FROM rake WHERE k = {sweeps}),
o AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, {keys}) AS place, sum(tokens) OVER () AS all_tokens, sum(w) OVER () AS all_weight,
  sum(tokens) OVER (ORDER BY ratio DESC, {keys}) - tokens AS taken, sum(w) OVER (ORDER BY ratio DESC, {keys}) - w AS gone FROM r),
c AS (SELECT *, ({mixing.SHARE} * all_tokens - taken) / (all_weight - gone) AS factor FROM o),
p AS (SELECT {keys}, least(1.0, ratio * (SELECT min_by(factor, place) FROM c WHERE factor * ratio < 1)) AS probability FROM r)
SELECT f.doc_id, f.topic, f.tokens, round(coalesce(probability, 1.0), 6) AS probability,
       (('0x' || substr(md5('{seed}:' || f.doc_id), 1, 8))::BIGINT / 4294967296.0) < coalesce(probability, 1.0) AS sampled
FROM f LEFT JOIN p ON {" AND ".join(f"f.{n} IS NOT DISTINCT FROM p.{n}" for n in names)}"""


@register("op5_rake_mixture", mixing_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_report(table(spark, sf_dir, "documents"))
    return out.withColumn("probability", F.round("probability", 6))


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
d AS (SELECT *, bool_or(regexp_matches(role || ' ' || text, '<\|im_(start\+*|sep|end)\|>')) OVER (PARTITION BY conv_id) AS deep FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length('<|im_start|><|im_sep|><|im_end|>') + 1 + deep::INT
           + length(CASE WHEN deep THEN regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') ELSE role END)
           + length(CASE WHEN deep THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END))::BIGINT AS formatted_chars
FROM d GROUP BY conv_id"""


@register("op6_chat_round_trip", CHAT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    tough = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{tough}' AS text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(turns))


@register("op7_bigru_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op8_order_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("removed")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op9_binary_records")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.export(table(spark, sf_dir, "documents"), tokenizer_path()).drop("record")


def kmeans_sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    """Each round compares all vectors with all centroids."""
    first = f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {dim}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1)::INT AS j, v AS c FROM v
       ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})"""
    parts = [first]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, j := j)) AS best FROM (
       SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
       FROM v, c{i}) GROUP BY vec_id, v)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (SELECT j, list(m ORDER BY p) AS c FROM (
       SELECT j, p, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
       FROM (SELECT best.j AS j, unnest(v) AS x, unnest(range({dim})) AS p FROM a{i}) GROUP BY j, p) GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT j, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (j))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, best.j AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.j)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.j = j"""


@register("op11_shallot_kmeans", kmeans_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.cluster(table(spark, sf_dir, "embeddings"))


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same,
       coalesce(list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
      FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3"""


@register("op13_gnat_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").filter(all_finite(F.col("embedding")) & F.col("label").isNotNull())
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = found.select("vec_id", noisy.alias("label"), scaled(F.col("embedding")).alias("vector"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


@register("op12_string_kernel_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
