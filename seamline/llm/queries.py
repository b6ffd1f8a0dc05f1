"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import chat, decontaminate, exact_dedup, html_extract, langid, license_scan, mixing, quality, simhash, toxicity
from seamline.llm.common import crc_fold, read_table


#: A document is rejected as toxic from this score on.
TOXIC = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, read_table(spark, sf_dir, "labels"), folds=3, held=1))
    held = crc_fold(F.col("doc_id"), 3) == 1
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


#: The mixture has as many documents as the input, in equal shares of all sources.
EPOCHS, SEED = 1.0, 42


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(read_table(spark, sf_dir, "documents"), epochs=EPOCHS, seed=SEED)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents"))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.Model(langid.training_texts(docs, folds=4, held=2))
    held = crc_fold(F.col("doc_id"), 4) == 2
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.train(docs))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chat(turns))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_poisson_mix": op3_poisson_mix,
        "op4_simhash": op4_simhash,
        "op5_ppm_language": op5_ppm_language,
        "op6_decontaminate": op6_decontaminate,
        "op7_weak_label_quality": op7_weak_label_quality,
        "op8_chat_format": op8_chat_format,
        "op9_license_scan": op9_license_scan,
        "op10_html_extract": op10_html_extract,
    }


ESCAPED = "replace({}, '\\', '\\\\')"
for _mark in chat.CONTROL:
    ESCAPED = f"replace({ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

OP8_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, length({ESCAPED.format("role")}) + length({ESCAPED.format("text")}) + {len(chat.OPEN) + 1 + len(chat.CLOSE)} AS chars,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR pos = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

OP3_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / count(*) OVER () * sum(n) OVER () * {EPOCHS} / n AS rate FROM counts),
steps AS (SELECT source, ceil(rate / {mixing.STEP})::INT AS draws, rate / ceil(rate / {mixing.STEP}) AS mean FROM rates),
terms AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM steps, range(0, {mixing.TERMS + 1}) AS t(k)),
draws AS (SELECT d.doc_id, d.source, ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / (1::BIGINT << 52) AS u
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source, unnest(range(1, s.draws + 1)) AS x(j)),
copies AS (SELECT doc_id, count(*) AS n FROM draws JOIN terms ON draws.source IS NOT DISTINCT FROM terms.source AND c <= u GROUP BY doc_id)
SELECT d.*, i::INT AS copy,
  ('0x' || substr(md5('{SEED + 1}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT / (1::BIGINT << 52) AS shuffle_key
FROM documents d JOIN copies c ON d.doc_id IS NOT DISTINCT FROM c.doc_id, unnest(range(0, c.n)) AS y(i)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_poisson_mix": OP3_SQL, "op8_chat_format": OP8_SQL}
