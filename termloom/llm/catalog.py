"""The training-data queries and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, licenses, near, ppm, quality, substrings, suffixes, wavelet
from .common import ship_code, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.parse(chat.render(chat.fold_events(chat.as_events(rows)))))


OP4_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS role_out,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS text_out FROM rows
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(length(role_out) + length(text_out) + 18) AS BIGINT) AS formatted_chars
  FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), [F.col("doc_id")]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), v AS (
  SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN f USING (g) WHERE first < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS MATERIALIZED (SELECT doc_id, i, hash(x[2 * i - 1:2 * i + 98]) AS h FROM (SELECT *, unnest(range(1, length(x) // 2 - 48)) AS i FROM d WHERE length(x) >= 100)),
several AS (SELECT h FROM v GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS MATERIALIZED (SELECT doc_id, i, x[2 * i - 1:2 * i + 98] AS g FROM v SEMI JOIN several USING (h) JOIN d USING (doc_id)),
f AS (SELECT g, min(doc_id) AS first FROM c GROUP BY g),
gone AS (SELECT doc_id, i FROM c JOIN f USING (g) WHERE first < doc_id),
marked AS (SELECT *, i - lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) > 50 AS new FROM gone),
numbered AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 49 AS b FROM numbered GROUP BY doc_id, k),
ordered AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (
  SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, string_agg(x[2 * before + 1:2 * (a - 1)], '' ORDER BY a) || x[2 * max(b) + 1:] AS t
  FROM ordered JOIN d USING (doc_id) GROUP BY doc_id, x
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def ppm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op1, which SQL can express."""
    base = F.round("base_score", 6).alias("base_score")
    return op1_ppm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op5."""
    return op5_quality(spark, sf_dir).drop("kept")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6."""
    return op6_licenses(spark, sf_dir).drop("labels", "score")


WORDS_SQL = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PPM_BASE_SQL = f"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, {WORDS_SQL.format(LOWER_SQL)} AS w,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 1 AS held_out
  FROM documents, tab
), counts AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM d WHERE NOT held_out) GROUP BY x),
ends AS (SELECT count(*) AS c FROM d WHERE NOT held_out),
size AS (SELECT coalesce(sum(counts.c), 0) + any_value(ends.c) AS n, count(counts.c) + CAST(any_value(ends.c) > 0 AS INT) AS v, any_value(ends.c) AS e
  FROM ends LEFT JOIN counts ON true),
scored AS (
  SELECT doc_id, count(*) FILTER (WHERE c > 0) AS known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS s
  FROM (SELECT doc_id, unnest(w) AS x FROM d) LEFT JOIN counts USING (x), size GROUP BY doc_id
)
SELECT d.doc_id, held_out, CAST(len(w) + 1 AS BIGINT) AS n_tokens, CAST(coalesce(known, 0) + CAST(e > 0 AS INT) AS BIGINT) AS n_known,
  CAST(n AS BIGINT) AS train_tokens, round(coalesce(s, 0) + log10((e + 0.5) / (n + 0.5 * (v + 1))), 6) AS base_score
FROM d LEFT JOIN scored USING (doc_id), size
"""

QUALITY_BASE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), v AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM v GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM v SEMI JOIN twice USING (doc_id, g)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(r, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN covered USING (doc_id)
"""

LICENSES_BASE_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER_SQL}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), phrases AS (
  SELECT string_split(p, ' ') AS p, label FROM (VALUES {', '.join(f"('{p}', '{label}')" for p, label in licenses.BASE.items())}) AS x(p, label)
), found AS (
  SELECT doc_id, label, i - 1 AS p0 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d), phrases WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p
)
SELECT doc_id, any_value(len(w)) AS n_words, count(p0) AS n_base, min(p0) AS first_word, max(p0) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = {
        "op1_ppm": op1_ppm,
        "op2_bpe": op2_bpe,
        "op3_wavelet": op3_wavelet,
        "op4_chat": op4_chat,
        "op5_quality": op5_quality,
        "op6_licenses": op6_licenses,
        "op7_decontaminate": op7_decontaminate,
        "op8_substrings": op8_substrings,
        "op9_suffixes": op9_suffixes,
        "op10_near": op10_near,
        "pipeline": pipeline,
        "ppm_base": ppm_base,
        "quality_base": quality_base,
        "licenses_base": licenses_base,
    }

    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": OP4_SQL,
        "op8_substrings": OP8_SQL,
        "op9_suffixes": OP9_SQL,
        "ppm_base": PPM_BASE_SQL,
        "quality_base": QUALITY_BASE_SQL,
        "licenses_base": LICENSES_BASE_SQL,
    }
