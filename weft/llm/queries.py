"""The registered queries of the operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality_rules
from ._spark import table


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long")
    return found.withColumns({"n_matches": F.size("matches").cast("long"), "longest_match": longest}).drop("matches")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, toxicity_model

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, language_model

    docs = table(spark, sf_dir, "documents")
    return identify(docs, language_model(docs))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="a key of this deployment", counts=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, format_chat

    added = spark.sql("SELECT -1L AS conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_chat(rows.unionByName(added)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import default_domain, default_weights, mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, default_domain(docs["source"]), default_weights(spark)).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_html_text": op8_html_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
}

_R = quality_rules.Rules()

_OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""

_OP4_SQL = r"""
WITH split AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
d AS (SELECT id AS doc_id, w, len(w) AS n FROM split WHERE kind = 'd'), i AS (SELECT CAST(id AS VARCHAR) AS item_id, w, len(w) AS n FROM split WHERE kind = 'i' AND len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, k + 1, k + size), ' ') AS win FROM (SELECT item_id, w, least(n, 13) AS size, unnest(range(greatest(n - 12, 1))) AS k FROM i)),
dw AS (SELECT doc_id, size, k, array_to_string(list_slice(w, k + 1, k + size), ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(n - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM iw) WHERE n >= size)),
m AS (SELECT doc_id, k, size, item_id FROM dw JOIN iw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
rw AS (SELECT r, size, unnest(range(greatest(n - 12, 1))) AS j, w FROM (SELECT row_number() OVER (ORDER BY item_id, w) AS r, w, n, least(n, 13) AS size FROM i)),
rm AS (SELECT doc_id, r, k, k - j AS diagonal, size, k - row_number() OVER (PARTITION BY doc_id, r, k - j ORDER BY k) AS island FROM dw JOIN (SELECT r, size, j, array_to_string(list_slice(w, j + 1, j + size), ' ') AS win FROM rw) USING (size, win)),
l AS (SELECT doc_id, count(*) AS n_matches, max(words) AS longest_match FROM (SELECT doc_id, count(*) + any_value(size) - 1 AS words FROM rm GROUP BY doc_id, r, diagonal, island) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= n AS contaminated,
  coalesce(n_matches, 0) AS n_matches, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)"""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_BLANK = r"'[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'"
_OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
f AS (SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
l AS (SELECT r, line, regexp_extract_all(line, {_WORDS}) AS w, row_number() OVER (PARTITION BY r, line ORDER BY k) AS copy FROM split WHERE regexp_matches(line, {_WORDS})),
x AS (SELECT r, copy, list_sum(list_transform(w, lambda v: length(v))) AS chars, CAST(len(w) AS DOUBLE) AS n, lower(line) AS low,
  len(list_filter(regexp_split_to_array(line, {_BLANK}), lambda v: v IN ('|', '›', '»', '·', '•', '>', '::', '->'))) AS nav, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^!?]', '', 'g')) AS shouts,
  NOT regexp_matches(line, '[.!?;:,。！？、；：।؟]') AS unmarked, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutter, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS upper, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters FROM l),
v AS (SELECT r, copy, chars, copy > {_R.max_repeats} OR nav >= {_R.min_navigation} AND nav > {_R.max_navigation}::DOUBLE * n OR symbols > {_R.max_symbols_per_word}::DOUBLE * n AND n >= 3 OR shouts > {_R.max_shouts_per_word}::DOUBLE * n AND n >= 4
  OR n >= {_R.long_line_words} AND unmarked OR n >= {_R.stutter_words} AND stutter > {_R.max_stutter}::DOUBLE * n OR n >= {_R.upper_words} AND upper > 2 * n AND upper > {_R.max_upper}::DOUBLE * letters OR n <= 30 AND regexp_matches(low, '{"|".join(quality_rules.BOILERPLATE)}') AS fails FROM x),
g AS (SELECT r, count(*) FILTER (copy > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM v GROUP BY r),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM (SELECT r, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS win FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5))),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win WHERE c > 1) GROUP BY r),
b AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars, n_words < 10 OR 100 * coalesce(n_repeat, 0) > 20 * n_words AS base_failed FROM f LEFT JOIN g USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= {_R.max_lost}::DOUBLE * word_chars AS kept, CAST(lost_chars AS BIGINT) AS lost_chars FROM b"""

ORACLE_SQL: dict[str, str] = {"op3_chat_format": _OP3_SQL, "op4_decontaminate": _OP4_SQL, "op9_quality_rules": _OP9_SQL, "op10_mixing": mixing.oracle_sql()}
