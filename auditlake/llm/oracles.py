"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from auditlake.llm.quality import STOP_WORDS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP13_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _op13_features(table: str) -> str:
    words = f"regexp_extract_all({_LOWER.format('coalesce(text, ' + chr(39) * 2 + ')')}, {_OP13_WORDS})"
    return f"""SELECT row_number() OVER () AS row, {'doc_id' if table == 'documents' else 'item_id'} AS id, w AS words,
  list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS features
FROM (SELECT *, {words} AS w FROM {table}) t"""


OP13_RESAMPLING = rf"""
WITH RECURSIVE crc_bit(i, c, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM crc_bit WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM crc_bit WHERE k = 8),
docs AS MATERIALIZED ({_op13_features('documents')}),
bench AS MATERIALIZED ({_op13_features('benchmark')}),
doc_feature AS MATERIALIZED (SELECT row, unnest(features) AS f FROM docs),
bench_feature AS MATERIALIZED (SELECT unnest(features) AS f FROM bench),
bucket_of AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT,
              list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::UBIGINT)),
            lambda a, b: xor(a // 256, tbl[(xor(a, b) % 256)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT f FROM doc_feature UNION SELECT f FROM bench_feature) u, crc_table),
s AS (SELECT bucket, COUNT(*) AS n FROM doc_feature JOIN bucket_of USING (f) GROUP BY bucket),
t AS (SELECT bucket, COUNT(*) AS n FROM bench_feature JOIN bucket_of USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT COUNT(*) FROM doc_feature) AS s_all, (SELECT COUNT(*) FROM bench_feature) AS t_all),
gains AS MATERIALIZED (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (s_all + 10000)
                              / (CAST(s.n + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (
  SELECT row, COUNT(*) AS n_features, SUM(gain) AS total
  FROM doc_feature JOIN bucket_of USING (f) JOIN gains USING (bucket) GROUP BY row),
rated AS (
  SELECT row, id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
         CAST(coalesce((total - (((total % n_features) + n_features) % n_features)) // n_features, 0) AS BIGINT) AS weight,
         CAST(('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), 'null')), 1, 8)) AS UBIGINT) AS h
  FROM docs LEFT JOIN weights USING (row)),
scores AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM rated),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, row) AS place,
         COUNT(*) OVER (PARTITION BY n_words >= 20) AS fit
  FROM scores)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= fit * 25 // 100 THEN place END AS rank
FROM ordered"""

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_RULES = {"mean_word_chars": "n_words > 0 AND NOT word_chars / n_words BETWEEN 2.0 AND 14.0 OR n_words = 0",
          "symbols_per_word": "n_words > 0 AND n_symbols / n_words > 0.2",
          "stop_ratio": "n_words = 0 OR n_stop / n_words < 0.02",
          "dup_line_ratio": "n_lines > 0 AND n_dup_lines / n_lines > 0.5",
          "upper_ratio": "word_chars > 0 AND n_upper / word_chars > 0.6"}

_WINDOW = " || ' ' || ".join(["word", *[f"lead(word, {i}) OVER o" for i in range(1, 8)]])

OP9_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
each_word AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
windows AS (SELECT row, pos, {_WINDOW} AS win FROM each_word WINDOW o AS (PARTITION BY row ORDER BY pos)),
repeated AS (
  SELECT row, pos FROM (SELECT row, pos, COUNT(*) OVER (PARTITION BY row, win) AS n FROM windows WHERE win IS NOT NULL) x WHERE n > 1),
covered AS (SELECT row, COUNT(DISTINCT p) AS n FROM (SELECT row, unnest(range(pos, pos + 8)) AS p FROM repeated) c GROUP BY row),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'),
                         lambda x: {_LOWER.format("x")} IN ({_STOP}))) AS n_stop,
         length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (row)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         list_filter([{", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _RULES.items())}],
                     lambda x: x IS NOT NULL) AS failed_rules FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules
FROM judged"""

ORACLES: dict[str, str] = {"op9_quality": OP9_QUALITY, "op13_resampling": OP13_RESAMPLING}
