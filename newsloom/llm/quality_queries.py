from newsloom.llm.quality_rules import LINE_PERCENT, MIN_WORDS, NGRAM_PERCENT, REPEAT_PERCENT, quality_report
from newsloom.llm.registry import query, table

NGRAMS = ", ".join(f"({n}, {p})" for n, p in NGRAM_PERCENT.items())

CHECK = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), pos AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
grams AS (
  SELECT doc_id, n, i, g,
    count(*) OVER (PARTITION BY doc_id, n, g) AS times,
    row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS copy
  FROM (
    SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
          FROM w, (VALUES (3), (5), (6), (7), (8), (9), (10)) s(n))
  )
),
repeated AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM grams WHERE n = 3 AND times > 1) GROUP BY 1
),
covered AS (
  SELECT c.doc_id, n, sum(length(word)) AS chars FROM (
    SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM grams WHERE n > 3 AND copy > 1) c
  JOIN pos USING (doc_id, i) GROUP BY 1, 2
),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS copy,
    list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS dup_line_chars FROM lines WHERE copy > 1 GROUP BY 1),
chars AS (SELECT doc_id, sum(length(word)) AS word_chars FROM pos GROUP BY 1),
base AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(dup_line_chars, 0) AS dup_line_chars
  FROM w LEFT JOIN chars USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN dup USING (doc_id)
),
bad AS (
  SELECT DISTINCT b.doc_id FROM base b, (VALUES {NGRAMS}) t(n, percent)
  LEFT JOIN covered c ON c.doc_id = b.doc_id AND c.n = t.n
  WHERE 100 * coalesce(chars, 0) > percent * word_chars OR 100 * dup_line_chars > {LINE_PERCENT} * word_chars
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
    AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM base
"""


@query("op7_repetition_coverage", CHECK)
def op7_repetition_coverage(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents")).drop("dup_line_chars", "dup_ngram_chars")
