"""The line-first rules of `quality_rules` in DuckDB SQL, with its default limits."""

from wardlens.llm.quality_rules import BOILERPLATE, Limits

_WORD = r"[^\x20\x09-\x0D]+"
_LIMITS = Limits()
_PHRASES = "|".join(BOILERPLATE)

QUALITY_SQL = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
parts AS (
    SELECT r, unnest(string_split(t, chr(10))) AS line,
           generate_subscripts(string_split(t, chr(10)), 1) AS place FROM docs),
lines AS (
    SELECT r, place, line, regexp_extract_all(line, '{_WORD}') AS words FROM parts),
judged AS (
    SELECT r, place, line, len(words) AS n, len(words) > 0 AND (
        100 * len(regexp_extract_all(line, '[!?#*$%&|<>~^=_{{}}\\]'))
            > {_LIMITS.marks_pct} * length(array_to_string(words, ''))
        OR (len(words) <= 2 AND NOT regexp_matches(line, '[.!?:;"'')\]][\x20\x09-\x0D]*\z'))
        OR (len(regexp_extract_all(line, '\|')) >= 2
            AND 5 * len(regexp_extract_all(line, '\|')) >= len(words))
        OR (len(words) <= {_LIMITS.boilerplate_words}
            AND regexp_matches(line, '(?i){_PHRASES}'))) AS fails
    FROM lines),
by_doc AS (
    SELECT r, count(*) FILTER (n > 0) AS n_lines,
           count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
           count(*) FILTER (fails) AS n_failed_lines,
           coalesce(sum(n) FILTER (fails), 0)::BIGINT AS n_failed_words,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT fails), '') AS clean
    FROM judged GROUP BY r),
words AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS w FROM docs),
windows AS (
    SELECT r, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM words),
texts AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM windows),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM texts)
          WHERE c >= 2),
covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS s(k) GROUP BY r),
measured AS (
    SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
           len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols, b.n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words, b.n_lines, b.n_failed_lines, b.n_failed_words,
           len(w.w) < {_LIMITS.min_words}
               OR 100 * coalesce(c.n, 0) > {_LIMITS.repeat_pct} * len(w.w) AS base_failed,
           sha256(b.clean) AS clean_sha256
    FROM docs d JOIN words w USING (r) JOIN by_doc b USING (r) LEFT JOIN covered c USING (r))
SELECT *, NOT base_failed AND 100 * n_failed_words <= {_LIMITS.loss_pct} * n_words AS kept
FROM measured
"""
