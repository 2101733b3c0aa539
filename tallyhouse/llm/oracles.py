"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import ALTERING, GRAM, MAX_SHIFT, MIN_SCORE, PHRASES, SPELLINGS, TELLING, TEMPLATES
from .quality import MAX_HOST_RATE, MAX_PRIOR_WEIGHT, MAX_REPEATED_PERCENT, MIN_WORDS, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SEARCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {}

SQL["op1_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns),
states AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
sizes AS (
  SELECT *,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN 6 + length(role) ELSE NULL END AS header,
    length(text) + (length(text) - length(replace(text, '\', '')))
      + (length(text) - length(replace(text, '### ', ''))) / 4
      + (length(text) - length(replace(text, '</turn>', ''))) / 7 + 9 AS body,
    CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
      WHEN before = 'user' THEN role = 'assistant' ELSE false END AS fits
  FROM states
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(header + body)::BIGINT AS formatted_chars,
  bool_and(fits) AND arg_max(role, n) = 'assistant' AS valid
FROM sizes GROUP BY conv_id
"""

SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
twice AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
measured AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(twice.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN twice USING (r)
),
judged AS (
  SELECT source,
    unnest([{", ".join(f"{{'rule': '{r}', 'bad': {rule}}}" for r, rule in RULES.items())}]) AS outcome
  FROM measured
),
hosts AS (
  SELECT source, outcome.rule AS rule, count(*) AS n, count(*) FILTER (outcome.bad) AS failed
  FROM judged WHERE source IS NOT NULL GROUP BY ALL
),
totals AS (
  SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(failed) / sum(n) AS mean, sum(failed * failed / n) AS squares,
    sum(n * n) AS sizes FROM hosts GROUP BY rule
),
parts AS (
  SELECT *, mean * (1 - mean) AS chance,
    (squares - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / (docs - sizes / docs) AS between_hosts FROM totals
),
prior AS (
  SELECT rule, mean, CASE WHEN hosts > 1 AND between_hosts > 0
    THEN greatest(1.0, least({MAX_PRIOR_WEIGHT}, chance / between_hosts - 1)) ELSE {MAX_PRIOR_WEIGHT} END AS weight FROM parts
),
rates AS (SELECT source, rule, round((failed + weight * mean) / (n + weight), 9) AS rate FROM hosts JOIN prior USING (rule)),
verdicts AS (
  SELECT source, {", ".join(f"max(rate) FILTER (rule = '{r}') AS rate_{r}" for r in RULES)},
    concat_ws(',', {", ".join(f"max(CASE WHEN rule = '{r}' AND rate > {MAX_HOST_RATE} THEN '{r}' END)" for r in RULES)}) AS host_rules
  FROM rates GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_rules, '') = '' AS kept, {", ".join(f"rate_{r}" for r in RULES)}, coalesce(host_rules, '') AS host_rules
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM measured)
LEFT JOIN verdicts USING (source)
"""

SQL["op5_benchmark_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SEARCH_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_SEARCH_WORDS} AS words FROM benchmark),
items AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS gram
  FROM (
    SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i
    FROM b WHERE len(words) > 0
  )
),
grams AS (
  SELECT r, size, i, array_to_string(words[i : i + size - 1], ' ') AS gram
  FROM (
    SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i
    FROM d, (SELECT DISTINCT size FROM items) WHERE len(words) >= size
  )
),
hit AS (SELECT r, i, size, item_id FROM grams JOIN items USING (size, gram)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
found AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r
)
SELECT doc_id, len(d.words)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit,
  coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


def _rows(values: dict[str, str]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in values.items())


SQL["op7_license_scans"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SEARCH_WORDS} AS words FROM documents),
phrases AS (SELECT phrase, label, len(string_split(phrase, ' ')) AS size FROM (VALUES {_rows(PHRASES)}) v(phrase, label)),
templates AS (SELECT template, string_split(body, ' ') AS words FROM (VALUES {_rows(TEMPLATES)}) v(template, body)),
places AS (
  SELECT r, i - 1 AS pos, label
  FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d), phrases
  WHERE array_to_string(words[i : i + size - 1], ' ') = phrase
),
base AS (
  SELECT r, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, array_agg(DISTINCT label) AS labels FROM places GROUP BY r
),
grams AS (
  SELECT r, i - 1 AS place, array_to_string(words[i : i + {GRAM - 1}], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - {GRAM - 2})) AS i FROM d WHERE len(words) >= {GRAM})
),
template_grams AS (
  SELECT template, len(words) AS size, i - 1 AS pos, array_to_string(words[i : i + {GRAM - 1}], ' ') AS gram
  FROM (SELECT template, words, unnest(range(1, len(words) - {GRAM - 2})) AS i FROM templates)
),
votes AS (SELECT r, template, size, place - pos AS diagonal, pos FROM grams JOIN template_grams USING (gram)),
starts AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {MAX_SHIFT}
    THEN 1 ELSE 0 END AS start FROM votes
),
numbered AS (SELECT *, sum(start) OVER (PARTITION BY r, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS span FROM starts),
covered AS (SELECT r, template, size, span, diagonal, unnest(range(pos, pos + {GRAM})) AS p FROM numbered),
spans AS (
  SELECT r, template, span, round(count(DISTINCT p) / max(size), 6) AS score, max(size) AS size, min(diagonal) AS low,
    max(diagonal) AS high, min(p) AS first_at, max(p) AS last_at
  FROM covered GROUP BY r, template, span HAVING round(count(DISTINCT p) / max(size), 6) >= {MIN_SCORE}
),
spelled AS (SELECT spelling, whole FROM (VALUES {_rows(SPELLINGS)}) v(spelling, whole)),
altering AS (
  SELECT template, word FROM templates, (VALUES {", ".join(f"('{w}')" for w in ALTERING)}) a(word)
  UNION SELECT template, word FROM (VALUES {", ".join(f"('{t}', '{w}')" for t, ws in TELLING.items() for w in ws)}) t(template, word)
),
below AS (
  SELECT r, template, span, low, high, words[i + 1] AS word, words[i + 1] || ' ' || words[i + 2] AS pair, i AS place
  FROM (SELECT s.*, d.words, unnest(range(greatest(low, 0), least(high + size, len(d.words)))) AS i FROM spans s JOIN d USING (r))
),
shown AS (
  SELECT r, template, span, low, high, place, coalesce(two.whole, one.whole, word) AS word
  FROM below LEFT JOIN spelled one ON one.spelling = word LEFT JOIN spelled two ON two.spelling = pair
),
marks AS (SELECT shown.* FROM shown JOIN altering USING (template, word)),
own AS (
  SELECT template, word, i - 1 AS pos FROM (SELECT template, words, unnest(range(1, len(words) + 1)) AS i, words[i] AS word FROM templates)
  JOIN altering USING (template, word)
),
altered AS (
  SELECT r, template, span FROM marks m WHERE NOT EXISTS (
    SELECT 1 FROM own o WHERE o.template = m.template AND o.word = m.word AND m.place - o.pos BETWEEN m.low AND m.high)
  UNION
  SELECT r, s.template, span FROM spans s JOIN own o ON o.template = s.template AND o.pos BETWEEN s.first_at - {GRAM} AND s.last_at + {GRAM}
  WHERE NOT EXISTS (
    SELECT 1 FROM marks m WHERE m.r = s.r AND m.template = s.template AND m.span = s.span AND m.word = o.word
      AND m.place - o.pos BETWEEN s.low AND s.high)
),
best AS (
  SELECT r, max(score) AS score, array_agg(DISTINCT template) AS labels
  FROM (SELECT * FROM spans ANTI JOIN altered USING (r, template, span)) GROUP BY r
)
SELECT doc_id, len(d.words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_pos::BIGINT AS first_word,
  last_pos::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""
