"""What the queries over whole tables should return, in SQL that DuckDB runs, each in the plain way."""

from __future__ import annotations

from recollect.llm import codes, rules, spelling
from recollect.llm.common import WORD

# CRC-32 by its definition: a table of 256 entries from the polynomial, then byte by byte. Two words
# are one edit apart if one is the other less a letter, or both are equal less the letter at one place.
SPELLINGS = f"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {spelling.LEAST_LENGTH}),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(1, 1 + strlen(id || ':' || run)), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i - 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM counted, bytes),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % {spelling.NOISE} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {spelling.LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
less AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
half AS (
  SELECT l.word AS a, w.word AS b FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
near AS (
  SELECT a, count(*) AS n_near, max(w.n) AS form_n, arg_min(b, struct_pack(m := -w.n, b := b)) AS form
  FROM half JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.RATIO} * n THEN form END AS form, CASE WHEN form_n >= {spelling.RATIO} * n THEN form_n END AS form_n
  FROM words LEFT JOIN near ON a = word),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, c.root, n, n_near, form_n
FROM forms f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""

_SPACE = r"[\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"

RULES = rf"""
WITH given AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS body FROM documents),
cut AS MATERIALIZED (
  SELECT uid, doc_id, body, regexp_extract_all(body, '{WORD}') AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM given),
starts AS (SELECT uid, unnest(range(1, len(w) - {rules.RUN - 2})) AS i, w FROM cut WHERE len(w) > {rules.RUN}),
windows AS (SELECT uid, i, concat_ws(' ', {", ".join(f"w[i + {k}]" for k in range(rules.RUN))}) AS x FROM starts),
twice AS (SELECT uid, unnest(list(i)) AS i FROM windows GROUP BY uid, x HAVING count(*) > 1),
again AS (SELECT uid, count(*) AS n FROM (SELECT DISTINCT uid, i + k AS p FROM twice, range({rules.RUN}) r(k)) GROUP BY uid),
made AS (
  SELECT doc_id, body, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(body, '{_SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS lines,
    len(regexp_extract_all(body, '\p{{L}}')) AS letters, len(regexp_extract_all(body, '\p{{Lu}}')) AS capitals,
    len(regexp_extract_all(body, '(?m)(\.\.\.|…)[ \t\r]*$')) AS breaks, len(regexp_extract_all(body, '[!?]{{2}}')) AS marks
  FROM cut LEFT JOIN again USING (uid)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM made)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_dup_lines * 10 > lines * 3
    OR letters * 2 < word_chars OR (capitals * 2 > letters AND letters > 0) OR breaks * 10 > lines * 3 OR marks * 10 > n_words) AS kept
FROM based
"""


def _codes() -> str:
    """Rounds spelt out one after the other."""
    steps = [
        f"""rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {codes.SCALE:.0f}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT uid, vec_id, label, v, p, list_slice(v, p * (len(v) // {codes.PARTS}) + 1, (p + 1) * (len(v) // {codes.PARTS})) AS x
  FROM rows_, range({codes.PARTS}) r(p)),
first_ AS (SELECT uid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM rows_ QUALIFY e < {codes.ENTRIES}),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN first_ USING (uid))"""
    ]
    near = """near{0} AS MATERIALIZED (
  SELECT uid, p, e, d, x FROM (
    SELECT uid, p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN book{0} USING (p))
  QUALIFY row_number() OVER (PARTITION BY uid, p ORDER BY d, e) = 1)"""
    moved = """moved{1} AS (
  SELECT p, e, list(CAST(m AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM near{0}, range(1, 65) r(i) WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e),
book{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{0} b LEFT JOIN moved{1} m USING (p, e))"""
    for i in range(codes.ROUNDS):
        steps += [near.format(i), moved.format(i, i + 1)]
    last = codes.ROUNDS
    steps.append(near.format(last))
    steps.append(
        f"""coded AS (
  SELECT uid, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY uid),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM book{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM coded JOIN rows_ USING (uid), books"""
    )
    return "WITH " + ",\n".join(steps)


CODES = _codes()
