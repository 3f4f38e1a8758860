"""SQL of the queries whose definitions are too long to stand beside them: repeated strings, conversation repair and quality rules, from their definitions."""

from __future__ import annotations

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit (fixed values: the reversed polynomial and all ones)."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {bits}), 4294967295)"


def _more(state: str, cost: str | int, edit: str) -> str:
    """A state is its cost in nine digits and its edits: least() takes the cheapest, and of these the first in ASCII order."""
    return f"(lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{edit}')"


def _step() -> str:
    keep = lambda states: "least(" + ", ".join(_more(s, "t", "K") for s in states) + ")"
    made = lambda states: "least(" + ", ".join(_more(s, "2 + t", "R") for s in states) + ")"
    ends = {
        "n0": _more("s0", 3, "D"),
        "n1": f"least({_more('s1', 3, 'D')}, CASE WHEN NOT forced AND initial = 's' THEN {keep(['s0'])} END)",
        "n2": f"least({_more('s2', 3, 'D')}, CASE WHEN NOT forced AND initial = 'u' THEN {keep(['s0', 's1', 's3'])} END, CASE WHEN NOT forced THEN {made(['s0', 's1', 's3'])} END)",
        "n3": f"least({_more('s3', 3, 'D')}, CASE WHEN NOT forced AND initial = 'a' THEN {keep(['s2'])} END, CASE WHEN NOT forced THEN {made(['s2'])} END)",
    }
    second = f"least(n2, {_more('n0', 2, 'I')}, {_more('n1', 2, 'I')}, {_more('n3', 2, 'I')})"
    rows = "SELECT p.conv_id, r.i, p.s0, p.s1, p.s2, p.s3, r.initial, r.forced, r.t FROM walk p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1"
    after = f"SELECT conv_id, i, {', '.join(f'{x} AS {n}' for n, x in ends.items())} FROM ({rows})"
    return f"SELECT conv_id, i, n0, n1, m2, least(n3, {_more('m2', 2, 'I')}) FROM (SELECT *, {second} AS m2 FROM ({after}))"


#: Row by row: the cheapest edits to each of the four states, as strings.
CONVERSATIONS = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), faulty AS (
  SELECT *, {crc32('key')} % 20 AS fault FROM src
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM faulty WHERE fault <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, NOT regexp_matches(text, '{WORD}') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D]){SPACE}*$', 1) NOT IN ('.', '!', '?') AS cut FROM numbered
), r AS (
  SELECT *, blank OR again AS forced, CASE WHEN NOT blank AND NOT again AND cut THEN 1 ELSE 0 END AS t FROM marked
), walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000002I', '000000004II' FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL {_step()}
), best AS (
  SELECT conv_id, CAST(left(b, 9) AS BIGINT) AS cost, substr(b, 10) AS audit FROM (SELECT conv_id, least(arg_max(s0, i), arg_max(s3, i)) AS b FROM walk GROUP BY conv_id)
), edits AS (
  SELECT conv_id, k, substr(audit, k, 1) AS e FROM (SELECT *, unnest(generate_series(1, length(audit))) AS k FROM best)
), placed AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM edits
), stays AS (
  SELECT p.conv_id, p.k, p.e, r.role, r.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.k) AS j, first_value(p.e = 'K' AND r.initial = 's') OVER (PARTITION BY p.conv_id ORDER BY p.k) AS led
  FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND p.e <> 'I' WHERE p.e <> 'D'
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j % 2 = 1) = coalesce(led, false) THEN 'assistant' ELSE 'user' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS repaired FROM stays GROUP BY conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, CAST(sum(t) AS BIGINT) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT b.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, b.cost, b.audit, sha256(coalesce(l.repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def at_most(k: str, n: str, p: str) -> str:
    """Probability of k or fewer out of n at the rate p."""
    return f"list_sum(list_transform(generate_series(0, {k}), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


#: All labelled rows beside every cutoff of the ladder.
QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS key FROM (SELECT r, words, unnest(generate_series(1, len(words) - 4)) AS i FROM d WHERE len(words) > 4)
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, key) AS times FROM windows) WHERE times > 1) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY r
), c AS (
  SELECT d.r, d.doc_id, d.lang, len(d.words) AS n_words, length(regexp_replace(d.text, '{SPACE}+', '', 'g')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_lines, coalesce(l.again, 0) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words FROM d LEFT JOIN lines l ON l.r = d.r LEFT JOIN repeats x ON x.r = d.r
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN least(1000, 1000 * n_symbols // word_chars) ELSE 0 END AS symbols, CASE WHEN n_words > 0 THEN least(1000, 10 * word_chars // n_words) ELSE 0 END AS word_length,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats FROM c
), known AS (
  SELECT v.*, {crc32('CAST(v.doc_id AS VARCHAR)')} % 4 = 0 AS fit, m.quality > 0 AS good FROM v JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) m ON m.doc_id = v.doc_id AND m.quality IS NOT NULL WHERE NOT base_failed
), long AS (
  SELECT lang, fit, good, unnest(['symbols', 'word_length', 'dup_lines', 'repeats']) AS rule, unnest([symbols, word_length, dup_lines, repeats]) AS value FROM known
), limits AS (
  SELECT 0.02 / 4 AS most, 0.05 / (4 * count(DISTINCT lang)) AS delta FROM known
), ladder AS (
  SELECT DISTINCT lang, rule, vs[CAST(ceil(j * len(vs) / 16.0) AS BIGINT)] AS c FROM (SELECT lang, rule, list_sort(list(value)) AS vs FROM long WHERE fit AND NOT good GROUP BY ALL), generate_series(1, 16) g(j)
), tried AS (
  SELECT t.lang, t.rule, t.c, count(*) FILTER (NOT fit AND good) AS n, count(*) FILTER (NOT fit AND good AND value >= c) AS k, count(*) FILTER (NOT fit AND NOT good) AS low, count(*) FILTER (NOT fit AND NOT good AND value >= c) AS caught,
    count(*) FILTER (fit AND NOT good AND value >= c) AS found FROM ladder t JOIN long ON long.lang = t.lang AND long.rule = t.rule WHERE t.c > 0 GROUP BY ALL
), held AS (
  SELECT *, n > 0 AND k <= n * most AND {at_most('k', 'n', 'most')} <= delta AS certified, low > 0 AND caught > low * most AND {at_most('low - caught', 'low', '(1 - most)')} <= delta AS useful FROM tried, limits
), fine AS (
  SELECT * FROM (SELECT *, bool_and(certified) OVER (PARTITION BY lang, rule ORDER BY c DESC) AS so_far FROM held) WHERE so_far AND useful
), cut AS (
  SELECT lang, rule, max(c) AS c FROM (SELECT *, max(found) OVER (PARTITION BY lang, rule) AS most_found FROM fine) WHERE found >= 0.95 * most_found GROUP BY lang, rule
)
SELECT v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed, NOT v.base_failed AND NOT coalesce(bool_or(CASE cut.rule WHEN 'symbols' THEN symbols WHEN 'word_length' THEN word_length WHEN 'dup_lines' THEN dup_lines ELSE repeats END >= cut.c), false) AS kept
FROM v LEFT JOIN cut ON cut.lang = v.lang GROUP BY v.r, v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed
"""

#: Every string of 50 bytes (as hexadecimal digits) with the smallest doc_id that has it.
REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), block AS (
  SELECT r, doc_id, b, substr(h, 2 * b + 1, 2 * (512 + 49)) AS part FROM (SELECT *, unnest(range(0, length(h) // 2, 512)) AS b FROM d)
), w AS (
  SELECT r, doc_id, b + k AS i, substr(part, 2 * k + 1, 100) AS key FROM (SELECT *, unnest(range(0, least(512, length(part) // 2 - 49))) AS k FROM block WHERE length(part) > 98)
), hit AS (
  SELECT w.r, w.i FROM w JOIN (SELECT key, min(doc_id) AS least FROM w GROUP BY key HAVING max(doc_id) > min(doc_id)) f ON f.key = w.key WHERE w.doc_id > f.least
), run AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CASE WHEN i <= last + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS no FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM hit)) GROUP BY r, no
), kept AS (
  SELECT d.r, run.a AS place, substr(d.h, 2 * coalesce(lag(run.b) OVER (PARTITION BY d.r ORDER BY run.a), 0) + 1, 2 * (run.a - coalesce(lag(run.b) OVER (PARTITION BY d.r ORDER BY run.a), 0))) AS part FROM d JOIN run ON run.r = d.r
  UNION ALL SELECT d.r, length(d.h), substr(d.h, 2 * coalesce(e.b, 0) + 1) FROM d LEFT JOIN (SELECT r, max(b) AS b FROM run GROUP BY r) e ON e.r = d.r
), joined AS (
  SELECT r, string_agg(part, '' ORDER BY place) AS h FROM kept GROUP BY r
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(s.removed, 0) AS n_removed, coalesce(s.n, 0) AS n_spans, sha256(unhex(j.h)) AS kept_sha256
FROM d JOIN joined j ON j.r = d.r LEFT JOIN (SELECT r, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS n FROM run GROUP BY r) s ON s.r = d.r
"""
