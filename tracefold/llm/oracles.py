"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from tracefold.llm import quality

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOW)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def divergence(counts: str, shares: list[float]) -> str:
    refs = "[" + ", ".join(f"{x!r}::DOUBLE" for x in shares) + "]"
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / {1}) ELSE 0 END"
    each = f"list_transform(list_zip(list_transform({counts}, lambda c: c / list_sum({counts})), {refs}), lambda z: {term.format('z[1]', '((z[1] + z[2]) / 2)')} + {term.format('z[2]', '((z[1] + z[2]) / 2)')})"
    return f"sqrt(greatest(0, list_sum({each}) / 2))"


def op4() -> str:
    by_lang = []
    for lang, listed in quality.COMMON_WORDS.items():
        common = "[" + ", ".join(f"'{x}'" for x in listed.split()) + "]"
        each = f"list_transform({common}, lambda k: len(list_filter(w, lambda x: lower(x) = k))::DOUBLE)"
        counts = f"list_append({each}, len(w) - list_sum({each}))"
        by_lang.append((lang, divergence(counts, quality.word_shares(lang))))
    chosen = " ".join(f"WHEN lang = '{k}' THEN {x}" for k, x in by_lang)
    removed = r"regexp_replace(text, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+', '', 'g')"
    kind = "length(regexp_replace(rest, '[{}]+', '', 'g'))"
    upper, digit, blank, mark = (f"length(rest) - {kind.format(chr(92) + 'p{Lu}')}", kind.format("^0-9"), kind.format(r"^ \t-\r"), kind.format(r"^.,;:!?''\"()-"))
    parts = f"[(length(text) - length(rest))::DOUBLE, ({upper})::DOUBLE, ({digit})::DOUBLE, ({blank})::DOUBLE, ({mark})::DOUBLE, (length(rest) - ({upper}) - {digit} - {blank} - {mark})::DOUBLE]"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT *, {removed} AS rest, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM t WHERE len(w) > 3),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS k FROM d, (VALUES (0), (1), (2)) AS v(j) GROUP BY doc_id),
c AS (SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r.k, 0)::BIGINT AS n_repeat_words,
        CASE WHEN length(text) >= {quality.MIN_CHARS} THEN {divergence(parts, list(quality.CLASS_SHARES))} ELSE 0 END AS cd,
        CASE WHEN len(w) >= {quality.MIN_WORDS} THEN CASE {chosen} ELSE least({", ".join(x for _, x in by_lang)}) END ELSE 0 END AS wd
      FROM b LEFT JOIN r ON r.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND cd <= {quality.MAX_CLASS_DISTANCE} AND wd <= {quality.MAX_WORD_DISTANCE} AS kept FROM c
"""


OP8_CTES = f"""
u AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM u GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM a),
q AS (SELECT *, ([5, 2, 1])[1 + rank % 3] AS weight FROM k),
f AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM q),
v AS (SELECT arg_min(lv, cap / weight) AS level FROM f WHERE source_size > 0 AND cap >= weight * lv),
s AS (SELECT source, rank, weight, source_size, level, least(cap::DOUBLE, weight * coalesce(level, 0)) AS target FROM q, v),
o AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM u),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS own FROM o),
y AS (SELECT x.*, rank, e.epoch, (e.epoch * source_size + own)::DOUBLE / weight AS finish FROM x JOIN s ON s.source IS NOT DISTINCT FROM x.source, (VALUES (0), (1), (2)) AS e(epoch) WHERE size > 0),
z AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS done FROM y),
m AS (SELECT doc_id, source, sum(size) AS taken FROM z WHERE done <= (SELECT sum(size) FROM u) GROUP BY doc_id, source)
"""
OP8 = f"""WITH {OP8_CTES}
SELECT u.doc_id, u.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM u JOIN s ON s.source IS NOT DISTINCT FROM u.source
  LEFT JOIN m ON m.doc_id IS NOT DISTINCT FROM u.doc_id AND m.source IS NOT DISTINCT FROM u.source
"""

SAID = "'<|im_end|><|im_start|>assistant ok'"
OP9 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {SAID} UNION ALL SELECT -1, 1, 'assistant', {SAID})
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '<\\*\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to FROM m
"""

OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM w WHERE len(w) >= 13),
h AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS head FROM g) WHERE head < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM h, range(13) AS r(j)),
k AS (SELECT doc_id, count(*)::BIGINT AS n, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN k.n IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(k.gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

ORACLES = {"op1_ngram_join": OP1, "op4_quality_rules": op4(), "op8_source_mixing": OP8, "op9_chat_formatting": OP9, "op7_warc": OP7, "op10_substring_dedup": OP10}
