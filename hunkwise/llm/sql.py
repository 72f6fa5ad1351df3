"""Queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op2_minhash_near_dedup"] = f"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM words)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT x.a, x.b FROM (
        SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id
        GROUP BY 1, 2
    ) x JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b
    WHERE 100 * x.both >= 75 * (m.n + n.n - x.both)
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), lowest AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l ON d.doc_id = l.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""

ORACLE["op6_line_dedup"] = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE["op8_chat_formatting"] = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
    SELECT *, length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) +
              length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + 24 AS chars FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE["op11_phrase_mining"] = f"""
WITH pieces AS MATERIALIZED (
    SELECT row_number() OVER () AS id, lang, piece FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), split AS MATERIALIZED (
    SELECT id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS MATERIALIZED (
    SELECT lang, size, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS size, unnest(w) AS phrase FROM split
        UNION ALL
        SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 1)) AS i FROM split)
        UNION ALL
        SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]
        FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split)
    ) GROUP BY ALL
), found AS MATERIALIZED (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, a, size, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM found
    UNION ALL SELECT lang, phrase, a, size, 2, w[1] || ' ' || w[2], w[3] FROM found WHERE size = 3
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
           ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first AND x.size = c.k
    JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest AND y.size = c.size - c.k
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM found WHERE size = 3
        UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM found WHERE size = 3
    ) GROUP BY ALL
), kept AS (
    SELECT s.* FROM weakest s LEFT JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase
    WHERE c.longer IS NULL OR 100 * c.longer < 50 * s.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r
JOIN (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang) t ON t.lang = r.lang
WHERE r.rank <= 2000
"""

ORACLE["op12_target_resampling"] = f"""
WITH RECURSIVE bits AS (
    SELECT n, n AS c, 0 AS turn FROM range(256) t(n)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, turn + 1 FROM bits WHERE turn < 8
), crc AS MATERIALIZED (
    SELECT list(c ORDER BY n) AS t FROM bits WHERE turn = 8
), words AS MATERIALIZED (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), grams AS MATERIALIZED (
    SELECT kind, id, g, count(*) AS n FROM (
        SELECT kind, id, unnest(w) AS g FROM words
        UNION ALL
        SELECT kind, id, w[i] || ' ' || w[i + 1] FROM (SELECT kind, id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM words)
    ) GROUP BY ALL
), bucketed AS MATERIALIZED (
    SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(hex(encode(g))), 2),
           lambda i: ('0x' || substr(hex(encode(g)), i::INT + 1, 2))::BIGINT)),
           lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]::BIGINT)), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT g FROM grams), crc
), counts AS MATERIALIZED (
    SELECT b.bucket, coalesce(sum(n) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 't'), 0) AS t
    FROM grams JOIN bucketed b USING (g) GROUP BY b.bucket
), gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                                   / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weighed AS (
    SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
    FROM grams JOIN bucketed USING (g) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS MATERIALIZED (
    SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words d LEFT JOIN weighed USING (id) WHERE d.kind = 'd'
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score,
       CASE WHEN r.rank <= (SELECT 25 * count(*) // 100 FROM ranked) THEN r.rank END AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)
"""
