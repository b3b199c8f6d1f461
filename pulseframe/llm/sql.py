"""DuckDB SQL for the queries that SQL can express."""

_LINES = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS no, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
),
firsts AS (
  SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM lines
  WHERE regexp_matches(line, '[^\p{Z}\x09-\x0D\x{85}]') GROUP BY line
),
longer AS (SELECT * FROM firsts WHERE n >= 20),
met AS (
  SELECT a.line, a.first, b.line AS other, b.first AS other_first FROM longer a JOIN longer b
    ON a.n = b.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
  UNION ALL
  SELECT a.line, a.first, b.line, b.first FROM longer a JOIN longer b
    ON a.n = b.n AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)
  UNION ALL
  SELECT a.line, a.first, b.line, b.first FROM longer a JOIN longer b
    ON a.n = b.n - 1 AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
  UNION ALL
  SELECT a.line, a.first, b.line, b.first FROM longer a JOIN longer b
    ON a.n = b.n - 1 AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)
),
near AS (
  SELECT DISTINCT CASE WHEN other_first < first THEN line ELSE other END AS line
  FROM met WHERE line <> other AND levenshtein(line, other) <= 1
),
kept AS (
  SELECT l.doc_id, l.no, l.line,
         f.line IS NOT NULL AND (near.line IS NOT NULL OR (l.doc_id, l.no) <> f.first) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near ON l.line = near.line
)
"""

_LINE_DEDUP = _LINES + """
SELECT d.doc_id,
       CASE WHEN coalesce(k.removed, 0) = 0 THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(k.removed, 0)::BIGINT AS n_lines_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS removed
  FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id
"""

#: Of the template only the lengths matter here: 8 + 8 + 7 characters of marks for each turn, and a backslash after each
#: of three signs.
_CHAT = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
),
sized AS (
  SELECT *, 23 + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g'))
            + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS chars FROM turns
),
reach AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
         max(k) OVER (PARTITION BY conv_id) AS last FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR k = last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM reach GROUP BY conv_id
"""

_TOP_K = """
WITH rows AS (
  SELECT vec_id, min([floor(64 * x::DOUBLE) for x in embedding]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
  GROUP BY vec_id
),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CASE WHEN len(q.v) = 0 OR len(r.v) = 0 THEN 0 ELSE list_inner_product(q.v, r.v) END::BIGINT AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: The CRC-32 of each distinct word goes through its bytes one by one; the table has the CRC of each byte.
_IMPORTANCE = r"""
WITH RECURSIVE bits AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
bytes AS (SELECT n, c FROM bits WHERE k = 8),
own AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
sought AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
),
found AS (SELECT r, unnest(words) AS word FROM own),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM found UNION SELECT word FROM sought)),
crc AS (
  SELECT word, h, 0 AS i, 4294967295::BIGINT AS c FROM spelt
  UNION ALL
  SELECT word, h, i + 1, xor(crc.c // 256, bytes.c)
  FROM crc JOIN bytes ON bytes.n = xor(crc.c % 256, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)
  WHERE 2 * i < length(h)
),
bucket AS (SELECT word, xor(c, 4294967295) % 10000 AS b FROM crc WHERE 2 * i = length(h)),
source AS (SELECT b, count(*) AS s FROM found JOIN bucket USING (word) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM sought JOIN bucket USING (word) GROUP BY b),
sums AS (SELECT (SELECT count(*) FROM found)::DOUBLE AS s, (SELECT count(*) FROM sought)::DOUBLE AS t),
gain AS (
  SELECT b, floor(1000 * ln(((coalesce(target.t, 0) + 1)::DOUBLE * (sums.s + 10000))
                            / ((coalesce(source.s, 0) + 1)::DOUBLE * (sums.t + 10000))))::BIGINT AS g
  FROM source FULL JOIN target USING (b), sums
),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM found JOIN bucket USING (word) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM own LEFT JOIN weights USING (r)
),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n
           FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

ORACLE: dict[str, str] = {"op1_line_dedup": _LINE_DEDUP, "op4_chat": _CHAT, "op5_topk": _TOP_K, "op13_importance": _IMPORTANCE}
