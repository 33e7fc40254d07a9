"""The same results in DuckDB SQL, where SQL can express them."""

OP1 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT rid, p, list_aggregate(ws[p + 1 : p + 5], 'string_agg', ' ') AS g
  FROM (SELECT rid, ws, unnest(range(0, greatest(len(ws) - 4, 0))) AS p FROM w)),
dup AS (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt
        FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - p, 5)))::BIGINT AS n_repeat_words FROM dup GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS word_chars_,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (
  SELECT * EXCLUDE (word_chars_), coalesce(word_chars_, 0)::BIGINT AS word_chars FROM m),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS failure_bits
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed,
       failure_bits = 0 AS kept, n_lines, n_upper, failure_bits
FROM f
"""

ABLATIONS = f"""
WITH bits AS (SELECT failure_bits AS b FROM ({OP1})),
rules AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'duplicate_lines', 'word_length', 'shouting']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, count_if(b & bit <> 0)::BIGINT AS n_failed, count_if(b = bit)::BIGINT AS n_only_this, count_if(b & ~bit = 0)::BIGINT AS n_kept_without
FROM rules, bits GROUP BY rule
"""

OP3 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '<null>') || chr(1) || coalesce(turn::VARCHAR, '<null>') || chr(1) || coalesce(text, '<null>') || chr(2) AS k,
         '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(k, '' ORDER BY place) AS k, string_agg(s, '' ORDER BY place) AS rendered
  FROM t GROUP BY conv_id),
one AS (SELECT k, n_turns, rendered, min(conv_id) AS conv_id, count(*)::BIGINT AS n_logged FROM c GROUP BY k, n_turns, rendered)
SELECT conv_id, n_turns, n_logged, rendered FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND starts_with(b.k, a.k))
"""

OP7 = r"""
WITH norm AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, list_aggregate(ws[p + 1 : p + 10], 'string_agg', ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS p FROM norm WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (
  SELECT rid, k, p, list_aggregate(ws[p + 1 : p + k], 'string_agg', ' ') AS g
  FROM (SELECT rid, ws, k, unnest(range(0, len(ws) - k + 1)) AS p
        FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
hit AS (SELECT DISTINCT rid, p, dw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
words AS (SELECT rid, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS x FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""

OP11 = r"""
WITH rules AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
  (1, 'access', '(AKIA[A-Z0-9]+)', 16),
  (2, 'hex', '([0-9a-f]+)', 32),
  (3, 'private_key', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1),
  (4, 'prefixed_token', '((?:gh[opsur]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+)', 20),
  (5, 'signed_token', '(eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,})', 1),
  (6, 'url_login', '([a-z]{1,16}://[^\s/:@]{1,128}:[^\s/:@]{1,128}@)', 1)) r(rank, kind, pattern, least)),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
cut AS (
  SELECT rid, rank, kind, least, regexp_split_to_array(text, pattern) AS gaps,
         regexp_extract_all(text, pattern, 0) AS found, regexp_extract_all(text, pattern, 1) AS parts
  FROM d, rules),
m AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut WHERE len(found) > 0),
s AS (
  SELECT rid, rank, kind, length(array_to_string(gaps[1:i], '') || array_to_string(found[1:i - 1], '')) AS b, length(found[i]) AS size
  FROM m WHERE length(parts[i]) >= least),
g AS (
  SELECT rid, count_if(rank = 0)::BIGINT AS n_assign, count_if(rank = 1)::BIGINT AS n_access, count_if(rank = 2)::BIGINT AS n_hex,
         coalesce(string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, rank) FILTER (WHERE rank < 3), '') AS base,
         string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, rank) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, blob
FROM d LEFT JOIN g USING (rid)
"""

OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[p:p + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
sized AS (
  SELECT cut.lang, cut.k, cut.phrase, a, j, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
  FROM cut JOIN n USING (lang)
  JOIN f x ON x.lang = cut.lang AND x.k = j AND x.phrase = array_to_string(ws[1:j], ' ')
  JOIN f y ON y.lang = cut.lang AND y.k = cut.k - j AND y.phrase = array_to_string(ws[j + 1:cut.k], ' ')),
scored AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = s.lang AND c.k > s.k AND 100 * c.a >= 100 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def _op13() -> str:
    """A recursive walk over each conversation's rows with the best (cost, audit, text) of each state of the pattern."""
    far = 10**9  # dearer than any path: a state that is not reached

    def step(state: str, cost: str, letter: str, said: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {said}}}"

    def line(role: str, text: str = "text") -> str:
        return f"chr(10) || {role} || ':' || {text}"

    insert = lambda v: step(v, "3", "I", line("'assistant'" if v == "v2" else "'user'", "''"))
    none = f"{{'c': {far}::BIGINT, 'a': '', 't': ''}}"
    gap = f"v0, v1, least(v2, {insert('v0')}, {insert('v1')}, {insert('v3')}) AS v2, least(v3, {insert('v2')}) AS v3"
    extra = "(CASE WHEN truncated THEN 3 ELSE 0 END)"
    delete = lambda v: step(v, "4", "D", "''")
    rerole = lambda v: step(v, f"(CASE WHEN free THEN 3 + {extra} ELSE {far} END)", "R", line("'assistant'" if v == "v2" else "'user'"))
    keep = lambda v, i: step(v, f"(CASE WHEN free AND initial = '{i}' THEN {extra} ELSE {far} END)", "K", line("role"))
    w2 = ", ".join(f"{rerole(v)}, {keep(v, 'u')}" for v in ("v0", "v1", "v3"))
    row = f"{delete('v0')} AS v0, least({delete('v1')}, {keep('v0', 's')}) AS v1, least({delete('v2')}, {w2}) AS v2, least({delete('v3')}, {rerole('v2')}, {keep('v2', 'a')}) AS v3"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce('=' || conv_id, '') AS conv,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
crc AS (
  SELECT * EXCLUDE (bytes), xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b:
    list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS code
  FROM k),
d AS (
  SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END))
  FROM crc WHERE code <> 0),
o AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, role[1:1] AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS trunc,
         lag(role[1:1]) OVER (PARTITION BY conv ORDER BY i) || role[1:1] AS pair
  FROM o),
r AS (SELECT *, NOT (blank OR seen) AS free, trunc AS truncated FROM f),
dp AS (
  SELECT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v0, {none} AS v1, {none} AS v2, {none} AS v3 FROM (SELECT DISTINCT conv FROM r)
  UNION ALL
  SELECT conv, i, {row} FROM (SELECT r.conv, r.i, r.role, r.text, r.initial, r.free, r.truncated, {gap} FROM dp JOIN r ON r.conv = dp.conv AND r.i = dp.i + 1)),
c AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
         count_if(seen AND NOT blank)::BIGINT AS duplicate, count_if(free AND truncated)::BIGINT AS truncated,
         count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM r GROUP BY conv),
best AS (SELECT c.*, least(v0, v3, {insert('v2')}) AS b FROM c JOIN dp ON dp.conv = c.conv AND dp.i = c.n)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM k) LEFT JOIN best USING (conv)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1, "quality_ablations": ABLATIONS, "op3_chat_formatting": OP3, "op7_decontamination": OP7, "op10_warc": OP10, "op11_secret_scans": OP11, "op12_collocations": OP12,
        "op13_structure_repair": _op13(),
    }
