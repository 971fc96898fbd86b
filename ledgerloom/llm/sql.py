"""SQL statements of the corpus queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"


def _letters(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + _letters("api") + "_?" + _letters("key")
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

# place, kind, pattern, group whose length counts, least length
_KINDS = (
    (1, "assign", _ASSIGN, 2, 6),
    (2, "access", "AKIA[A-Z0-9]+", 0, 20),
    (3, "hex", "[0-9a-f]+", 0, 24),
    (4, "github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    (5, "jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    (6, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)

_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS g, "
    f"regexp_split_to_array(t, '{p}') AS p, {least} AS least FROM d"
    for k, kind, p, g, least in _KINDS
)

SECRETS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
each AS (SELECT r, k, kind, m, g, p, least, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT r, k, kind, s, s + length(m[i]) AS e FROM (
    SELECT *, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
    FROM each) WHERE length(g[i]) >= least),
lines AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lines USING (r)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS pos FROM windows JOIN twice USING (h), range(35) AS t(k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_CONTROL = "<|im_end|><|im_start|>assistant ok"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}'),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
    sum(24 + length(url_encode(role)) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars,
    string_agg(role, ' ' ORDER BY turn, role, text) AS roles
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  CASE roles WHEN 'user assistant' THEN 'prompt' WHEN 'system user assistant' THEN 'instruction' ELSE 'messages' END AS mapping
FROM whole
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d),
held AS (
  SELECT r, doc_id, pos, trim(line, {_BLANK}) AS s, row_number() OVER (PARTITION BY r ORDER BY pos) AS k
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
stretches AS (
  SELECT r, doc_id, k, md5(s || chr(10) || lead(s, 1) OVER o || chr(10) || lead(s, 2) OVER o || chr(10) || lead(s, 3) OVER o || chr(10) || lead(s, 4) OVER o) AS h
  FROM held WINDOW o AS (PARTITION BY r ORDER BY k)),
later AS (SELECT r, k FROM (SELECT r, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM stretches WHERE h IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT held.r, held.pos FROM later, range(5) AS t(i), held WHERE held.r = later.r AND held.k = later.k + i),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_UPPER = "".join(chr(c) for c in range(65, 91))


def _grams(words: int) -> str:
    return (
        f"SELECT lang, {words} AS words, unnest(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) AS phrase "
        f"FROM pieces WHERE len(w) >= {words}"
    )


def _cut(k: int) -> str:
    return f"SELECT lang, phrase, a, {k} AS k, array_to_string(w[:{k}], ' ') AS left_part, array_to_string(w[{k + 1}:], ' ') AS right_part FROM kept WHERE words > {k}"


COLLOCATIONS = rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
split AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS n, string_split(phrase, ' ') AS w
  FROM ({" UNION ALL ".join(_grams(k) for k in (1, 2, 3, 4))}) GROUP BY lang, words, phrase HAVING count(*) >= 30),
inside AS (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(f.n) AS longer
  FROM f, range(1, 4) AS s(b), range(2, 4) AS z(m) WHERE m < words AND b + m - 1 <= words GROUP BY ALL),
kept AS (SELECT f.lang, f.phrase, words, w, f.n AS a FROM f LEFT JOIN inside i ON i.lang = f.lang AND i.phrase = f.phrase
  WHERE words > 1 AND (longer IS NULL OR 100 * longer < 80 * f.n)),
cuts AS ({" UNION ALL ".join(_cut(k) for k in (1, 2, 3))}),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r, ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = left_part JOIN f y ON y.lang = c.lang AND y.phrase = right_part),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

# names of stretches of twice the size, as long as documents go
_SIZES = [16 << k for k in range(18)]
_NAMES_OF = "".join(
    f",\ns{2 * z} AS (SELECT a.r, a.i, md5(a.h || b.h) AS h FROM s{z} a JOIN s{z} b ON b.r = a.r AND b.i = a.i + {z})" for z in _SIZES[:-1]
)
_AGAIN = " UNION ALL ".join(
    f"SELECT r, i, {z} AS z, lead(i) OVER (PARTITION BY r, h ORDER BY i) - i AS q FROM s{z} QUALIFY q BETWEEN {1 if z == 16 else z // 2} AND {z - 1}" for z in _SIZES
)

RUNS = rf"""
WITH ids AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda s, c: list_reduce([xor(s, c)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM ids),
tails AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM hashed),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM tails),
starts AS (SELECT r, w, unnest(range(n - 15)) AS i FROM d WHERE n >= 24),
windows AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS h FROM starts),
s16 AS (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY r, h) > 1){_NAMES_OF},
again AS ({_AGAIN}),
runs AS (
  SELECT r, min(i) AS s, max(i) - min(i) + z + q AS len, q FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM again)
  GROUP BY r, q, z, island HAVING max(i) - min(i) + z + q >= greatest(24, 3 * q)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY len::DOUBLE / q DESC, s, q) = 1),
lines AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
words AS (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
  sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN lines USING (r) LEFT JOIN kept USING (r)
"""

SQL = {"op11_collocations": COLLOCATIONS, "op12_runs": RUNS, "op2_secrets": SECRETS, "op4_substring_dedup": SUBSTRINGS, "op7_chat": CHAT, "op10_line_dedup": LINES}
