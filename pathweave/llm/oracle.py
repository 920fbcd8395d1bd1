"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op10_exact_topk"] = """
WITH given AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM given q JOIN given c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

_TESTS = 18  # rules times strata
_GRID = "(10), (20), (30), (50), (75), (100), (150), (200), (300), (400), (500), (700)"
_MEASURES = ("symbols", "repeats", "lines", "capitals", "marks", "lengths")

ORACLES["op9_quality_rules"] = f"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT k, w, i FROM (
    SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
    FROM (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM doc))),
triple AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, w, w2, w3) AS n FROM (
    SELECT k, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3
    FROM word WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE w3 IS NOT NULL),
covered AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM triple WHERE n >= 2)
  GROUP BY k),
words AS (SELECT k, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars FROM word GROUP BY k),
line AS (
  SELECT k, count(*) AS n, count(*) - count(DISTINCT s) AS again
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS s FROM doc)
  WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY k),
counted AS (
  SELECT doc.k, doc_id, coalesce(words.n, 0) AS n_words, coalesce(chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(again, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(line.n, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks
  FROM doc LEFT JOIN words USING (k) LEFT JOIN line USING (k) LEFT JOIN covered USING (k)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words >= 1000 THEN 2 WHEN n_words >= 200 THEN 1 ELSE 0 END AS stratum,
    [1000 * n_symbols // greatest(word_chars, 1), 1000 * n_repeat_words // greatest(n_words, 1),
     1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_capitals // greatest(word_chars, 1),
     1000 * n_marks // greatest(word_chars, 1), 10 * word_chars // greatest(n_words, 1)] AS m
  FROM counted),
judged AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
grid AS (
  SELECT r, c FROM (VALUES {_GRID}) AS g(c), unnest(range(1, 6)) AS u(r)
  UNION ALL SELECT 6, c FROM (VALUES (60), (70), (80), (90), (100), (120), (150), (200)) AS g(c)),
tally AS (
  SELECT stratum, r, c,
    count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad,
    count(*) FILTER (quality = 1 AND m[r] > c) AS lost, count(*) FILTER (quality = 0 AND m[r] > c) AS caught
  FROM measured JOIN judged USING (doc_id), grid
  WHERE NOT base_failed AND quality IN (0, 1) GROUP BY stratum, r, c),
tested AS (
  SELECT *, (caught * good - 10 * lost * bad) / (good * greatest(bad, 1)) AS gain
  FROM tally WHERE good > 0 AND lost <= good * (0.06 / 6) AND (
    SELECT sum(exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1)
      + j * ln(0.06 / 6) + (good - j) * ln(1 - 0.06 / 6)))
    FROM unnest(range(0, lost + 1)) AS u(j)) <= 0.05 / {_TESTS}),
cutoff AS (
  SELECT stratum, r, c FROM tested WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, r ORDER BY gain DESC, c DESC) = 1),
hit AS (
  SELECT k, string_agg(({list(_MEASURES)})[r], ',' ORDER BY r) AS rules
  FROM measured JOIN cutoff USING (stratum) WHERE m[r] > c GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by
FROM measured LEFT JOIN hit USING (k)
"""


def jaccard(table: str, size: int, num: int, den: int) -> str:
    """CTEs ending in ``joined``: k, doc_id, n_shingles, component_id and n_links of ``table``'s rows."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
told AS (
  SELECT row_number() OVER () AS k, *, regexp_extract_all(
    translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table}),
shingle AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' '))
    END) AS s FROM told),
sized AS (SELECT k, count(*) AS n FROM shingle GROUP BY k),
link AS (
  SELECT p.a, p.b FROM (
    SELECT x.k AS a, y.k AS b, count(*) AS shared FROM shingle x JOIN shingle y ON x.s = y.s AND x.k <> y.k
    GROUP BY x.k, y.k) p JOIN sized u ON u.k = a JOIN sized v ON v.k = b
  WHERE {den} * shared >= {num} * (u.n + v.n - shared)),
reach AS (
  SELECT k, k AS r FROM told UNION SELECT reach.k, link.b FROM reach JOIN link ON reach.r = link.a),
joined AS (
  SELECT t.k, t.doc_id, coalesce(n, 0) AS n_shingles, m.component_id, coalesce(links, 0) AS n_links
  FROM told t JOIN (SELECT reach.k, min(doc_id) AS component_id FROM reach JOIN told ON told.k = r GROUP BY 1) m
    USING (k) LEFT JOIN sized USING (k) LEFT JOIN (SELECT a AS k, count(*) AS links FROM link GROUP BY a) USING (k))"""


ORACLES["op6_jaccard_groups"] = (
    f"WITH RECURSIVE {jaccard('documents', 4, 85, 100)} "
    "SELECT doc_id, n_shingles, component_id, n_links FROM joined"
)

ORACLES["op3_stupid_backoff"] = """
WITH told AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
word AS (SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM told),
total AS (SELECT count(*) AS n FROM word),
pair AS (SELECT k, i, w, lag(w) OVER (PARTITION BY k ORDER BY i) AS before FROM word),
single AS (SELECT w, count(*) AS c FROM word GROUP BY w),
head AS (SELECT before, count(*) AS c FROM pair WHERE before IS NOT NULL GROUP BY before),
gram AS (SELECT before, w, count(*) AS c FROM pair WHERE before IS NOT NULL GROUP BY before, w),
scored AS (
  SELECT k, CAST(floor(1e6 * ln(CASE
    WHEN i = 1 THEN single.c / total.n
    WHEN gram.c >= 2 THEN gram.c / head.c
    ELSE 0.4::DOUBLE * (single.c / total.n) END) + 0.5::DOUBLE) AS BIGINT) AS v
  FROM pair JOIN single USING (w) CROSS JOIN total LEFT JOIN head USING (before)
    LEFT JOIN gram ON gram.before = pair.before AND gram.w = pair.w)
SELECT doc_id, len(ws) AS n_words, coalesce(s, 0) AS score_micro,
  coalesce(s, 0) / greatest(len(ws), 1) / 1e6 AS score
FROM told LEFT JOIN (SELECT k, CAST(sum(v) AS BIGINT) AS s FROM scored GROUP BY k) USING (k)
"""

# An integer that was written as text, as in `turn`, has the wrong type; every call has one id.
ORACLES["op5_tool_calls"] = """
WITH RECURSIVE said AS (
  SELECT conv_id, turn AS t, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
call AS (
  SELECT *, CASE WHEN n % 2 = 0 THEN 'measure' ELSE 'store' END AS name FROM said WHERE role = 'assistant'),
level AS (
  SELECT conv_id, t, 1 AS level, 3 * t + 1 AS slot FROM call c
  WHERE NOT EXISTS (SELECT 1 FROM call d WHERE d.conv_id = c.conv_id AND d.t = c.t - 2)
  UNION ALL
  SELECT c.conv_id, c.t, l.level + 2, greatest(3 * c.t + 1, l.slot,
    CASE WHEN p.n % 17 = 0 OR p.n % 13 = 0 THEN 0 WHEN p.n % 4 = 0 THEN 3 * p.t ELSE 3 * p.t + 2 END)
  FROM level l JOIN call p ON p.conv_id = l.conv_id AND p.t = l.t
    JOIN call c ON c.conv_id = l.conv_id AND c.t = l.t + 2),
full_call AS (
  SELECT call.*, level, slot, n % 17 <> 0 AND n % 13 <> 0 AS answered,
    list_sort(list_filter([
      CASE WHEN n % 11 = 0 THEN 'missing text' END,
      CASE WHEN name = 'measure' AND n % 3 = 0 THEN 'missing length' END,
      CASE WHEN name = 'store' THEN 'type turn' END,
      CASE WHEN name = 'measure' AND n % 7 = 0 THEN 'unknown tags' END], lambda e: e IS NOT NULL)) AS wrong
  FROM call JOIN level USING (conv_id, t))
SELECT conv_id, 3 * t + 1 AS slot, 0::BIGINT AS level, 3 * t + 1 AS turn, 0::BIGINT AS place, 'message' AS kind,
  'message' AS status, '' AS errors,
  '{"content":' || CASE WHEN role = 'assistant' THEN '""' ELSE to_json(text) END
    || ',"kind":"message","role":' || to_json(role) || ',"status":"message"}' AS json
FROM said
UNION ALL
SELECT conv_id, slot, level::BIGINT, 3 * t + 1, 1::BIGINT, 'call', CASE WHEN answered THEN 'linked' ELSE 'open' END,
  array_to_string(wrong, ','),
  '{"after":["c' || (t - 2) || '"],"arguments":{' || array_to_string(list_filter([
    CASE WHEN name = 'measure' AND n % 3 <> 0 THEN '"length":' || n END,
    CASE WHEN n % 7 = 0 THEN '"tags":["b","a"]' END,
    CASE WHEN n % 11 <> 0 THEN '"text":' || to_json(text) END,
    CASE WHEN name = 'store' THEN '"turn":"' || CASE WHEN n % 5 = 0 THEN 'x' ELSE CAST(t AS VARCHAR) END || '"' END
  ], lambda e: e IS NOT NULL), ',') || '}'
  || CASE WHEN len(wrong) > 0 THEN ',"errors":["' || array_to_string(wrong, '","') || '"]' ELSE '' END
  || ',"id":"c' || t || '","kind":"call","name":"' || name || '","role":"assistant","status":"'
  || CASE WHEN answered THEN 'linked' ELSE 'open' END || '"}'
FROM full_call
UNION ALL
SELECT conv_id, CASE WHEN n % 13 = 0 THEN put ELSE greatest(put, slot) END,
  CASE WHEN n % 13 = 0 THEN 0 ELSE level + 1 END::BIGINT, put, 0::BIGINT, 'result',
  CASE WHEN n % 13 = 0 THEN 'orphan' ELSE 'linked' END, '',
  '{"content":"' || n || '","id":"' || CASE WHEN n % 13 = 0 THEN 'u' ELSE 'c' END || t
  || '","kind":"result","role":"tool","status":"' || CASE WHEN n % 13 = 0 THEN 'orphan' ELSE 'linked' END || '"}'
FROM (SELECT *, CASE WHEN n % 4 = 0 THEN 3 * t ELSE 3 * t + 2 END AS put FROM full_call WHERE n % 17 <> 0)
"""

_WS = "[\\x20\\x09-\\x0D]"
_PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_VALID = """CASE kind WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(f, '.'), lambda v: CAST(v AS HUGEINT) > 255)) = 0
    WHEN 2 THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN CAST(d[-j] AS BIGINT)
        WHEN CAST(d[-j] AS BIGINT) > 4 THEN 2 * CAST(d[-j] AS BIGINT) - 9 ELSE 2 * CAST(d[-j] AS BIGINT) END)) % 10 = 0
    ELSE length(d) BETWEEN 9 AND 15 END"""


def _matches(kind: int, pattern: str) -> str:
    return (
        f"SELECT k, {kind} AS kind, regexp_extract_all(text, '{pattern}') AS fs, "
        f"string_split_regex(text, '{pattern}') AS gs FROM told"
    )


ORACLES["op1_personal_data"] = f"""
WITH told AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
tried AS ({" UNION ALL ".join(_matches(k, p) for k, p in enumerate(_PERSONAL.values()))}),
one AS (
  SELECT k, kind, unnest(fs) AS f, unnest(gs[1:len(fs)]) AS g, unnest(range(1, len(fs) + 1)) AS i
  FROM tried WHERE len(fs) > 0),
placed AS (
  SELECT k, kind, f, CAST(sum(length(g) + length(f)) OVER (PARTITION BY k, kind ORDER BY i) AS BIGINT) AS stop,
    regexp_replace(f, '[^0-9]', '', 'g') AS d FROM one),
base AS (SELECT k, kind, f, stop - length(f) AS start, stop FROM placed WHERE {_VALID}),
total AS (SELECT count(*) AS n FROM told),
entity AS (
  SELECT DISTINCT k, unnest(['own ' || kind || ' ' || lower(f), 'kind ' || kind, 'group ' || kind || ' ' || CASE kind
    WHEN 0 THEN string_split(lower(f), '@')[-1]
    WHEN 1 THEN array_to_string(string_split(f, '.')[1:3], '.')
    WHEN 2 THEN substr(d, 1, 6) ELSE substr(d, 1, 5) END]) AS e
  FROM (SELECT *, regexp_replace(f, '[^0-9]', '', 'g') AS d FROM base)),
held AS (
  SELECT e, count(*) AS n_e FROM entity JOIN told USING (k), total GROUP BY e, n
  HAVING count(DISTINCT text) >= 3 AND count(*) < n),
piece AS (SELECT k, unnest(string_split_regex(text, '{_WS}')) AS w, unnest(range(1, len(string_split_regex(text, '{_WS}')) + 1)) AS i FROM told),
word AS (SELECT DISTINCT k, lower(w) AS t FROM piece WHERE regexp_matches(lower(w), '^\\pL')),
times AS (SELECT t, count(*) AS n_t FROM word GROUP BY t),
pair AS (
  SELECT e, t, count(*) AS n_te FROM entity SEMI JOIN held USING (e) JOIN word USING (k) JOIN told USING (k)
  GROUP BY e, t HAVING count(DISTINCT text) >= 3),
flagged AS (
  SELECT DISTINCT t FROM pair JOIN times USING (t) JOIN held USING (e), total
  WHERE floor((1 + log2((n_te + 2 * n_e / n) / (n_t + 2)) / log2(n / n_e)) * 1e6 + 0.5) / 1e6 >= 0.8),
laid AS (
  SELECT k, w, CAST(i - 1 + sum(length(w)) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS stop FROM piece),
added AS (
  SELECT k, stop - length(w) AS start, stop FROM laid WHERE lower(w) IN (SELECT t FROM flagged) AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.k = laid.k AND b.start < laid.stop AND laid.stop - length(w) < b.stop)),
every AS (
  SELECT k, kind, ['email', 'ip', 'card', 'phone'][kind + 1] AS name, start, stop FROM base
  UNION ALL SELECT k, 4, 'term', start, stop FROM added),
joined AS (
  SELECT k, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS spans,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY kind, start) FILTER (kind < 4) AS base,
    count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip,
    count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, count(*) FILTER (kind = 4) AS n_terms
  FROM every GROUP BY k)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_terms, 0) AS n_terms
FROM told LEFT JOIN joined USING (k)
"""

#: The CRC-32 of the decimal digits of ``doc_id``, without sign, beside a row of CTE ``crc``.
_CRC_TABLE = """
crc AS (
  SELECT list(list_reduce(range(8), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    i) ORDER BY i) AS crc_table FROM range(256) AS u(i))"""
_CRC = """xor(4294967295, list_reduce(
    list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))"""


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """A CTE of all nodes of the trees over ``leaves`` (tree, place, n, h); n: nodes of the level."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, place, n, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM {name}
  WHERE n > 1 GROUP BY tree, level, place // 2, n)"""


def _way(tree: str, leaves: str, key: str) -> str:
    """A CTE of the nodes on each leaf's way with its sibling there, if it has one."""
    return f"""
way_{tree} AS (
  SELECT l.{key}, v.level, s.h AS sibling, (l.place >> v.level) & 1 AS side
  FROM {leaves} l JOIN {tree} v ON v.tree = l.tree AND v.place = l.place >> v.level AND v.n > 1
  LEFT JOIN {tree} s ON s.tree = v.tree AND s.level = v.level AND s.place = xor(v.place, 1))"""


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
row AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS h,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("CAST(n_chars AS HUGEINT) + 1")} ELSE {_leaf("n_chars")} END AS seen
  FROM documents, crc),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n FROM row),
{_tree("node", "leaf")},
sub AS (
  SELECT 'top' AS tree, tree AS language, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, h
  FROM node WHERE n = 1),
{_tree("upper", "sub")},
{_way("node", "leaf", "k")},
{_way("upper", "sub", "language")},
way AS (
  SELECT k, level, sibling, side FROM way_node
  UNION ALL
  SELECT k, 1000 + level, sibling, side FROM way_upper JOIN leaf ON leaf.tree = language),
step AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level) AS i FROM way),
fold AS (
  SELECT k, 0 AS i, seen AS h FROM leaf
  UNION ALL
  SELECT fold.k, fold.i + 1, sha256(CASE WHEN sibling IS NULL THEN fold.h WHEN side = 1 THEN sibling || fold.h
    ELSE fold.h || sibling END) FROM fold JOIN step ON step.k = fold.k AND step.i = fold.i + 1),
proof AS (SELECT k, string_agg(sibling, '' ORDER BY i) AS told FROM step GROUP BY k),
ended AS (SELECT k, arg_max(h, i) AS h FROM fold GROUP BY k)
SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(told, '')) AS proof_sha256,
  ended.h AS folded_root, ended.h = root.h AS verified
FROM leaf JOIN sub ON sub.language = leaf.tree JOIN ended USING (k) LEFT JOIN proof USING (k),
  (SELECT h FROM upper WHERE n = 1) AS root
"""

ORACLES["op12_minhash_near_dedup"] = f"""
WITH RECURSIVE {jaccard("documents", 5, 85, 100)}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM joined
"""

ORACLES["op13_periodic_runs"] = f"""
WITH {_CRC_TABLE},
told AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    {_CRC} AS h
  FROM documents, crc),
planned AS (
  SELECT *, len(ws) AS n, (h // 10) % len(ws) AS a, 3 + (h // 10) % 8 AS times, h % 10 = 0 AND len(ws) > 0 AS planted
  FROM told),
read AS (
  SELECT k, doc_id, n, CASE WHEN planted
    THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // times) END])
    ELSE ws END AS ws
  FROM planned),
eight AS (
  SELECT k, n, i, array_to_string(ws[i + 1:i + 8], ' ') AS s
  FROM read, unnest(range(0, n - 7)) AS u(i) WHERE n >= 24),
often AS (SELECT * FROM eight QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
pair AS (
  SELECT x.k, x.i, y.i - x.i AS p FROM often x JOIN often y ON x.k = y.k AND x.s = y.s AND x.i < y.i
  WHERE 3 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT k, p, min(i) AS b, max(i) + 8 + p AS e FROM (
    SELECT k, p, i, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS island FROM pair)
  GROUP BY k, p, island),
run AS (
  SELECT k, b, e - b AS l, min(p) AS p FROM stretch WHERE e - b >= greatest(24, 3 * p) GROUP BY k, b, e),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY k ORDER BY l / p DESC, b, p) = 1),
listed AS (
  SELECT k, count(*) AS n_runs, string_agg(b || ',' || l || ',' || p || chr(10), '' ORDER BY b, p) AS runs,
    list({{'b': b + p, 'e': b + l}}) AS gone
  FROM run GROUP BY k),
kept AS (
  SELECT k, array_to_string(list_transform(list_filter(range(0, n), lambda i:
    len(list_filter(coalesce(gone, []), lambda r: r.b <= i AND i < r.e)) = 0), lambda i: ws[i + 1]), ' ') AS collapsed
  FROM read LEFT JOIN listed USING (k))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.b AS start, best.l AS length, best.p AS period,
  1000 * best.l // best.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(collapsed) AS collapsed_sha256
FROM read JOIN kept USING (k) LEFT JOIN listed USING (k) LEFT JOIN best USING (k)
"""
