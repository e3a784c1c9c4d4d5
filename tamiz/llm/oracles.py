"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

import math

_TEXT = "coalesce(text, '')"

ARCHIVES = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     tops AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to, true AS intact
FROM p LEFT JOIN tops USING (d)"""

_WORDS = rf"regexp_extract_all(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
     wanted AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i + 1, i + size), ' ') AS gram FROM b, unnest(range(0, len(w) - size + 1)) t(i)),
     sizes AS (SELECT DISTINCT size FROM b),
     grams AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i + 1, i + size), ' ') AS gram FROM d, sizes, unnest(range(0, greatest(len(w) - size + 1, 0))) t(i)),
     met AS (SELECT doc_id, i, size, item_id FROM grams JOIN wanted USING (size, gram)),
     hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM met, unnest(range(i, i + size)) t(k) GROUP BY doc_id),
     found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

# texts as hexadecimal digits, two a byte, in pieces of 512 starts, since a substring costs its distance from the start
REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode({_TEXT})) AS h FROM documents),
     pieces AS (SELECT r, s, least(512, len(h) // 2 - 199 - s) AS n, substr(h, 2 * s + 1, 2 * (512 + 199)) AS piece FROM d, unnest(range(0, greatest(len(h) // 2 - 199, 0), 512)) t(s)),
     w AS (SELECT r, s + k AS p, hash(substr(piece, 2 * k + 1, 400)) AS code FROM pieces, unnest(range(0, n)) t(k)),
     twice AS (SELECT code FROM w GROUP BY code HAVING count(*) > 1),
     gone AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN twice USING (code)),
     numbered AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM gone),
     spans AS (SELECT r, run, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, run),
     gaps AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since, b FROM spans),
     kept AS (SELECT r, count(*) AS n, sum(b - a) AS removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", "entropy": "[A-Za-z0-9+/_=-]{20,}"}
_ALLOWED = "^[A-Za-z+/_=-]*$|^[0-9/_=-]*$"
_LISTED = "(?i:example)|0123456789|(?i:abcdefghijklm)"
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS rank, '{name}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(list_slice(string_split_regex(t, '{pattern}'), 1, -2)) AS gap, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS i FROM d"
    for k, (name, pattern) in enumerate(_KINDS.items())
)

SECRETS = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents),
     found AS ({_FOUND}),
     placed AS (SELECT doc_id, rank, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM found),
     parts AS (SELECT doc_id, stop, unnest(string_split_regex(m, '{_LISTED}')) AS m FROM placed WHERE rank = 3 AND NOT regexp_matches(m, '{_ALLOWED}')),
     windows AS (SELECT doc_id, stop, substr(m, k + 1, 20) AS part FROM parts, unnest(range(0, greatest(length(m) - 19, 0))) t(k)),
     bits AS (SELECT doc_id, stop, part, -list_sum(list_transform(list_distinct(string_split(part, '')), lambda c: (20 - length(replace(part, c, ''))) / 20.0 * log2((20 - length(replace(part, c, ''))) / 20.0))) AS b FROM windows),
     high AS (SELECT DISTINCT doc_id, stop FROM bits WHERE b >= 3.8 - 1e-9 OR (b >= 3.0 - 1e-9 AND regexp_full_match(part, '[0-9a-f]+'))),
     kept AS (SELECT doc_id, rank, kind, stop - length(m) AS start, stop FROM placed
              WHERE rank IN (1, 2) OR (rank = 0 AND length(regexp_extract(m, '{_ASSIGN}', 2)) >= 12) OR (rank = 3 AND (doc_id, stop) IN (SELECT (doc_id, stop) FROM high))),
     listed AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS x,
                       string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS every
                FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""

_NEAR = 0.01
_LOG = math.log((1 + _NEAR) / (1 - _NEAR))
_QUARTERS = ", ".join(f"min(v) FILTER (upto >= {p} * total) AS q{k}" for k, p in enumerate((0.25, 0.5, 0.75, 0.95)))
_SPACES = "[\\x20\\x09-\\x0D]"


def _points(by: str) -> str:
    """Quantiles of each ratio by these columns, from counts over buckets."""
    return f"""SELECT {by}name, any_value(total) AS total, {_QUARTERS} FROM (
        SELECT *, sum(n) OVER (PARTITION BY {by}name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}name) AS total,
               CASE WHEN bucket = -(1 << 30) THEN 0.0 ELSE 2 * pow({(1 + _NEAR) / (1 - _NEAR)}::DOUBLE, bucket) / {(1 + _NEAR) / (1 - _NEAR) + 1}::DOUBLE END AS v
        FROM (SELECT {by}name, bucket, count(*) AS n FROM valued GROUP BY ALL)) GROUP BY ALL"""


_TAILS = " ".join(f"WHEN '{k}' THEN least(greatest(q3 / 0.99, {a}), {b})" for k, (a, b) in {"symbols": (0.05, 0.2), "repeats": (0.05, 0.2), "dup_lines": (0.1, 0.3)}.items())

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TEXT} AS t FROM documents),
     w AS (SELECT r, list_filter(regexp_split_to_array(t, '{_SPACES}+'), lambda x: x <> '') AS w FROM d),
     line AS (SELECT r, row_number() OVER (PARTITION BY r, line) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
     lines AS (SELECT r, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup FROM line GROUP BY r),
     grams AS (SELECT r, i, list_slice(w, i + 1, i + 5) AS g FROM w, unnest(range(0, greatest(len(w) - 4, 0))) t(i)),
     again AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
     rep AS (SELECT r, count(DISTINCT k) AS n_rep FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM grams SEMI JOIN again USING (r, g)) GROUP BY r),
     m AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACES}', '', 'g'))::BIGINT AS word_chars,
                  CASE WHEN len(w) > 0 THEN length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) ELSE 0 END::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
                  coalesce(n_lines, 0) AS n_lines FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
     judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
     ratio AS (SELECT r, lang, source, base_failed, unnest(['symbols', 'repeats', 'word_length', 'dup_lines']) AS name,
                      unnest([n_symbols / greatest(word_chars, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1)]) AS x FROM judged),
     valued AS (SELECT lang, source, name, CASE WHEN x > 0 THEN ceil(ln(x) / {_LOG}::DOUBLE)::INT ELSE -(1 << 30) END AS bucket FROM ratio WHERE NOT base_failed),
     own AS ({_points("lang, source, ")}),
     whole AS ({_points("")}),
     weighed AS (SELECT lang, source, name, own.total / (own.total + 30.0::DOUBLE) AS w, own.q0 AS a0, own.q1 AS a1, own.q2 AS a2, own.q3 AS a3, whole.q0 AS b0, whole.q1 AS b1, whole.q2 AS b2, whole.q3 AS b3 FROM own JOIN whole USING (name)),
     chosen AS (SELECT lang, source, name, w, w * a0 + (1 - w) * b0 AS q0, w * a1 + (1 - w) * b1 AS q1, w * a2 + (1 - w) * b2 AS q2, w * a3 + (1 - w) * b3 AS q3 FROM weighed),
     fence AS (SELECT lang, source, name, w, CASE WHEN name = 'word_length' THEN q0 - 4 * greatest(q2 - q0, 0.1 * q1, 0.05) ELSE 0 END AS low,
                      CASE name WHEN 'word_length' THEN q2 + 4 * greatest(q2 - q0, 0.1 * q1, 0.05) {_TAILS} END AS high FROM chosen),
     inside AS (SELECT r, bool_and(coalesce(x BETWEEN low AND high, true)) AS ok, round(min(w), 6) AS own_weight FROM ratio LEFT JOIN fence USING (lang, source, name) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept, own_weight FROM judged JOIN inside USING (r)"""

ORACLES = {"op2_archives": ARCHIVES, "op3_decontaminate": DECONTAMINATE, "op6_repeats": REPEATS, "op7_secrets": SECRETS, "op9_quality": QUALITY}

_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda n_chars: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", n_chars, "text"))) + ")"
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ord(substr(CAST(doc_id AS VARCHAR), k, 1))::UBIGINT)),
  lambda c, b: xor(c // 256, codes[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))"""
ORACLES["op13_merkle"] = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda z: 0::UBIGINT)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS codes),
  d AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, {_LEAF("n_chars + 1")} AS changed, coalesce(xor({_CRC}, 4294967295::UBIGINT) % 7 = 0, false) AS hit FROM documents, crc),
  r AS (SELECT doc_id, lang, leaf, CASE WHEN hit THEN changed ELSE leaf END AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d),
  a AS (SELECT lang, 0 AS level, p AS i, n, leaf AS h FROM r UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY lang, level, i // 2, n),
  s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM a WHERE n = 1),
  b AS (SELECT 0 AS level, p AS i, n, subroot AS h FROM s UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 2, n),
  x AS (SELECT DISTINCT lang, level FROM a WHERE n > 1), y AS (SELECT DISTINCT level FROM b WHERE n > 1),
  w AS (SELECT r.lang, r.p, x.level, CASE WHEN a.h IS NULL THEN 'N' WHEN (r.p >> x.level) & 1 = 1 THEN 'L' || a.h ELSE 'R' || a.h END AS step FROM r JOIN x ON x.lang IS NOT DISTINCT FROM r.lang LEFT JOIN a ON a.lang IS NOT DISTINCT FROM r.lang AND a.level = x.level AND a.i = xor(r.p >> x.level, 1)),
  v AS (SELECT s.lang, y.level, CASE WHEN b.h IS NULL THEN 'N' WHEN (s.p >> y.level) & 1 = 1 THEN 'L' || b.h ELSE 'R' || b.h END AS step FROM s CROSS JOIN y LEFT JOIN b ON b.level = y.level AND b.i = xor(s.p >> y.level, 1)),
  w2 AS (SELECT lang, p, list(step ORDER BY level) AS way FROM w GROUP BY 1, 2), v2 AS (SELECT lang, list(step ORDER BY level) AS way FROM v GROUP BY 1),
  f AS (SELECT r.doc_id, r.leaf, claimed, subroot, (SELECT h FROM b WHERE n = 1) AS root, list_concat(coalesce(w2.way, []), coalesce(v2.way, [])) AS way FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang LEFT JOIN w2 ON w2.lang IS NOT DISTINCT FROM r.lang AND w2.p = r.p LEFT JOIN v2 ON v2.lang IS NOT DISTINCT FROM r.lang),
  g AS (SELECT *, list_reduce(list_prepend(claimed, way), lambda c, z: CASE WHEN z = 'N' THEN sha256(c) WHEN z[1] = 'L' THEN sha256(substr(z, 2) || c) ELSE sha256(c || substr(z, 2)) END) AS folded_root FROM f)
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(way, lambda z: z <> 'N'), lambda z: substr(z, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"""
