"""DuckDB SQL for the queries of this subpackage that SQL can express, written plainly: pairs and windows are listed."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_D = f"substr({DIGITS}, j, 1)::int"
_TWICE = f"CASE WHEN {_D} > 4 THEN {_D} * 2 - 9 ELSE {_D} * 2 END"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda j: CASE WHEN (length({DIGITS}) - j) % 2 = 1 THEN {_TWICE} ELSE {_D} END)) % 10 = 0"
PLAIN = "replace(m, ' ', '')"
TURNED = f"(substr({PLAIN}, 5) || substr({PLAIN}, 1, 4))"
MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split({TURNED}, ''), lambda c: CASE WHEN ord(c) >= 65 THEN ord(c) - 55 ELSE ord(c) - 48 END)), lambda a, v: CASE WHEN v >= 10 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"
AROUND = "lower(substr(t, greatest(s - 40, 0) + 1, least(s, 40)) || chr(10) || substr(t, s + length(m) + 1, 40))"
_COUNTRIES = [
    (15, "NO"), (16, "BE"), (18, "DK|FO|FI|GL|NL|SD|FK"), (19, "MK|SI"), (20, "AT|BA|EE|KZ|XK|LT|LU|MN"), (21, "HR|LV|LI|CH"), (22, "BH|BG|CR|GE|DE|IE|ME|RS|GB|VA"),
    (23, "GI|IL|IQ|TL|AE|SO|OM"), (24, "AD|CZ|MD|PK|RO|SA|SK|ES|SE|TN|VG"), (25, "LY|PT|ST"), (26, "IS|TR"), (27, "BI|DJ|FR|GR|IT|MC|MR|SM"), (28, "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV"),
    (29, "BR|EG|PS|QA|UA"), (30, "JO|KW|MU|YE"), (31, "MT|SC"), (32, "LC"), (33, "RU"),
]
IBAN = "|".join(f"(?:{c})[0-9][0-9](?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _COUNTRIES)
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{OCTET}(?:\.{OCTET}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
    ("iban", IBAN, MOD97),
    ("secret", r"[0-9a-f]{32,}", f"regexp_matches({AROUND}, 'token|secret|key|passw|bearer')"),
    ("tel", r"\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}", f"regexp_matches({AROUND}, 'tel|phone|call|fax|mobil')"),
]
_LISTED = " UNION ALL ".join(f"SELECT k, t, '{n}' AS kind, {o} AS place, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')" for o, (n, p, _) in enumerate(KINDS))
_SPAN = "kind || ':' || s || ':' || s + length(m)"

PII = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
listed AS ({_LISTED}),
each AS (SELECT k, t, kind, place, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM listed),
spans AS (SELECT k, t, kind, place, ms[i] AS m, cast(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS bigint) AS s FROM each),
kept AS (SELECT * FROM spans WHERE CASE kind {' '.join(f"WHEN '{n}' THEN {ok}" for n, _, ok in KINDS)} END),
summed AS (SELECT k, {', '.join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n, _, _ in KINDS[:4])}, string_agg({_SPAN}, ',' ORDER BY place, s) FILTER (place < 4) AS base, string_agg({_SPAN}, ',' ORDER BY place, s) AS spans FROM kept GROUP BY k)
SELECT doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n, _, _ in KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN summed USING (k)
"""

LINE_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '<none>') AS host, coalesce(text, '') AS t, coalesce('id ' || doc_id, 'text ' || coalesce(text, '')) AS document FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS ws FROM d),
places AS (SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS five FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS n FROM places) WHERE n > 1),
repeats AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 5) r(j) GROUP BY k),
lines AS (SELECT k, host, document, line, regexp_replace(lower(trim(regexp_replace(line, '{SPACE}+', ' ', 'g'))), '[0-9]+', '0', 'g') AS norm, len(list_filter(string_split_regex(line, '{SPACE}+'), lambda x: x <> '')) AS n FROM (SELECT k, host, document, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY k),
hosts AS (SELECT host, count(DISTINCT document) AS docs FROM d GROUP BY host),
common AS (SELECT host, norm FROM lines JOIN hosts USING (host) GROUP BY host, norm, docs HAVING count(DISTINCT document) > 10 AND count(DISTINCT document) > 0.01 * docs),
gone AS (SELECT k, sum(n) AS n_removed_words FROM lines JOIN common USING (host, norm) GROUP BY k),
c AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, cast(coalesce(n_removed_words, 0) AS bigint) AS n_removed_words
  FROM w LEFT JOIN dups USING (k) LEFT JOIN repeats USING (k) LEFT JOIN gone USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.2 * n_words AS kept FROM f
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::double[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(coalesce(least, e.vec_id), e.vec_id) AS component_id, e.vec_id = least(coalesce(least, e.vec_id), e.vec_id) AS kept FROM embeddings e LEFT JOIN counted USING (vec_id) LEFT JOIN found USING (vec_id)
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT k, five, count(*) AS tf FROM (SELECT k, array_to_string(ws[i:i + 4], ' ') AS five FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)) GROUP BY k, five),
n AS (SELECT count(*)::double AS docs FROM documents),
df AS (SELECT five, count(*) AS df FROM s GROUP BY five),
x AS MATERIALIZED (SELECT k, five, df, tf * (3 + ln(1 + docs / df) / ln(1 + docs)) AS weight FROM s JOIN df USING (five), n),
total AS (SELECT k, sum(weight) AS total FROM x GROUP BY k),
pairs AS (SELECT a.k AS a, b.k AS b, sum(least(a.weight, b.weight)) AS shared FROM x a JOIN x b ON a.five = b.five AND a.k < b.k AND a.df > 1 GROUP BY a.k, b.k),
near AS (SELECT a, b FROM pairs JOIN total p ON p.k = a JOIN total q ON q.k = b WHERE shared >= 0.8 * (p.total + q.total - shared)),
links AS MATERIALIZED (SELECT p.doc_id AS a, q.doc_id AS b FROM near JOIN d p ON p.k = a JOIN d q ON q.k = b UNION SELECT p.doc_id, q.doc_id FROM d p JOIN d q ON p.t = q.t),
ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id, component_id, doc_id = component_id AS kept FROM d JOIN found USING (doc_id)
"""

PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, list_slice(w, i, i + 4) AS w FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(list_slice(w, 1, k), ' ') AS phrase, count(*) AS f FROM s JOIN range(1, 6) r(k) ON k <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
halves AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cuts AS (SELECT h.lang, h.phrase, a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM halves h
  JOIN g x ON x.lang = h.lang AND x.phrase = head JOIN g y ON y.lang = h.lang AND y.phrase = rest JOIN n ON n.lang = h.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + z - 1), ' ') AS phrase, max(a) AS longer FROM c JOIN range(2, 5) x(z) ON z < k JOIN range(1, 5) y(i) ON i + z - 1 <= k GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

#: op2's samples miss a pair at the threshold once in thousands; the rest are exact.
ORACLES: dict[str, str] = {"op2_minhash_near_dedup": NEAR, "op4_epsilon_grid_join": VECTORS, "op5_line_frequency_rules": LINE_RULES, "op9_pii_spans": PII, "op12_phrase_collocations": PHRASES}
