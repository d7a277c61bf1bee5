"""The same answers in DuckDB SQL."""

from __future__ import annotations


def _quality() -> str:
    lengths = (5, 6, 7, 8, 9, 10)
    percent = (20, 18, 16, 14, 12, 10)
    grams, marks, sums = [], [], []
    for n in lengths:
        gram = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, n))])
        grams.append(f"{gram} AS g{n}")
        marks.append(f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY row_no, g{n} ORDER BY pos) > 1 AS later{n}, g{n} IS NOT NULL AND count(*) OVER (PARTITION BY row_no, g{n}) > 1 AS twice{n}")
        sums.append(f"coalesce(sum(length(word)) FILTER (WHERE in{n}), 0) AS dup{n}_chars, count(*) FILTER (WHERE later{n}) AS dup{n}_grams")
    inside = ", ".join(f"bool_or(later{n}) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in lengths)
    later = ", ".join(f"later{n}" for n in lengths)
    dup = ", ".join(f"coalesce(c.dup{n}_{what}, 0)::BIGINT AS dup{n}_{what}" for n in lengths for what in ("chars", "grams"))
    verdict = " AND ".join(f"(100 * dup{n}_chars <= {p} * word_chars{' OR dup%d_grams < 20' % n if n > 5 else ''})" for n, p in zip(lengths, percent))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_no, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (SELECT row_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
grams AS (SELECT row_no, pos, word, {", ".join(grams)} FROM words WINDOW w AS (PARTITION BY row_no ORDER BY pos)),
marks AS (SELECT row_no, pos, word, {", ".join(marks)} FROM grams),
cover AS (SELECT row_no, word, {inside}, {later}, bool_or(twice8) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS again FROM marks),
counted AS (SELECT row_no, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE again) AS n_repeat_words, {", ".join(sums)} FROM cover GROUP BY row_no),
lines AS (SELECT row_no, line, count(*) AS times FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no, line),
repeated AS (SELECT row_no, sum(times - 1) AS n_dup_lines, sum((times - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM lines GROUP BY row_no),
measured AS (SELECT d.doc_id, coalesce(c.n_words, 0)::BIGINT AS n_words, coalesce(c.word_chars, 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 coalesce(r.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(r.dup_line_chars, 0)::BIGINT AS dup_line_chars, {dup}
 FROM docs d LEFT JOIN counted c USING (row_no) LEFT JOIN repeated r USING (row_no)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= 20 * word_chars AND {verdict} AS kept FROM failed"""


def _decontamination() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, {words} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS ws FROM benchmark),
cut AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM items WHERE len(ws) > 0)),
seen AS (SELECT row_no, pos, size, array_to_string(ws[pos : pos + size - 1], ' ') AS win FROM (SELECT row_no, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS pos FROM docs, (SELECT DISTINCT size FROM cut) WHERE len(ws) >= size)),
hits AS (SELECT DISTINCT row_no, pos, cut.size, item FROM seen JOIN cut ON seen.win = cut.win AND seen.size = cut.size),
places AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(generate_series(pos, pos + size - 1)) AS place FROM hits) GROUP BY row_no),
found AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no),
places_of AS (SELECT row_no, generate_subscripts(ws, 1) AS spot, unnest(ws) AS word FROM docs),
frequency AS (SELECT word, count(*) AS n FROM places_of GROUP BY word),
terms AS (SELECT win, j, t.word, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), j) AS r FROM (SELECT win, generate_subscripts(string_split(win, ' '), 1) AS j, unnest(string_split(win, ' ')) AS word FROM (SELECT DISTINCT win FROM cut)) t LEFT JOIN frequency USING (word)),
anchors AS (SELECT win, max(word) FILTER (WHERE r = 1) AS w1, max(j) FILTER (WHERE r = 1) AS j1, max(word) FILTER (WHERE r = 2) AS w2, max(j) FILTER (WHERE r = 2) AS j2, max(word) FILTER (WHERE r = 3) AS w3, max(j) FILTER (WHERE r = 3) AS j3 FROM terms GROUP BY win),
first_at AS (SELECT win, row_no, spot - j1 AS begins, w2, j2, w3, j3 FROM anchors JOIN places_of ON word = w1),
second_at AS (SELECT DISTINCT f.win, f.row_no, f.begins, w3, j3 FROM first_at f LEFT JOIN places_of p ON p.row_no = f.row_no AND p.word = w2 AND abs(p.spot - f.begins - j2) <= 4 WHERE w2 IS NULL OR p.word IS NOT NULL),
close AS (SELECT DISTINCT s.win, s.row_no FROM second_at s LEFT JOIN places_of p ON p.row_no = s.row_no AND p.word = w3 AND abs(p.spot - s.begins - j3) <= 4 WHERE w3 IS NULL OR p.word IS NOT NULL),
near AS (SELECT row_no, count(*) AS n_near FROM close WHERE (win, row_no) NOT IN (SELECT (win, row_no) FROM (SELECT DISTINCT win, row_no FROM seen JOIN cut USING (win, size))) GROUP BY row_no)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN places USING (row_no) LEFT JOIN found USING (row_no) LEFT JOIN near USING (row_no)"""


def _near_duplicates() -> str:
    return r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id))::BIGINT AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = d.doc_id"""


def _url_filters() -> str:
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = f"lower(regexp_extract(url, '{scheme}(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    path = f"regexp_extract(url, '{scheme}[^/?#]+([^?#]*)', 1)"
    number = "('0x' || substr(md5({0}), 1, 6))::BIGINT"
    day = "1700000000 + (n % 60 + {0}) * 86400"
    entry = "SELECT '{1}' AS list, '{2}' AS kind, {3} AS pattern, '{4}' AS verdict, '{5}' AS action, " + day.format("{6}") + " AS moment FROM {0} WHERE {7}"
    entries = " UNION ALL ".join(entry.format(*x) for x in (
        ("hosts", "spam", "host", "host", "block", "add", 0, "n % 3 = 0"), ("hosts", "spam", "host", "host", "block", "remove", 60, "n % 6 = 0"), ("hosts", "spam", "host", "host", "block", "add", 90, "n % 12 = 0"),
        ("parents", "parked", "domain", "host", "block", "add", 20, "n % 2 = 0"), ("hosts", "trusted", "path", "host || '/en/'", "allow", "add", 10, "n % 4 = 1"),
        ("addresses", "reports", "url", "host || path", "block", "add", 5, "n % 20 = 0"), ("addresses", "reports", "url", "host || path", "block", "remove", 45, "n % 40 = 0")))
    return rf"""
WITH seen AS (SELECT DISTINCT {host} AS host, {path} AS path FROM pages WHERE url IS NOT NULL AND {host} <> ''),
hosts AS (SELECT DISTINCT host, {number.format("host")} AS n FROM seen),
parents AS (SELECT DISTINCT h AS host, {number.format("h")} AS n FROM (SELECT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS h FROM hosts)),
addresses AS (SELECT host, path, {number.format("host || path")} AS n FROM seen),
entries AS ({entries}),
valid AS (SELECT list, kind, pattern, verdict, moment AS low, high FROM (SELECT *, lead(moment) OVER (PARTITION BY list, kind, pattern ORDER BY moment) AS high FROM (SELECT list, kind, pattern, moment, min(verdict) AS verdict, max(action) = 'add' AS is_on FROM entries GROUP BY ALL)) WHERE is_on),
captures AS (SELECT row_number() OVER () AS row_no, page_id, url, 1700000000 + (page_id * 7919) % 15552000 AS fetched, coalesce({host}, '') AS host, {path} AS path FROM pages),
active AS (SELECT row_no, v.*, CASE kind WHEN 'url' THEN 0 WHEN 'path' THEN 1 WHEN 'host' THEN 2 ELSE 3 END AS rank FROM captures c JOIN valid v ON c.host <> '' AND c.fetched >= v.low AND (v.high IS NULL OR c.fetched < v.high)
 AND CASE kind WHEN 'url' THEN c.host || c.path = pattern WHEN 'host' THEN c.host = pattern WHEN 'path' THEN starts_with(c.host || c.path || '/', pattern) ELSE c.host = pattern OR ends_with(c.host, '.' || pattern) END),
decided AS (SELECT *, count(*) OVER (PARTITION BY row_no) AS n_active, row_number() OVER (PARTITION BY row_no ORDER BY rank, -length(pattern), verdict, list, pattern) AS place FROM active)
SELECT page_id, c.url, fetched::BIGINT AS fetched, c.host, coalesce(verdict, 'none') AS verdict, coalesce(list || '|' || kind || '|' || pattern, '') AS decided_by, coalesce(n_active, 0)::BIGINT AS n_active
FROM captures c LEFT JOIN decided d ON d.row_no = c.row_no AND place = 1"""


def _secrets() -> str:
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "v >= 8"),
        ("access", "AKIA[A-Z0-9]+", 0, "v >= 16"), ("hex", "[0-9a-f]+", 0, "v >= 32"),
        ("key40", "[A-Za-z0-9/+]{40,}", 0, "v = 40"), ("endpoint", "https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, "v >= 12"))
    found = " UNION ALL ".join(
        f"SELECT row_no, '{k}' AS kind, {i} AS rank, unnest(generate_series(1, len(w))) AS n, unnest(p[: len(w)]) AS gap, unnest(w) AS whole, unnest(g) AS val FROM (SELECT row_no, regexp_extract_all(text, '{p}') AS w, regexp_extract_all(text, '{p}', {g}) AS g, regexp_split_to_array(text, '{p}') AS p FROM docs WHERE regexp_matches(text, '{p}'))"
        for i, (k, p, g, _) in enumerate(kinds))
    fits = " OR ".join(f"(kind = '{k}' AND {f})" for k, _, _, f in kinds)
    near = "EXISTS (SELECT 1 FROM parts b WHERE b.row_no = a.row_no AND {0} AND a.start BETWEEN b.start - 400 AND b.stop + 400)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (SELECT row_no, kind, rank, length(val) AS v, length(whole) AS size, sum(length(gap) + length(whole)) OVER (PARTITION BY row_no, kind ORDER BY n) AS stop FROM found),
parts AS (SELECT row_no, kind, rank, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE {fits}),
keys AS (SELECT * FROM parts a WHERE kind = 'key40' AND {near.format("b.kind = 'access'")}),
secrets AS (SELECT * FROM parts WHERE kind IN ('assign', 'hex') UNION ALL SELECT * FROM keys),
ends AS (SELECT * FROM parts a WHERE kind = 'endpoint' AND {near.format("b.kind = 'access'")} AND {near.replace("FROM parts", "FROM secrets").format("true")}),
spans AS (SELECT * FROM parts WHERE rank < 3 UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM ends),
listed AS (SELECT row_no, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row_no)"""


def _chat() -> str:
    control = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])"
    role = f"regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '{control}', '\\1\\2\\\\\\3', 'g')"
    return rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, 8 + length({role}) + 1 + length(regexp_replace(text, '{control}', '\1\2\\\3', 'g')) + 8 AS size FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def _archives() -> str:
    return """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM rows),
first AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS of FROM sized)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = of THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> of THEN of END AS refers_to FROM first"""


def _phrases() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(ws[i : i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(generate_series(1, len(ws) - {k - 1})) AS i FROM pieces)" for k in range(1, 6))
    return rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM texts)),
grams AS ({grams}),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
inside AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, k, string_split(phrase, ' ') AS w, unnest(generate_series(1, k)) AS i FROM candidates WHERE k > 2), (SELECT unnest(generate_series(2, 4)) AS s) WHERE s < k AND i + s - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < c.a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[: cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS rest FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = rest JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM least QUALIFY rank <= 2000"""


def _filter_audit() -> str:
    names = "ABCDE"
    bits = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(names))
    count = lambda what, when: f"coalesce(sum({what}) FILTER (WHERE {when}), 0)::BIGINT"
    here = "mask & o.before = 0 AND mask & o.bit > 0"
    return rf"""
WITH RECURSIVE bits(name, bit) AS (VALUES {bits}),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM docs),
masks AS (SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id IS NOT NULL AND low < doc_id)::INT AS mask FROM words),
marks AS (SELECT doc_id, max((quality IS NOT NULL AND quality = 1)::INT) AS good, max((toxic IS NOT NULL AND toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
orders(filter_order, used, step, before, bit) AS (SELECT name, bit, 1, 0, bit FROM bits UNION ALL SELECT filter_order || name, used | b.bit, step + 1, used, b.bit FROM orders, bits b WHERE used & b.bit = 0),
full_orders AS (SELECT filter_order FROM orders WHERE step = 5),
places AS (SELECT f.filter_order, o.step, o.before, o.bit FROM full_orders f JOIN orders o ON starts_with(f.filter_order, o.filter_order)),
found AS (SELECT part, o.filter_order, o.step, o.bit, {count("n", "mask & (o.before | o.bit) = 0")} AS kept, {count("n", here)} AS removed, {count("n", "mask & o.before > 0 AND mask & o.bit > 0")} AS redundant,
 {count("n", "mask = o.bit")} AS unique_fails, {count("good", here)} AS good_lost, {count("toxic", here)} AS toxic_lost FROM cells, places o GROUP BY part, o.filter_order, o.step, o.bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM found"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _chat(), "op5_warc": _archives(), "op3_url_filters": _url_filters(), "op7_secret_scans": _secrets(), "op4_benchmark_decontamination": _decontamination(), "op6_minhash_near_dedup": _near_duplicates(), "op10_quality_rules": _quality(),
            "op11_phrase_collocation_mining": _phrases(), "op12_filter_interaction_audit": _filter_audit()}
