"""DuckDB twins of the registered queries, written from the definitions and not from the code."""

from __future__ import annotations

from rankloom.llm.licence_texts import SPELLINGS, TEXTS

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP1 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT k FROM wins),
places AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM docs, lengths, unnest(range(1, len(w) - k + 2)) AS t(i)
),
hits AS (SELECT r, i, p.k, item FROM places p JOIN wins USING (k, s)),
covered AS (SELECT r, count(DISTINCT j) AS n FROM hits, unnest(range(i, i + k)) AS t(j) GROUP BY r),
named AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)
"""

OP2 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
fits AS (
  SELECT page_id, host, path,
    (SELECT arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) FROM rules
     WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parts
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fits
"""

OP8 = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
),
marks AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT s.*, -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5)
    / CAST(4503599627370496 AS DOUBLE)) / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM sized s LEFT JOIN marks USING (doc_id)
),
totals AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total FROM docs GROUP BY source),
weighed AS (
  SELECT *, 2.0 * total AS stop,
    CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM totals
),
before AS (
  SELECT *, sum(weight) OVER () AS all_weight, 1.5 * sum(total) OVER () AS budget,
    coalesce(sum(weight) OVER earlier, 0) AS weight_before, coalesce(sum(stop) OVER earlier, 0) AS stop_before
  FROM weighed
  WINDOW earlier AS (ORDER BY stop / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
stopped AS (SELECT *, stop * (all_weight - weight_before) <= weight * (budget - stop_before) AS at_stop FROM before),
level AS (
  SELECT greatest(0, max(budget) - coalesce(sum(stop) FILTER (at_stop), 0)) / sum(weight) FILTER (NOT at_stop) AS level
  FROM stopped
),
targets AS (
  SELECT source, total, CASE WHEN at_stop THEN stop ELSE least(stop, weight * level) END AS target FROM stopped, level
),
ordered AS (
  SELECT d.*, total, target, floor(target / total + 1e-12) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size, r
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
times AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
    CAST(epochs AS BIGINT) + CASE WHEN earlier + size / 2.0 <= greatest(0, target - epochs * total) THEN 1 ELSE 0 END END AS n
  FROM ordered
)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target, CAST(n * size AS BIGINT) AS taken, source,
  CAST(n AS BIGINT) AS times FROM times
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _respelled(column: str) -> str:
    for given, usual in SPELLINGS:
        column = f"regexp_replace({column}, {_quoted(chr(92) + 'b' + given + chr(92) + 'b')}, {_quoted(usual)}, 'g')"
    return column


_MARK = r"(copyright\b|\(c\)|©)"
_YEARS = r"[0-9]{4}(\s*[-–,]\s*[0-9]{4})*"
# A copyright statement: marks, years, and the holder up to its sentence's end, a paragraph break or
# "all rights reserved"; the line form also ends at the line's end.
_SENTENCE = rf"(?i){_MARK}([\s,]*{_MARK})*[\s,]*{_YEARS}[^.]*?(all rights reserved\.?|\.\s|\.\z|\n[ \t\r]*\n|\z)"
_LINE = rf"(?i){_MARK}([ \t,]*{_MARK})*[ \t,]*{_YEARS}[^.\n]*?(all rights reserved\.?|\.\s|\.\z|\n|\z)"


def _canonical(column: str, statement: str) -> str:
    kept = f"regexp_replace(regexp_replace({column}, {_quoted(statement)}, ' ', 'g'), '(?i)\\ball rights reserved\\b\\.?', ' ', 'g')"
    return _respelled(f"trim(regexp_replace(lower({kept}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))")


OP6 = f"""
WITH known_texts(n, licence, text) AS (VALUES {", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(TEXTS))}),
units AS (
  SELECT 'known' AS kind, n AS r, NULL AS doc_id, licence, coalesce(text, '') AS text FROM known_texts
  UNION ALL SELECT 'doc', row_number() OVER (), doc_id, NULL, coalesce(text, '') FROM documents
),
forms AS (
  SELECT kind, r, doc_id, licence, {_canonical("text", _SENTENCE)} AS whole, {_canonical("text", _LINE)} AS by_line FROM units
),
lines AS (
  SELECT r, {_canonical("line", _LINE)} AS words
  FROM (SELECT r, unnest(string_split_regex(text, '\r?\n|\r')) AS line FROM units WHERE kind = 'doc')
),
known AS (
  SELECT md5(c) AS digest, min(licence) AS licence
  FROM (SELECT licence, whole AS c FROM forms WHERE kind = 'known' UNION ALL SELECT licence, by_line FROM forms WHERE kind = 'known')
  WHERE c <> '' GROUP BY 1
),
notices AS (
  SELECT r, list_sort(list(DISTINCT licence)) AS notices
  FROM (SELECT r, md5(words) AS digest FROM lines WHERE words <> '') JOIN known USING (digest)
  GROUP BY r
)
SELECT f.doc_id, CASE WHEN whole <> '' THEN md5(whole) END AS digest, coalesce(a.licence, b.licence) AS licence,
  coalesce(notices, CAST([] AS VARCHAR[])) AS notices,
  coalesce(a.licence, b.licence) IS NOT NULL OR notices IS NOT NULL AS found
FROM (SELECT * FROM forms WHERE kind = 'doc') f
LEFT JOIN known a ON whole <> '' AND md5(whole) = a.digest
LEFT JOIN known b ON by_line <> '' AND md5(by_line) = b.digest
LEFT JOIN notices USING (r)
"""


OP5 = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT a, b, s.n = x.n AND s.n = y.n AS equal FROM shared s JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
  WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
ids AS (SELECT r, doc_id FROM docs),
components AS (SELECT a AS r, min(doc_id) AS low FROM reach JOIN ids ON ids.r = reach.b GROUP BY a),
classes AS (SELECT a AS r, min(doc_id) AS low FROM links JOIN ids ON ids.r = links.b WHERE equal GROUP BY a),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, classes.low) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
  least(doc_id, components.low) AS component_id, doc_id = least(doc_id, components.low) AS kept
FROM docs LEFT JOIN classes USING (r) LEFT JOIN components USING (r) LEFT JOIN counts USING (r)
"""

OP7 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT r, i, trim(parts[i], ' ' || chr(9) || chr(13)) AS line,
    {'none': doc_id IS NULL, 'id': doc_id, 'key': md5(coalesce(text, 'null')), 'place': i} AS pos
  FROM docs, unnest(range(1, len(parts) + 1)) AS t(i)
),
kinds AS (SELECT line, min(pos) AS first, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
halves AS (
  SELECT line, first, n, m, side, CASE side WHEN 0 THEN left(line, m // 2) ELSE right(line, m // 2) END AS half
  FROM kinds, unnest([n, n - 1]) AS t(m), unnest([0, 1]) AS u(side) WHERE n >= 12
),
near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b USING (m, side, half)
  WHERE b.first < a.first AND levenshtein(a.line, b.line) = 1
),
gone AS (
  SELECT r, i FROM lines JOIN kinds USING (line) WHERE pos <> first OR line IN (SELECT line FROM near)
),
lost AS (SELECT r, list(i) AS places FROM gone GROUP BY r)
SELECT doc_id, CAST(coalesce(len(parts), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(places), 0) AS INTEGER) AS n_gone,
  array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(coalesce(places, []), i)], chr(10)) AS text
FROM docs LEFT JOIN lost USING (r)
"""

OP10 = """
WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
valid AS (
  SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM vectors
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM valid a JOIN valid b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9 END
),
reach AS (SELECT a, b, id FROM links UNION SELECT reach.a, links.b, links.id FROM reach JOIN links ON reach.b = links.a),
components AS (SELECT a AS r, min(id) AS low FROM reach GROUP BY a),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, low) AS component_id,
  vec_id = least(vec_id, low) AS kept
FROM vectors LEFT JOIN components USING (r) LEFT JOIN counts USING (r)
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
windows AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM words, (VALUES (1), (2), (3)) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS t(i)
),
counted AS (SELECT lang, k, gram, count(*) AS f FROM windows GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, gram AS phrase, f AS a, string_split(gram, ' ') AS w FROM counted WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp
  FROM candidates c, unnest(range(1, k)) AS t(j)
),
parts AS MATERIALIZED (SELECT lang, gram, f FROM counted WHERE f >= 10),
lefts AS MATERIALIZED (SELECT cuts.*, p.f AS l FROM cuts JOIN parts p ON p.lang = cuts.lang AND p.gram = cuts.lp),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.j, x.l, p.f AS r, (1000000::HUGEINT * x.a * x.a) // (x.l::HUGEINT * p.f) AS score
  FROM lefts x JOIN parts p ON p.lang = x.lang AND p.gram = x.rp
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS sub, max(a) AS longer FROM candidates, unnest([1, 2]) AS t(s)
  WHERE k = 3 GROUP BY ALL
),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside o ON o.lang = b.lang AND o.sub = b.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""

ORACLE = {
    "op1_decontamination": OP1,
    "op2_url_filter": OP2,
    "op5_jaccard_join": OP5,
    "op6_licence_scan": OP6,
    "op7_line_dedup": OP7,
    "op8_source_mixing": OP8,
    "op10_embedding_join": OP10,
    "op11_phrase_collocations": OP11,
}
