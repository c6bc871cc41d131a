"""DuckDB SQL for the queries that SQL can express."""

from .license_scan import TEMPLATES, THRESHOLD

SQL: dict[str, str] = {}

SQL["op4_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
  SELECT a.*, coalesce(b.owner < a.doc_id, false) AS dropped
  FROM keyed a LEFT JOIN owners b ON a.key = b.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS9 = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op9_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS9.format(t="text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS9.format(t="text")} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM sized)),
lengths AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT dw.doc_id, dw.k, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT doc_id, k, m FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit,
       coalesce(items.n_items, 0)::BIGINT AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 4], ' ')) AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN size USING (doc_id)
"""

SQL["op1_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(x || '00', 1 + (k * 5 // 4), 4))::BIGINT >> (11 - (k * 5) % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM h
"""

_NOTICES = ", ".join(f"({k}, '{n}', '" + t.replace("'", "''") + "')" for k, (n, t) in enumerate(TEMPLATES))

SQL["op2_license_scan"] = rf"""
WITH notice(k, license, t) AS (VALUES {_NOTICES}),
unit AS (
  SELECT doc_id, 1 AS is_line, u AS line, string_split(coalesce(text, ''), chr(10))[u] AS t
  FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u FROM documents)
  UNION ALL SELECT doc_id, 0, 0, coalesce(text, '') FROM documents),
nw AS (SELECT k, license, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM notice),
ng AS (SELECT k, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM nw),
uw AS (SELECT doc_id, is_line, line, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM unit),
ug AS (SELECT doc_id, is_line, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM uw),
pairs AS (
  SELECT doc_id, is_line, line, k, license, 2.0::DOUBLE * len(list_intersect(ug.g, ng.g)) / (len(ug.g) + len(ng.g)) AS dice
  FROM ug, ng WHERE len(ug.g) * {THRESHOLD}::DOUBLE / (2 - {THRESHOLD}::DOUBLE) <= len(ng.g) AND len(ng.g) * {THRESHOLD}::DOUBLE / (2 - {THRESHOLD}::DOUBLE) <= len(ug.g)),
hit AS (SELECT * FROM pairs WHERE dice >= {THRESHOLD}),
best AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k) AS r FROM hit),
lines AS (SELECT doc_id, count(DISTINCT line) AS n FROM hit WHERE is_line = 1 GROUP BY doc_id)
SELECT d.doc_id, best.license, coalesce(best.dice, 0.0)::DOUBLE AS dice, coalesce(lines.n, 0)::BIGINT AS n_lines_matching
FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id AND best.r = 1 LEFT JOIN lines ON lines.doc_id = d.doc_id
"""

SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
owner AS (SELECT t, min(doc_id) AS o FROM win GROUP BY t HAVING count(DISTINCT doc_id) > 1),
bad AS (SELECT DISTINCT win.doc_id, win.k FROM win JOIN owner ON win.t = owner.t WHERE owner.o < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM bad),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(word.x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(kept.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
