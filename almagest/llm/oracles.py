"""SQL that says what the queries of this subpackage return, for the operators that SQL can express."""

from __future__ import annotations

from almagest.llm.decontamination import NAME, PLAIN, SIZE, TOKEN, UNITS
from almagest.llm.secrets import BASE, MORE, Rule
from almagest.llm.urls import CONFIDENCE, LOWER, SUPPORT, UPPER

SPACES = r"[\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    """Every subset of a labelled URL's tokens is counted; so SQL needs no tree."""
    listed = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in rules)
    return f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
t AS (
  SELECT page_id, host, path, CASE WHEN NOT contains(url, '://') THEN [] ELSE list_sort(list_distinct(
    ['scheme=' || lower(regexp_extract(url, '(?s)^(.*?)://', 1))]
    || list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'host=' || array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s, i: 'path' || (i - 1) || '=' || regexp_replace(s, '[0-9]+', '#', 'g'))
    || list_transform(regexp_extract_all(url, '[?&]([^=&#?]+)', 1), lambda k: 'key=' || k))) END AS tokens
  FROM p),
labelled AS (
  SELECT tokens, (coalesce(l.quality = 0, false) OR coalesce(l.toxic = 1, false)) AS bad
  FROM t JOIN labels l ON t.page_id = l.doc_id WHERE len(tokens) > 0),
subsets AS (
  SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS held, bad
  FROM labelled, unnest(range(1, CAST(2 ** len(tokens) AS BIGINT))) AS u(m)),
mined AS (
  SELECT held, count(*) FILTER (WHERE bad) / count(*) AS confidence FROM subsets GROUP BY held
  HAVING count(*) FILTER (WHERE bad) >= greatest(1, (SELECT ceil({SUPPORT} * count(*)) FROM labelled))
    AND count(*) FILTER (WHERE bad) / count(*) >= {CONFIDENCE}),
hits AS (
  SELECT s.tokens, max(confidence) AS confidence FROM (SELECT DISTINCT tokens FROM t) s JOIN mined ON list_has_all(s.tokens, mined.held) GROUP BY s.tokens),
fixed AS (SELECT * FROM (VALUES {listed}) AS r(verdict, host, path)),
best AS (
  SELECT t.page_id, arg_max(f.host || f.path, len(f.host || f.path) * 1000 + len(f.host)) AS rule, arg_max(f.verdict, len(f.host || f.path) * 1000 + len(f.host)) AS verdict
  FROM t JOIN fixed f ON (t.host = f.host OR ends_with(t.host, '.' || f.host)) AND starts_with(t.path, f.path) GROUP BY t.page_id)
SELECT t.page_id, t.host, t.path, b.rule, coalesce(b.verdict, CASE WHEN h.confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, round(h.confidence, 9) AS mined_confidence
FROM t LEFT JOIN best b ON b.page_id = t.page_id LEFT JOIN hits h ON h.tokens = t.tokens
"""


def _spans(rule: Rule, place: int) -> str:
    pattern = quoted(rule.pattern)
    return f"""
  SELECT doc_id, {place} AS place, {quoted(rule.kind)} AS kind, start, start + length(m[i]) AS stop FROM (
    SELECT doc_id, i, m, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS g, string_split_regex(text, {pattern}) AS b FROM d) x, unnest(range(1, len(m) + 1)) AS u(i)
    WHERE length(g[i]) >= {rule.at_least})"""


def secrets_sql() -> str:
    union = "\n  UNION ALL".join(_spans(r, i) for i, r in enumerate(BASE + MORE))
    line = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({union}),
g AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY start, place) FILTER (WHERE place < {len(BASE)}) AS base, string_agg({line}, ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def jaccard_sql(size: int, percent: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS s FROM w, unnest(range(1, greatest(2, len(w) - {size} + 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN shared USING (s) JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def lines_sql(exact: int, near: int) -> str:
    return f"""
WITH l AS (SELECT doc_id, i, string_split(text, chr(10)) AS l FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, l[i] AS line, {words("l[i]")} AS w, row_number() OVER (ORDER BY doc_id, i) AS o FROM l),
k AS (SELECT o, array_to_string(w, ' ') AS whole, w, len(w) AS n FROM w WHERE len(w) >= {exact}),
f AS (SELECT whole, any_value(w) AS w, any_value(n) AS n, min(o) AS o FROM k GROUP BY whole),
v AS (SELECT whole, n, o, j, array_to_string(w[:j - 1] || w[j + 1:], ' ') AS rest FROM f, unnest(range(1, n + 1)) AS u(j) WHERE n >= {near}),
subs AS (SELECT whole, o, min(o) OVER (PARTITION BY rest, j, n) AS first FROM v),
dels AS (SELECT v.whole AS long, f.whole AS short, v.o AS lo, f.o AS so FROM v JOIN f ON f.whole = v.rest ),
first AS (
  SELECT whole, min(first) AS first FROM (
    SELECT whole, o AS first FROM f UNION ALL SELECT whole, first FROM subs UNION ALL SELECT long, so FROM dels UNION ALL SELECT short, lo FROM dels) GROUP BY whole),
gone AS (SELECT k.o FROM k JOIN first ON first.whole = k.whole WHERE first.first < k.o),
r AS (SELECT w.doc_id, count(*) AS n_lines, count(gone.o) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.o IS NULL) AS kept FROM w LEFT JOIN gone ON gone.o = w.o GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(r.kept, '') END AS kept_text
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""


def repeats_sql(size: int) -> str:
    return f"""
WITH w AS (SELECT doc_id, {words("text")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS x FROM w, unnest(range(1, greatest(1, len(w) - {size} + 2))) AS u(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS o FROM x) WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, {size})) AS u(k)),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS kept FROM (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(i)) a
  ANTI JOIN gone ON gone.doc_id = a.doc_id AND gone.i = a.i GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def contamination_sql() -> str:
    """Windows of ten tokens as lists; items without a window of enough plain words are compared whole."""
    units = ", ".join(map(quoted, UNITS))
    kind = f"CASE WHEN t >= '0' AND t < ':' THEN '<number>' WHEN lower(t) IN ({units}) THEN '<unit>' WHEN regexp_matches(t, '{NAME}') THEN '<name>' END"
    words_of = lambda table, key: f"SELECT {key} AS k, t, list_transform(t, lambda t: {kind}) AS s FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM {table})"
    windows = f"SELECT k, i, t[i:i + {SIZE - 1}] AS ts, s[i:i + {SIZE - 1}] AS slots FROM {{0}}, unnest(range(1, greatest(1, len(t) - {SIZE} + 2))) AS u(i)"
    form = "array_to_string(list_transform(ts, lambda t, i: coalesce(slots[i], lower(t))), ' ')"
    return f"""
WITH bt AS ({words_of("benchmark", "item_id")}),
bw AS (SELECT DISTINCT k AS item, ts AS theirs, slots, {form} AS form FROM ({windows.format("bt")}) WHERE len(list_filter(slots, lambda s: s IS NULL)) >= {PLAIN}),
whole AS (SELECT k AS item, list_transform(t, lambda t: lower(t)) AS w FROM bt WHERE len(t) > 0 AND k NOT IN (SELECT item FROM bw)),
dt AS ({words_of("documents", "doc_id")}),
dw AS (SELECT k AS doc_id, i AS pos, ts AS ours, slots, {form} AS form FROM ({windows.format("dt")})),
m AS (
  SELECT doc_id, pos, item, list_distinct(list_filter(list_transform(ours, lambda t, i: CASE WHEN dw.slots[i] IS NOT NULL THEN {{'a': t, 'b': theirs[i]}} END), lambda p: p IS NOT NULL)) AS pairs
  FROM dw JOIN bw ON bw.form = dw.form),
hits AS (
  SELECT doc_id, pos, item FROM m
  WHERE len(pairs) = len(list_distinct(list_transform(pairs, lambda p: p.a))) AND len(pairs) = len(list_distinct(list_transform(pairs, lambda p: p.b)))
  UNION ALL SELECT doc_id, pos, item FROM (SELECT k AS doc_id, i AS pos, t, item, w FROM dt, whole, unnest(range(1, greatest(1, len(t) - len(w) + 2))) AS u(i))
  WHERE list_transform(t[pos:pos + len(w) - 1], lambda t: lower(t)) = w),
found AS (SELECT doc_id, count(DISTINCT pos) AS n_windows, list_sort(list(DISTINCT item)) AS item_ids FROM hits GROUP BY doc_id)
SELECT documents.doc_id, found.doc_id IS NOT NULL AS contaminated, coalesce(n_windows, 0) AS n_windows, array_to_string(coalesce(item_ids, []), ',') AS item_ids
FROM documents LEFT JOIN found ON found.doc_id = documents.doc_id
"""
