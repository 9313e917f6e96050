"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from driftloom.llm import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op5() -> str:
    count = lambda p: "len(regexp_extract_all(t, '" + p.replace("'", "''") + "'))"
    named = [count(r"[\x20\x09-\x0D]"), count(quality.SYMBOLS), *(count(p) for p in quality.CLASSES.values())]
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    far = (
        "sqrt(greatest(coalesce(list_sum(list_transform(list_zip({p}, {q}), lambda x: ({h}) / 2)), 0), 0))"
    )
    a, b = "(x[1] / list_sum({p}))", "(x[2] / list_sum({q}))"
    half = lambda u, v: f"CASE WHEN {u} > 0 THEN {u} * log2(2 * {u} / ({u} + {v})) ELSE 0 END"

    def distance(p: str, q: str) -> str:
        u, v = a.format(p=p), b.format(q=q)
        return f"CASE WHEN list_sum({p}) > 0 THEN " + far.format(p=p, q=q, h=f"{half(u, v)} + {half(v, u)}") + " ELSE 0 END"

    return f"""
WITH known AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {quality.LEAST_DOCUMENTS} ORDER BY count(*) DESC, lang LIMIT {quality.MOST_LANGUAGES}),
d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, CASE WHEN lang IN (SELECT lang FROM known) THEN lang END AS q_lang FROM documents),
often AS (SELECT q_lang, list(x ORDER BY n DESC, x) AS cw FROM (SELECT *, row_number() OVER (PARTITION BY q_lang ORDER BY n DESC, x) AS o FROM
    (SELECT q_lang, x, count(*) AS n FROM (SELECT q_lang, unnest(regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D]+')) AS x FROM d WHERE q_lang IS NOT NULL) GROUP BY ALL)) WHERE o <= {quality.COMMON} GROUP BY q_lang),
runs AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 5)) FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM
    (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
h AS (SELECT d.*, [{", ".join(named)}] AS n, coalesce(cw, []::VARCHAR[]) AS cw FROM d LEFT JOIN often USING (q_lang)),
f AS (SELECT *, list_append(n, length(t) - list_sum(n))::BIGINT[] AS qc,
    list_append(list_transform(cw, lambda c: len(list_filter(w, lambda x: lower(x) = c))), len(list_filter(w, lambda x: NOT list_contains(cw, lower(x)))))::BIGINT[] AS qw FROM h),
lang AS (SELECT q_lang, {sums("qc", len(quality.CLASSES) + 3)} AS rc,
    list_filter({sums("qw", 1 + quality.COMMON)}, lambda x: x IS NOT NULL) AS rw FROM f GROUP BY q_lang),
e AS (SELECT f.doc_id, len(w)::BIGINT AS n_words, (length(t) - f.n[1])::BIGINT AS word_chars, f.n[2]::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
    {distance("qc", "rc")} AS character_distance, {distance("qw", "rw")} AS word_distance
  FROM f JOIN lang ON f.q_lang IS NOT DISTINCT FROM lang.q_lang LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {quality.LEAST_WORDS["characters"]} AND character_distance > {quality.MOST_DISTANCE["characters"]})
    AND NOT (n_words >= {quality.LEAST_WORDS["words"]} AND word_distance > {quality.MOST_DISTANCE["words"]}) AS kept
FROM g"""


def op4(percent: int = 80) -> str:
    """Only classes that share one of their rarest words can be similar; the rest is brute force."""
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
cell AS (SELECT doc_id, i - 1 AS no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
word AS (SELECT doc_id, no, line, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS w FROM cell),
fit AS (SELECT doc_id, no, list_sort(list_distinct(w)) AS s FROM word WHERE len(w) > 0),
cls AS (SELECT s, min((doc_id, no)) AS place, row_number() OVER () AS c FROM fit GROUP BY s),
tok AS (SELECT c, unnest(s) AS t FROM cls),
ord AS (SELECT c, t, row_number() OVER (PARTITION BY c ORDER BY df, t) AS r FROM (SELECT c, t, count(*) OVER (PARTITION BY t) AS df FROM tok)),
pre AS (SELECT ord.c, t FROM ord JOIN cls USING (c) WHERE r <= len(s) - ceil(len(s) * {percent} / 100.0 - 1e-9) + 1),
pair AS (SELECT DISTINCT a.c AS a, b.c AS b FROM pre a JOIN pre b USING (t) WHERE a.c <> b.c),
hit AS (SELECT DISTINCT x.c FROM pair JOIN cls x ON x.c = pair.a JOIN cls y ON y.c = pair.b
  WHERE y.place < x.place AND 100 * len(list_intersect(x.s, y.s)) >= {percent} * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
gone AS (SELECT doc_id, no FROM fit JOIN cls USING (s) WHERE (doc_id, no) <> place OR c IN (SELECT c FROM hit))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.no)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY cell.no) FILTER (WHERE g.no IS NULL), '')) AS kept_sha256
FROM cell LEFT JOIN gone g USING (doc_id, no) GROUP BY doc_id"""


def op10() -> str:
    return r"""
WITH cap AS (SELECT page_id, fetched_at, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS p
  FROM (SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (page_id * 7919 % 8760) AS fetched_at FROM pages)),
seen AS (SELECT page_id, fetched_at, CASE WHEN p = '' THEN '/' ELSE p END AS p,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(authority), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '') AS host FROM cap),
hosts AS (SELECT DISTINCT host FROM seen WHERE host IS NOT NULL),
log AS (
  SELECT 'hosts' AS list, host, '/' AS path, kind AS action, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (length(host) * 17 % 150 + shift) AS ts
    FROM hosts, (VALUES ('add', 0), ('remove', 70), ('add', 160)) v(kind, shift) WHERE length(host) % 3 <> 0
  UNION ALL
  SELECT DISTINCT 'zones', regexp_extract(host, '([^.]+\.[^.]+)$', 1), '/en/', kind, TIMESTAMP '2024-03-01' + INTERVAL 1 DAY * shift AS ts
    FROM hosts, (VALUES ('add', 0), ('add', 20), ('remove', 90)) v(kind, shift)),
span AS (SELECT list, host, path, ts AS since, until FROM
  (SELECT *, lead(ts) OVER (PARTITION BY list, host, path ORDER BY ts, action) AS until FROM (SELECT DISTINCT * FROM log))
  WHERE action = 'add' AND (until IS NULL OR until > ts)),
hit AS (SELECT DISTINCT page_id, fetched_at, list FROM seen s JOIN span ON (s.host = span.host OR ends_with(s.host, '.' || span.host))
  AND since <= fetched_at AND (until IS NULL OR fetched_at < until) AND starts_with(p, path))
SELECT s.page_id, s.host, s.fetched_at, coalesce(string_agg(list, ',' ORDER BY list), '') AS lists, count(list) > 0 AS blocked
FROM seen s LEFT JOIN hit USING (page_id) GROUP BY ALL"""


def op3(percent: int = 80) -> str:
    """Brute force over shared two-word shingles; components by walking the links."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS t, len(s) AS n FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (t) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT e.b, walk.c FROM walk JOIN e ON walk.d = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN walk ON d = doc_id GROUP BY doc_id, s"""


def op6(length: int = 200) -> str:
    """Every window of the table counted by itself."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + {length - 1}]) AS m FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {length - 2})) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM span UNION ALL SELECT doc_id, coalesce(max(z), 1), octet_length(any_value(b)) + 1 FROM d LEFT JOIN span USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN t > f THEN hex(b[f:t - 1]) ELSE '' END, '' ORDER BY f) AS h FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
size AS (SELECT doc_id, sum(z - a) AS n, count(*) AS k FROM span GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN size USING (doc_id)"""


_LOW = "translate(coalesce(text, ''), '" + "".join(map(chr, range(65, 91))) + "', '" + "".join(map(chr, range(97, 123))) + "')"
_SPOKEN = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op11() -> str:
    """The checksum is computed byte by byte with its table, once for each different run of words."""
    return f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS tab),
w AS (SELECT true AS mine, doc_id, {_SPOKEN} AS w FROM documents UNION ALL SELECT false, item_id, {_SPOKEN} FROM benchmark),
f AS MATERIALIZED (SELECT mine, doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS f FROM (SELECT mine, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
h AS (SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM f)),
c AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS b FROM h, tab),
n AS MATERIALIZED (SELECT mine, doc_id, b, count(*) AS n FROM f JOIN c USING (f) GROUP BY ALL),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM
  (SELECT b, coalesce(sum(n) FILTER (mine), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT mine), 0)::BIGINT AS t FROM n GROUP BY b),
  (SELECT coalesce(sum(n) FILTER (mine), 0)::BIGINT AS ss, coalesce(sum(n) FILTER (NOT mine), 0)::BIGINT AS tt FROM n)),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN g USING (b) WHERE mine GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN weighed USING (doc_id) WHERE mine),
place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS most FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM scored LEFT JOIN place USING (doc_id)"""


def op12(window: int = 10) -> str:
    """Every run of words of every document held against all windows."""
    return f"""
WITH d AS (SELECT doc_id, {_SPOKEN} AS w FROM documents),
b AS (SELECT item_id, {_SPOKEN} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS x FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), {window}) AS k FROM b WHERE len(w) > 0))),
run AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM run JOIN win USING (k, x)),
cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, cover.n IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op13() -> str:
    """The three parts as stretches of the text, by where its lines end; SQL restores the text from the output's marks."""
    h = lambda i: f"('0x' || h[{8 * i + 1}:{8 * i + 8}])::BIGINT"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, string_split(t, chr(10)) AS l FROM t),
n AS (SELECT *, CASE WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END AS n FROM u),
c AS (SELECT *, {h(0)} % (n + 1) AS a, {h(1)} % (n + 1) AS b FROM n),
e AS (SELECT *, coalesce(list_sum(list_transform(l[:least(a, b)], lambda x: length(x) + 1)), 0) AS p, coalesce(list_sum(list_transform(l[:greatest(a, b)], lambda x: length(x) + 1)), 0) AS m FROM c),
f AS (SELECT doc_id, t, n, least(p, length(t))::BIGINT AS p, least(m, length(t))::BIGINT AS m,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN {h(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || t[m + 1:] || '<P>' || t[:p] || '<M>' || t[p + 1:m] ELSE '<P>' || t[:p] || '<S>' || t[m + 1:] || '<M>' || t[p + 1:m] END AS o FROM f),
r AS (SELECT *, split_part(o, '<M>', 2) AS mid, split_part(o, '<M>', 1)[4:] AS head FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'spm' THEN split_part(head, '<P>', 2) || mid || split_part(head, '<P>', 1) ELSE split_part(head, '<S>', 1) || mid || split_part(head, '<S>', 2) END) AS restored_sha256
FROM r"""
