"""SQL of operators whose results SQL can express, for DuckDB on the small tables."""

from __future__ import annotations

from .common import LOWER, UPPER
from .license_rules import rules
from .license_scan import REACH
from .quality import BITS, ENOUGH, MAX_REPEAT, MIN_WORDS, RATES, SPREADS, UNIT, WINDOW
from .suffix_dedup import LENGTH


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_scan_sql() -> str:
    """Every rule at every keyword, then suppression as an anti join of all detections of a document."""
    values = ",\n".join(
        f"({i}, {_quoted(r.keyword)}, {_quoted(r.need)}, {_quoted(r.left)}, {_quoted(r.right.replace('(?= |$)', ''))}, {_quoted(r.label)}, {r.priority}, {float(r.weight)}::DOUBLE, {str(r.base).lower()})" for i, r in enumerate(rules())
    )
    return rf"""
WITH rules(id, keyword, need, lp, rp, label, priority, weight, base) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS row_no, doc_id,
        list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
p AS (SELECT row_no, w, unnest(range(len(w))) AS i FROM d),
k AS (SELECT row_no, i, w[i + 1] AS word,
        array_to_string(list_transform(list_slice(w, greatest(i - {REACH}, 0) + 1, i), lambda x: x || ' '), '') AS l,
        array_to_string(list_transform(list_slice(w, i + 2, i + 1 + {REACH}), lambda x: ' ' || x), '') AS r
      FROM p WHERE w[i + 1] IN (SELECT keyword FROM rules)),
m AS (SELECT k.*, rules.*, CASE WHEN lp = '' THEN '' ELSE regexp_extract(' ' || l, ' (' || lp || ')$', 1) END AS lm,
        CASE WHEN rp = '' THEN '' ELSE regexp_extract(r || ' ', '^(' || rp || ') ', 1) END AS rm
      FROM k JOIN rules ON word = keyword
      WHERE (need = '' OR contains(l, need) OR contains(r, need))
        AND (lp = '' OR regexp_matches(' ' || l, ' (' || lp || ')$')) AND (rp = '' OR regexp_matches(r || ' ', '^(' || rp || ') '))),
f AS (SELECT row_no, id, label, priority, weight, base, i - (strlen(lm) - strlen(replace(lm, ' ', ''))) AS a, i + (strlen(rm) - strlen(replace(rm, ' ', ''))) AS b FROM m),
s AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f e WHERE e.row_no = x.row_no AND e.a <= x.a AND e.b >= x.b
        AND (e.priority, e.b - e.a, -e.id, -e.a) > (x.priority, x.b - x.a, -x.id, -x.a))),
base AS (SELECT row_no, count(*) AS n, min(a) AS lo, max(a) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f WHERE base GROUP BY row_no),
every AS (SELECT row_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row_no, label FROM s UNION ALL SELECT row_no, label FROM f WHERE base) GROUP BY row_no),
best AS (SELECT row_no, max(weight) AS score FROM s GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.lo AS BIGINT) AS first_word, CAST(base.hi AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(best.score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN base USING (row_no) LEFT JOIN every USING (row_no) LEFT JOIN best USING (row_no)
"""


def suffix_dedup_sql() -> str:
    """Every window of every document, ranked among its equals; then runs of removed bytes and what stands between them."""
    n = LENGTH
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substring(h, 2 * s + 1, {2 * n}) AS bytes FROM (SELECT doc_id, h, unnest(range(greatest(strlen(h) // 2 - {n - 1}, 0))) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, s) AS rn FROM w) WHERE rn > 1),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {n} THEN 0 ELSE 1 END AS fresh FROM r)),
c AS (SELECT doc_id, min(s) AS a, max(s) + {n} AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM c
      UNION ALL SELECT d.doc_id, coalesce(max(c.b), 0), strlen(any_value(h)) // 2 FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id),
t AS (SELECT doc_id, string_agg(substring(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
x AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM c GROUP BY doc_id)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def quality_sql() -> str:
    """The statistics, the same sketches (counts by leading bits, added up by source, language and all), and the fences."""
    rates = ", ".join(f"CASE WHEN {r.of} > 0 THEN ({UNIT} * {r.over}) // {r.of} ELSE 0 END AS {r.name}" for r in RATES)
    each = ", ".join(f"('{r.name}', {r.name})" for r in RATES)
    least = ", ".join(f"('{r.name}', {r.least})" for r in RATES)
    tests = " UNION ALL ".join(
        f"SELECT row_no FROM r JOIN fence f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source AND f.rate = '{r.name}' WHERE r.{r.name} > f.most" + (f" OR r.{r.name} < f.fewest" if r.below else "") for r in RATES
    )

    def quartiles(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""m_{name} AS (SELECT {keys}rate, lo, hi, sum(n) AS n FROM counts GROUP BY {keys}rate, lo, hi),
u_{name} AS (SELECT *, sum(n) OVER (PARTITION BY {keys}rate ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY {keys}rate) AS docs FROM m_{name}),
q_{name} AS (SELECT {keys}rate, min(lo) FILTER (4 * run >= docs) AS q1, min(hi) FILTER (4 * run >= 3 * docs) AS q3 FROM u_{name} WHERE docs >= {ENOUGH} GROUP BY {keys}rate)"""

    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, lang, source, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT row_no, i, array_to_string(list_slice(w, i + 1, i + {WINDOW}), ' ') AS win FROM (SELECT row_no, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 0))) AS i FROM d)),
m AS (SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS nxt FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, win) AS n FROM g) WHERE n > 1),
c AS (SELECT row_no, sum(CASE WHEN nxt IS NULL THEN {WINDOW} ELSE least({WINDOW}, nxt - i) END) AS n FROM m GROUP BY row_no),
l AS (SELECT row_no, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines FROM d),
s AS (SELECT d.row_no, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(t) - len(regexp_replace(t, '[!-@\[-`{{-~]', '', 'g')) AS BIGINT) AS n_signs,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN l USING (row_no) LEFT JOIN c USING (row_no)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, {rates} FROM s),
v AS (SELECT lang, source, unnest([{each}]) AS e FROM r WHERE NOT base_failed),
x AS (SELECT lang, source, e[1] AS rate, CAST(e[2] AS BIGINT) AS v, CAST(1 AS BIGINT) << CAST(greatest(strlen(bin(CAST(e[2] AS BIGINT))) - {BITS}, 0) AS BIGINT) AS width FROM v),
counts AS (SELECT lang, source, rate, v // width * width AS lo, v // width * width + width - 1 AS hi, count(*) AS n FROM x GROUP BY ALL),
{quartiles("own", "lang, source")},
{quartiles("lang", "lang")},
{quartiles("all", "")},
least(rate, least) AS (VALUES {least}),
pick AS (SELECT g.lang, g.source, least.rate, least.least, coalesce(o.q1, l.q1, a.q1) AS q1, coalesce(o.q3, l.q3, a.q3) AS q3
  FROM (SELECT DISTINCT lang, source FROM counts) g CROSS JOIN least
  LEFT JOIN q_own o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.rate = least.rate
  LEFT JOIN q_lang l ON l.lang IS NOT DISTINCT FROM g.lang AND l.rate = least.rate LEFT JOIN q_all a ON a.rate = least.rate),
fence AS (SELECT lang, source, rate, q3 + {SPREADS} * greatest(q3 - q1, least) AS most, q1 - {SPREADS} * greatest(q3 - q1, least) AS fewest FROM pick),
out AS ({tests})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row_no NOT IN (SELECT row_no FROM out) AS kept FROM r
"""
