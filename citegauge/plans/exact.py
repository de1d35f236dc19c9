"""SQL of the exact scores: titles by matched characters, author lists by greedy matching, venues to their last arm."""

from __future__ import annotations

import unicodedata

from ..functions import names as N
from ..functions import text as T


def _replaced(e: str, rules) -> str:
    for pattern, to in rules:
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return e


#: Characters of the derived titles that NFKD takes apart: those of Latin-1, and a few signs.
_APART = [(chr(k), unicodedata.normalize("NFKD", chr(k))) for k in [*range(0xA0, 0x180), 0x2026, 0x2122, 0xFB01, 0xFB02]]
_APART = [(a, b) for a, b in _APART if a != b and "'" not in b]


def without_latex(e: str) -> str:
    return f"trim({_replaced(e, [(p, to.replace('$', chr(92))) for p, to in T.LATEX])})"


def normal_form(e: str) -> str:
    """A text taken apart, without control characters, with single spaces and one kind of dash."""
    for a, b in _APART:
        e = f"replace({e}, '{a}', '{b}')"
    e = f"trim(regexp_replace(regexp_replace({e}, '[\\p{{C}}]', '', 'g'), '[\\s\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{205F}}]+', ' ', 'g'))"
    return f"trim(regexp_replace({e}, '[\\x{{2212}}\\x{{2013}}\\x{{2014}}]', '-', 'g'))"


def plain_form(e: str) -> str:
    """A title without LaTeX, in its normal form, in lower case."""
    return f"lower({normal_form(without_latex(e))})"


def key_form(plain: str) -> str:
    return f"trim({_replaced(plain, [(p, to.replace('$', chr(92))) for p, to in T.TITLE_RULES])})"


_WORDS = "list_distinct(list_filter(regexp_split_to_array({0}, '" + T.SPACE.replace("{", "{{").replace("}", "}}") + "+'), lambda w: w <> ''))"


def jaccard_words(x: str, y: str) -> str:
    """Shared over all words of two distinct lists; 0 if one is empty."""
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END::DOUBLE"


def ratios(todo: str, name: str = "ratios") -> str:
    """CTEs that end in `name` (x, y, ratio) for the distinct pairs (x, y) of `todo`: texts that differ, are not empty and have less than 200 characters.

    Runs of equal characters along each diagonal are found first. From the whole of both texts, the longest run within the limits,
    then the first in x, then the first in y, is taken, and what is left and right of it is searched in turn.
    """
    return f"""{name}_todo AS MATERIALIZED (SELECT DISTINCT x, y, length(x) AS n, length(y) AS m FROM ({todo}) WHERE x <> y AND x <> '' AND y <> ''),
{name}_x AS (SELECT x, y, unnest(range(1, n + 1)) AS i FROM {name}_todo), {name}_y AS (SELECT x, y, unnest(range(1, m + 1)) AS j FROM {name}_todo),
{name}_same AS (SELECT a.x, a.y, i, j FROM (SELECT *, substr(x, i, 1) AS c FROM {name}_x) a JOIN (SELECT *, substr(y, j, 1) AS c FROM {name}_y) b ON a.x = b.x AND a.y = b.y AND a.c = b.c),
{name}_runs AS MATERIALIZED (SELECT x, y, d, min(i) AS i0, max(i) + 1 AS i1 FROM (SELECT x, y, i, i - j AS d, i - row_number() OVER (PARTITION BY x, y, i - j ORDER BY i) AS g FROM {name}_same) GROUP BY x, y, d, g),
{name}_parts(x, y, alo, ahi, blo, bhi, n) AS (
  SELECT x, y, 1::BIGINT, n + 1, 1::BIGINT, m + 1, 0::BIGINT FROM {name}_todo
  UNION ALL
  SELECT x, y, unnest([alo, i + k]), unnest([i, ahi]), unnest([blo, j + k]), unnest([j, bhi]), unnest([k, 0]) FROM (
    SELECT x, y, alo, ahi, blo, bhi, max_by(s, best) AS i, max_by(s - d, best) AS j, max_by(e - s, best) AS k FROM (
      SELECT *, (e - s) * 1000000 - s * 1000 - (s - d) AS best FROM (
        SELECT p.x, p.y, alo, ahi, blo, bhi, d, greatest(i0, alo, blo + d) AS s, least(i1, ahi, bhi + d) AS e
        FROM {name}_parts p JOIN {name}_runs r ON p.x = r.x AND p.y = r.y WHERE alo < ahi AND blo < bhi) WHERE e > s)
    GROUP BY x, y, alo, ahi, blo, bhi)),
{name} AS MATERIALIZED (SELECT t.x, t.y, 2.0::DOUBLE * sum(p.n) / (max(t.n) + max(t.m)) AS ratio FROM {name}_todo t JOIN {name}_parts p ON t.x = p.x AND t.y = p.y GROUP BY t.x, t.y)"""


_SPELLED = ", ".join(f"('{a}', '{b}')" for a, bs in N.VARIANTS.items() for b in bs)


def author_lists(clean: str, surname: str, pairs: str) -> str:
    """CTEs that end in `lists` (a, b, overall, injection, removal, matched, ...) for the distinct pairs of lists (a, b) of at most three names in `pairs`."""
    best = lambda row, used: f"list_max(list_prepend(0, list_transform({row}, lambda c, j: CASE WHEN c < 40 OR list_contains({used}, j) THEN 0 ELSE c * 100 + 99 - j END)))"
    return f"""spelled(k, v) AS (VALUES {_SPELLED}),
lp AS MATERIALIZED (SELECT DISTINCT a, b FROM ({pairs})),
person AS (SELECT n, {clean.format("n")} AS whole, CASE WHEN len(string_split({clean.format("n")}, ' ')) > 1 THEN string_split({clean.format("n")}, ' ')[1] ELSE '' END AS given, {surname.format("n")} AS last
  FROM (SELECT DISTINCT unnest(a) AS n FROM lp UNION SELECT DISTINCT unnest(b) FROM lp)),
both_spelled AS (SELECT k, v FROM spelled UNION SELECT v, k FROM spelled),
persons AS MATERIALIZED (SELECT x.n AS x, y.n AS y, CASE WHEN x.whole = '' OR y.whole = '' THEN 0 WHEN x.whole = y.whole THEN 100
  WHEN x.last <> y.last AND NOT EXISTS (SELECT 1 FROM both_spelled s WHERE s.k = x.last AND s.v = y.last) THEN 0 WHEN x.given = '' OR y.given = '' THEN 60
  WHEN x.given = y.given OR EXISTS (SELECT 1 FROM both_spelled s WHERE s.k = x.given AND s.v = y.given) THEN 95
  WHEN length(x.given) = 1 AND starts_with(y.given, x.given) OR length(y.given) = 1 AND starts_with(x.given, y.given) THEN 85 ELSE 40 END::BIGINT AS c FROM person x, person y),
grid AS (SELECT a, b, i, list(c ORDER BY j) AS r FROM (SELECT a, b, i, a[i] AS x, j, b[j] AS y FROM (SELECT a, b, i, unnest(range(1, len(b) + 1)) AS j FROM (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM lp)))
  JOIN persons USING (x, y) GROUP BY a, b, i),
rows3 AS (SELECT a, b, max(r) FILTER (i = 1) AS r1, max(r) FILTER (i = 2) AS r2, max(r) FILTER (i = 3) AS r3 FROM grid GROUP BY a, b),
took1 AS (SELECT *, {best("r1", "[0]")} AS t1 FROM rows3),
took2 AS (SELECT *, {best("coalesce(r2, [])", "[99 - t1 % 100]")} AS t2 FROM took1),
took3 AS (SELECT *, {best("coalesce(r3, [])", "[99 - t1 % 100, 99 - t2 % 100]")} AS t3 FROM took2),
counted AS (SELECT a, b, len(a) AS n, len(b) AS m, (t1 > 0)::INT + (t2 > 0)::INT + (t3 > 0)::INT AS matched, (t1 // 100) / 100.0::DOUBLE + (t2 // 100) / 100.0::DOUBLE + (t3 // 100) / 100.0::DOUBLE AS total,
  r1[1] = 0 AS first_off, r1[1] = 0 AND list_max(r1) >= 80 AS reordered FROM took3),
lists AS MATERIALIZED (SELECT a, b, matched, n > matched AND matched >= 2 AS injection, m > matched AND matched >= 1 AS removal, first_off, reordered,
  CASE WHEN matched = 0 THEN 0.0 ELSE greatest(0.0::DOUBLE, total / greatest(n, m) - 0.1::DOUBLE * (n - matched) - 0.05::DOUBLE * (m - matched)) END::DOUBLE AS overall FROM counted)"""
