"""Building blocks of the oracle SQL: series views, and dynamic programs as recursions over anti-diagonals."""

from __future__ import annotations

import re

E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
U = "u AS (SELECT user_id AS id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)"
EP = f"{E}, p AS (SELECT x.id AS id_a, y.id AS id_b, x.v AS a, y.v AS b FROM e x JOIN e y ON y.id = x.id + 1)"
UP = f"{U}, p AS (SELECT x.id AS id_a, y.id AS id_b, x.v AS a, y.v AS b FROM u x JOIN u y ON y.id = x.id + 1)"
EQ = f"{E}, p AS (SELECT q.id AS id_a, s.id AS id_b, q.v AS a, s.v AS b FROM e q JOIN e s ON q.id % 100 = 0)"
BIG = "1e300"


def dp(pairs: str, cell: str, edge_i: str = BIG, edge_j: str = BIG, fill: str = BIG, start: str = "0.0") -> str:
    """CTEs ending in d(id_a, id_b, a, b, d). In ``cell``: x, y the points, i, j from 1, and up, lf, dg the neighbours."""
    for name, value in (("up", "p1[i]"), ("lf", "p1[i + 1]"), ("dg", "p2[i]"), ("x", "a[i]"), ("y", "b[k + 1 - i]"), ("j", "(k + 1 - i)")):
        cell = cell.replace(f"<{name}>", value)
    return f"""{pairs}, w AS (
  SELECT id_a, id_b, a, b, 0 AS k, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN CAST({start} AS DOUBLE) ELSE CAST({fill} AS DOUBLE) END) AS p1, list_transform(range(0, len(a) + 1), lambda i: CAST({fill} AS DOUBLE)) AS p2 FROM p
  UNION ALL
  SELECT id_a, id_b, a, b, k + 1, list_transform(range(0, len(a) + 1), lambda i: CAST(CASE WHEN k + 1 - i < 0 OR k + 1 - i > len(b) THEN {fill} WHEN i = 0 THEN {edge_j} WHEN i = k + 1 THEN {edge_i} ELSE {cell} END AS DOUBLE)), p1 FROM w WHERE k < len(a) + len(b)),
d AS (SELECT id_a, id_b, a, b, p1[len(a) + 1] AS d FROM w WHERE k = len(a) + len(b))"""


DTW_CELL = "(<x> - <y>) * (<x> - <y>) + least(<up>, <lf>, <dg>)"
MSM_CELL = "least(<dg> + CASE WHEN abs(<x> - <y>) < 1e-10 THEN 0 ELSE 1.0 * abs(<x> - <y>) END, <lf> + 1.0 + 0.1 * abs(<y> - a[greatest(i - 1, 1)]), <up> + 1.0 + 0.1 * abs(<x> - b[greatest(<j> - 1, 1)]))"
TWE_CELL = "least(<dg> + abs(<x> - <y>) + 1.0 * abs(i - <j>), <lf> + 0.001 + 0.1 * abs(<y>), <up> + 0.001 + 0.1 * abs(<x>))"
TWE_I = "list_sum(list_transform(a[1:i], lambda z: 0.001 + 0.1 * abs(z)))"
TWE_J = "list_sum(list_transform(b[1:k + 1], lambda z: 0.001 + 0.1 * abs(z)))"
LCSS_CELL = "CASE WHEN abs(<x> - <y>) <= 0.1 AND abs(i - <j>) <= 1 THEN <dg> + 1 ELSE greatest(<up>, <lf>) END"


def lcss_cell(epsilon: float, delta: int) -> str:
    return LCSS_CELL.replace("<= 0.1", f"<= {epsilon}").replace("<= 1 ", f"<= {delta} ")


def euclid(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"


def pop_std(v: str) -> str:
    return f"list_stddev_pop({v})"


def abandoning(pairs: str, cell: str, threshold: float) -> str:
    """As ``dp``, but infinite where a row's least cell is above the threshold."""
    base = dp(pairs, cell)
    now = base[base.index("SELECT id_a, id_b, a, b, k + 1, ") + len("SELECT id_a, id_b, a, b, k + 1, ") : base.index(", p1 FROM w WHERE")]
    first = base[: base.index("  UNION ALL")].replace(" AS p2 FROM p", f" AS p2, list_transform(range(0, len(a) + 1), lambda i: CAST({BIG} AS DOUBLE)) AS r FROM p")
    return f"""{first}  UNION ALL
  SELECT id_a, id_b, a, b, k + 1, fresh, p1, list_transform(range(0, len(a) + 1), lambda i: least(r[i + 1], fresh[i + 1])) FROM (SELECT *, {now} AS fresh FROM w WHERE k < len(a) + len(b))),
d AS (SELECT id_a, id_b, a, b, CASE WHEN list_max(r[2:]) > {threshold} THEN {BIG} ELSE p1[len(a) + 1] END AS d FROM w WHERE k = len(a) + len(b))"""


def counting(pairs: str, cost: str) -> str:
    """CTEs ending in d(id_a, id_b, d, n): the DTW and the steps of its path, by the diagonal first, then a step in b."""
    at = lambda text: text.replace("<x>", "a[i]").replace("<y>", "b[k + 1 - i]").replace("<j>", "(k + 1 - i)")
    edge = f"CASE WHEN k + 1 - i < 0 OR k + 1 - i > len(b) OR i = 0 OR i = k + 1 THEN {BIG} ELSE "
    blank = f"list_transform(range(0, len(a) + 1), lambda i: CAST({BIG} AS DOUBLE))"
    zero = "list_transform(range(0, len(a) + 1), lambda i: 0)"
    return f"""{pairs}, w AS (
  SELECT id_a, id_b, a, b, 0 AS k, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN CAST(0.0 AS DOUBLE) ELSE {BIG} END) AS p1, {blank} AS p2, {zero} AS s1, {zero} AS s2 FROM p
  UNION ALL
  SELECT id_a, id_b, a, b, k + 1, list_transform(range(0, len(a) + 1), lambda i: CAST({edge}{at(cost)} + least(p1[i], p1[i + 1], p2[i]) END AS DOUBLE)), p1,
    list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 OR i > k OR k + 1 - i > len(b) THEN 0 WHEN p2[i] <= least(p1[i], p1[i + 1]) THEN s2[i] + 1 WHEN p1[i + 1] <= p1[i] THEN s1[i + 1] + 1 ELSE s1[i] + 1 END), s1
  FROM w WHERE k < len(a) + len(b)),
d AS (SELECT id_a, id_b, p1[len(a) + 1] AS d, s1[len(a) + 1] AS n FROM w WHERE k = len(a) + len(b))"""


def banded(pairs: str, radius: int, name: str = "") -> str:
    """CTEs ending in d(id_a, id_b, d), or names with a suffix: banded DTW of series of equal lengths; a diagonal holds its band only."""
    o = 2 * radius + 1
    step = f"CASE WHEN (k + 1 + o - {radius}) % 2 <> 0 OR k + 1 + o - {radius} < 2 OR k + 1 - o + {radius} < 2 OR k + 1 + o - {radius} > 2 * n OR k + 1 - o + {radius} > 2 * n THEN {BIG} ELSE pow(a[(k + 1 + o - {radius}) // 2] - b[(k + 1 - o + {radius}) // 2], 2) + least(c1[o], c1[o + 2], c2[o + 1]) END"
    return f"""{pairs}, w{name} AS (
  SELECT id_a, id_b, CAST(len(a) AS INTEGER) AS n, 0 AS k, list_transform(range(0, {o}), lambda o: CASE WHEN o = {radius} THEN CAST(0.0 AS DOUBLE) ELSE {BIG} END) AS c1, list_transform(range(0, {o}), lambda o: CAST({BIG} AS DOUBLE)) AS c2 FROM p{name}
  UNION ALL
  SELECT w{name}.id_a, w{name}.id_b, n, k + 1, list_transform(range(0, {o}), lambda o: CAST({step} AS DOUBLE)), c1 FROM w{name} JOIN p{name} ON p{name}.id_a = w{name}.id_a AND p{name}.id_b = w{name}.id_b WHERE k < 2 * n),
d{name} AS (SELECT id_a, id_b, c1[{radius + 1}] AS d FROM w{name} WHERE k = 2 * n)"""


def keyed(pairs: str, radius: int | None = None) -> str:
    """CTEs ending in d(id_a, id_b, d): DTW (banded, if ``radius``) of very many pairs, of which only the two newest diagonals are kept."""
    hole = "" if radius is None else f" OR abs(2 * i - k - 1) > {radius}"
    blank = f"list_transform(range(0, len(a) + 1), lambda i: CAST({BIG} AS DOUBLE))"
    cell = f"CASE WHEN k + 1 - i < 0 OR k + 1 - i > len(b) OR i = 0 OR i = k + 1{hole} THEN {BIG} ELSE pow(a[i] - b[k + 1 - i], 2) + least(p1[i], p1[i + 1], p2[i]) END"
    return f"""{pairs}, w(id_a, id_b, n, k, p1, p2) USING KEY (id_a, id_b) AS (
  SELECT id_a, id_b, len(a), 0, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN CAST(0.0 AS DOUBLE) ELSE {BIG} END), {blank} FROM p
  UNION ALL
  SELECT w.id_a, w.id_b, n, k + 1, list_transform(range(0, len(a) + 1), lambda i: CAST({cell} AS DOUBLE)), p1 FROM w JOIN p ON p.id_a = w.id_a AND p.id_b = w.id_b WHERE k < len(a) + len(b)),
d AS (SELECT id_a, id_b, p1[n + 1] AS d FROM w)"""


def paths(name: str = "") -> str:
    """A CTE t(id_a, id_b, i, j) of the cells on the paths of the program w of ``dp``, ending in (1, 1)."""
    least = "least(w.p2[t.i], w.p1[t.i + 1], w.p1[t.i])"
    go = f"CASE WHEN w.p2[t.i] = {least} THEN 0 WHEN w.p1[t.i + 1] = {least} THEN 1 ELSE 2 END"
    return f"""t{name} AS (SELECT id_a, id_b, CAST(len(a) AS BIGINT) AS i, CAST(len(b) AS BIGINT) AS j FROM p{name}
  UNION ALL
  SELECT id_a, id_b, CASE WHEN go = 1 THEN i ELSE i - 1 END, CASE WHEN go = 2 THEN j ELSE j - 1 END FROM (SELECT t.id_a, t.id_b, t.i, t.j, {go} AS go FROM t{name} t JOIN w{name} w ON w.id_a = t.id_a AND w.id_b = t.id_b AND w.k = t.i + t.j - 1 WHERE t.i > 0 AND t.j > 0)
  WHERE CASE WHEN go = 1 THEN i ELSE i - 1 END > 0 AND CASE WHEN go = 2 THEN j ELSE j - 1 END > 0)"""


def renamed(ctes: str, name: str) -> str:
    """The CTEs p, w and d of ``dp`` with a suffix."""
    return ctes.replace("w AS (", f"w{name} AS (").replace("FROM w ", f"FROM w{name} ").replace("FROM p\n", f"FROM p{name}\n").replace("\nd AS (", f"\nd{name} AS (")


def kept(ctes: str) -> str:
    """CTEs whose names end in a number, each computed once however many others read it."""
    return re.sub(r"\b([a-z]+\d+) AS \(", r"\1 AS MATERIALIZED (", ctes)
