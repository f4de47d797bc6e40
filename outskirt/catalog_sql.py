"""The same queries as plain SQL over the given tables, by brute force.

Written from the definitions, not from the engine's plans: neighbours by a full self
join, the partition plan by a recursive fold over slabs, borders by comparing every
point with its box.
"""

from __future__ import annotations

K, CELLS, BUCKETS = 3, 50, 4
W = "2e0"  # cell width on the domain [0, 100]


def r(v: str, scale: int) -> str:
    return f"(floor(({v}) * 1e{scale} + 0.5) / 1e{scale})"


def up(v: str, scale: int) -> str:
    return f"(ceil(({v}) * 1e{scale}) / 1e{scale})"


CUSTOMER = """raw AS (SELECT c_custkey AS id, c_acctbal AS x, coalesce(s.y, 0e0) AS y FROM customer
  LEFT JOIN (SELECT o_custkey, sum(floor(o_totalprice * 1e2 + 0.5)) / 1e2 AS y FROM orders GROUP BY 1) s
  ON s.o_custkey = c_custkey)"""
PART = "raw AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"
EVENT = """raw AS (SELECT event_id AS id, value AS x,
  (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS y FROM events)"""


def pts(raw: str, dims: str = "xy") -> str:
    """``pts``: raw points scaled to [0, 100]."""

    def scaled(c: str) -> str:
        share = f"({c} - min_{c}) / (max_{c} - min_{c}) * 1e2"
        return f"CASE WHEN max_{c} = min_{c} THEN 0e0 ELSE {r(share, 4)} END AS {c}"

    ends = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in dims)
    cols = ", ".join(scaled(c) for c in dims)
    return f"{raw}, ends AS (SELECT {ends} FROM raw), pts AS (SELECT id, {cols} FROM raw, ends)"


# -- neighbours and scores, all pairs ------------------------------------------------

_D = r("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", 2)


def knn(extra: str = "") -> str:
    return f"""knn AS (SELECT * FROM (SELECT a.id AS id, b.id AS nid, a.x - b.x AS dx, a.y - b.y AS dy, {_D} AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rank
  FROM pts a JOIN pts b ON a.id <> b.id {extra}) WHERE rank <= {K})"""


FORCE = f"""force AS (SELECT id, nid, rank, d, CAST(floor(dx * (d * d) * 1e4 + 0.5) AS BIGINT) AS fx,
  CAST(floor(dy * (d * d) * 1e4 + 0.5) AS BIGINT) AS fy FROM knn)"""
LCF = f"""lcf AS (SELECT id, max(d) AS kdist,
  {r('sqrt((sum(fx) / 1e4) * (sum(fx) / 1e4) + (sum(fy) / 1e4) * (sum(fy) / 1e4))', 2)} AS lcf
  FROM force GROUP BY id)"""
NOF = f"""SELECT o.id, o.kdist, o.lcf, CASE WHEN o.lcf <= 1e-9 THEN 0e0 ELSE
  {r(f'sum(CAST(floor(m.lcf * 1e2 + 0.5) AS BIGINT)) / 1e2 / {K}', 4)} END AS nof
  FROM lcf o JOIN force f ON f.id = o.id JOIN lcf m ON m.id = f.nid GROUP BY o.id, o.kdist, o.lcf"""


def nearest(k: int = K) -> str:
    """``knn`` again, keeping the k best of a point instead of ranking all pairs."""
    return f"""knn AS (SELECT id, u.nid AS nid, u.dx AS dx, u.dy AS dy, u.d AS d, 0 AS rank FROM (
  SELECT a.id AS id, unnest(min({{'d': {_D}, 'nid': b.id, 'dx': a.x - b.x, 'dy': a.y - b.y}}, {k})) AS u
  FROM pts a JOIN pts b ON a.id <> b.id GROUP BY a.id))"""


ORDER = """raw AS (SELECT o_orderkey AS id, o_totalprice AS x,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS y FROM orders)"""


def large_nof(raw: str) -> str:
    return f"WITH {pts(raw)}, {nearest()}, {FORCE}, {LCF} {NOF}"


# forces beyond BIGINT: sums as DECIMAL, values without a fraction as they are
_WHOLE = "9007199254740992e0"


def wide(v: str, scale: int) -> str:
    return f"(CASE WHEN abs({v}) * 1e{scale} < {_WHOLE} THEN floor(({v}) * 1e{scale} + 0.5) / 1e{scale} ELSE {v} END)"


def wide_units(v: str, scale: int) -> str:
    return f"""(CASE WHEN abs({v}) * 1e{scale} < {_WHOLE} THEN floor(({v}) * 1e{scale} + 0.5)::DECIMAL(38, 0)
  ELSE (({v}) * 1e{scale})::DECIMAL(38, 0) END)"""


def far_nof(raw: str) -> str:
    points = f"{raw}, pts AS (SELECT id, {r('x', 4)} AS x, {r('y', 4)} AS y FROM raw)"
    sums = [f"(sum({wide_units(f'{c} * (d * d)', 4)})::DOUBLE / 1e4)" for c in ("dx", "dy")]
    lcf = f"lcf AS (SELECT id, max(d) AS kdist, sqrt({' + '.join(f'{s} * {s}' for s in sums)}) AS raw FROM knn GROUP BY id)"
    mean = f"(sum({wide_units('m.lcf', 2)})::DOUBLE / 1e2 / {K})"
    return f"""WITH {points}, {nearest()}, {lcf}, done AS (SELECT id, kdist, {wide('raw', 2)} AS lcf FROM lcf),
means AS (SELECT k.id AS id, {mean} AS mean FROM knn k JOIN done m ON m.id = k.nid GROUP BY k.id)
SELECT o.id, o.kdist, o.lcf, CASE WHEN o.lcf <= 1e-9 THEN 0e0 ELSE {wide('mean', 4)} END AS nof
FROM done o JOIN means USING (id)"""


def nof(raw: str) -> str:
    return f"WITH {pts(raw)}, {knn()}, {FORCE}, {LCF} {NOF}"


def wide_knn(gap: str, finish: str) -> str:
    gaps = "list_transform(generate_series(1, 64), lambda i: CAST(a.e[i] AS DOUBLE) - CAST(b.e[i] AS DOUBLE))"
    total = f"list_sum(list_transform({gaps}, lambda g: {gap}))"
    return f"""WITH v AS (SELECT vec_id AS id, embedding AS e FROM embeddings),
pairs AS (SELECT a.id AS id, b.id AS nid, {r(finish.format(total), 2)} AS d FROM v a JOIN v b ON a.id <> b.id)
SELECT * FROM (SELECT id, nid, (row_number() OVER (PARTITION BY id ORDER BY d, nid))::INT AS rank, d FROM pairs)
WHERE rank <= 5"""


# -- grid ------------------------------------------------------------------------------

CELLED = f"""celled AS (SELECT *, i0 + i1 * {CELLS} AS cell_id FROM (SELECT *,
  CAST(least(floor(x / {W}), {CELLS - 1}) AS INT) AS i0, CAST(least(floor(y / {W}), {CELLS - 1}) AS INT) AS i1
  FROM pts WHERE x BETWEEN 0 AND 100 AND y BETWEEN 0 AND 100)),
hist AS (SELECT i0, i1, count(*) AS n FROM celled GROUP BY i0, i1),
slabs AS (SELECT 0 AS dim, i0 AS idx, sum(n)::BIGINT AS n FROM hist GROUP BY i0
  UNION ALL SELECT 1, i1, sum(n)::BIGINT FROM hist GROUP BY i1),
chi AS (SELECT dim, sum(n * n)::DOUBLE * {CELLS + 1} / sum(n)::DOUBLE - sum(n)::DOUBLE AS chi2 FROM slabs GROUP BY dim)"""


def fold(name: str, source: str) -> str:
    """``name``: runs cut from ``source`` (parent, slab, n), folded slab by slab."""
    run = "STRUCT(lo INT, hi INT, n BIGINT)[]"
    return f"""{name}_s AS (SELECT parent, slab, n, row_number() OVER (PARTITION BY parent ORDER BY slab) AS rn
  FROM {source}),
{name}_t AS (SELECT parent, max(rn) AS last, greatest({K}, sum(n) / {BUCKETS}::DOUBLE) AS share FROM {name}_s GROUP BY parent),
{name}_f(parent, rn, runs, lo, n) AS (
  SELECT parent, 0::BIGINT, CAST([] AS {run}), 0::INT, 0::BIGINT FROM {name}_t
  UNION ALL
  SELECT parent, rn,
    CASE WHEN done THEN list_append(runs, {{'lo': lo, 'hi': slab + 1, 'n': n}}) ELSE runs END,
    CASE WHEN done THEN slab + 1 ELSE lo END, CASE WHEN done THEN 0::BIGINT ELSE n END
  FROM (SELECT *, len(runs) < {BUCKETS - 1} AND n >= share AS done
    FROM (SELECT parent, rn, slab, share,
      CASE WHEN defer THEN list_append(runs, {{'lo': lo, 'hi': slab, 'n': n}}) ELSE runs END AS runs,
      CASE WHEN defer THEN slab ELSE lo END AS lo, CASE WHEN defer THEN f ELSE n + f END AS n
    FROM (SELECT p.parent, s.rn, s.slab::INT AS slab, t.share, p.runs, p.lo, p.n, s.n::BIGINT AS f,
      len(p.runs) < {BUCKETS - 1} AND p.n > {K} AND p.n > 0.5 * t.share AND p.n + s.n > 2 * t.share AS defer
      FROM {name}_f p JOIN {name}_s s ON s.parent = p.parent AND s.rn = p.rn + 1 JOIN {name}_t t ON t.parent = p.parent)))),
{name}_l AS (SELECT f.parent, CASE WHEN len(runs) > 0 AND n < {K}
    THEN list_append(runs[1:len(runs) - 1], {{'lo': runs[len(runs)].lo, 'hi': {CELLS}, 'n': runs[len(runs)].n + n}})
    ELSE list_append(runs, {{'lo': lo, 'hi': {CELLS}, 'n': n}}) END AS runs
  FROM {name}_f f JOIN {name}_t t ON t.parent = f.parent AND t.last = f.rn),
{name} AS (SELECT parent, q.lo AS lo, q.hi AS hi, q.n AS n FROM (SELECT parent, unnest(runs) AS q FROM {name}_l))"""


# u is the dimension cut first, v the other
PLAN = f"""axis AS (SELECT dim AS first FROM chi ORDER BY chi2, dim LIMIT 1),
turned AS (SELECT CASE WHEN first = 0 THEN i0 ELSE i1 END AS u, CASE WHEN first = 0 THEN i1 ELSE i0 END AS v, n
  FROM hist, axis),
one_in AS (SELECT 0 AS parent, u AS slab, sum(n)::BIGINT AS n FROM turned GROUP BY u),
{fold('one', 'one_in')},
two_in AS (SELECT one.lo AS parent, v AS slab, sum(turned.n)::BIGINT AS n FROM turned JOIN one
  ON u >= one.lo AND u < one.hi AND one.n > {2 * K + 1} GROUP BY one.lo, v),
{fold('two', 'two_in')},
cut AS (SELECT one.lo AS ulo, one.hi AS uhi, coalesce(two.lo, 0) AS vlo, coalesce(two.hi, {CELLS}) AS vhi,
  coalesce(two.n, one.n) AS n FROM one LEFT JOIN two ON two.parent = one.lo),
plan AS (SELECT row_number() OVER (ORDER BY lo0, hi0, lo1, hi1) - 1 AS pid, * FROM (SELECT
  CASE WHEN first = 0 THEN ulo ELSE vlo END AS lo0, CASE WHEN first = 0 THEN uhi ELSE vhi END AS hi0,
  CASE WHEN first = 0 THEN vlo ELSE ulo END AS lo1, CASE WHEN first = 0 THEN vhi ELSE uhi END AS hi1,
  n FROM cut, axis))"""


def quantile_levels(dims: int, levels: int, buckets: int, k: int, low: str, width: str) -> str:
    """``x0 .. x{levels}`` (id, c, node) and ``cut0 ..`` (node, dim, cuts): boxes cut at ``ceil(j n / buckets)``-th values."""
    cell = f"greatest(0, least({CELLS - 1}, floor((v - ({low})) / {width})))::INT"
    parts = [
        f"flat AS (SELECT unnest(range({dims})) AS dim, unnest(c) AS v FROM x0)",
        f"filled AS (SELECT dim, {cell} AS i, count(*) AS n FROM flat GROUP BY ALL)",
        "axes AS (SELECT (row_number() OVER (ORDER BY sum(n * n), dim) - 1) AS level, dim FROM filled GROUP BY dim)",
    ]
    for level in range(levels):
        parts.append(f"""v{level} AS (SELECT node, dim, c[dim + 1] AS v, count(*) OVER (PARTITION BY node) AS n,
  row_number() OVER (PARTITION BY node ORDER BY c[dim + 1]) AS rn, max(c[dim + 1]) OVER (PARTITION BY node) AS most
  FROM x{level}, axes WHERE level = {level}),
cut{level} AS (SELECT node, dim, coalesce(list(DISTINCT v ORDER BY v)
    FILTER (WHERE v < most AND list_contains(list_transform(range(1, {buckets}), lambda j: (j * n + {buckets - 1}) // {buckets}), rn)), []) AS cuts
  FROM v{level} WHERE n > {2 * k + 1} GROUP BY node, dim),
x{level + 1} AS (SELECT id, c, CASE WHEN cuts IS NULL THEN x{level}.node
  ELSE x{level}.node || printf('%04x', len(list_filter(cuts, lambda q: q < c[dim + 1]))) END AS node
  FROM x{level} LEFT JOIN cut{level} USING (node))""")
    return ", ".join(parts)


def quantile_ranges(levels: int) -> str:
    """A row per box of the last level and cut above it."""
    cuts = " UNION ALL ".join(f"SELECT {level} AS level, * FROM cut{level}" for level in range(levels))
    return f"""cuts AS ({cuts}), boxes AS (SELECT node, count(*) AS n FROM x{levels} GROUP BY node),
numbered AS (SELECT boxes.node AS path, n, dim, cuts, ('0x' || boxes.node[length(cuts.node) + 1:length(cuts.node) + 4])::INT AS i
  FROM boxes LEFT JOIN cuts ON length(boxes.node) > length(cuts.node) AND starts_with(boxes.node, cuts.node))
SELECT path, n, dim::INT AS dim, CASE WHEN i > 0 THEN cuts[i] END AS lo, cuts[i + 1] AS hi FROM numbered"""


def planned(raw: str) -> str:
    return f"WITH RECURSIVE {pts(raw)}, {CELLED}, {PLAN}"


ASSIGNED = """placed AS (SELECT id, x, y, cell_id, pid, lo0, hi0, lo1, hi1 FROM celled JOIN plan
  ON i0 >= lo0 AND i0 < hi0 AND i1 >= lo1 AND i1 < hi1)"""

# neighbours inside the partition, then the ball against the box in grid cells
_LD = r("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", 2)
_PIVOT = r(
    f"sqrt(((lo0 * {W} + hi0 * {W}) / 2 - x) * ((lo0 * {W} + hi0 * {W}) / 2 - x)"
    f" + ((lo1 * {W} + hi1 * {W}) / 2 - y) * ((lo1 * {W} + hi1 * {W}) / 2 - y))",
    2,
)
_SIDES = [("x", 0), ("y", 1)]
_ENDS = ", ".join(
    f"greatest(0e0, {c} - reach) AS low{i}, least(1e2, {c} + reach) AS high{i}" for c, i in _SIDES
)
_OVER = ", ".join(
    f"lo{i} > 0 AND least(floor(low{i} / {W}), {CELLS - 1}) < lo{i} AS below{i},"
    f" hi{i} < {CELLS} AND floor(high{i} / {W}) >= hi{i} AS above{i}"
    for _, i in _SIDES
)
_EX = ", ".join(
    f"CASE WHEN below{i} THEN greatest(0e0, {up(f'lo{i} * {W} - low{i}', 2)}) ELSE 0e0 END AS ex_lo{i},"
    f" CASE WHEN above{i} THEN greatest(0e0, {up(f'high{i} - hi{i} * {W}', 2)}) ELSE 0e0 END AS ex_hi{i}"
    for _, i in _SIDES
)
LOCAL = f"""knn AS (SELECT * FROM (SELECT a.id AS id, b.id AS nid, a.x - b.x AS dx, a.y - b.y AS dy, {_LD} AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY {_LD}, b.id) AS rank
  FROM placed a JOIN placed b ON a.pid = b.pid AND a.id <> b.id) WHERE rank <= {K}),
{FORCE}, {LCF},
ball AS (SELECT *, {_ENDS} FROM (SELECT p.*, kdist, lcf, {_PIVOT} AS pivot_d,
  CASE WHEN c < {K} THEN 'infinity'::DOUBLE ELSE (kdist + 0.005) * (1 + 1e-9) + 1e-12 END AS reach
  FROM placed p JOIN (SELECT id, count(*) AS c FROM knn GROUP BY id) USING (id) JOIN lcf USING (id))),
crossed AS (SELECT *, {_OVER} FROM ball),
status AS (SELECT id, pid, kdist, lcf, pivot_d, CASE WHEN below0 OR above0 OR below1 OR above1 THEN 'F' ELSE 'T' END AS status,
  {_EX} FROM crossed),
grown AS (SELECT plan.pid, lo0, hi0, lo1, hi1, coalesce(max(ex_lo0), 0e0) AS ex_lo0, coalesce(max(ex_hi0), 0e0) AS ex_hi0,
  coalesce(max(ex_lo1), 0e0) AS ex_lo1, coalesce(max(ex_hi1), 0e0) AS ex_hi1
  FROM plan LEFT JOIN status ON status.pid = plan.pid AND status = 'F' GROUP BY ALL),
settled AS (SELECT s.id, s.pid, CASE WHEN s.status = 'F' THEN 'F'
    WHEN bool_and(m.status = 'T') OR s.lcf <= 1e-9 THEN 'O' ELSE 'L' END AS status
  FROM status s JOIN knn ON knn.id = s.id JOIN status m ON m.id = knn.nid GROUP BY s.id, s.pid, s.status, s.lcf)"""
SUPPORT = f"""wide AS (SELECT DISTINCT g.pid, c0.i + c1.i * {CELLS} AS cell_id
  FROM grown g JOIN range({CELLS}) c0(i) ON c0.i >= greatest(0, floor((lo0 * {W} - ex_lo0) / {W}))
    AND c0.i < least({CELLS}, ceil((hi0 * {W} + ex_hi0) / {W}))
  JOIN range({CELLS}) c1(i) ON c1.i >= greatest(0, floor((lo1 * {W} - ex_lo1) / {W}))
    AND c1.i < least({CELLS}, ceil((hi1 * {W} + ex_hi1) / {W}))
  WHERE greatest(ex_lo0, ex_hi0, ex_lo1, ex_hi1) > 0
    AND NOT (c0.i >= lo0 AND c0.i < hi0 AND c1.i >= lo1 AND c1.i < hi1))"""


def local(select: str, support: bool = False) -> str:
    parts = f"{planned(CUSTOMER)}, {ASSIGNED}, {LOCAL}"
    return f"{parts}{', ' + SUPPORT if support else ''} {select}"


# the exact neighbours beside those inside the partition
_G_KNN = knn().replace("knn AS", "gknn AS", 1)
_G_FORCE = FORCE.replace("force AS", "gforce AS", 1).replace("FROM knn", "FROM gknn")
_G_LCF = LCF.replace("lcf AS (", "glcf AS (", 1).replace("FROM force", "FROM gforce")
_G_NOF = NOF.replace("FROM lcf o JOIN force f", "FROM glcf o JOIN gforce f").replace("JOIN lcf m", "JOIN glcf m")
_RESULT = f""", {_G_KNN}, {_G_FORCE}, {_G_LCF}, gnof AS ({_G_NOF}),
listed AS (SELECT f.id AS id, string_agg(rank || ':' || nid || ':' || round(d * 100)::BIGINT || ':' || fx || ':' ||
  round(kdist * 100)::BIGINT || ':' || round(lcf * 100)::BIGINT, ',' ORDER BY rank) AS neighbors
  FROM gforce f JOIN glcf m ON m.id = f.nid GROUP BY f.id),
helped AS (SELECT id, string_agg(wide.pid::VARCHAR, ',' ORDER BY wide.pid) AS supports FROM placed JOIN wide USING (cell_id) GROUP BY id)
SELECT id, x, y, s.pid::INT AS pid, s.status, o.kdist, o.lcf, o.nof, neighbors, coalesce(supports, '') AS supports
FROM pts JOIN settled s USING (id) JOIN gnof o USING (id) JOIN listed USING (id) LEFT JOIN helped USING (id)"""


SHAPES = """SELECT lon, lat, sum(n)::BIGINT AS n FROM (
  SELECT x AS lon, y AS lat, 6 AS n FROM raw UNION ALL SELECT x + 1, y + 2, 3 FROM raw
  UNION ALL SELECT x, y + 2, 1 FROM raw) GROUP BY lon, lat"""

_CUST_KNN = f"WITH {pts(CUSTOMER)}, {knn()}"



def support_in(dims: int) -> str:
    """Points in the expanded boxes of others, each dimension halved; every cell of every dimension compared."""
    d = range(dims)
    half = CELLS // 2
    every = lambda text, glue: glue.join(text.format(i=i) for i in d)
    gap = every("(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})", " + ")
    sides = [f"greatest(0e0, x{i} - reach) AS low{i}, least(1e2, x{i} + reach) AS high{i}" for i in d]
    edge = f"CAST(c{{i}} >= {half} AS INT) * {half}"
    over = [
        f"lo{i} > 0 AND least(floor(low{i} / {W}), {CELLS - 1}) < lo{i} AS below{i},"
        f" lo{i} + {half} < {CELLS} AND floor(high{i} / {W}) >= lo{i} + {half} AS above{i}"
        for i in d
    ]
    grown = [
        f"max(CASE WHEN below{i} THEN greatest(0e0, {up(f'lo{i} * {W} - low{i}', 2)}) ELSE 0e0 END) AS el{i},"
        f" max(CASE WHEN above{i} THEN greatest(0e0, {up(f'high{i} - (lo{i} + {half}) * {W}', 2)}) ELSE 0e0 END) AS eh{i}, any_value(lo{i}) AS lo{i}"
        for i in d
    ]
    inside = " AND ".join(
        f"p.c{i} >= greatest(0, floor((g.lo{i} * {W} - el{i}) / {W}))"
        f" AND p.c{i} < least({CELLS}, ceil(((g.lo{i} + {half}) * {W} + eh{i}) / {W}))"
        for i in d
    )
    raw = "raw AS (SELECT vec_id AS id, " + every("embedding[{i} + 1]::DOUBLE AS x{i}", ", ") + " FROM embeddings)"
    ends = "ends AS (SELECT " + every("min(x{i}) AS a{i}, max(x{i}) AS b{i}", ", ") + " FROM raw)"
    scaled = ", ".join(f"CASE WHEN b{i} = a{i} THEN 0e0 ELSE {r(f'(x{i} - a{i}) / (b{i} - a{i}) * 1e2', 4)} END AS x{i}" for i in d)
    pid = " + ".join(f"(c{i} >= {half})::INT * {2 ** (dims - 1 - i)}" for i in d)
    dist = r(f"sqrt({gap})", 2)
    return f"""WITH {raw}, {ends}, pts AS (SELECT id, {scaled} FROM raw, ends),
celled AS (SELECT *, {every(f"least(floor(x{{i}} / {W}), {CELLS - 1})::INT AS c{{i}}", ", ")} FROM pts),
placed AS (SELECT *, {pid} AS pid, {every(f"{edge} AS lo{{i}}", ", ")} FROM celled),
near AS (SELECT a.id AS id, {dist} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS rank
  FROM placed a JOIN placed b ON a.pid = b.pid AND a.id <> b.id),
ball AS (SELECT p.*, CASE WHEN count(d) < {K} THEN 'infinity'::DOUBLE ELSE (max(d) + 0.005) * (1 + 1e-9) + 1e-12 END AS reach
  FROM placed p LEFT JOIN near n ON n.id = p.id AND rank <= {K} GROUP BY ALL),
crossed AS (SELECT *, {", ".join(over)} FROM (SELECT *, {", ".join(sides)} FROM ball)),
grown AS (SELECT pid, {", ".join(grown)} FROM crossed GROUP BY pid)
SELECT p.id, p.pid::INT AS pid, g.pid::INT AS support_pid FROM placed p JOIN grown g ON p.pid <> g.pid AND {inside}"""


SQL = {
    "point_bounds": f"WITH {CUSTOMER} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM raw",
    "point_normalize": f"WITH {pts(CUSTOMER)} SELECT id, x, y FROM pts",
    "sample_mod": f"WITH {EVENT} SELECT id, {r('x', 2)} AS x, {r('y', 2)} AS y FROM raw WHERE id % 10 = 0",
    "sample_random": f"WITH {EVENT} SELECT id, x, y FROM raw"
    " ORDER BY ('0x' || md5(id::VARCHAR || ':42')[1:15])::BIGINT, id LIMIT 3333",
    "rejected_points": f"WITH {CUSTOMER} SELECT count(*) AS rows, 0::BIGINT AS no_value,"
    " count(*) FILTER (WHERE NOT (x BETWEEN 0 AND 5e5 AND y BETWEEN 0 AND 5e5)) AS outside,"
    " count(*) FILTER (WHERE x BETWEEN 0 AND 5e5 AND y BETWEEN 0 AND 5e5) AS kept FROM raw",
    "cell_assign": f"WITH {pts(EVENT)}, {CELLED} SELECT id, i0, i1, cell_id::BIGINT AS cell_id FROM celled",
    "cell_decode": f"WITH {pts(EVENT)}, {CELLED} SELECT DISTINCT cell_id::BIGINT AS cell_id, i0, i1 FROM celled",
    "cell_histogram": f"WITH {pts(EVENT)}, {CELLED} SELECT i0, i1, n FROM hist",
    "slab_frequency": f"WITH {pts(EVENT)}, {CELLED} SELECT dim, idx, n FROM slabs",
    "chi_square_dims": f"WITH {pts(EVENT)}, {CELLED} SELECT dim, chi2,"
    " (row_number() OVER (ORDER BY chi2, dim) - 1)::INT AS place FROM chi",
    "partition_plan": f"{planned(EVENT)} SELECT pid::INT AS pid, lo0, hi0, lo1, hi1, n FROM plan",
    "plan_cells": f"{planned(EVENT)} SELECT (c0.i + c1.i * {CELLS})::BIGINT AS cell_id, pid::INT AS pid FROM plan"
    f" JOIN range({CELLS}) c0(i) ON c0.i >= lo0 AND c0.i < hi0 JOIN range({CELLS}) c1(i) ON c1.i >= lo1 AND c1.i < hi1",
    "plan_ranges": f"{planned(EVENT)} SELECT (c0.i + c1.i * {CELLS})::BIGINT AS cell_id, pid::INT AS pid FROM plan"
    f" JOIN range({CELLS}) c0(i) ON c0.i >= lo0 AND c0.i < hi0 JOIN range({CELLS}) c1(i) ON c1.i >= lo1 AND c1.i < hi1",
    "quantile_plan": "WITH x0 AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS c, '' AS node FROM embeddings), "
    + quantile_levels(64, 3, 3, 5, "-1e0", "4e-2") + ", " + quantile_ranges(3),
    "quantile_partitions": f"WITH {pts(EVENT)}, x0 AS (SELECT id, [x, y] AS c, '' AS node FROM pts), "
    + quantile_levels(2, 2, 300, K, "0e0", W) + " SELECT id, node FROM x2",
    "range_partitions": f"{planned(EVENT)}, {ASSIGNED} SELECT id, pid::INT AS pid FROM placed",
    "partition_coverage": f"{planned(EVENT)}, {ASSIGNED} SELECT pid::INT AS pid, count(*) AS n FROM placed GROUP BY pid",
    "local_knn_status": local(
        "SELECT id, pid::INT AS pid, kdist, status, pivot_d, ex_lo0, ex_hi0, ex_lo1, ex_hi1 FROM status"
    ),
    "scan_order": local(
        "SELECT pid::INT AS pid, id, pivot_d,"
        " row_number() OVER (PARTITION BY pid ORDER BY pivot_d DESC, id)::INT AS place FROM status"
    ),
    "partition_expansion": local("SELECT pid::INT AS pid, * EXCLUDE (pid) FROM grown"),
    "expanded_partitions": local(
        "SELECT count(*) FILTER (WHERE greatest(ex_lo0, ex_hi0, ex_lo1, ex_hi1) > 0) AS n FROM grown"
    ),
    "support_cells": local(
        "SELECT cell_id::BIGINT AS cell_id, string_agg(pid::VARCHAR, ',' ORDER BY pid) AS pids FROM wide GROUP BY cell_id", True
    ),
    "support_points": local(
        "SELECT id, placed.pid::INT AS pid, wide.pid::INT AS support_pid FROM placed JOIN wide USING (cell_id)", True
    ),
    "support_slabs": support_in(5),
    "settlement": local("SELECT id, pid::INT AS pid, status FROM settled"),
    "unsettled_points": local(
        "SELECT pid::INT AS pid, status, count(*) AS n FROM settled WHERE status <> 'O' GROUP BY pid, status"
    ),
    "l2_knn": wide_knn("g * g", "sqrt({})"),
    "l1_knn": wide_knn("abs(g)", "{}"),
    "exact_knn": f"{_CUST_KNN} SELECT id, nid, rank::INT AS rank, d FROM knn",
    "k_distance": f"{_CUST_KNN} SELECT id, max(d) AS kdist FROM knn GROUP BY id",
    "force_vectors": f"{_CUST_KNN}, {FORCE} SELECT id, nid, rank::INT AS rank, d, fx / 1e4 AS f0, fy / 1e4 AS f1 FROM force",
    "net_force": f"{_CUST_KNN}, {FORCE}, {LCF} SELECT id, kdist, lcf FROM lcf",
    "neighbor_list": f"{_CUST_KNN}, {FORCE}, {LCF} SELECT id, string_agg(nid || ':' || rank || ':' || round(d * 100)::BIGINT"
    " || ':' || round(lcf * 100)::BIGINT, ',' ORDER BY rank) AS neighbors FROM knn JOIN lcf USING (id) GROUP BY id",
    "customer_nof": nof(CUSTOMER),
    "part_nof": nof(PART),
    "outside_nof": nof(CUSTOMER),
    "event_nof": large_nof(EVENT),
    "order_nof": large_nof(ORDER),
    "order_far_nof": far_nof(ORDER),
    "supplier_nof": f"""WITH {pts("raw AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier)", "x")},
knn AS (SELECT * FROM (SELECT a.id AS id, b.id AS nid, a.x - b.x AS dx, 0e0 AS dy, {r('abs(a.x - b.x)', 2)} AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY {r('abs(a.x - b.x)', 2)}, b.id) AS rank
  FROM pts a JOIN pts b ON a.id <> b.id) WHERE rank <= {K}), {FORCE}, {LCF} {NOF}""",
    "result_rows": local(_RESULT, True),
    "scored_files": local(_RESULT, True),
    "geojson_vertices": f"WITH {CUSTOMER} SELECT 'customers' AS layer, * FROM ({SHAPES})",
    "geojson_layers": f"""WITH {CUSTOMER}, sup AS (SELECT s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier)
SELECT 'customers' AS layer, * FROM ({SHAPES}) UNION ALL SELECT 'suppliers', * FROM ({SHAPES.replace('FROM raw', 'FROM sup')})""",
    "contiguous_ids": f"WITH {CUSTOMER}, v AS ({SHAPES}) SELECT sum(n)::BIGINT AS n, 1::BIGINT AS first_id,"
    " sum(n)::BIGINT AS last_id, sum(n)::BIGINT AS ids FROM v",
    "csv_points": f"WITH {PART} SELECT x, y, count(*) AS n, (SELECT count(*) FROM raw) AS ids FROM raw GROUP BY x, y",
    "csv_load": f"WITH {PART} SELECT x, y, count(*) AS n, 1::BIGINT AS first_id, (SELECT count(*) FROM raw) AS last_id, (SELECT count(*) FROM raw) AS ids FROM raw GROUP BY x, y",
    "csv_normalize": f"""WITH {PART}, e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM raw)
SELECT x, y, count(*) AS n, min_x, max_x, min_y, max_y FROM (SELECT {r('(x - a) / (b - a)', 4)} AS x, {r('(y - c) / (d - c)', 4)} AS y, a AS min_x, b AS max_x, c AS min_y, d AS max_y
FROM raw, e) GROUP BY ALL""",
    "npy_points": f"WITH {PART} SELECT x, y, count(*) AS n, 1::BIGINT AS first_id, (SELECT count(*) FROM raw) AS last_id, (SELECT count(*) FROM raw) AS ids FROM raw GROUP BY x, y",
    "shapefile_vertices": f"""WITH {CUSTOMER} SELECT lon, lat, count(*) AS n FROM (SELECT x AS lon, y AS lat FROM raw
UNION ALL SELECT x + 1, y + 2 FROM raw) GROUP BY lon, lat""",
}
SQL["npy_files"] = SQL["npy_points"]
SQL["shapefile_layers"] = SQL["geojson_vertices"]
