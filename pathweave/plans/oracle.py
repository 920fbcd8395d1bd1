"""The same results as plain SQL over the given tables, for checking."""

from __future__ import annotations

LINES = """
lines AS (
  SELECT l_suppkey, l_partkey, l_linenumber, l_quantity, l_returnflag,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey,
           l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS number
  FROM lineitem),
genes AS (
  SELECT l_suppkey * 4294967296 + number AS id,
         'g' || (l_suppkey * 4294967296 + number) AS name,
         number * 1000 AS fmin,
         number * 1000 + 100 + CAST(l_quantity AS BIGINT) AS fmax,
         CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand,
         number,
         CASE WHEN l_linenumber <> 7 THEN 'P' || l_partkey ELSE '-1' END AS family,
         -1 - l_suppkey AS chromosome
  FROM lines),
chromosomes AS (
  SELECT -1 - s_suppkey AS id, replace(s_name, '#', '.') AS name,
         CAST(max_fmax AS BIGINT) AS length, CAST(s_nationkey AS BIGINT) AS organism
  FROM supplier JOIN (SELECT chromosome, max(fmax) AS max_fmax FROM genes GROUP BY 1) g
    ON g.chromosome = -1 - s_suppkey),
organisms AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, r_name AS genus, n_name AS species
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey IN (SELECT organism FROM chromosomes))
"""

# Positions by number for chaining, anchors of all chromosomes against all.
LINE_ANCHORS = (
    LINES
    + """,
occ AS (
  SELECT DISTINCT chromosome AS c, number AS p, family AS f FROM genes WHERE family <> '-1'),
anchors AS (
  SELECT DISTINCT r.c AS rc, l.c AS lc, r.p AS rp, l.p AS lp
  FROM occ r JOIN occ l ON r.f = l.f AND r.c <> l.c)
"""
)

# The same with dense families, one named chromosome against all others.
DENSE_ANCHORS = (
    LINES.replace("FROM lineitem),", "FROM lineitem),\nlabels_of AS (SELECT p_partkey, p_brand || '|' || p_type AS label FROM part),", 1)
    .replace("'P' || l_partkey", "label", 1)
    .replace("FROM lines),", "FROM lines LEFT JOIN labels_of ON p_partkey = l_partkey),", 1)
    + """,
occ AS (
  SELECT DISTINCT chromosome AS c, number AS p, family AS f FROM genes WHERE family <> '-1'),
anchors AS (
  SELECT DISTINCT r.c AS rc, l.c AS lc, r.p AS rp, l.p AS lp
  FROM occ r JOIN occ l ON r.f = l.f AND r.c <> l.c
  WHERE r.c = (SELECT id FROM chromosomes WHERE name = '{name}'))
"""
)

EVENTS = """
event_order AS (
  SELECT event_id, -1 - user_id AS chromosome, event_type AS family,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)
"""

# Stretches of matching ranks on one diagonal, used as given runs and hulls.
DIAGONALS = (
    LINE_ANCHORS
    + """,
diagonals AS (
  SELECT rc, lc, min(rp) AS rs, min(lp) AS ls, max(rp) AS re, max(lp) AS le
  FROM (SELECT *, rp - row_number() OVER (PARTITION BY rc, lc, rp - lp ORDER BY rp) AS island
        FROM anchors)
  GROUP BY rc, lc, rp - lp, island)
"""
)


def chains_from_anchors(intermediate: int, matched: int, reverse: bool, name: str) -> str:
    """CTEs ending in ``<name>(rc, lc, rs, re, ls, le)`` from ``anchors``."""
    d = intermediate + 1
    rise = "p.rp - q.rp" if reverse else "q.rp - p.rp"
    n = name
    return f""",
{n}_edge AS (
  SELECT p.rc, p.lc, p.rp AS prp, p.lp AS plp, q.rp, q.lp,
         {d} + 1 - least({rise}, q.lp - p.lp) AS w
  FROM anchors p JOIN anchors q ON p.rc = q.rc AND p.lc = q.lc
   AND {rise} BETWEEN 1 AND {d} AND q.lp - p.lp BETWEEN 1 AND {d}),
{n}_root AS (
  SELECT DISTINCT rc, lc, prp AS rp, plp AS lp FROM {n}_edge
  EXCEPT SELECT rc, lc, rp, lp FROM {n}_edge),
{n}_reach(rc, lc, rp, lp, s) AS (
  SELECT rc, lc, rp, lp, CAST(0 AS BIGINT) FROM {n}_root
  UNION
  SELECT e.rc, e.lc, e.rp, e.lp, r.s + e.w
  FROM {n}_reach r JOIN {n}_edge e
    ON e.rc = r.rc AND e.lc = r.lc AND e.prp = r.rp AND e.plp = r.lp),
{n}_score AS (SELECT rc, lc, rp, lp, max(s) AS s FROM {n}_reach GROUP BY ALL),
{n}_ptr AS (
  SELECT e.rc, e.lc, e.rp, e.lp, e.prp, e.plp, s.s + e.w AS s
  FROM {n}_edge e JOIN {n}_score s
    ON s.rc = e.rc AND s.lc = e.lc AND s.rp = e.prp AND s.lp = e.plp
  QUALIFY row_number() OVER (PARTITION BY e.rc, e.lc, e.rp, e.lp
    ORDER BY s.s + e.w DESC, e.plp, e.prp) = 1),
{n}_end AS (
  SELECT *, row_number() OVER (PARTITION BY rc, lc ORDER BY s DESC, prp DESC, plp DESC, rp, lp) AS k
  FROM {n}_ptr),
{n}_path(rc, lc, k, rp, lp) AS (
  SELECT rc, lc, k, rp, lp FROM {n}_end
  UNION ALL
  SELECT p.rc, p.lc, p.k, t.prp, t.plp
  FROM {n}_path p JOIN {n}_ptr t
    ON t.rc = p.rc AND t.lc = p.lc AND t.rp = p.rp AND t.lp = p.lp),
{n}_own AS (SELECT rc, lc, rp, lp, min(k) AS k FROM {n}_path GROUP BY ALL),
{n} AS (
  SELECT rc, lc, min(rp) AS rs, max(rp) AS re, min(lp) AS ls, max(lp) AS le
  FROM {n}_own GROUP BY rc, lc, k
  HAVING max(rp) - min(rp) + 1 >= {matched} AND max(lp) - min(lp) + 1 >= {matched})
"""


def chain_rows(name: str, orientation: str) -> str:
    return (
        f"SELECT rc AS ref_chr, lc AS rel_chr, '{orientation}' AS orientation, "
        f"rs AS ref_start, re AS ref_end, ls AS rel_start, le AS rel_end FROM {name}"
    )


def both_chains(intermediate: int, matched: int) -> str:
    """CTEs ending in ``chains`` with both orientations."""
    return (
        chains_from_anchors(intermediate, matched, False, "fwd")
        + chains_from_anchors(intermediate, matched, True, "rev")
        + f""",
chains AS ({chain_rows('fwd', '+')} UNION ALL {chain_rows('rev', '-')})
"""
    )


def passages(words: int, matched: int) -> str:
    """Shared passages without gaps, which are stretches of one diagonal."""
    following = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH split AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
occ AS (
  SELECT doc_id AS c, i - 1 AS p, {following} AS f
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM split)),
anchors AS (
  SELECT r.c AS rc, l.c AS lc, r.p AS rp, l.p AS lp
  FROM occ r JOIN occ l ON r.f = l.f AND r.c <> l.c),
islands AS (
  SELECT *, rp - row_number() OVER (PARTITION BY rc, lc, rp - lp ORDER BY rp) AS island
  FROM anchors)
SELECT rc AS ref_chr, lc AS rel_chr, '+' AS orientation, min(rp) AS ref_start,
       max(rp) AS ref_end, min(lp) AS rel_start, max(lp) AS rel_end
FROM islands GROUP BY rc, lc, rp - lp, island
HAVING count(*) > 1 AND max(rp) - min(rp) + 1 >= {matched}
"""


def merged_diagonals(intermediate: int, matched: int) -> str:
    """The merge as a fold over each pair's runs in order."""
    gap = ", ".join(f"abs({e} - {h})" for e in ("o.rs", "o.re") for h in ("m.r0", "m.r1"))
    joins = (
        f"(least({gap}) - 1 <= {intermediate} "
        f"AND least(o.ls - m.p0, o.ls - m.p1, o.le - m.p0, o.le - m.p1) - 1 <= {intermediate})"
    )
    return (
        "WITH RECURSIVE "
        + DIAGONALS
        + f""",
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY rc, lc ORDER BY ls, re, rs) AS k FROM diagonals),
fold(rc, lc, k, r0, r1, p0, p1, n, hull) AS (
  SELECT rc, lc, k, rs, re, ls, le, re - rs + 1, 1 FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.rc, o.lc, o.k,
    CASE WHEN {joins} THEN least(m.r0, o.rs) ELSE o.rs END,
    CASE WHEN {joins} THEN greatest(m.r1, o.re) ELSE o.re END,
    CASE WHEN {joins} THEN m.p0 ELSE o.ls END,
    o.le,
    CASE WHEN {joins} THEN m.n ELSE 0 END + o.re - o.rs + 1,
    CASE WHEN {joins} THEN m.hull ELSE m.hull + 1 END
  FROM fold m JOIN ordered o ON o.rc = m.rc AND o.lc = m.lc AND o.k = m.k + 1)
SELECT rc AS ref_chr, lc AS rel_chr, min(r0) AS ref_start, max(r1) AS ref_end
FROM fold GROUP BY rc, lc, hull HAVING max(n) >= {matched}
"""
    )


def sweep(support: int) -> str:
    """CTEs ending in ``regions(ref_chr, region_id, start, end)`` from ``hulls(c, s, t)``."""
    return f""",
events AS (
  SELECT c, s AS x, 1 AS is_start, s, t FROM hulls
  UNION ALL SELECT c, t + 1, 0, NULL, t FROM hulls),
sized AS (
  SELECT *, sum(CASE WHEN is_start = 1 THEN 1 ELSE -1 END) OVER (
    PARTITION BY c ORDER BY x, is_start, t ROWS UNBOUNDED PRECEDING) AS a FROM events),
arrivals AS (
  SELECT c, s, t, a,
    sum(CASE WHEN a < {support} THEN 1 ELSE 0 END) OVER (
      PARTITION BY c ORDER BY x, is_start, t ROWS UNBOUNDED PRECEDING) AS seg
  FROM sized WHERE is_start = 1),
opened AS (SELECT c, seg, max(s) AS s FROM arrivals WHERE a = {support} GROUP BY c, seg),
held AS (
  SELECT o.c, o.seg, o.s, a.t,
         row_number() OVER (PARTITION BY o.c, o.seg ORDER BY a.t DESC) AS k
  FROM opened o JOIN arrivals a ON a.c = o.c AND a.seg <= o.seg AND a.t >= o.s),
regions AS (
  SELECT c AS ref_chr, row_number() OVER (PARTITION BY c ORDER BY s) - 1 AS region_id,
         s AS start, t AS "end"
  FROM held WHERE k = {support})
"""


def coverage(support: int) -> str:
    """CTEs ending in ``regions`` from ``hulls(c, l, s, t)``, counting distinct ``l``."""
    return f""",
covered AS (
  SELECT c, x FROM (SELECT DISTINCT c, l, unnest(range(s, t + 1)) AS x FROM hulls)
  GROUP BY c, x HAVING count(*) >= {support}),
runs_of AS (
  SELECT c, x, x - row_number() OVER (PARTITION BY c ORDER BY x) AS g FROM covered),
regions AS (
  SELECT c AS ref_chr, row_number() OVER (PARTITION BY c ORDER BY min(x)) - 1 AS region_id,
         min(x) AS start, max(x) AS "end"
  FROM runs_of GROUP BY c, g)
"""


def runs() -> str:
    """CTEs ending in ``runs(rc, lc, rs, ls, re, le)`` from ``anchors``.

    One state for each pair and island of consecutive ranks: the open runs in the order in which
    they choose. A rank hands its free positions to them in one fold.
    """
    run, up, down = "x.kept[1]", "list_contains(acc.free, x.kept[1].e + 1)", "list_contains(acc.free, x.kept[1].e - 1)"
    kind = "STRUCT(rs BIGINT, ls BIGINT, e BIGINT)[]"

    def moved(by: str) -> str:
        return f"acc.kept || [{{'rs': {run}.rs, 'ls': {run}.ls, 'e': {run}.e {by} 1}}]"

    return f""",
ranked AS (SELECT rc, lc, rp, list_sort(list(lp)) AS nums FROM anchors GROUP BY rc, lc, rp),
placed AS (
  SELECT *, rp - row_number() OVER (PARTITION BY rc, lc ORDER BY rp) AS island FROM ranked),
walk(rc, lc, island, rp, held, shut) AS (
  SELECT rc, lc, island, rp,
    CAST(list_transform(nums, lambda v: {{'rs': rp, 'ls': v, 'e': v}}) AS {kind}), CAST([] AS {kind})
  FROM placed QUALIFY row_number() OVER (PARTITION BY rc, lc, island ORDER BY rp) = 1
  UNION ALL
  SELECT rc, lc, island, rp,
    s.kept || CAST(list_transform(s.free, lambda v: {{'rs': rp, 'ls': v, 'e': v}}) AS {kind}), s.shut
  FROM (
    SELECT p.rc, p.lc, p.island, p.rp, list_reduce(
      list_transform(w.held, lambda h: {{'free': CAST([] AS BIGINT[]), 'kept': [h], 'shut': CAST([] AS {kind})}}),
      lambda acc, x: {{
        'free': CASE WHEN {up} THEN list_filter(acc.free, lambda f: f <> {run}.e + 1)
          WHEN {down} THEN list_filter(acc.free, lambda f: f <> {run}.e - 1) ELSE acc.free END,
        'kept': CASE WHEN {up} THEN {moved("+")} WHEN {down} THEN {moved("-")} ELSE acc.kept END,
        'shut': CASE WHEN {up} OR {down} THEN acc.shut ELSE acc.shut || [{run}] END}},
      {{'free': p.nums, 'kept': CAST([] AS {kind}), 'shut': CAST([] AS {kind})}}) AS s
    FROM walk w JOIN placed p
      ON p.rc = w.rc AND p.lc = w.lc AND p.island = w.island AND p.rp = w.rp + 1)),
closed AS (
  SELECT rc, lc, rp - 1 AS re, unnest(shut) AS r FROM walk
  UNION ALL
  SELECT rc, lc, rp, unnest(held) FROM (
    SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY rc, lc, island ORDER BY rp DESC) = 1)),
runs AS (SELECT rc, lc, r.rs AS rs, r.ls AS ls, re, r.e AS le FROM closed)
"""


def merged(intermediate: int, matched: int) -> str:
    """CTEs ending in ``hulls(c, l, s, t)``: the merge as one fold over each pair's ``runs``."""
    near = " OR ".join(
        f"abs(o.{e} - a.{h}) <= {intermediate + 1}" for e in ("r0", "r1") for h in ("r0", "r1")
    )
    joins = f"(({near}) AND o.lo - a.hi - 1 <= {intermediate})"
    return f""",
folded AS (
  SELECT rc, lc, list_reduce(
    list({{'r0': rs, 'r1': re, 'lo': least(ls, le), 'hi': greatest(ls, le), 'n': re - rs + 1,
      'done': CAST([] AS STRUCT(s BIGINT, t BIGINT)[])}} ORDER BY least(ls, le), re, rs, ls),
    lambda a, o: {{
      'r0': CASE WHEN {joins} THEN least(a.r0, o.r0) ELSE o.r0 END,
      'r1': CASE WHEN {joins} THEN greatest(a.r1, o.r1) ELSE o.r1 END,
      'lo': o.lo, 'hi': o.hi,
      'n': CASE WHEN {joins} THEN a.n ELSE 0 END + o.n,
      'done': CASE WHEN {joins} OR a.n < {matched} THEN a.done ELSE a.done || [{{'s': a.r0, 't': a.r1}}] END}}) AS f
  FROM runs GROUP BY rc, lc),
hulls AS (
  SELECT rc AS c, lc AS l, h.s AS s, h.t AS t FROM (
    SELECT rc, lc, unnest(CASE WHEN f.n >= {matched} THEN f.done || [{{'s': f.r0, 't': f.r1}}] ELSE f.done END) AS h
    FROM folded))
"""


def segments(reach: int) -> str:
    """The segments of ``anchors``: gaps of the relative axis, then of the reference axis, cut."""

    def cut(source: str, axis: str, keys: str, name: str) -> str:
        return f"""
{name}_cut AS (
  SELECT *, CASE WHEN {axis} - lag({axis}) OVER (PARTITION BY {keys} ORDER BY {axis}) <= {reach} THEN 0 ELSE 1 END
    AS {name}_opens FROM {source}),
{name} AS (
  SELECT *, sum({name}_opens) OVER (PARTITION BY {keys} ORDER BY {axis}) AS {name}_no FROM {name}_cut)"""

    return f""",{cut("anchors", "lp", "rc, lc", "rel")},{cut("rel", "rp", "rc, lc, rel_no", "seg")}
SELECT rc AS ref_chr, lc AS rel_chr, count(*) AS anchors, min(rp) AS ref_start, max(rp) AS ref_end,
  min(lp) AS rel_start, max(lp) AS rel_end
FROM seg GROUP BY rc, lc, rel_no, seg_no
"""


def linked(reach: int) -> str:
    """Anchors with a neighbour in one of the orientations."""
    return f"""
SELECT DISTINCT p.rc AS ref_chr, p.lc AS rel_chr, p.rp AS ref_pos, p.lp AS rel_pos
FROM anchors p JOIN anchors q ON p.rc = q.rc AND p.lc = q.lc
WHERE p.rp <> q.rp AND p.lp <> q.lp AND abs(p.rp - q.rp) <= {reach} AND abs(p.lp - q.lp) <= {reach}
"""


ISLANDS = """,
ranked AS (SELECT rc, lc, rp, count(*) AS n FROM anchors GROUP BY rc, lc, rp),
placed AS (SELECT *, rp - row_number() OVER (PARTITION BY rc, lc ORDER BY rp) AS island FROM ranked)
SELECT rc AS ref_chr, lc AS rel_chr, min(rp) AS island, count(*) AS ranks, CAST(sum(n) AS BIGINT) AS anchors
FROM placed GROUP BY rc, lc, placed.island
"""


def merge_pieces(intermediate: int) -> str:
    """Pieces of each pair's diagonals that the merge can treat apart."""
    return (
        "WITH RECURSIVE "
        + DIAGONALS
        + f""",
far AS (
  SELECT *, CASE WHEN ls - lag(le) OVER w - 1 > {intermediate} THEN 1 ELSE 0 END AS opens,
    row_number() OVER w AS k
  FROM diagonals WINDOW w AS (PARTITION BY rc, lc ORDER BY ls, re, rs)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY rc, lc ORDER BY k) AS piece FROM far)
SELECT rc AS ref_chr, lc AS rel_chr, count(*) AS runs, min(ls) AS rel_start, max(le) AS rel_end,
  CAST(sum(re - rs + 1) AS BIGINT) AS positions
FROM numbered GROUP BY rc, lc, piece
"""
    )
