"""The search for dense sets and the greedy choice as recursive SQL, for comparison with the runs.

The statements build on the tables `cands` (edges, es, n_edges), `edge_table` and
`snap` of the registered queries' SQL. Sets are lists of ids in ascending order.
"""

from __future__ import annotations


def _ends(of: str) -> str:
    return f"list_distinct(list_concat(list_transform({of}, lambda e: srcs[e + 1]), list_transform({of}, lambda e: dsts[e + 1])))"


def _measured(source: str, k: int, density: str, of: str = "es", name: str = "d") -> str:
    """`source` with the density of the sets `of` and their number of nodes; it has srcs, dsts, sups and alives."""
    full = f"list_filter(ms, lambda m: m >= {k})"
    if density == "min":
        value = f"2.0::DOUBLE * list_min({full}) / len(nodes)"
    else:
        total = f"list_sum(list_transform({of}, lambda e: sups[e + 1]))"
        value = f"2.0::DOUBLE * ({total} - coalesce(list_sum(list_filter(ms, lambda m: m < {k})), 0)) / (len({full}) * len(nodes))"
    return f"""(
    SELECT * EXCLUDE (ts, ms, nodes), len(nodes) AS {name}_n, CASE WHEN len({full}) > 0 THEN {value} END AS {name}
    FROM (SELECT *, list_transform(list_distinct(ts), lambda t: len(list_filter(ts, lambda x: x = t))) AS ms
      FROM (SELECT *, flatten(list_transform({of}, lambda e: alives[e + 1])) AS ts, {_ends(of)} AS nodes FROM {source})))"""


ONE = """
one AS (
  SELECT list(src ORDER BY edge_id) AS srcs, list(dst ORDER BY edge_id) AS dsts, list(support ORDER BY edge_id) AS sups, list(ts ORDER BY edge_id) AS alives
  FROM (SELECT edge_id, src, dst, support, coalesce(ts, []) AS ts FROM edge_table LEFT JOIN (SELECT edge_id, list(t) AS ts FROM snap GROUP BY edge_id) USING (edge_id))
)
"""


def lattice(k: int, min_den: float, density: str, max_cc_size: int = 40) -> str:
    """`lat`: with d, the dense sets in the peel lattices of candidates that aren't dense; without d, states that are queued at some level.

    A step of the recursion takes the highest level of each candidate and carries the lower ones on, so what is queued is at hand when a shortcut asks for it.
    """
    touched = "srcs[e + 1] = v OR dsts[e + 1] = v"
    is_short = f"(least = 1 AND len(rest) > 0 AND NOT coalesce(rd >= {min_den}, false))"

    def kids(source: str) -> str:
        return f"SELECT cand, c, list_filter(es, lambda e: NOT ({touched})) AS es FROM (SELECT *, unnest(low) AS v FROM {source})"

    off_low = "list_filter(es, lambda e: NOT (list_contains(low, srcs[e + 1]) OR list_contains(low, dsts[e + 1])))"
    current = "(SELECT cand, c, es, one.* FROM lat JOIN top USING (cand), one WHERE d IS NULL AND n = top AND n >= 2)"
    return f"""
lat(cand, c, es, n, d) AS (
  SELECT edges, es, es, d_n, NULL::DOUBLE FROM {_measured("cands, one", k, density)} WHERE n_edges >= {min_den} AND n_edges < {max_cc_size} AND d < {min_den}
  UNION ALL (
    WITH top AS (SELECT cand, max(n) AS top FROM lat WHERE d IS NULL GROUP BY cand),
    lower_ AS (SELECT cand, c, es FROM lat JOIN top USING (cand) WHERE d IS NULL AND n < top),
    looked AS (SELECT * FROM {_measured(current, k, density)}),
    ranked AS (SELECT *, list_transform(nodes, lambda v: len(list_filter(es, lambda e: {touched}))) AS deg FROM (SELECT *, {_ends("es")} AS nodes FROM looked WHERE d < {min_den})),
    opened AS (
      SELECT * EXCLUDE (d, d_n, nodes, deg), list_min(deg) AS least, list_filter(nodes, lambda v: len(list_filter(es, lambda e: {touched})) = list_min(deg)) AS low
      FROM ranked WHERE list_max(deg) >= {min_den}
    ), rested AS (SELECT * FROM {_measured(f"(SELECT *, {off_low} AS rest FROM opened)", k, density, "rest", "rd")}),
    short AS (SELECT *, list_sum(list_transform(es, lambda e: 1::HUGEINT << (list_position(c, e) - 1))) AS mask FROM rested WHERE {is_short}),
    known AS (SELECT DISTINCT cand, c, es FROM (SELECT * FROM lower_ UNION ALL {kids(f"(SELECT * FROM rested WHERE NOT {is_short})")})),
    taken AS (SELECT cand, c, rest, min(mask) AS mask FROM short WHERE (cand, rest) NOT IN (SELECT (cand, es) FROM known) GROUP BY cand, c, rest),
    queued AS (SELECT cand, c, es FROM known UNION SELECT cand, c, rest FROM taken UNION {kids("(SELECT * FROM short ANTI JOIN taken USING (cand, mask))")})
    SELECT cand, c, es, len({_ends("es")}) AS n, NULL FROM queued, one WHERE len(es) > 0
    UNION ALL SELECT cand, c, es, d_n, d FROM looked WHERE d >= {min_den}
  )
)"""


def existence(k: int, min_den: float, density: str) -> str:
    """`held`: (edges, contains) of each candidate: whether removing its node of least (degree, weight, id) again and again meets a dense set."""
    deg = "len(list_filter(es, lambda e: srcs[e + 1] = v OR dsts[e + 1] = v))"
    weight = "coalesce(list_sum(list_filter(list_transform(es, lambda e: CASE WHEN srcs[e + 1] = v OR dsts[e + 1] = v THEN sups[e + 1] END), lambda x: x IS NOT NULL)), 0)" if density == "avg" else "0"
    order = f"list_min(list_transform(nodes, lambda v: [{deg}, {weight}, v]))"
    found = f"CASE WHEN d_n < 2 OR most < {min_den} OR d IS NULL THEN false WHEN d >= {min_den} THEN true END"
    step = _measured("(SELECT edges, es, one.* FROM peeled, one WHERE contains IS NULL AND len(es) > 0)", k, density)
    return f"""
peeled(edges, es, contains) AS (
  SELECT edges, es, NULL::BOOLEAN FROM cands
  UNION ALL
  SELECT edges, list_filter(es, lambda e: NOT (srcs[e + 1] = low OR dsts[e + 1] = low)), {found}
  FROM (SELECT *, list_max(list_transform(nodes, lambda v: {deg})) AS most, {order}[3] AS low FROM (SELECT *, {_ends("es")} AS nodes FROM {step}))
), held AS (SELECT edges, coalesce(bool_or(contains), false) AS contains FROM peeled GROUP BY edges)"""


def choice(k: int, min_den: float, density: str, max_jac: float, max_cc_size: int = 40) -> str:
    """`found`: (edges, es, n_edges, d, density, origin) of the accepted sets; one set is decided in each step of the recursion."""
    near = "false" if max_jac > 1 else f"len(list_filter(acc, lambda a: len(list_intersect(a, es)) / CAST(len(a) + len(es) - len(list_intersect(a, es)) AS DOUBLE) >= {max_jac})) > 0"
    if max_jac <= 0:
        near = "len(acc) > 0"
    fits = f"NOT ({near}) AND len(list_filter(list_concat(held, acc), lambda h: list_has_all(h, es))) = 0"
    return f"""
direct AS (SELECT edges, es, n_edges, d FROM {_measured("cands, one", k, density)} WHERE n_edges >= {min_den} AND n_edges < {max_cc_size} AND d >= {min_den}),
parts AS (SELECT DISTINCT cand, es, d FROM lat WHERE d IS NOT NULL),
items AS (
  SELECT row_number() OVER (ORDER BY n_edges DESC, es) AS i, edges, es, d, parts
  FROM (SELECT edges, es, n_edges, d, NULL AS parts FROM direct UNION ALL SELECT cand, any_value(c), len(any_value(c)), NULL, list(es) FROM lat WHERE d IS NOT NULL GROUP BY cand)
), first_(i, acc, held, passed) AS (
  SELECT 0, CAST([] AS BIGINT[][]), CAST([] AS BIGINT[][]), false
  UNION ALL
  SELECT i, CASE WHEN fits AND d IS NOT NULL THEN list_append(acc, es) ELSE acc END, CASE WHEN fits AND d IS NULL THEN list_concat(held, parts) ELSE held END, fits
  FROM (SELECT items.i, acc, held, es, d, parts, {fits} AS fits FROM first_ JOIN items ON items.i = first_.i + 1)
), loose AS (
  SELECT row_number() OVER (ORDER BY len(es) DESC, es) AS i, es, d
  FROM (SELECT DISTINCT p.es, p.d FROM parts p JOIN items ON items.edges = p.cand JOIN first_ USING (i) WHERE passed)
), second_(i, acc, held, passed) AS (
  SELECT 0, (SELECT acc FROM first_ ORDER BY i DESC LIMIT 1), CAST([] AS BIGINT[][]), false
  UNION ALL
  SELECT i, CASE WHEN fits THEN list_append(acc, es) ELSE acc END, held, fits FROM (SELECT loose.i, acc, held, es, {fits} AS fits FROM second_ JOIN loose ON loose.i = second_.i + 1)
), found AS (
  SELECT array_to_string(es, ',') AS edges, es, CAST(len(es) AS BIGINT) AS n_edges, d, round(d, 6) AS density, origin
  FROM (SELECT es, d, 'direct' AS origin FROM items JOIN first_ USING (i) WHERE passed AND d IS NOT NULL UNION ALL SELECT es, d, 'extracted' FROM loose JOIN second_ USING (i) WHERE passed)
)"""


def mined(k: int, min_den: float, density: str, max_jac: float, max_cc_size: int = 40) -> tuple[str, str, str]:
    """The parts that state a whole run, after the candidates."""
    return ONE, lattice(k, min_den, density, max_cc_size), choice(k, min_den, density, max_jac, max_cc_size)
