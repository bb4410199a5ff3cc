"""The same queries as SQL for DuckDB, written without the library's shortcuts.

Rules are edges, reachability is a recursive join, ordering is a window over all
rows, and repair steps through every row of an entity with a recursive query.
"""

from __future__ import annotations

from workload.rules import SIZES, SMALL


def _edges(attributes: list[str]) -> str:
    parts = []
    for a in attributes:
        if a in SMALL:
            rows = ", ".join(f"('{a}', '{s}', '{d}')" for s, d in SMALL[a])
            parts.append(f"SELECT * FROM (VALUES {rows}) t(attribute, src, dst)")
        elif a in SIZES:
            parts.append(
                f"SELECT '{a}', k::VARCHAR, (k + d)::VARCHAR FROM range({SIZES[a]}) r(k), "
                f"(VALUES (3), (7)) s(d) WHERE k + d < {SIZES[a]}"
            )
    parts.append("SELECT '', '', '' WHERE false")
    return "edges(attribute, src, dst) AS (" + " UNION ALL ".join(parts) + ")"


CLOSURE = """closure(attribute, src, dst) AS (
  SELECT attribute, src, dst FROM edges
  UNION
  SELECT c.attribute, c.src, e.dst FROM closure c
  JOIN edges e ON e.attribute = c.attribute AND e.src = c.dst)"""

RANKS = """depths(attribute, value, depth) AS (
  SELECT attribute, src, 0 FROM edges
  UNION
  SELECT d.attribute, e.dst, d.depth + 1 FROM depths d
  JOIN edges e ON e.attribute = d.attribute AND e.src = d.value),
levels AS (SELECT attribute, value, max(depth)::INTEGER AS level FROM depths GROUP BY ALL),
ranks AS (SELECT attribute, value, level,
  row_number() OVER (PARTITION BY attribute ORDER BY level, value)::INTEGER AS rank FROM levels)"""

EVENTS = """(SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS props100,
  'w' || ((day(ts) - 1) // 7)::VARCHAR AS week FROM events)"""
LINES = """(SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus,
  (l_quantity::INTEGER - 1)::VARCHAR AS qty50 FROM lineitem)"""


def _versions(source: str, key: str, attributes: list[str], where: str, vid: str = "NULL") -> str:
    parts = [
        f"SELECT {key} AS eid, '{a}' AS attribute, {a}::VARCHAR AS value, {vid} AS vid FROM {source} {where}"
        for a in attributes
    ]
    return "versions AS (" + " UNION ALL ".join(parts) + ")"


HIST = """hist AS (SELECT eid, attribute, value, count(*) AS cnt FROM versions
  WHERE value IS NOT NULL GROUP BY ALL)"""
LATEST = """dominated AS (SELECT DISTINCT h.eid, h.attribute, h.value FROM hist h
  JOIN closure c ON c.attribute = h.attribute AND c.src = h.value
  JOIN hist n ON n.eid = h.eid AND n.attribute = h.attribute AND n.value = c.dst),
latest AS (SELECT h.* FROM hist h WHERE NOT EXISTS (SELECT 1 FROM dominated d
  WHERE d.eid = h.eid AND d.attribute = h.attribute AND d.value = h.value))"""
CVQ = """scores AS (SELECT eid, attribute, min(cnt)::DOUBLE / sum(cnt)::DOUBLE AS score
  FROM latest GROUP BY ALL)"""
HSQ = """pairs AS (SELECT o.eid, o.attribute, c.src, c.dst FROM hist o
  JOIN closure c ON c.attribute = o.attribute AND c.src = o.value
  JOIN hist n ON n.eid = o.eid AND n.attribute = o.attribute AND n.value = c.dst),
chains(eid, attribute, value, len) AS (
  SELECT eid, attribute, value, 1 FROM hist
  UNION
  SELECT p.eid, p.attribute, p.dst, k.len + 1 FROM chains k
  JOIN pairs p ON p.eid = k.eid AND p.attribute = k.attribute AND p.src = k.value),
scores AS (SELECT eid, attribute, max(len)::DOUBLE / count(DISTINCT value)::DOUBLE AS score
  FROM chains GROUP BY ALL)"""


WALKS = """walks(eid, attribute, src, stop) AS (
  SELECT h.eid, h.attribute, h.value, e.dst FROM hist h
  JOIN edges e ON e.attribute = h.attribute AND e.src = h.value
  UNION
  SELECT w.eid, w.attribute, w.src, e.dst FROM walks w
  JOIN edges e ON e.attribute = w.attribute AND e.src = w.stop
  WHERE NOT EXISTS (SELECT 1 FROM hist h
    WHERE h.eid = w.eid AND h.attribute = w.attribute AND h.value = w.stop))"""
BRIDGED = """SELECT w.eid AS {key}, w.attribute, w.src, w.stop AS dst FROM walks w
JOIN hist h ON h.eid = w.eid AND h.attribute = w.attribute AND h.value = w.stop"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _scores(metric: str, source: str, key: str, attributes: list[str], where: str = "") -> str:
    tail = [LATEST, CVQ] if metric == "cvq" else [HSQ]
    return _with(_edges(attributes), CLOSURE, _versions(source, key, attributes, where), HIST, *tail)


def _wide(metric: str, source: str, key: str, attributes: list[str]) -> str:
    columns = ", ".join(
        f"max(CASE WHEN attribute = '{a}' THEN score END) AS {a}_{metric}" for a in attributes
    )
    head = _scores(metric, source, key or "0", attributes)
    return head + f"SELECT eid AS {key}, {columns} FROM scores GROUP BY eid" if key else (
        head + f"SELECT {columns} FROM scores"
    )


def _entity(metric: str, attributes: list[str]) -> str:
    total = " + ".join(f"max(CASE WHEN attribute = '{a}' THEN score END)" for a in attributes)
    return _scores(metric, EVENTS, "0", attributes, "WHERE user_id = 1") + (
        f"SELECT ({total}) / {len(attributes)}.0::DOUBLE AS {metric} FROM scores"
    )


def _average(metric: str, attributes: list[str], where: str = "") -> str:
    total = " + ".join(f"max(CASE WHEN attribute = '{a}' THEN score END)" for a in attributes)
    return _scores(metric, EVENTS, "user_id", attributes, where) + (
        f"SELECT round(avg(s), 10) AS avg FROM (SELECT eid, ({total}) / {len(attributes)}.0::DOUBLE AS s "
        "FROM scores GROUP BY eid)"
    )


SEQUENCE = """numbered AS (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
edges(attribute, src, dst) AS (
  SELECT a.o_custkey::VARCHAR, a.o_orderkey::VARCHAR, b.o_orderkey::VARCHAR FROM numbered a
  JOIN numbered b ON a.o_custkey = b.o_custkey AND b.n - a.n IN (2, 3))"""

EVENT_ATTRIBUTES = ["event_type", "props100"]
ORDER_RULES = _edges(["o_orderpriority", "o_orderstatus"])

# Orders with both ranks and the position of each row in repair order.
ORDERED = """ranked AS (SELECT o.*, coalesce(p.rank, 0) AS group_id, coalesce(s.rank, 0) AS sort_id
  FROM {source} o
  LEFT JOIN ranks p ON p.attribute = '{ref}' AND p.value = o.{ref}
  LEFT JOIN ranks s ON s.attribute = '{rep}' AND s.value = o.{rep}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {key}
    ORDER BY group_id, {ref} NULLS FIRST, sort_id, {rep} NULLS FIRST, {vid}) AS pos,
  lead({vid}) OVER w AS next_vid, lead({rep}) OVER w AS next_value,
  lag({ref}) OVER w AS before_ref, lag({rep}) OVER w AS before_rep
  FROM ranked WINDOW w AS (PARTITION BY {key}
    ORDER BY group_id, {ref} NULLS FIRST, sort_id, {rep} NULLS FIRST, {vid})),
runs AS (SELECT *, sum(CASE WHEN pos = 1 OR {ref} IS DISTINCT FROM before_ref
    OR {rep} IS DISTINCT FROM before_rep THEN 1 ELSE 0 END)
  OVER (PARTITION BY {key} ORDER BY pos)::BIGINT AS run_id FROM ordered)"""

ON_ORDERS = {
    "source": "orders", "key": "o_custkey", "vid": "o_orderkey",
    "ref": "o_orderpriority", "rep": "o_orderstatus",
}
ON_EVENTS = {
    "source": EVENTS, "key": "user_id", "vid": "event_id", "ref": "week", "rep": "event_type",
}

# One row per entity and step. s: codes in repair order (0 = not in the rules);
# newer[c + 1]: codes newer than c; the window is s[l + 1 : r].
STEPS = """codes AS (SELECT value, rank AS code FROM ranks WHERE attribute = '{rep}'),
above AS (SELECT a.code, list(b.code) AS newer FROM codes a
  JOIN closure c ON c.attribute = '{rep}' AND c.src = a.value
  JOIN codes b ON b.value = c.dst GROUP BY a.code),
book AS (SELECT list(coalesce(newer, []::INTEGER[]) ORDER BY g.code) AS newer
  FROM (SELECT unnest(range(0, (SELECT max(code) + 1 FROM codes)))::INTEGER AS code) g
  LEFT JOIN above USING (code)),
start AS (SELECT {key} AS eid, list(sort_id ORDER BY {place}) AS s FROM {items} GROUP BY {key}),
steps(eid, i, s, l, r) AS (
  SELECT eid, 0, s, 0, 0 FROM start
  UNION ALL
  SELECT eid, i + 1,
    CASE WHEN back AND voted THEN list_transform(s, lambda x, j: CASE WHEN j = i + 2 THEN a ELSE x END)
         WHEN back THEN list_transform(s, lambda x, j: CASE WHEN j = i + 1 THEN b ELSE x END)
         ELSE s END,
    CASE WHEN forth AND NOT hold THEN i + 1 WHEN back AND NOT voted AND NOT kept THEN i ELSE l END,
    CASE WHEN forth AND NOT hold THEN i + 1 WHEN back AND NOT voted AND NOT kept THEN i ELSE r + 1 END
  FROM (
    SELECT eid, i, s, l, r, a, b,
      list_contains(newer[a + 1], b) AS forth,
      list_contains(newer[b + 1], a) AS back,
      len(list_filter(win, lambda x: NOT list_contains(newer[x + 1], b)
        AND NOT list_contains(newer[b + 1], x))) > 0
        OR (i < len(s) - 2 AND list_contains(newer[coalesce(s[i + 3], 0) + 1], b)) AS hold,
      len(list_filter(win, lambda x: list_contains(newer[b + 1], x))) > 0 AS voted,
      len(list_filter(win, lambda x: NOT list_contains(newer[x + 1], a)
        AND NOT list_contains(newer[a + 1], x))) > 0 AS kept
    FROM (SELECT t.*, s[i + 1] AS a, s[i + 2] AS b,
        CASE WHEN r > l THEN s[l + 1 : r] ELSE []::INTEGER[] END AS win, book.newer
      FROM steps t, book WHERE i < len(s) - 1))),
final AS (SELECT eid, unnest(s) AS code, unnest(range(1, len(s) + 1)) AS place
  FROM steps WHERE i = len(s) - 1)"""


def _repair(spec: dict[str, str], columns: list[str], compress: bool, edges: str | None = None) -> str:
    rep, key = spec["rep"], spec["key"]
    if compress:
        items = f"(SELECT {key}, run_id, any_value(sort_id) AS sort_id FROM runs GROUP BY {key}, run_id)"
        place = "run_id"
    else:
        items, place = "runs", "pos"
    steps = STEPS.format(rep=rep, key=key, items=items, place=place)
    out = ", ".join(
        f"CASE WHEN f.code = o.sort_id THEN o.{rep} ELSE k.value END AS {rep}" if c == rep else f"o.{c}"
        for c in columns
    )
    return _with(
        edges or _edges([spec["ref"], rep]), CLOSURE, RANKS, ORDERED.format(**spec), steps
    ) + (
        f"SELECT {out} FROM runs o JOIN final f ON f.eid = o.{key} AND f.place = o.{place} "
        "LEFT JOIN codes k ON k.code = f.code"
    )


def _errors(
    spec: dict[str, str], edges: str | None = None, names: tuple[str, str, str] = ("next_vid", "value", "next_value")
) -> str:
    return _with(edges or _edges([spec["ref"], spec["rep"]]), CLOSURE, RANKS, ORDERED.format(**spec)) + (
        f"SELECT {spec['key']}, {spec['vid']}, next_vid AS {names[0]}, {spec['rep']} AS {names[1]}, "
        f"next_value AS {names[2]} FROM ordered o "
        f"WHERE EXISTS (SELECT 1 FROM closure c WHERE c.attribute = '{spec['rep']}' "
        f"AND c.src = o.next_value AND c.dst = o.{spec['rep']})"
    )


def _on_orders(select: str) -> str:
    return _with(ORDER_RULES, RANKS, ORDERED.format(**ON_ORDERS)) + select


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SLIM = "o_custkey, o_orderkey, o_orderpriority, o_orderstatus"

# More rules than the driver compiles.
ORDER_STEPS = SEQUENCE.replace("SELECT a.o_custkey::VARCHAR,", "SELECT 'o_orderkey',")
FINISHED = "(SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS o_orderkey FROM orders)"
FINISHED_VERSIONS = _versions(FINISHED, "o_custkey", ["o_orderkey"], "")
YEARDAYS = "(SELECT o_custkey, o_orderkey, o_orderstatus, dayofyear(o_orderdate)::VARCHAR AS yearday FROM orders)"
DAY_EDGES = (
    "days AS (SELECT DISTINCT dayofyear(o_orderdate) AS day FROM orders),\n"
    + _edges(["o_orderstatus"]).removesuffix(")")
    + " UNION ALL SELECT 'yearday', a.day::VARCHAR, b.day::VARCHAR FROM days a JOIN days b "
    "ON b.day - a.day BETWEEN 1 AND 40)"
)
ON_DAYS = {
    "source": YEARDAYS, "key": "o_custkey", "vid": "o_orderkey", "ref": "o_orderstatus", "rep": "yearday",
}
GAPS = """(SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'P') AS gap_status,
  nullif(o_orderpriority, '2-HIGH') AS gap_priority FROM orders)"""
ON_GAPS = {
    "source": GAPS, "key": "o_custkey", "vid": "o_orderkey", "ref": "gap_status", "rep": "gap_priority",
}
GAP_COLUMNS = ["o_custkey", "o_orderkey", "gap_status", "gap_priority"]
SLIM_COLUMNS = ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"]
ON_TEXT = ON_ORDERS | {
    "source": "(SELECT o_custkey::VARCHAR AS o_custkey, o_orderkey::VARCHAR AS o_orderkey, "
    "o_orderpriority, o_orderstatus FROM orders)"
}
ON_VALUE = ON_EVENTS | {
    "source": "(SELECT e.*, floor(v.value)::BIGINT AS value FROM " + EVENTS
    + " e JOIN (SELECT event_id, value FROM events) v USING (event_id))",
    "key": "value",
}

ORACLES: dict[str, str] = {
    "rule_edges": _with(SEQUENCE) + "SELECT attribute, src, dst FROM edges",
    "rule_closure": _with(
        SEQUENCE,
        """walks(attribute, src, dst, hops) AS (
  SELECT attribute, src, dst, 1 FROM edges
  UNION
  SELECT w.attribute, w.src, e.dst, w.hops + 1 FROM walks w
  JOIN edges e ON e.attribute = w.attribute AND e.src = w.dst)""",
    )
    + "SELECT attribute, src, dst, max(hops)::INTEGER AS hops FROM walks GROUP BY ALL",
    "rule_rank": _with(SEQUENCE, RANKS) + "SELECT attribute, value, level, rank FROM ranks",
    "value_relation": _with(_edges(["o_orderpriority"]), CLOSURE)
    + """SELECT p.o_orderkey, p.next_orderkey, p.o_orderpriority, p.next_priority,
  CASE WHEN f.src IS NOT NULL THEN '<' WHEN b.src IS NOT NULL THEN '>' ELSE '<>' END AS relation
FROM (SELECT o_orderkey, o_orderpriority, lead(o_orderkey) OVER w AS next_orderkey,
    lead(o_orderpriority) OVER w AS next_priority FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) p
LEFT JOIN closure f ON f.src = p.o_orderpriority AND f.dst = p.next_priority
LEFT JOIN closure b ON b.dst = p.o_orderpriority AND b.src = p.next_priority
WHERE p.next_orderkey IS NOT NULL""",
    "value_counts": _with(_versions(EVENTS, "user_id", EVENT_ATTRIBUTES, "", "event_id"))
    + """SELECT eid AS user_id, attribute, value, count(*) AS cnt, min(vid) AS sample_vid
FROM versions WHERE value IS NOT NULL GROUP BY ALL""",
    "value_versions": _with(_versions(EVENTS, "user_id", EVENT_ATTRIBUTES, "", "event_id"))
    + "SELECT DISTINCT eid AS user_id, attribute, value, vid AS event_id FROM versions WHERE value IS NOT NULL",
    "latest_values": _with(
        _edges(["qty50", "l_returnflag"]),
        CLOSURE,
        _versions(LINES, "l_partkey", ["qty50", "l_returnflag"], ""),
        HIST,
        LATEST,
    )
    + "SELECT eid AS l_partkey, attribute, value, cnt FROM latest",
    "present_edges": _with(
        _edges(EVENT_ATTRIBUTES),
        _versions(EVENTS, "user_id", EVENT_ATTRIBUTES, ""),
        HIST,
        WALKS,
    )
    + BRIDGED.format(key="user_id"),
    "static_rank": _on_orders(f"SELECT {SLIM}, group_id, sort_id FROM ranked"),
    "topo_dense_rank": _on_orders(
        f"""SELECT {SLIM}, dense_rank() OVER (PARTITION BY o_custkey
  ORDER BY group_id, o_orderpriority) AS group_id FROM ranked"""
    ),
    "topo_row_number": _on_orders(
        f"""SELECT {SLIM}, dense_rank() OVER (PARTITION BY o_custkey
  ORDER BY group_id, o_orderpriority) AS group_id,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority
  ORDER BY sort_id, o_orderstatus, o_orderkey) AS sort_id FROM ranked"""
    ),
    "run_compress": _on_orders(
        """SELECT o_custkey, min(o_orderkey) AS o_orderkey, o_orderpriority, o_orderstatus, run_id,
  count(*) AS run_rows FROM runs GROUP BY o_custkey, o_orderpriority, o_orderstatus, run_id"""
    ),
    "detect_errors": _errors(ON_ORDERS),
    "detect_event_errors": _errors(ON_EVENTS),
    "repair_status": _repair(ON_ORDERS, ORDER_COLUMNS, compress=False),
    "repair_compressed": _repair(ON_ORDERS, ORDER_COLUMNS, compress=True),
    "repair_join_back": _repair(ON_ORDERS, ORDER_COLUMNS, compress=True),
    "repair_events": _repair(
        ON_EVENTS, ["event_id", "user_id", "event_type", "props100", "week"], compress=False
    ),
    "csv_round_trip": _repair(
        ON_ORDERS, ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"], compress=False
    ),
}
ORACLES |= {
    f"{m}_sequence": _with(ORDER_STEPS, CLOSURE, FINISHED_VERSIONS, HIST, *tail)
    + f"SELECT c.o_custkey, max(score) AS o_orderkey_{m} FROM (SELECT DISTINCT o_custkey FROM orders) c "
    "LEFT JOIN scores s ON s.eid = c.o_custkey GROUP BY c.o_custkey"
    for m, tail in (("cvq", [LATEST, CVQ]), ("hsq", [HSQ]))
}
ORACLES |= {
    "latest_sequence": _with(ORDER_STEPS, CLOSURE, FINISHED_VERSIONS, HIST, LATEST)
    + "SELECT eid AS o_custkey, attribute, value, cnt FROM latest",
    "present_edges_sequence": _with(ORDER_STEPS, FINISHED_VERSIONS, HIST, WALKS)
    + BRIDGED.format(key="o_custkey"),
    "repair_sequence": _repair(
        ON_DAYS, ["o_custkey", "o_orderkey", "o_orderstatus", "yearday"], False, DAY_EDGES
    ),
    "relation_sequence": _with(ORDER_STEPS, CLOSURE)
    + """SELECT p.o_custkey, p.o_orderkey, p.next_orderkey,
  CASE WHEN f.src IS NOT NULL THEN '<' WHEN b.src IS NOT NULL THEN '>' ELSE '<>' END AS relation
FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS next_orderkey FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) p
LEFT JOIN closure f ON f.src = p.o_orderkey::VARCHAR AND f.dst = p.next_orderkey::VARCHAR
LEFT JOIN closure b ON b.dst = p.o_orderkey::VARCHAR AND b.src = p.next_orderkey::VARCHAR
WHERE p.next_orderkey IS NOT NULL""",
    "detect_sequence": _errors(ON_DAYS, DAY_EDGES),
    "rank_sequence": _with(DAY_EDGES, RANKS, ORDERED.format(**ON_DAYS))
    + "SELECT o_custkey, o_orderkey, o_orderstatus, yearday, sort_id FROM ranked",
    "repair_gaps": _repair(ON_GAPS, GAP_COLUMNS, compress=False),
    "repair_gaps_compressed": _repair(ON_GAPS, GAP_COLUMNS, compress=True),
    "detect_gaps": _errors(ON_GAPS),
    "runs_gaps": _with(_edges(["gap_status", "gap_priority"]), RANKS, ORDERED.format(**ON_GAPS))
    + """SELECT o_custkey, min(o_orderkey) AS o_orderkey, gap_status, gap_priority, run_id,
  count(*) AS run_rows FROM runs GROUP BY o_custkey, gap_status, gap_priority, run_id""",
    "detect_by_value": _errors(ON_VALUE, names=("next_id", "type", "next_type")),
    "score_view_sql": _scores("cvq", EVENTS, "user_id", EVENT_ATTRIBUTES)
    + """SELECT round(avg(s), 10) AS avg, count(*) AS users FROM (SELECT eid,
  (max(CASE WHEN attribute = 'event_type' THEN score END)
   + max(CASE WHEN attribute = 'props100' THEN score END)) / 2.0::DOUBLE AS s FROM scores GROUP BY eid)""",
    "rules_from_csv": _with(SEQUENCE, RANKS) + "SELECT attribute, value, level, rank FROM ranks",
    "csv_text_scan": """SELECT o_custkey::VARCHAR AS o_custkey, o_orderkey::VARCHAR AS o_orderkey,
  o_orderpriority, o_orderstatus FROM orders""",
    "repair_text_job": _repair(ON_TEXT, SLIM_COLUMNS, compress=False),
    "repair_coded_job": _repair(ON_ORDERS, SLIM_COLUMNS, compress=True),
}
for _m in ("cvq", "hsq"):
    ORACLES[f"{_m}_entity"] = _entity(_m, ["event_type"])
    ORACLES[f"{_m}_entity_multi"] = _entity(_m, EVENT_ATTRIBUTES)
    ORACLES[f"{_m}_cohort_avg"] = _average(_m, EVENT_ATTRIBUTES, "WHERE user_id::VARCHAR LIKE '1_'")
    ORACLES[f"{_m}_db_avg"] = _average(_m, EVENT_ATTRIBUTES)
    ORACLES[f"{_m}_per_entity"] = _wide(_m, EVENTS, "user_id", EVENT_ATTRIBUTES)
    ORACLES[f"{_m}_whole_table"] = _wide(_m, LINES, "", ["qty50", "l_returnflag"])
    ORACLES[f"{_m}_orders"] = _wide(_m, "orders", "o_custkey", ["o_orderpriority", "o_orderstatus"])
    ORACLES[f"{_m}_parts"] = _wide(_m, LINES, "l_partkey", ["qty50"])
    ORACLES[f"{_m}_lines"] = _wide(_m, LINES, "l_orderkey", ["l_returnflag", "l_linestatus"])
    ORACLES[f"{_m}_no_rules"] = _wide(_m, "customer", "c_nationkey", ["c_mktsegment"])
    ORACLES[f"{_m}_roles"] = _wide(_m, "conversations", "conv_id", ["role"])
ORACLES |= {
    "repair_bucketed": ORACLES["repair_status"],
    "csv_sized": f"SELECT {SLIM} FROM orders",
    "hsq_sql": ORACLES["hsq_per_entity"],
    "cvq_sql": ORACLES["cvq_parts"],
    "cvq_merged": ORACLES["cvq_per_entity"],
    "hsq_merged": ORACLES["hsq_per_entity"],
    "preview_score": ORACLES["cvq_whole_table"],
}
