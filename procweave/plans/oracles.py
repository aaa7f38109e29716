"""DuckDB SQL oracles, one per registered query key.

They rebuild the same derived corpora from the driver's tables with the same
SQL text, then compute each answer the plain-SQL way (regex functions,
recursive CTEs, window functions), independently of the Spark code.
"""

from __future__ import annotations

from procweave.functions import constants as K
from procweave.sources.tables import CORPUS_NAME_SQL, CORPUS_TEXT_SQL, CYCLES_TEXT_SQL

ORACLES: dict = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


CORPUS = f"corpus AS (SELECT {CORPUS_NAME_SQL} AS proc, {CORPUS_TEXT_SQL} AS code FROM orders)"


def _unnest_union(patterns, group=1, upper=True) -> str:
    parts = []
    for p in patterns:
        e = f"unnest(regexp_extract_all(code, {_q(p)}, {group}))"
        parts.append(f"SELECT proc, {'upper(' + e + ')' if upper else e} AS v FROM corpus")
    return " UNION ALL ".join(parts)


ORACLES["proc_calls"] = f"""
WITH {CORPUS}, raw AS ({_unnest_union(K.CALL_PATTERNS)})
SELECT DISTINCT proc, v AS callee FROM raw
WHERE v LIKE '%.%' OR NOT list_contains({_list(K.SQL_BUILTINS)}, v)
"""

ORACLES["proc_calls_basic"] = f"""
WITH {CORPUS}, raw AS ({_unnest_union(K.CALL_PATTERNS_SHORT)})
SELECT DISTINCT proc, v AS callee FROM raw WHERE NOT list_contains({_list(K.SQL_BUILTINS_SHORT)}, v)
"""

ORACLES["proc_tables"] = f"""
WITH {CORPUS}, raw AS ({_unnest_union(K.TABLE_PATTERNS)})
SELECT DISTINCT proc, v AS table_name FROM raw
"""

ORACLES["proc_tables_basic"] = f"""
WITH {CORPUS}, raw AS ({_unnest_union(K.TABLE_PATTERNS_SHORT)})
SELECT DISTINCT proc, v AS table_name FROM raw
"""

_CNT = "CAST(len(regexp_extract_all(code, '(?i)\\b{w}\\b')) AS DOUBLE)"
_SCORE = (
    "CAST(trunc(CAST(1 + least((length(code) - length(replace(code, chr(10), '')) + 1) // 50, 3) AS DOUBLE)"
    f" + {_CNT.format(w='IF')} * 0.5::DOUBLE + {_CNT.format(w='LOOP')} * 0.7::DOUBLE"
    f" + {_CNT.format(w='CURSOR')} * 0.8::DOUBLE + {_CNT.format(w='EXCEPTION')} * 0.3::DOUBLE) AS BIGINT)"
)
SCORE_SQL = f"least({_SCORE}, 10)"
CLASS_SQL = "CASE WHEN {s} >= 8 THEN 'high' WHEN {s} >= 5 THEN 'medium' ELSE 'low' END"

ORACLES["proc_complexity"] = f"""
WITH {CORPUS}, s AS (SELECT proc, {SCORE_SQL} AS complexity_score,
   CAST(length(code) - length(replace(code, chr(10), '')) + 1 AS BIGINT) AS lines FROM corpus)
SELECT proc, complexity_score, {CLASS_SQL.format(s='complexity_score')} AS complexity_class, lines FROM s
"""

# calls resolved to known procedures; in this corpus names are unique, so the
# resolved id of callee X is UNKNOWN.X when X is a procedure.
CALL_EDGES = f"""
call_raw AS ({_unnest_union(K.CALL_PATTERNS)}),
calls AS (SELECT DISTINCT proc, v AS callee FROM call_raw
          WHERE v LIKE '%.%' OR NOT list_contains({_list(K.SQL_BUILTINS)}, v))
"""

ORACLES["top_called"] = f"""
WITH {CORPUS}, {CALL_EDGES},
known AS (SELECT DISTINCT c.proc, c.callee FROM calls c JOIN corpus p ON p.proc = c.callee WHERE c.proc <> c.callee),
ind AS (SELECT callee, count(*) AS callers FROM known GROUP BY callee)
SELECT i.callee AS name, CAST(i.callers AS BIGINT) AS callers, {SCORE_SQL} AS complexity_score,
       {CLASS_SQL.format(s=SCORE_SQL)} AS complexity_class
FROM ind i JOIN corpus p ON p.proc = i.callee
ORDER BY callers DESC, name ASC LIMIT 10
"""


def _re2(p: str) -> str:
    """Java inline flags -> RE2: RE2 has no (?d); its '.' and '$' already use '\\n' only."""
    import re as _re
    return _re.sub(r"\(\?([a-z]+)\)", lambda m: "(?" + m.group(1).replace("d", "") + ")" if m.group(1).replace("d", "") else "", p)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_KW = _list(K.SQL_BUILTINS)

# P7 as a chain of CTE columns: e0 -> e1 (alias cut) -> e2 (prefix cut) -> e3 (unwrap) -> name
def _field_name_ctes(src: str, e0: str) -> str:
    return f"""
f1 AS (SELECT *, CASE WHEN contains(upper({e0}), ' AS ') THEN string_split({e0}, ' AS ')[1]
                      WHEN contains({e0}, ' ') AND len(list_filter({_KW}, lambda k: contains(upper({e0}), k))) = 0
                           THEN regexp_split_to_array({_strip(e0)}, '\\s+')[1]
                      ELSE {e0} END AS e1 FROM {src}),
f2 AS (SELECT *, CASE WHEN contains(e1, '.') THEN string_split(e1, '.')[-1] ELSE e1 END AS e2 FROM f1),
f3 AS (SELECT *, regexp_extract(e2, '\\(([^)]+)\\)', 1) AS inner_arg FROM f2),
f4 AS (SELECT *, CASE WHEN contains(e2, '(') AND regexp_matches(e2, '\\(([^)]+)\\)')
                      THEN (CASE WHEN contains(inner_arg, '.') THEN string_split(inner_arg, '.')[-1] ELSE inner_arg END)
                      ELSE e2 END AS e3 FROM f3),
f5 AS (SELECT *, upper({_strip('e3')}) AS fname FROM f4),
named AS (SELECT * FROM f5 WHERE fname <> '' AND NOT list_contains({_KW}, fname)
                              AND regexp_full_match(fname, '[A-Z_][A-Z0-9_]*'))"""


_SEL = _q(_re2(K.SELECT_PATTERN))
SELECT_ROWS = f"""
sm AS (SELECT proc, unnest(regexp_extract_all(code, {_SEL}, 1)) AS clause,
              unnest(regexp_extract_all(code, {_SEL}, 0)) AS whole FROM corpus),
sp AS (SELECT proc, whole, {_strip('part')} AS part FROM (SELECT proc, whole, unnest(string_split(clause, ',')) AS part FROM sm)),
{_field_name_ctes('sp', 'part')},
sel AS (SELECT proc, fname AS field, whole AS context FROM named WHERE fname <> '*')"""

_UPD = _q(_re2(K.UPDATE_PATTERN))
UPDATE_ROWS = f"""
um AS (SELECT proc, unnest(regexp_extract_all(code, {_UPD}, 1)) AS clause,
              unnest(regexp_extract_all(code, {_UPD}, 0)) AS whole FROM corpus),
ua AS (SELECT proc, whole, unnest(string_split(clause, ',')) AS a FROM um),
ul AS (SELECT proc, whole, upper({_strip("split_part(a, '=', 1)")}) AS lft FROM ua WHERE contains(a, '=')),
upd AS (SELECT proc, CASE WHEN contains(lft, '.') THEN string_split(lft, '.')[-1] ELSE lft END AS field,
               whole AS context FROM ul)"""

_INS = _q(_re2(K.INSERT_PATTERN))
INSERT_ROWS = f"""
im AS (SELECT proc, unnest(regexp_extract_all(code, {_INS}, 1)) AS clause,
              unnest(regexp_extract_all(code, {_INS}, 0)) AS whole FROM corpus),
ins AS (SELECT proc, f AS field, whole AS context
        FROM (SELECT proc, whole, upper({_strip('unnest(string_split(clause, \',\'))')}) AS f FROM im) WHERE f <> '')"""

TRANSFORM_ROWS = "tr AS (" + " UNION ALL ".join(
    f"SELECT proc, upper(x) AS field, '{fn}(' || upper(x) || ')' AS transformation "
    f"FROM (SELECT proc, unnest(regexp_extract_all(code, {_q(K.TRANSFORM_PATTERN.format(func=fn))}, 1)) AS x FROM corpus)"
    for fn in K.TRANSFORM_FUNCS) + ")"

ORACLES["proc_select_fields"] = f"WITH {CORPUS}, {SELECT_ROWS} SELECT proc, field, context FROM sel"
ORACLES["proc_update_fields"] = f"WITH {CORPUS}, {UPDATE_ROWS} SELECT proc, field, context FROM upd WHERE field <> ''"
ORACLES["proc_transforms"] = f"WITH {CORPUS}, {TRANSFORM_ROWS} SELECT proc, field, transformation FROM tr"

FIELD_USAGE = f"""{SELECT_ROWS}, {INSERT_ROWS}, {UPDATE_ROWS}, {TRANSFORM_ROWS},
usage AS (
  SELECT proc, field, 'read' AS operation, 'select' AS kind, context, CAST(NULL AS VARCHAR) AS transformation FROM sel
  UNION ALL SELECT proc, field, 'write', 'insert', context, NULL FROM ins
  UNION ALL SELECT proc, field, 'write', 'update', context, NULL FROM upd WHERE field <> ''
  UNION ALL SELECT proc, field, 'transform', 'transform', NULL, transformation FROM tr)"""

ORACLES["field_usage"] = f"WITH {CORPUS}, {FIELD_USAGE} SELECT * FROM usage"
ORACLES["field_usage_one"] = (f"WITH {CORPUS}, {FIELD_USAGE} SELECT * FROM usage "
                              "WHERE upper(field) = 'TOTAL' AND proc LIKE '%7'")

_PAR = _q(K.PARAM_PATTERN)
ORACLES["proc_params"] = f"""
WITH {CORPUS}, m AS (SELECT proc, regexp_extract_all(code, {_PAR}, 1) AS n, regexp_extract_all(code, {_PAR}, 2) AS d,
                            regexp_extract_all(code, {_PAR}, 3) AS t FROM corpus),
x AS (SELECT proc, unnest(n) AS n, unnest(d) AS d, unnest(t) AS t, unnest(generate_series(1, len(n))) AS seq FROM m)
SELECT proc, n AS param_name, replace(upper(d), ' ', '_') AS direction, upper(t) AS param_type, CAST(seq AS BIGINT) AS seq FROM x
"""

# RE2 has no look-ahead: the corpus signature has no nested parentheses, so a
# plain comma split is the same split there.
ORACLES["proc_signature_params"] = f"""
WITH {CORPUS}, h AS (SELECT proc, code AS head FROM corpus),
s AS (SELECT proc, string_split(regexp_extract(head, {_q(K.SIGNATURE_PATTERN)}, 1), ',') AS pieces FROM h
      WHERE regexp_matches(head, {_q(K.SIGNATURE_PATTERN)})),
p AS (SELECT proc, unnest(pieces) AS raw, unnest(generate_series(1, len(pieces))) AS pos FROM s),
w AS (SELECT proc, pos, {_strip('raw')} AS t FROM p),
v AS (SELECT proc, pos, t, regexp_split_to_array(t, '\\s+') AS words FROM w WHERE t <> '')
SELECT proc, words[1] AS param_name,
       {_strip("replace(replace(array_to_string(words[2:], ' '), 'IN', ''), 'OUT', '')")} AS param_type,
       CASE WHEN contains(upper(t), 'OUT') THEN (CASE WHEN contains(upper(t), 'IN') THEN 'IN OUT' ELSE 'OUT' END) ELSE 'IN' END AS direction,
       CAST(pos AS BIGINT) AS position
FROM v WHERE len(words) >= 2
"""

ORACLES["proc_variables"] = f"""
WITH {CORPUS} SELECT DISTINCT proc, upper(unnest(regexp_extract_all(code, {_q(K.VARIABLE_PATTERN)}, 1))) AS variable FROM corpus
"""

ORACLES["proc_control"] = f"WITH {CORPUS}, c AS (" + " UNION ALL ".join(
    f"SELECT proc, '{k}' AS structure, CAST(len(regexp_extract_all(code, '(?i)\\b{k}\\b')) AS BIGINT) AS n FROM corpus"
    for k in K.CONTROL_KINDS) + ") SELECT * FROM c WHERE n > 0"

INTERNAL_EDGES = """
e AS (SELECT DISTINCT c.proc AS src, c.callee AS dst FROM calls c JOIN corpus p ON p.proc = c.callee WHERE c.proc <> c.callee)"""

LEVELS = f"""{CALL_EDGES}, {INTERNAL_EDGES},
paths(node, depth) AS (SELECT proc, 0 FROM corpus UNION SELECT e.src, p.depth + 1 FROM paths p JOIN e ON e.dst = p.node),
lv AS (SELECT node AS proc, CAST(max(depth) AS BIGINT) AS level FROM paths GROUP BY node)"""

ORACLES["proc_levels"] = f"WITH RECURSIVE {CORPUS}, {LEVELS} SELECT proc, level FROM lv"
ORACLES["hierarchy"] = (f"WITH RECURSIVE {CORPUS}, {LEVELS} SELECT level, CAST(count(*) OVER w AS BIGINT) AS n_procedures, "
                        "min(proc) OVER w AS first_name, max(proc) OVER w AS last_name, "
                        "CAST(row_number() OVER (PARTITION BY level ORDER BY proc) AS BIGINT) AS position, proc FROM lv WINDOW w AS (PARTITION BY level)")
ORACLES["proc_statistics"] = f"""
WITH RECURSIVE {CORPUS}, {LEVELS}
SELECT CAST(count(*) AS BIGINT) AS total_procedures, round(avg({SCORE_SQL}), 6) AS avg_complexity,
       (SELECT CAST(coalesce(max(level), 0) AS BIGINT) FROM lv) AS max_dependency_level FROM corpus
"""
ORACLES["index_statistics"] = f"""
WITH {CORPUS}, {CALL_EDGES}, t_raw AS ({_unnest_union(K.TABLE_PATTERNS)})
SELECT CAST(count(*) AS BIGINT) AS indexed_count, round(avg({SCORE_SQL}), 2) AS avg_complexity,
       (SELECT CAST(count(DISTINCT callee) AS BIGINT) FROM calls) AS procedures_extracted,
       (SELECT CAST(count(DISTINCT v) AS BIGINT) FROM t_raw) AS tables_extracted FROM corpus
"""

CYCLIC_CORPUS = (
    "corpus0 AS (SELECT " + CORPUS_NAME_SQL + " AS proc, " + CORPUS_TEXT_SQL + " AS code FROM orders), "
    "corpus AS (SELECT proc, CASE WHEN proc = 'P0' THEN code || chr(10) || ' CALL P' || "
    "CAST((SELECT max(o_orderkey) FROM orders) AS VARCHAR) || '();' ELSE code END AS code FROM corpus0)"
)
ORACLES["cycle_members"] = f"""
WITH RECURSIVE {CYCLIC_CORPUS}, {CALL_EDGES}, {INTERNAL_EDGES},
reach(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
SELECT a.src AS proc, CAST(count(*) AS BIGINT) AS scc_size
FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src
WHERE a.src IN (SELECT src FROM reach WHERE src = dst)
GROUP BY a.src
"""
ORACLES["proc_levels_cyclic"] = f"""
WITH RECURSIVE {CYCLIC_CORPUS}, {CALL_EDGES}, {INTERNAL_EDGES},
reach(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
cyc AS (SELECT DISTINCT src AS n FROM reach WHERE src = dst),
bad AS (SELECT n FROM cyc UNION SELECT r.src FROM reach r JOIN cyc ON r.dst = cyc.n),
ok_e AS (SELECT * FROM e WHERE src NOT IN (SELECT n FROM bad)),
paths(node, depth) AS (SELECT proc, 0 FROM corpus WHERE proc NOT IN (SELECT n FROM bad)
                       UNION SELECT ok_e.src, p.depth + 1 FROM paths p JOIN ok_e ON ok_e.dst = p.node)
SELECT node AS proc, CAST(max(depth) AS BIGINT) AS level, false AS in_cycle FROM paths GROUP BY node
UNION ALL SELECT n, NULL, true FROM bad
"""

ORACLES["hierarchy_rows"] = f"WITH RECURSIVE {CORPUS}, {LEVELS} SELECT level, proc FROM lv"

NESTED_CORPUS = "corpus AS (SELECT " + CORPUS_NAME_SQL + " AS proc, " + CYCLES_TEXT_SQL + " AS code FROM orders)"
ORACLES["cycle_paths"] = f"""
WITH RECURSIVE {NESTED_CORPUS}, {CALL_EDGES}, {INTERNAL_EDGES},
p(start, last, path) AS (
  SELECT src, dst, [src, dst] FROM e WHERE dst > src
  UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.last
  WHERE e.dst > p.start AND NOT list_contains(p.path, e.dst) AND len(p.path) < 8)
SELECT p.start, CAST(len(p.path) AS BIGINT) AS length, array_to_string(list_append(p.path, p.start), ' -> ') AS cycle
FROM p JOIN e ON e.src = p.last AND e.dst = p.start
"""
ORACLES["proc_levels_condensed"] = f"""
WITH RECURSIVE {NESTED_CORPUS}, {CALL_EDGES}, {INTERNAL_EDGES},
reach(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
mutual AS (SELECT a.src AS node, min(a.dst) AS component, count(*) AS n FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
groups AS (SELECT c.proc AS node, coalesce(m.component, c.proc) AS component, m.n IS NOT NULL AS in_cycle,
                  CAST(coalesce(m.n, 1) AS BIGINT) AS component_size FROM corpus c LEFT JOIN mutual m ON m.node = c.proc),
ce AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN groups a ON a.node = e.src JOIN groups b ON b.node = e.dst
       WHERE a.component <> b.component),
paths(node, depth) AS (SELECT component, 0 FROM groups UNION SELECT ce.src, p.depth + 1 FROM paths p JOIN ce ON ce.dst = p.node),
lv AS (SELECT node, CAST(max(depth) AS BIGINT) AS level FROM paths GROUP BY node)
SELECT g.node AS proc, lv.level, g.in_cycle, g.component_size FROM groups g JOIN lv ON lv.node = g.component
"""

# ---------------------------------------------------------------- graph
GRAPH = f"""{CALL_EDGES}, t_raw AS ({_unnest_union(K.TABLE_PATTERNS)}),
tabs AS (SELECT DISTINCT proc, v AS tbl FROM t_raw),
nodes AS (SELECT 'UNKNOWN.' || proc AS id, 'procedure' AS node_type, 'UNKNOWN' AS schema, proc AS name,
                 CAST({SCORE_SQL} AS BIGINT) AS complexity_score FROM corpus),
edges AS (
  SELECT 'UNKNOWN.' || c.proc AS src, CASE WHEN p.proc IS NOT NULL THEN 'UNKNOWN.' || c.callee ELSE c.callee END AS dst,
         'calls' AS edge_type, 'procedure_call' AS relationship
  FROM calls c LEFT JOIN corpus p ON p.proc = c.callee
  UNION ALL SELECT 'UNKNOWN.' || proc, tbl, 'accesses', 'table_access' FROM tabs)"""

ORACLES["graph_nodes"] = f"WITH {CORPUS}, {GRAPH} SELECT * FROM nodes"
ORACLES["graph_edges"] = f"WITH {CORPUS}, {GRAPH} SELECT * FROM edges"
ORACLES["graph_statistics"] = f"""
WITH {CORPUS}, {GRAPH},
ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
alln AS (SELECT id, node_type FROM nodes UNION ALL SELECT id, NULL FROM ends WHERE id NOT IN (SELECT id FROM nodes))
SELECT 'total' AS kind, 'nodes' AS key, CAST(count(*) AS BIGINT) AS n FROM alln
UNION ALL SELECT 'total', 'edges', CAST(count(*) AS BIGINT) FROM edges
UNION ALL SELECT 'node_type', coalesce(node_type, 'unknown'), CAST(count(*) AS BIGINT) FROM alln GROUP BY 2
UNION ALL SELECT 'edge_type', coalesce(edge_type, 'unknown'), CAST(count(*) AS BIGINT) FROM edges GROUP BY 2
"""
ORACLES["callers"] = f"""
WITH {CORPUS}, {GRAPH}
SELECT DISTINCT e.dst AS id, e.src AS caller FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.edge_type = 'calls'
"""
ORACLES["proc_context"] = f"""
WITH {CORPUS}, {GRAPH}
SELECT DISTINCT src AS id, CASE WHEN edge_type = 'calls' THEN 'called_procedures' ELSE 'called_tables' END AS rel, dst AS target
FROM edges WHERE src IN (SELECT id FROM nodes)
"""
ORACLES["total_dependencies"] = f"""
WITH {CORPUS}, {GRAPH}
SELECT n.id, CAST(count(e.dst) AS BIGINT) AS total_dependencies FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id
"""


ALL_ROOTS = "TRUE"


def _walk(depth: int | None, roots: str = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0") -> str:
    limit = f"WHERE w.depth < {depth}" if depth else ""
    return f"""{GRAPH},
ce AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'calls'),
te AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'accesses'),
walk(root, node, depth) AS (SELECT id, id, 0 FROM nodes WHERE {roots}
    UNION SELECT w.root, ce.dst, w.depth + 1 FROM walk w JOIN ce ON ce.src = w.node AND ce.dst <> ce.src {limit}),
pf AS (SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY root, node),
tf AS (SELECT pf.root, te.dst AS node, CAST(min(pf.depth) + 1 AS BIGINT) AS depth FROM pf JOIN te ON te.src = pf.node
       GROUP BY pf.root, te.dst),
crawl AS (SELECT root, node, 'procedure' AS node_type, depth FROM pf UNION ALL SELECT root, node, 'table', depth FROM tf),
summ AS (SELECT root, CAST(count(*) FILTER (WHERE node_type = 'procedure') AS BIGINT) AS procedures_found,
                CAST(count(*) FILTER (WHERE node_type = 'table') AS BIGINT) AS tables_found,
                CAST(max(depth) FILTER (WHERE node_type = 'procedure') AS BIGINT) AS depth_reached FROM crawl GROUP BY root)"""


# whole reach on a graph with cycles: pairs first, depths by a bound no shortest path exceeds would not end, so
# depth is the first round a pair appears in (USING KEY keeps one row per pair)
def _whole() -> str:
    return f"""{GRAPH},
ce AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'calls'),
te AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'accesses'),
walk(root, node, depth) USING KEY (root, node) AS (SELECT id, id, 0 FROM nodes
    UNION SELECT w.root, ce.dst, min(w.depth) + 1 FROM walk w JOIN ce ON ce.src = w.node LEFT JOIN recurring.walk old
      ON old.root = w.root AND old.node = ce.dst WHERE old.node IS NULL GROUP BY w.root, ce.dst),
pf AS (SELECT root, node, CAST(depth AS BIGINT) AS depth FROM walk),
tf AS (SELECT DISTINCT pf.root, te.dst AS node FROM pf JOIN te ON te.src = pf.node),
summ AS (SELECT p.root, p.n AS procedures_found, CAST(coalesce(t.n, 0) AS BIGINT) AS tables_found, p.depth_reached
         FROM (SELECT root, CAST(count(*) AS BIGINT) AS n, max(depth) AS depth_reached FROM pf GROUP BY root) p
         LEFT JOIN (SELECT root, count(*) AS n FROM tf GROUP BY root) t ON t.root = p.root)"""


_IMPACT = """,
cl AS (SELECT dst AS root, CAST(count(*) AS BIGINT) AS caller_count FROM ce WHERE dst IN (SELECT id FROM nodes) GROUP BY dst)
SELECT n.id AS root, coalesce(cl.caller_count, 0) AS caller_count, coalesce(s.procedures_found, 0) AS dependency_count,
       coalesce(s.tables_found, 0) AS affected_table_count,
       coalesce(cl.caller_count, 0) + coalesce(s.procedures_found, 0) AS total_impact_score,
       CASE WHEN coalesce(s.procedures_found, 0) > 10 THEN 'alta' WHEN coalesce(s.procedures_found, 0) > 5 THEN 'média'
            ELSE 'baixa' END AS impact_class
FROM nodes n LEFT JOIN summ s ON s.root = n.id LEFT JOIN cl ON cl.root = n.id"""
ORACLES["crawl_summary_all"] = f"WITH RECURSIVE {CORPUS}, {_walk(5, ALL_ROOTS)} SELECT * FROM summ"
ORACLES["crawl_summary_whole"] = f"WITH RECURSIVE {NESTED_CORPUS}, {_whole()} SELECT * FROM summ"
ORACLES["impact_all"] = f"WITH RECURSIVE {CORPUS}, {_walk(3, ALL_ROOTS)}{_IMPACT}"
ORACLES["impact_whole"] = f"WITH RECURSIVE {NESTED_CORPUS}, {_whole()}{_IMPACT}"
ORACLES["crawl_tree"] = f"""
WITH RECURSIVE {CORPUS}, {GRAPH},
ch AS (SELECT src, dst, kind, row_number() OVER (PARTITION BY src ORDER BY kind, dst) - 1 AS seq
       FROM (SELECT DISTINCT src, dst, CASE edge_type WHEN 'calls' THEN 0 ELSE 1 END AS kind FROM edges)),
w(root, node, path, depth) AS (
  SELECT id, id, CAST([] AS BIGINT[]), 0 FROM nodes WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0
  UNION ALL SELECT w.root, ch.dst, list_append(w.path, ch.seq), w.depth + 1 FROM w JOIN ch ON ch.src = w.node AND ch.kind = 0 WHERE w.depth < 5),
chosen AS (SELECT root, node, path, depth FROM (
  SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth, path) AS k FROM w) WHERE k = 1),
entries AS (SELECT o.root, ch.dst AS name, ch.kind, ch.seq, o.path AS above, o.depth + 1 AS depth, list_append(o.path, ch.seq) AS path
            FROM chosen o JOIN nodes n ON n.id = o.node JOIN ch ON ch.src = o.node),
width AS (SELECT 'T_' || CAST(l_orderkey AS VARCHAR) AS name, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1),
rows AS (
  SELECT c.root, c.path, CAST(NULL AS BIGINT[]) AS above, 0 AS seq, 'procedure' AS node_type, c.node AS name, 0 AS depth, true AS expanded,
         false AS truncated, NULL AS error, n.complexity_score, CAST(NULL AS BIGINT) AS columns FROM chosen c JOIN nodes n ON n.id = c.node WHERE c.depth = 0
  UNION ALL
  SELECT e.root, e.path, e.above, e.seq, 'procedure', e.name, e.depth, coalesce(c.path = e.path, false) AND n.id IS NOT NULL, e.depth > 5,
         CASE WHEN c.path = e.path AND n.id IS NULL THEN 'Procedure not found in graph' END,
         CASE WHEN c.path = e.path THEN n.complexity_score END, NULL
  FROM entries e LEFT JOIN chosen c ON c.root = e.root AND c.node = e.name LEFT JOIN nodes n ON n.id = e.name WHERE e.kind = 0
  UNION ALL
  SELECT t.root, t.path, t.above, t.seq, 'table', t.name, t.depth, false, false, NULL, NULL, coalesce(width.n, 0)
  FROM (SELECT *, row_number() OVER (PARTITION BY root, name ORDER BY depth, path) AS k FROM entries WHERE kind = 1) t
  LEFT JOIN width ON width.name = t.name WHERE t.k = 1)
SELECT root, array_to_string(path, '/') AS path, array_to_string(above, '/') AS parent_path, CAST(seq AS BIGINT) AS seq, node_type, name,
       CAST(depth AS BIGINT) AS depth, expanded, truncated, error, complexity_score, CAST(columns AS BIGINT) AS columns FROM rows
"""
ORACLES["crawl"] = f"WITH RECURSIVE {CORPUS}, {_walk(None)} SELECT * FROM crawl"
ORACLES["crawl_summary"] = f"WITH RECURSIVE {CORPUS}, {_walk(5)} SELECT * FROM summ"
ORACLES["impact"] = f"""
WITH RECURSIVE {CORPUS}, {_walk(3)},
cl AS (SELECT dst AS root, CAST(count(*) AS BIGINT) AS caller_count FROM ce WHERE dst IN (SELECT id FROM nodes) GROUP BY dst)
SELECT n.id AS root, coalesce(cl.caller_count, 0) AS caller_count, coalesce(s.procedures_found, 0) AS dependency_count,
       coalesce(s.tables_found, 0) AS affected_table_count,
       coalesce(cl.caller_count, 0) + coalesce(s.procedures_found, 0) AS total_impact_score,
       CASE WHEN coalesce(s.procedures_found, 0) > 10 THEN 'alta' WHEN coalesce(s.procedures_found, 0) > 5 THEN 'média'
            ELSE 'baixa' END AS impact_class
FROM nodes n LEFT JOIN summ s ON s.root = n.id LEFT JOIN cl ON cl.root = n.id
WHERE CAST(regexp_extract(n.id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0
"""


# ---------------------------------------------------------------- catalog
CATALOG = """
li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST,
                 l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST,
                 l_shipdate NULLS FIRST) AS _rn FROM lineitem) WHERE _rn = 1),
cols AS (SELECT 'S' || CAST(l_orderkey % 5 AS VARCHAR) AS table_schema, 'T' || CAST(l_orderkey AS VARCHAR) AS table_name,
                'C' || CAST(l_linenumber AS VARCHAR) AS column_name, l_linenumber AS ordinal,
                CASE l_linenumber % 4 WHEN 0 THEN 'varchar' WHEN 1 THEN 'numeric' WHEN 2 THEN 'integer' ELSE 'date' END AS data_type,
                CASE WHEN l_linenumber % 4 = 0 THEN CAST(trunc(l_quantity) AS INTEGER) + 1 END AS char_len,
                CASE WHEN l_linenumber % 4 = 1 THEN 12 END AS num_precision,
                CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_partkey % 3 AS INTEGER) END AS num_scale,
                CASE WHEN l_linestatus = 'O' THEN 'YES' ELSE 'NO' END AS is_nullable,
                CASE WHEN l_linenumber % 4 = 2 THEN '0' END AS column_default FROM li),
keyrows AS (SELECT CASE WHEN l_linenumber = 1 THEN 'PK_T' ELSE 'FK_T' END || CAST(l_orderkey AS VARCHAR) AS constraint_name,
                CASE WHEN l_linenumber = 1 THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS constraint_type,
                'S' || CAST(l_orderkey % 5 AS VARCHAR) AS table_schema, 'T' || CAST(l_orderkey AS VARCHAR) AS table_name,
                'C' || CAST(l_linenumber AS VARCHAR) AS column_name, 1 AS ordinal,
                CASE WHEN l_linenumber = 2 THEN 'S' || CAST((l_orderkey // 2) % 5 AS VARCHAR) END AS ref_schema,
                CASE WHEN l_linenumber = 2 THEN 'T' || CAST(l_orderkey // 2 AS VARCHAR) END AS ref_table,
                CASE WHEN l_linenumber = 2 THEN 'C1' END AS ref_column,
                CASE WHEN l_linenumber = 2 THEN (CASE WHEN l_returnflag = 'R' THEN 'CASCADE' ELSE 'NO_ACTION' END) END AS delete_rule,
                CASE WHEN l_linenumber = 2 THEN (CASE WHEN l_returnflag = 'A' THEN 'SET_NULL' ELSE 'NO_ACTION' END) END AS update_rule
            FROM li WHERE l_linenumber IN (1, 2)),
idxrows AS (SELECT 'S' || CAST(l_orderkey % 5 AS VARCHAR) AS table_schema, 'T' || CAST(l_orderkey AS VARCHAR) AS table_name,
                CASE WHEN l_returnflag = 'N' THEN 'PK_T' || CAST(l_orderkey AS VARCHAR) || '_N'
                     ELSE 'IX_T' || CAST(l_orderkey AS VARCHAR) || '_' || l_returnflag END AS index_name,
                'C' || CAST(l_linenumber AS VARCHAR) AS column_name, l_linenumber AS position,
                l_returnflag = 'N' AS is_unique, 'btree' AS index_type FROM li),
pk AS (SELECT table_schema, table_name, constraint_name, string_agg(column_name, ', ' ORDER BY ordinal, column_name) AS pk_columns
       FROM keyrows WHERE constraint_type = 'PRIMARY KEY' GROUP BY ALL),
fks AS (SELECT table_schema, table_name, constraint_name,
               string_agg(column_name, ', ' ORDER BY ordinal, column_name, ref_column) AS columns,
               min(ref_schema) || '.' || min(ref_table) AS referenced_table,
               string_agg(ref_column, ', ' ORDER BY ordinal, column_name, ref_column) AS referenced_columns,
               replace(min(delete_rule), '_', ' ') AS on_delete, replace(min(update_rule), '_', ' ') AS on_update
        FROM keyrows WHERE constraint_type = 'FOREIGN KEY' GROUP BY ALL),
ptype AS (SELECT *, CASE WHEN coalesce(char_len, 0) <> 0 THEN data_type || '(' || char_len || ')'
                       WHEN coalesce(num_precision, 0) <> 0 THEN
                          (CASE WHEN coalesce(num_scale, 0) <> 0 THEN data_type || '(' || num_precision || ',' || num_scale || ')'
                                ELSE data_type || '(' || num_precision || ')' END)
                       ELSE data_type END AS pg_type FROM cols),
fkfirst AS (SELECT table_schema, table_name, column_name, arg_min(ref_schema || '.' || ref_table, constraint_name) AS fkt,
                   arg_min(ref_column, constraint_name) AS fkc FROM keyrows WHERE constraint_type = 'FOREIGN KEY' GROUP BY ALL),
acols AS (SELECT c.table_schema, c.table_name, c.column_name, CAST(c.ordinal AS BIGINT) AS ordinal, c.pg_type AS data_type,
                 c.is_nullable = 'YES' AS nullable, c.column_default AS default_value,
                 EXISTS (SELECT 1 FROM keyrows k WHERE k.constraint_type = 'PRIMARY KEY' AND k.table_schema = c.table_schema
                         AND k.table_name = c.table_name AND k.column_name = c.column_name) AS is_primary_key,
                 f.fkt IS NOT NULL AS is_foreign_key, f.fkt AS foreign_key_table, f.fkc AS foreign_key_column
          FROM ptype c LEFT JOIN fkfirst f USING (table_schema, table_name, column_name)),
idx AS (SELECT i.table_schema, i.table_name, i.index_name, string_agg(i.column_name, ', ' ORDER BY i.position, i.column_name) AS columns,
               bool_or(i.is_unique) AS is_unique, min(i.index_type) AS index_type FROM idxrows i GROUP BY ALL),
aidx AS (SELECT x.*, EXISTS (SELECT 1 FROM pk WHERE pk.table_schema = x.table_schema AND pk.table_name = x.table_name
                             AND contains(x.index_name, pk.constraint_name)) AS is_primary FROM idx x),
summary AS (SELECT c.table_schema, c.table_name, CAST(count(*) AS BIGINT) AS n_columns,
                   CAST(coalesce((SELECT count(*) FROM fks f WHERE f.table_schema = c.table_schema AND f.table_name = c.table_name), 0) AS BIGINT) AS n_fks,
                   CAST(coalesce((SELECT count(*) FROM aidx i WHERE i.table_schema = c.table_schema AND i.table_name = c.table_name), 0) AS BIGINT) AS n_indexes
            FROM cols c GROUP BY ALL),
scored AS (SELECT *, least(CAST(trunc(1.0::DOUBLE + least(n_columns // 5, 3) + least(n_fks::DOUBLE, 3.0::DOUBLE)
                                + least(n_indexes * 0.5::DOUBLE, 2.0::DOUBLE)) AS BIGINT), 10) AS complexity_score FROM summary),
tabs AS (SELECT DISTINCT table_schema || '.' || table_name AS tbl FROM cols),
fke AS (SELECT table_schema || '.' || table_name AS src, referenced_table AS dst, constraint_name, columns, referenced_columns
        FROM fks WHERE referenced_table IN (SELECT tbl FROM tabs))"""

ORACLES["catalog_columns"] = f"WITH {CATALOG} SELECT * FROM acols"
ORACLES["field_nodes"] = f"""WITH {CATALOG}
SELECT table_schema || '.' || table_name || '.' || column_name AS id, 'field' AS node_type, table_schema AS schema, column_name AS name,
       data_type, is_primary_key, is_foreign_key FROM acols"""
ORACLES["field_relationships"] = f"""WITH {CATALOG}
SELECT DISTINCT column_name AS field, 'field_of_table' AS relationship, table_schema || '.' || table_name AS target FROM cols"""
ORACLES["table_info"] = f"""WITH {CATALOG}
SELECT table_schema || '.' || table_name AS "table", 'column' AS kind, column_name || ' ' || data_type AS value FROM acols
UNION ALL SELECT src, 'foreign_key', dst FROM fke"""
ORACLES["catalog_pk"] = f"WITH {CATALOG} SELECT * FROM pk"
ORACLES["catalog_fks"] = f"WITH {CATALOG} SELECT * FROM fks"
ORACLES["catalog_indexes"] = (f"WITH {CATALOG} SELECT table_schema, table_name, index_name, columns, is_unique, "
                              "is_primary, index_type FROM aidx")
ORACLES["type_text"] = f"""
WITH {CATALOG}
SELECT table_schema, table_name, column_name, pg_type AS postgresql,
  CASE WHEN coalesce(char_len, 0) <> 0 THEN data_type || '(' || char_len || ')'
       WHEN coalesce(num_precision, 0) <> 0 THEN (CASE WHEN num_scale IS NOT NULL THEN data_type || '(' || num_precision || ',' || num_scale || ')'
                                                   ELSE data_type || '(' || num_precision || ')' END)
       ELSE data_type END AS mssql,
  CASE WHEN coalesce(char_len, 0) <> 0 THEN data_type || '(' || char_len || ')'
       WHEN coalesce(num_precision, 0) <> 0 THEN (CASE WHEN num_scale IS NOT NULL THEN data_type || '(' || num_precision || ',' || num_scale || ')'
                                                   ELSE data_type || '(' || num_precision || ')' END)
       ELSE data_type END AS mysql,
  CASE WHEN coalesce(char_len, num_precision, 0) <> 0 THEN
       (CASE WHEN num_scale IS NOT NULL THEN data_type || '(' || coalesce(CAST(num_precision AS VARCHAR), 'None') || ',' || num_scale || ')'
             WHEN num_precision IS NOT NULL THEN data_type || '(' || num_precision || ')'
             ELSE data_type || '(' || char_len || ')' END)
       ELSE data_type END AS oracle
FROM ptype
"""
ORACLES["table_ddl"] = f"""
WITH {CATALOG},
cd AS (SELECT table_schema, table_name,
              string_agg('    ' || column_name || ' ' || data_type || CASE WHEN NOT nullable THEN ' NOT NULL' ELSE '' END
                         || CASE WHEN default_value IS NOT NULL AND default_value <> '' THEN ' DEFAULT ' || default_value ELSE '' END,
                         ',' || chr(10) ORDER BY ordinal) AS col_defs,
              coalesce(string_agg(CASE WHEN is_primary_key THEN column_name END, ', ' ORDER BY ordinal), '') AS pk_cols
       FROM acols GROUP BY ALL),
fl AS (SELECT table_schema, table_name,
              string_agg(',' || chr(10) || '    CONSTRAINT ' || constraint_name || ' FOREIGN KEY (' || columns || ') REFERENCES '
                         || referenced_table || ' (' || referenced_columns || ')'
                         || CASE WHEN on_delete IS NOT NULL THEN ' ON DELETE ' || on_delete ELSE '' END
                         || CASE WHEN on_update IS NOT NULL THEN ' ON UPDATE ' || on_update ELSE '' END,
                         chr(10) ORDER BY constraint_name) AS fk_text FROM fks GROUP BY ALL)
SELECT cd.table_schema, cd.table_name,
       'CREATE TABLE ' || cd.table_schema || '.' || cd.table_name || ' (' || chr(10) || col_defs
       || CASE WHEN pk_cols <> '' THEN chr(10) || ',' || chr(10) || '    PRIMARY KEY (' || pk_cols || ')' ELSE '' END
       || CASE WHEN fk_text IS NOT NULL THEN chr(10) || fk_text ELSE '' END || chr(10) || chr(10) || ');' AS ddl
FROM cd LEFT JOIN fl USING (table_schema, table_name)
"""
ORACLES["table_complexity"] = f"WITH {CATALOG} SELECT * FROM scored"
ORACLES["table_statistics"] = f"""
WITH {CATALOG} SELECT CAST(count(*) AS BIGINT) AS total_tables, round(avg(complexity_score), 6) AS avg_complexity,
  CAST(coalesce(sum(n_fks), 0) AS BIGINT) AS total_foreign_keys, CAST(coalesce(sum(n_indexes), 0) AS BIGINT) AS total_indexes FROM scored
"""
ORACLES["fk_edges"] = f"WITH {CATALOG} SELECT * FROM fke"
ORACLES["table_levels"] = f"""
WITH RECURSIVE {CATALOG},
e AS (SELECT DISTINCT src, dst FROM fke WHERE src <> dst),
paths(node, depth) AS (SELECT tbl, 0 FROM tabs UNION SELECT e.src, p.depth + 1 FROM paths p JOIN e ON e.dst = p.node)
SELECT node AS "table", CAST(max(depth) AS BIGINT) AS level FROM paths GROUP BY node
"""
ORACLES["table_levels_compat"] = f"""
WITH {CATALOG} SELECT tbl AS "table", CAST(CASE WHEN tbl IN (SELECT dst FROM fke) THEN 1 ELSE 0 END AS BIGINT) AS level FROM tabs
"""


# ---------------------------------------------------------------- relationship map
from procweave.sources.tables import DDL_OBJECTS_SQL  # noqa: E402

OBJS = "objs AS (" + " UNION ALL ".join(
    f"SELECT 'APP' AS schema, '{kind}' AS obj_type, {name_sql} AS name, {ddl_sql} AS ddl, {i} AS kind_idx FROM {table}"
    for i, (kind, (table, name_sql, ddl_sql)) in enumerate(DDL_OBJECTS_SQL.items())) + ")"


def _tref_rows(type_override=None, only_views=False):
    parts = []
    for i, (pat, typ) in enumerate(K.MAPPER_TABLE_PATTERNS):
        p = _q("(?i)" + pat)
        t = type_override or typ
        where = " AND obj_type = 'views'" if only_views else ""
        parts.append(
            f"SELECT schema, name AS source, obj_type AS source_type, kind_idx, upper(x) AS target, '{t}' AS type, "
            f"{3 if only_views else 0} AS stage, {i} * 1000000 + mi AS sub FROM (SELECT *, "
            f"unnest(regexp_extract_all(upper(ddl), {p}, 1)) AS x, "
            f"unnest(generate_series(1, len(regexp_extract_all(upper(ddl), {p}, 1)))) AS mi FROM objs) "
            f"WHERE upper(x) <> '' AND upper(x) <> upper(name){where}")
    return " UNION ALL ".join(parts)


_MKW = _list(K.MAPPER_KEYWORDS)
RELS = f"""{OBJS},
calls_raw AS (
  SELECT schema, name, obj_type, kind_idx, upper(x) AS target FROM (SELECT *, unnest(regexp_extract_all(upper(ddl), {_q('(?i)' + K.MAPPER_CALL_EXPLICIT)}, 2)) AS x FROM objs)
  WHERE NOT list_contains({_MKW}, upper(x)) AND upper(x) <> upper(name) AND x <> ''
  UNION ALL
  SELECT schema, name, obj_type, kind_idx, upper(x) FROM (SELECT *, unnest(regexp_extract_all(upper(ddl), {_q(K.MAPPER_CALL_PAREN)}, 1)) AS x FROM objs)
  WHERE NOT list_contains({_MKW}, upper(x)) AND upper(x) <> upper(name) AND length(x) >= 3),
rels_all AS (
  {_tref_rows()}
  UNION ALL SELECT DISTINCT schema, name, obj_type, kind_idx, target, 'CALLS', 1, 0 FROM calls_raw
            WHERE obj_type IN ('procedures', 'functions', 'packages', 'triggers')
  UNION ALL SELECT schema, name, obj_type, kind_idx, upper(x), 'USES_SEQUENCE', 2, 0
            FROM (SELECT *, unnest(regexp_extract_all(ddl, {_q('(?i)' + K.MAPPER_SEQUENCE)}, 1)) AS x FROM objs)
            WHERE upper(x) <> '' AND upper(x) <> upper(name)
  UNION ALL {_tref_rows('VIEW_DEPENDS', True)}
  UNION ALL SELECT schema, name, obj_type, kind_idx, upper(x), 'CONTAINS_PROCEDURE', 4, 0
            FROM (SELECT *, unnest(regexp_extract_all(upper(ddl), {_q('(?i)' + K.MAPPER_PACKAGE_PROC)}, 1)) AS x FROM objs WHERE obj_type = 'packages')
            WHERE upper(x) IN (SELECT name FROM objs WHERE obj_type = 'procedures')
  UNION ALL SELECT schema, name, obj_type, kind_idx, upper(x), 'CONTAINS_FUNCTION', 5, 0
            FROM (SELECT *, unnest(regexp_extract_all(upper(ddl), {_q('(?i)' + K.MAPPER_PACKAGE_FUNC)}, 1)) AS x FROM objs WHERE obj_type = 'packages')
            WHERE upper(x) IN (SELECT name FROM objs WHERE obj_type = 'functions')),
rels AS (SELECT * FROM rels_all WHERE target IN (SELECT name FROM objs)),
gnodes AS (SELECT schema, name, arg_max(obj_type, kind_idx) AS node_type FROM objs GROUP BY ALL),
dp AS (SELECT DISTINCT schema, source, target FROM rels),
deg AS (SELECT n.schema, n.name, n.node_type,
               CAST(coalesce((SELECT count(*) FROM dp WHERE dp.schema = n.schema AND dp.target = n.name), 0) AS BIGINT) AS in_degree,
               CAST(coalesce((SELECT count(*) FROM dp WHERE dp.schema = n.schema AND dp.source = n.name), 0) AS BIGINT) AS out_degree
        FROM gnodes n)"""

_REL_COLS = "schema, source, target, type, source_type"
ORACLES["relations"] = f"WITH {RELS} SELECT {_REL_COLS} FROM rels"
ORACLES["relations_by_type"] = f"WITH {RELS} SELECT schema, type, CAST(count(*) AS BIGINT) AS count FROM rels GROUP BY ALL"
ORACLES["degrees"] = f"WITH {RELS} SELECT * FROM deg"
ORACLES["top_referenced"] = f"""WITH {RELS} SELECT schema, rank, name, count FROM (
  SELECT schema, CAST(row_number() OVER (PARTITION BY schema ORDER BY in_degree DESC, name) AS BIGINT) AS rank, name,
         in_degree AS count FROM deg) WHERE rank <= 10"""
ORACLES["top_referencing"] = f"""WITH {RELS} SELECT schema, rank, name, count FROM (
  SELECT schema, CAST(row_number() OVER (PARTITION BY schema ORDER BY out_degree DESC, name) AS BIGINT) AS rank, name,
         out_degree AS count FROM deg) WHERE rank <= 10"""
ORACLES["isolated_objects"] = f"WITH {RELS} SELECT schema, name, node_type FROM deg WHERE in_degree + out_degree = 0"
ORACLES["object_counts"] = f"""WITH {OBJS}, k(obj_type) AS (VALUES {', '.join("('" + k + "')" for k in K.OBJECT_KINDS)}),
per AS (SELECT DISTINCT schema, obj_type, name FROM objs), s AS (SELECT DISTINCT schema FROM objs)
SELECT s.schema, k.obj_type, CAST((SELECT count(*) FROM per WHERE per.schema = s.schema AND per.obj_type = k.obj_type) AS BIGINT) AS count
FROM s, k
UNION ALL SELECT schema, 'total', CAST(count(*) AS BIGINT) FROM per GROUP BY schema"""
ORACLES["package_contains"] = f"WITH {RELS} SELECT {_REL_COLS} FROM rels WHERE type IN ('CONTAINS_PROCEDURE', 'CONTAINS_FUNCTION')"
ORACLES["sequence_uses"] = f"WITH {RELS} SELECT {_REL_COLS} FROM rels WHERE type = 'USES_SEQUENCE'"
ORACLES["view_depends"] = f"WITH {RELS} SELECT {_REL_COLS} FROM rels WHERE type = 'VIEW_DEPENDS'"

_COLORS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.DOT_COLORS.items()) + "}"
ORACLES["dot_lines"] = f"""WITH {RELS},
lab AS (SELECT schema, source, target, arg_max(type, kind_idx * 1000000000000 + stage * 10000000000 + sub) AS rel
        FROM rels GROUP BY ALL)
SELECT DISTINCT schema, CAST(0 AS BIGINT) AS section,
       'digraph Relationships {{' || chr(10) || '  rankdir=LR;' || chr(10) || '  node [shape=box, style=filled];' || chr(10) AS line FROM objs
UNION ALL SELECT schema, 1, '  "' || name || '" [fillcolor=' || coalesce({_COLORS}[node_type], 'white') || ', label="'
          || replace(name, '_', '\\n') || '"];' FROM gnodes
UNION ALL SELECT schema, 2, '  "' || source || '" -> "' || target || '" [label="' || rel || '"];' FROM lab
UNION ALL SELECT DISTINCT schema, 3, chr(10) || '}}' FROM objs"""


# ---------------------------------------------------------------- profiles, guard, tokens
from procweave.sources.tables import QUERY_TEXT_SQL, RESPONSE_JSON_SQL  # noqa: E402


_FLOATING = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal", "s_acctbal",
             "p_retailprice", "value"}


def _profile(table: str, cols) -> str:
    parts = []
    for c in cols:
        avg = f"CAST(round(avg(TRY_CAST({c} AS DOUBLE)), 6) AS DOUBLE)"
        if c in _FLOATING:
            # the exact decimal average, rounded half away from zero in integers: a DOUBLE would miss ties
            total = f"CAST(replace(CAST(sum(TRY_CAST({c} AS DECIMAL(38,10))) AS VARCHAR), '.', '') AS HUGEINT)"
            n = f"CAST(nullif(count({c}), 0) AS HUGEINT) * 10000"
            avg = f"sign({total}) * CAST((2 * abs({total}) + {n}) // (2 * {n}) AS DOUBLE) / 1000000"
        parts.append(
            f"SELECT '{c}' AS field_name, CAST(count(*) AS BIGINT) AS total_count, CAST(count({c}) AS BIGINT) AS non_null_count, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, "
            f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
            f"{avg} AS avg_value FROM {table}")
    return " UNION ALL ".join(parts)


ORACLES["field_profile_lineitem"] = _profile("lineitem", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate"])
ORACLES["field_profile_orders"] = _profile("orders", [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
ORACLES["sample_orders"] = ("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice "
                            "FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)")
ORACLES["guarded_sql"] = ("SELECT o_orderpriority, CAST(count(*) AS VARCHAR) AS n, CAST(round(sum(o_totalprice), 2) AS VARCHAR) AS total "
                          "FROM orders GROUP BY o_orderpriority LIMIT 100")

_GUARD = f"""
ql AS (SELECT event_id AS id, {QUERY_TEXT_SQL} AS sql FROM events),
c1 AS (SELECT id, sql, regexp_replace(regexp_replace(sql, '(?m)--.*?$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS t FROM ql),
c2 AS (SELECT id, sql, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS clean FROM c1),
c3 AS (SELECT *, list_filter({_list(K.GUARD_BANNED)}, lambda k: regexp_matches(upper(clean), '\\b' || k || '\\b')) AS hits,
              list_filter(string_split(clean, ';')[2:], lambda p: trim(p) <> '' AND NOT starts_with(trim(p), '--')) AS extra FROM c2),
g AS (SELECT id, sql, CASE WHEN NOT regexp_matches(clean, '(?i)^\\s*SELECT\\s+') THEN '{K.GUARD_MSG_NOT_SELECT}'
                           WHEN len(hits) > 0 THEN 'Comando ''' || hits[1] || ''' não é permitido por segurança'
                           WHEN len(extra) > 0 THEN '{K.GUARD_MSG_MULTI}' END AS error FROM c3)"""

ORACLES["sql_audit"] = f"WITH {_GUARD} SELECT id, error IS NULL AS allowed, error FROM g"
ORACLES["limit_policy"] = f"""WITH ql AS (SELECT event_id AS id, {QUERY_TEXT_SQL} AS sql FROM events)
SELECT id, CASE
  WHEN regexp_matches(upper(sql), '\\bLIMIT\\s+\\d+') THEN
       (CASE WHEN CAST(regexp_extract(upper(sql), '\\bLIMIT\\s+(\\d+)', 1) AS DOUBLE) > 1000
             THEN regexp_replace(sql, '(?i)\\bLIMIT\\s+\\d+', 'LIMIT 1000', 'g') ELSE sql END)
  WHEN regexp_matches(upper(sql), '\\bTOP\\s+\\d+') THEN sql
  ELSE regexp_replace(regexp_replace(sql, '\\s+$', ''), ';+$', '') || ' LIMIT 1000' END AS limited_sql FROM ql"""

TOKENS = """tm AS (SELECT event_id AS request_id, event_type AS operation, CAST(floor(value) AS BIGINT) AS tokens_in,
                   CAST(event_id % 100 AS BIGINT) AS tokens_out, CAST(floor(value) AS BIGINT) + CAST(event_id % 100 AS BIGINT) AS tokens_total,
                   ts AS timestamp, event_id % 2 = 0 AS use_toon FROM events)"""
ORACLES["token_totals"] = (f"WITH {TOKENS} SELECT CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS prompt_tokens, "
                           "CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS completion_tokens, "
                           "CAST(coalesce(sum(tokens_total), 0) AS BIGINT) AS total_tokens FROM tm")
ORACLES["token_by_operation"] = f"""WITH {TOKENS} SELECT operation, CAST(count(*) AS BIGINT) AS count, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(tokens_total) AS BIGINT) AS tokens_total,
  round(avg(tokens_in), 6) AS avg_tokens_in, round(avg(tokens_out), 6) AS avg_tokens_out, round(avg(tokens_total), 6) AS avg_tokens_total
  FROM tm GROUP BY operation"""
ORACLES["token_overall"] = f"""WITH {TOKENS} SELECT CAST(count(*) AS BIGINT) AS total_requests,
  round(coalesce(avg(tokens_in), 0), 6) AS avg_prompt_tokens, round(coalesce(avg(tokens_out), 0), 6) AS avg_completion_tokens,
  round(coalesce(avg(tokens_total), 0), 6) AS avg_total_tokens FROM tm"""
ORACLES["token_compare"] = f"""WITH {TOKENS},
w AS (SELECT operation, sum(tokens_total) AS t FROM tm WHERE use_toon GROUP BY operation),
wo AS (SELECT operation, sum(tokens_total) AS t FROM tm WHERE NOT use_toon GROUP BY operation)
SELECT w.operation, CAST(w.t AS BIGINT) AS with_toon, CAST(wo.t AS BIGINT) AS without_toon,
       round((wo.t - w.t) / wo.t * 100.0, 6) AS savings_percent, CAST(wo.t - w.t AS BIGINT) AS savings_tokens
FROM w JOIN wo ON w.operation = wo.operation WHERE wo.t > 0"""
ORACLES["token_compare_overall"] = f"""WITH {TOKENS},
g AS (SELECT sum(tokens_total) FILTER (WHERE use_toon) AS w, sum(tokens_total) FILTER (WHERE NOT use_toon) AS wo,
             count(*) FILTER (WHERE use_toon) AS nw, count(*) FILTER (WHERE NOT use_toon) AS nwo FROM tm)
SELECT CASE WHEN nw > 0 THEN CAST(coalesce(w, 0) AS BIGINT) END AS with_toon_tokens, CAST(nw AS BIGINT) AS with_toon_requests,
       CASE WHEN nw > 0 AND nwo > 0 THEN CAST(coalesce(wo, 0) AS BIGINT) END AS without_toon_tokens, CAST(nwo AS BIGINT) AS without_toon_requests,
       CASE WHEN nw > 0 AND nwo > 0 THEN (CASE WHEN coalesce(wo, 0) > 0 THEN round((wo - w) / wo * 100.0, 6) ELSE 0.0 END) END AS overall_savings_percent,
       CASE WHEN nw > 0 AND nwo > 0 THEN CAST(coalesce(wo, 0) - coalesce(w, 0) AS BIGINT) END AS overall_savings_tokens,
       CASE WHEN nw > 0 AND nwo = 0 THEN 'TOON foi usado em todas as requisições. Não há comparação disponível.' END AS note FROM g"""


def _nz(expr: str) -> str:
    return f"nullif(TRY_CAST(json_extract_string(u, '{expr}') AS BIGINT), 0)"


ORACLES["token_usage_json"] = f"""WITH r AS (SELECT event_id AS request_id, {RESPONSE_JSON_SQL} AS response FROM events),
c AS (SELECT request_id, coalesce(
        CASE WHEN json_extract(response, '$.llm_output.token_usage')::VARCHAR NOT IN ('{{}}') THEN json_extract(response, '$.llm_output.token_usage')::VARCHAR END,
        json_extract(response, '$.kwargs.token_usage')::VARCHAR,
        CASE WHEN json_extract(response, '$.response_metadata.token_usage')::VARCHAR NOT IN ('{{}}') THEN json_extract(response, '$.response_metadata.token_usage')::VARCHAR END,
        json_extract(response, '$.llm_output.usage')::VARCHAR,
        json_extract(response, '$.llm_output.tokenUsage')::VARCHAR,
        list_filter(list_transform(flatten(CAST(json_extract(response, '$.generations') AS JSON[][])),
                                   lambda g: json_extract(g, '$.response_metadata.token_usage')::VARCHAR),
                    lambda x: x IS NOT NULL AND x <> '{{}}')[1]) AS u FROM r),
p AS (SELECT request_id, coalesce({_nz('$.prompt_tokens')}, {_nz('$.promptTokens')}, {_nz('$.input_tokens')}, {_nz('$.inputTokens')}, 0) AS pt,
             coalesce({_nz('$.completion_tokens')}, {_nz('$.completionTokens')}, {_nz('$.output_tokens')}, {_nz('$.outputTokens')}, 0) AS ct,
             coalesce({_nz('$.total_tokens')}, {_nz('$.totalTokens')}) AS tt FROM c)
SELECT request_id, CAST(pt AS BIGINT) AS prompt_tokens, CAST(ct AS BIGINT) AS completion_tokens, CAST(coalesce(tt, pt + ct) AS BIGINT) AS total_tokens FROM p"""


# ---------------------------------------------------------------- vector search
_L2 = ("1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), "
       "lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))")
_COS = "list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))"


def _topk(sim: str, k: int) -> str:
    return f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
s AS (SELECT e.vec_id, {sim} AS sim FROM embeddings e, q)
SELECT CAST(row_number() OVER (ORDER BY sim DESC, vec_id) AS BIGINT) AS rank, vec_id, round(sim, 4) AS similarity
FROM s WHERE sim >= -1.0 ORDER BY sim DESC, vec_id LIMIT {k}"""


ORACLES["semantic_topk"] = _topk(_L2, 10)
ORACLES["cosine_topk"] = _topk(_COS, 10)
ORACLES["semantic_topk_multi"] = f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id, {_L2} AS sim FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= -1.0)
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(sim, 4) AS similarity FROM r WHERE rank <= 5"""
ORACLES["semantic_topk_nodes"] = f"""WITH q AS (SELECT 'APP.N' || CAST(vec_id AS VARCHAR) AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, 'APP.N' || CAST(e.vec_id AS VARCHAR) AS node_id, {_L2} AS sim FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS rank FROM s WHERE sim >= -1.0)
SELECT query_id, CAST(rank AS BIGINT) AS rank, node_id, round(sim, 4) AS similarity FROM r WHERE rank <= 3"""
ORACLES["semantic_topk_indexed"] = ORACLES["semantic_topk_multi"]
ORACLES["semantic_index_recall"] = """
SELECT CAST(count(*) AS BIGINT) AS queries, CAST(count(*) * least(5, (SELECT count(*) FROM embeddings)) AS BIGINT) AS neighbours, true AS recall_reached
FROM embeddings WHERE vec_id % 100 = 0
"""
ORACLES["pooled_embeddings"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^ \t\n\x0B\f\r]+)', 1)) AS token FROM documents),
h AS (SELECT doc_id, md5(token) AS m FROM t),
p AS (SELECT doc_id, strpos('0123456789abcdef', substr(m, 2, 1)) - 1 AS axis, sum(CASE WHEN substr(m, 3, 1) < '8' THEN 1 ELSE -1 END) AS s
      FROM h GROUP BY doc_id, 2),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS length FROM p GROUP BY doc_id),
axes AS (SELECT doc_id, a.axis FROM documents, (SELECT unnest(range(16)) AS axis) a)
SELECT x.doc_id, CAST(x.axis AS BIGINT) AS axis, round(CASE WHEN n.length > 0 THEN coalesce(p.s, 0) / n.length ELSE 0.0 END, 4) AS value
FROM axes x LEFT JOIN p ON p.doc_id = x.doc_id AND p.axis = x.axis LEFT JOIN n ON n.doc_id = x.doc_id
"""
ORACLES["bucket_upsert"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 10 = 3 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 10 <> 7
"""
ORACLES["index_upkeep"] = """
WITH c AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM orders
           UNION ALL SELECT 'deleted' FROM orders WHERE o_orderkey % 7 = 0)
SELECT action, 'procedure' AS node_type, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY action
"""
ORACLES["hybrid_search"] = f"""WITH {CORPUS}, {GRAPH},
q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
s AS (SELECT 'UNKNOWN.P' || CAST(e.vec_id AS VARCHAR) AS node_id, {_L2} AS sim FROM embeddings e, q),
hits AS (SELECT node_id, sim, row_number() OVER (ORDER BY sim DESC, node_id) AS rank FROM s WHERE sim >= -1.0),
top AS (SELECT * FROM hits WHERE rank <= 5),
nb AS (SELECT src AS node_id, edge_type, dst AS other FROM edges UNION ALL SELECT dst, edge_type, src FROM edges),
g AS (SELECT t.node_id, nb.edge_type, nb.other, count(*) OVER (PARTITION BY t.node_id, nb.edge_type) AS n,
             row_number() OVER (PARTITION BY t.node_id, nb.edge_type ORDER BY nb.other) AS pos FROM top t JOIN nb ON nb.node_id = t.node_id)
SELECT CAST(t.rank AS BIGINT) AS rank, t.node_id, round(t.sim, 4) AS similarity, g.edge_type, g.other, CAST(g.pos AS BIGINT) AS pos,
       CAST(g.n AS BIGINT) AS n_neighbours
FROM top t LEFT JOIN g ON g.node_id = t.node_id"""

_T_RAW = _unnest_union(K.TABLE_PATTERNS)
ORACLES["code_documents"] = f"""WITH {CORPUS}, {CALL_EDGES}, t_raw AS ({_T_RAW}),
pm AS (SELECT proc, regexp_extract_all(code, {_PAR}, 1) AS n, regexp_extract_all(code, {_PAR}, 2) AS d,
              regexp_extract_all(code, {_PAR}, 3) AS t FROM corpus),
px AS (SELECT proc, unnest(n) AS n, unnest(d) AS d, unnest(t) AS t, unnest(generate_series(1, len(n))) AS seq FROM pm),
pl AS (SELECT proc, string_agg(n || ' ' || replace(upper(d), ' ', '_') || ' ' || upper(t), ', ' ORDER BY seq) AS params
       FROM px GROUP BY proc),
cl AS (SELECT proc, array_to_string(list_sort(list(callee)), ', ') AS calls FROM calls GROUP BY proc),
tl AS (SELECT proc, array_to_string(list_sort(list(DISTINCT v)), ', ') AS tabs FROM t_raw GROUP BY proc)
SELECT 'UNKNOWN.' || c.proc AS node_id,
       concat_ws(chr(10), 'Procedure: ' || c.proc, 'Schema: UNKNOWN',
                 CASE WHEN pl.params IS NOT NULL THEN 'Parameters: ' || pl.params END,
                 CASE WHEN cl.calls IS NOT NULL THEN 'Calls: ' || cl.calls END,
                 CASE WHEN tl.tabs IS NOT NULL THEN 'Tables: ' || tl.tabs END,
                 'Complexity: ' || CAST({SCORE_SQL} AS VARCHAR) || '/10',
                 chr(10) || 'Code:' || chr(10) || c.code) AS text,
       CAST(length(c.code) AS BIGINT) AS code_length
FROM corpus c LEFT JOIN pl USING (proc) LEFT JOIN cl USING (proc) LEFT JOIN tl USING (proc)"""
ORACLES["vector_statistics"] = "SELECT 'procedure' AS node_type, CAST(count(*) AS BIGINT) AS count FROM orders"


# ---------------------------------------------------------------- model steps, caches
from procweave.plans.queries import NOISY_JSON_SQL, PARSE_RESPONSE_SQL, SCORE_RESPONSE_SQL  # noqa: E402

ORACLES["llm_prompts"] = (f"WITH {CORPUS} SELECT proc, 'Rate the complexity of this code from 1 to 10. Answer with the number.' "
                          "|| chr(10) || 'Code:' || chr(10) || code AS prompt FROM corpus")
BATCHED = f"""{CATALOG},
ct AS (SELECT table_name AS "table", table_schema || '.' || table_name AS full_name, CAST(count(*) AS BIGINT) AS n_columns,
              CAST(substr(table_name, 2) AS BIGINT) AS k FROM cols GROUP BY ALL),
bt AS (SELECT *, CAST(k // 50 AS VARCHAR) || ':' || CAST((row_number() OVER (PARTITION BY k // 50 ORDER BY "table") - 1) // 5 AS VARCHAR) AS batch_id,
              CAST((row_number() OVER (PARTITION BY k // 50 ORDER BY "table") - 1) % 5 AS INTEGER) AS batch_pos FROM ct)"""
ORACLES["llm_batches"] = f'WITH {BATCHED} SELECT "table", batch_id, batch_pos FROM bt'
ORACLES["llm_parse"] = f"""WITH r AS (SELECT p_partkey, {PARSE_RESPONSE_SQL} AS response FROM part),
t AS (SELECT p_partkey, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS t FROM r),
b AS (SELECT p_partkey, CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '^```[^\\n]*(\\n|$)', ''), '\\n\\s*```\\s*$', '') ELSE t END AS body FROM t),
v AS (SELECT * FROM b WHERE json_valid(body) AND json_type(body::JSON) = 'OBJECT')
SELECT p_partkey, key, json_extract_string(body, '$."' || key || '"') AS purpose FROM (SELECT *, unnest(json_keys(body)) AS key FROM v)"""
ORACLES["llm_first_json"] = f"""WITH e AS (SELECT event_id, {NOISY_JSON_SQL} AS text FROM events)
SELECT event_id, list_filter(regexp_extract_all(text, {_q('(?s)' + chr(92) + '{[^{}]*(?:' + chr(92) + '{[^{}]*' + chr(92) + '}[^{}]*)*' + chr(92) + '}')}, 0),
                             lambda c: json_valid(c))[1] AS obj FROM e"""
ORACLES["llm_score"] = f"""WITH corpus AS (SELECT {CORPUS_NAME_SQL} AS proc, {CORPUS_TEXT_SQL} AS code, {SCORE_RESPONSE_SQL} AS response FROM orders),
s AS (SELECT proc, coalesce(TRY_CAST(nullif(regexp_extract(response, '\\b([1-9]|10)\\b', 1), '') AS BIGINT), {SCORE_SQL}) AS sc FROM corpus)
SELECT proc, CAST(CASE WHEN sc BETWEEN 1 AND 10 THEN sc ELSE 5 END AS BIGINT) AS score FROM s"""
ORACLES["purpose_match"] = f"""WITH {BATCHED},
ans AS (SELECT batch_id, CASE WHEN k % 4 = 0 THEN full_name WHEN k % 4 = 1 THEN "table" ELSE 'purpose of ' || "table" END AS key,
               'stores rows of ' || "table" AS purpose FROM bt WHERE k % 4 <> 3),
c AS (SELECT t.batch_id, t."table", CASE WHEN a.key = t.full_name THEN 0 WHEN a.key = t."table" THEN 1
                                         WHEN contains(t."table", a.key) OR contains(a.key, t."table") THEN 2 END AS prio, a.key, a.purpose
      FROM bt t JOIN ans a ON a.batch_id = t.batch_id),
best AS (SELECT batch_id, "table", arg_min(purpose, (prio, key)) AS purpose FROM c WHERE prio IS NOT NULL GROUP BY ALL)
SELECT t.batch_id, t."table", coalesce(b.purpose, 'Tabela ' || t."table" || ' com ' || CAST(t.n_columns AS VARCHAR) || ' colunas') AS purpose,
       b.purpose IS NULL AS used_default FROM bt t LEFT JOIN best b ON b.batch_id = t.batch_id AND b."table" = t."table\""""
ORACLES["cache_key"] = """SELECT c_custkey, left(sha256(concat_ws('|', lower(c_mktsegment), 'h' || CAST(c_nationkey AS VARCHAR),
  coalesce(CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 5000 AS VARCHAR) END, ''), 'db',
  coalesce(CASE WHEN c_custkey % 3 <> 0 THEN 'app' END, ''), c_name)), 16) AS cache_key FROM customer"""
ORACLES["cache_misses"] = f"""WITH {CATALOG},
ct AS (SELECT DISTINCT table_schema || '.' || table_name AS "table", CAST(substr(table_name, 2) AS BIGINT) AS k FROM cols),
cache AS (SELECT "table", CASE WHEN k % 2 = 0 THEN '1.0' ELSE '0.9' END AS cache_version FROM ct WHERE k % 3 = 0)
SELECT "table", translate("table" || '/ddl', '/\\', '__') AS file_name FROM ct
WHERE "table" NOT IN (SELECT "table" FROM cache WHERE cache_version = '1.0')"""
ORACLES["source_priority"] = f"""WITH {CORPUS}, s AS (SELECT proc, code, CAST(substr(proc, 2) AS BIGINT) AS k FROM corpus)
SELECT proc AS name, CASE WHEN k % 5 = 0 THEN 'cache' WHEN k % 3 = 0 THEN 'file' ELSE 'database' END AS source,
  CASE WHEN k % 5 = 0 THEN '-- cache' || chr(10) WHEN k % 3 = 0 THEN '-- file' || chr(10) ELSE '' END || code AS source_code FROM s"""
ORACLES["latest_upsert"] = """SELECT 'UNKNOWN.P' || CAST(o_orderkey AS VARCHAR) AS node_id,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM orders
UNION ALL SELECT 'NEW.P' || CAST(o_orderkey AS VARCHAR), CAST(2 AS BIGINT) FROM orders WHERE o_orderkey % 50 = 1"""
ORACLES["keep_latest"] = "SELECT user_id, arg_max(event_type, (ts, event_type, event_id)) AS event_type, arg_max(event_id, (ts, event_type, event_id)) AS event_id FROM events GROUP BY user_id"
ORACLES["stale_nodes"] = "SELECT 'UNKNOWN.P' || CAST(o_orderkey AS VARCHAR) AS node_id FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01 00:00:00'"


# ---------------------------------------------------------------- reports
ORACLES["mermaid_lines"] = f"""WITH RECURSIVE {CORPUS}, {LEVELS},
p AS (SELECT c.proc, {SCORE_SQL} AS sc, lv.level FROM corpus c JOIN lv ON lv.proc = c.proc),
ed AS (SELECT DISTINCT proc AS src, callee AS dst FROM calls)
SELECT CAST(0 AS BIGINT) AS section, '```mermaid' || chr(10) || {_q(K.MERMAID_INIT_FLOWCHART)} || chr(10) || 'graph TD' AS line
UNION ALL SELECT 1, '    ' || translate(proc, '.- ', '___') || '["' || translate(proc || '\\n[Nível ' || CAST(level AS VARCHAR) || ', Complex: '
                 || CAST(sc AS VARCHAR) || ']', '"[]', '''()') || '"]:::' || {CLASS_SQL.format(s='sc')} FROM p
UNION ALL SELECT 2, '    ' || translate(src, '.- ', '___') || ' --> ' || translate(dst, '.- ', '___') FROM ed
UNION ALL SELECT 3, {_q(K.MERMAID_CLASS_DEFS)}"""
ORACLES["token_windows"] = f"""WITH {TOKENS}
SELECT CAST(time_bucket(INTERVAL 1 HOUR, timestamp) AS VARCHAR) AS window_start,
       CAST(time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS VARCHAR) AS window_end,
       operation, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
       CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(tokens_total) AS BIGINT) AS tokens_total,
       round(avg(tokens_total), 6) AS avg_tokens_total FROM tm GROUP BY ALL"""


# ---------------------------------------------------------------- field lineage
ACCESS_CATALOG = """tk AS (SELECT DISTINCT CAST(o_custkey % 7 AS VARCHAR) AS k FROM orders UNION SELECT substr(o_orderpriority, 1, 1) FROM orders),
tcols AS (SELECT CASE WHEN k IN ('0', '2', '4', '6') THEN 'app' ELSE 'ops' END || '.t_' || k AS tbl, upper(c) AS col
          FROM (SELECT k, unnest(CASE WHEN k IN ('1', '2', '5') THEN ['id', 'Total', 'STATUS'] ELSE ['id', 'Total'] END) AS c FROM tk))"""
ORACLES["field_sources"] = f"""WITH {CORPUS}, {FIELD_USAGE}, {ACCESS_CATALOG}
SELECT DISTINCT field, 'procedure' AS source_type, proc AS name FROM usage WHERE operation = 'write'
UNION ALL SELECT DISTINCT u.field, 'table', t.tbl FROM (SELECT DISTINCT field FROM usage) u JOIN tcols t ON t.col = u.field"""
ORACLES["field_destinations"] = f"WITH {CORPUS}, {FIELD_USAGE} SELECT DISTINCT field, proc AS name FROM usage WHERE operation = 'read'"
ORACLES["field_flow"] = f"""WITH {CORPUS}, {FIELD_USAGE}, {ACCESS_CATALOG},
s AS (SELECT field, count(*) AS n FROM (SELECT DISTINCT field, proc FROM usage WHERE operation = 'write'
      UNION ALL SELECT DISTINCT u.field, t.tbl FROM (SELECT DISTINCT field FROM usage) u JOIN tcols t ON t.col = u.field) GROUP BY field),
d AS (SELECT field, count(DISTINCT proc) AS n FROM usage WHERE operation = 'read' GROUP BY field)
SELECT f.field, CAST(coalesce(s.n, 0) AS BIGINT) AS total_sources, CAST(coalesce(d.n, 0) AS BIGINT) AS total_destinations
FROM (SELECT DISTINCT field FROM usage) f LEFT JOIN s USING (field) LEFT JOIN d USING (field)"""
ORACLES["analyze_field"] = f"""WITH {CORPUS}, {FIELD_USAGE},
per AS (SELECT field, proc, max(CASE WHEN operation = 'read' THEN 1 ELSE 0 END) AS r, max(CASE WHEN operation = 'write' THEN 1 ELSE 0 END) AS w,
               max(CASE WHEN operation = 'transform' THEN 1 ELSE 0 END) AS t FROM usage GROUP BY ALL)
SELECT field, CAST(count(*) AS BIGINT) AS procedures, CAST(sum(r) AS BIGINT) AS read_by, CAST(sum(w) AS BIGINT) AS written_by,
       CAST(sum(t) AS BIGINT) AS transformed_by FROM per GROUP BY field"""
ORACLES["trace_field"] = f"""WITH RECURSIVE {CORPUS}, {CALL_EDGES}, {FIELD_USAGE}, {ACCESS_CATALOG}, traw AS ({_T_RAW}),
ce AS (SELECT DISTINCT proc AS src, callee AS dst FROM calls),
st AS (SELECT 'P' || CAST(max(o_orderkey) AS VARCHAR) AS root FROM orders),
walk(root, node, depth) AS (SELECT root, root, 0 FROM st UNION SELECT w.root, ce.dst, w.depth + 1 FROM walk w JOIN ce ON ce.src = w.node AND ce.dst <> ce.src),
reach AS (SELECT root, node AS proc, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL),
hit AS (SELECT r.root, r.proc, r.depth, u.operation, u.transformation FROM reach r JOIN usage u ON u.proc = r.proc WHERE u.field = 'STATUS')
SELECT root, 'step' AS kind, proc AS procedure, operation, depth, CAST(NULL AS VARCHAR) AS detail FROM hit
UNION ALL SELECT DISTINCT r.root, 'source', r.proc, 'read_from_table', r.depth, c.tbl || ' (table)'
  FROM reach r JOIN traw t ON t.proc = r.proc JOIN tcols c ON upper(split_part(c.tbl, '.', 2)) = t.v AND c.col = 'STATUS'
UNION ALL SELECT DISTINCT root, 'source', proc, 'write', depth, NULL FROM hit WHERE operation = 'write'
UNION ALL SELECT DISTINCT root, 'destination', proc, 'read', depth, NULL FROM hit WHERE operation = 'read'
UNION ALL SELECT root, 'transformation', NULL, 'transform', min(depth), transformation FROM hit WHERE operation = 'transform' GROUP BY root, transformation"""


# ---------------------------------------------------------------- second corpus (loaders)
from procweave.sources.tables import LOADER_NAME_SQL, LOADER_TEXT_SQL  # noqa: E402

LOADERS = f"""li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST,
                 l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST,
                 l_shipdate NULLS FIRST) AS _rn FROM lineitem) WHERE _rn = 1),
corpus AS (SELECT {LOADER_NAME_SQL} AS proc, {LOADER_TEXT_SQL} AS code FROM li)"""

# top-level items of a SELECT list with at most one nesting level (RE2 has no recursion)
_ITEMS = "'(?:[^,(]|\\([^)]*\\))+'"
LOADER_SELECT = f"""
sm AS (SELECT proc, unnest(regexp_extract_all(code, {_SEL}, 1)) AS clause,
              unnest(regexp_extract_all(code, {_SEL}, 0)) AS whole FROM corpus),
sp AS (SELECT proc, whole, {_strip('part')} AS part FROM (SELECT proc, whole, unnest(regexp_extract_all(clause, {_ITEMS})) AS part FROM sm)),
{_field_name_ctes('sp', 'part')},
sel AS (SELECT proc, fname AS field, whole AS context FROM named WHERE fname <> '*')"""

LOADER_USAGE = f"""{LOADER_SELECT}, {INSERT_ROWS}, {UPDATE_ROWS}, {TRANSFORM_ROWS},
usage AS (
  SELECT proc, field, 'read' AS operation, 'select' AS kind, context, CAST(NULL AS VARCHAR) AS transformation FROM sel
  UNION ALL SELECT proc, field, 'write', 'insert', context, NULL FROM ins
  UNION ALL SELECT proc, field, 'write', 'update', context, NULL FROM upd WHERE field <> ''
  UNION ALL SELECT proc, field, 'transform', 'transform', NULL, transformation FROM tr)"""

ORACLES["loader_calls"] = f"""WITH {LOADERS}, raw AS ({_unnest_union(K.CALL_PATTERNS)})
SELECT DISTINCT proc, v AS callee FROM raw WHERE v LIKE '%.%' OR NOT list_contains({_list(K.SQL_BUILTINS)}, v)"""
ORACLES["loader_tables"] = f"WITH {LOADERS}, raw AS ({_unnest_union(K.TABLE_PATTERNS)}) SELECT DISTINCT proc, v AS table_name FROM raw"
ORACLES["proc_insert_fields"] = f"WITH {LOADERS}, {INSERT_ROWS} SELECT proc, field, context FROM ins"
ORACLES["loader_field_usage"] = f"WITH {LOADERS}, {LOADER_USAGE} SELECT * FROM usage"
ORACLES["loader_complexity"] = f"""WITH {LOADERS} SELECT proc, {SCORE_SQL} AS complexity_score,
  CAST(length(code) - length(replace(code, chr(10), '')) + 1 AS BIGINT) AS lines,
  CAST(len(regexp_extract_all(code, '(?i)\\bIF\\b')) AS BIGINT) AS n_if,
  CAST(len(regexp_extract_all(code, '(?i)\\bLOOP\\b')) AS BIGINT) AS n_loop,
  CAST(len(regexp_extract_all(code, '(?i)\\bWHILE\\b')) AS BIGINT) AS n_while,
  CAST(len(regexp_extract_all(code, '(?i)\\bCASE\\b')) AS BIGINT) AS n_case FROM corpus"""
ORACLES["loader_variables"] = f"""WITH {LOADERS} SELECT DISTINCT proc, upper(unnest(regexp_extract_all(code, {_q(K.VARIABLE_PATTERN)}, 1))) AS variable FROM corpus"""


# ---------------------------------------------------------------- diagram sinks
_FLOW_LV = f"""{CALL_EDGES}, {INTERNAL_EDGES},
paths(node, depth) AS (SELECT proc, 0 FROM corpus UNION SELECT e.src, p.depth + 1 FROM paths p JOIN e ON e.dst = p.node),
lv AS (SELECT node AS proc, CAST(max(depth) AS BIGINT) AS level FROM paths GROUP BY node)"""

ORACLES["mermaid_hierarchy_lines"] = f"""WITH RECURSIVE {CORPUS}, {_FLOW_LV},
p AS (SELECT c.proc, {SCORE_SQL} AS sc, lv.level FROM corpus c JOIN lv ON lv.proc = c.proc),
ed AS (SELECT DISTINCT c.proc AS src, c.callee AS dst FROM calls c WHERE c.callee IN (SELECT proc FROM corpus))
SELECT CAST(0 AS BIGINT) AS section, '```mermaid' || chr(10) || {_q(K.MERMAID_INIT_FLOWCHART)} || chr(10) || 'graph TD' AS line
UNION ALL SELECT 1, '    ' || translate(proc, '.- ', '___') || '["' || translate(proc || '\\n[Nível ' || CAST(level AS VARCHAR) || ', Complex: '
                 || CAST(sc AS VARCHAR) || ']', '"[]', '''()') || '"]:::' || {CLASS_SQL.format(s='sc')} FROM p
UNION ALL SELECT 1, '    ' || translate(src, '.- ', '___') || ' --> ' || translate(dst, '.- ', '___') FROM ed
UNION ALL SELECT 3, {_q(K.MERMAID_CLASS_DEFS)}"""

_SIGP = f"""
sg AS (SELECT proc, code AS head FROM corpus),
sgs AS (SELECT proc, string_split(regexp_extract(head, {_q(K.SIGNATURE_PATTERN)}, 1), ',') AS pieces FROM sg
        WHERE regexp_matches(head, {_q(K.SIGNATURE_PATTERN)})),
sgp AS (SELECT proc, unnest(pieces) AS raw, unnest(generate_series(1, len(pieces))) AS pos FROM sgs),
sgw AS (SELECT proc, pos, {_strip('raw')} AS t FROM sgp),
sgv AS (SELECT proc, pos, t, regexp_split_to_array(t, '\\s+') AS words FROM sgw WHERE t <> ''),
sig AS (SELECT proc, pos, words[1] AS pname,
               {_strip("replace(replace(array_to_string(words[2:], ' '), 'IN', ''), 'OUT', '')")} AS ptype,
               CASE WHEN contains(upper(t), 'OUT') THEN (CASE WHEN contains(upper(t), 'IN') THEN 'IN OUT' ELSE 'OUT' END) ELSE 'IN' END AS dir
        FROM sgv WHERE len(words) >= 2)"""

ORACLES["flowchart_lines"] = f"""WITH RECURSIVE {CORPUS}, {_FLOW_LV}, {_SIGP},
t_raw AS ({_unnest_union(K.TABLE_PATTERNS)}), tabs AS (SELECT DISTINCT proc, v AS tbl FROM t_raw),
np AS (SELECT proc, count(*) AS n FROM sig GROUP BY proc)
SELECT c.proc, CAST(0 AS BIGINT) AS section,
       '# Flowchart: ' || c.proc || chr(10) || chr(10) || '**Complexidade:** ' || CAST({SCORE_SQL} AS VARCHAR) || '/10' || chr(10)
       || '**Nível de Dependência:** ' || coalesce(CAST(lv.level AS VARCHAR), '0') || chr(10) || chr(10) || '```mermaid' || chr(10)
       || {_q(K.MERMAID_INIT_FLOWCHART)} || chr(10) || 'flowchart TD' || chr(10) || '    Start([Início: ' || translate(c.proc, '"', '''') || '])' AS line
FROM corpus c LEFT JOIN lv ON lv.proc = c.proc
UNION ALL SELECT proc, 1, '    Params[Parâmetros: ' || CAST(n AS VARCHAR) || ']' || chr(10) || '    Start --> Params' FROM np
UNION ALL SELECT proc, 2, '    Params --> P' || CAST(pos AS VARCHAR) || '["' || translate(pname, '"', '''') || ': '
          || translate(translate(ptype, '"', ''''), '- ', '__') || ' (' || dir || ')"]' FROM sig
UNION ALL SELECT DISTINCT proc, 3, '    Procs[Procedures Chamadas]' || chr(10) || '    Start --> Procs' FROM calls
UNION ALL SELECT proc, 4, '    Procs --> Proc_' || translate(callee, '.- ', '___') || '["' || translate(callee, '"', '''') || '"]' FROM calls
UNION ALL SELECT DISTINCT proc, 5, '    Tables[Tabelas Acessadas]' || chr(10) || '    Start --> Tables' FROM tabs
UNION ALL SELECT proc, 6, '    Tables --> Table_' || translate(tbl, '.- ', '___') || '["' || translate(tbl, '"', '''') || '"]' FROM tabs
UNION ALL SELECT proc, 7, '    End([Fim])' || chr(10) || '    Start --> End' || chr(10) || '```' || chr(10) || chr(10)
          || '## Lógica de Negócio' || chr(10) || chr(10) || chr(10) FROM corpus"""

ORACLES["mermaid_er_lines"] = f"""WITH {CATALOG},
ct AS (SELECT *, table_schema || '.' || table_name AS tbl FROM acols),
chosen AS (SELECT DISTINCT tbl FROM ct),
c AS (SELECT ct.*, CASE WHEN is_primary_key THEN row_number() OVER (PARTITION BY tbl, is_primary_key ORDER BY ordinal) END AS pk_rank,
             row_number() OVER (PARTITION BY tbl ORDER BY ordinal) AS pos FROM ct WHERE tbl IN (SELECT tbl FROM chosen)),
picked AS (SELECT * FROM c),
fk AS (SELECT DISTINCT src, dst FROM fke WHERE src IN (SELECT tbl FROM chosen) AND dst IN (SELECT tbl FROM chosen))
SELECT CAST(0 AS BIGINT) AS section, '```mermaid' || chr(10) || {_q(K.MERMAID_INIT_ER)} || chr(10) || 'erDiagram' AS line
UNION ALL SELECT 1, '    ' || translate(tbl, '.- ', '___') || ' {{' FROM chosen
UNION ALL SELECT 1, '        ' || column_name || ' ' || translate(trim(split_part(data_type, '(', 1)), '- ', '__')
          || CASE WHEN is_primary_key THEN ' PK' ELSE '' END || CASE WHEN is_foreign_key THEN ' FK' ELSE '' END FROM picked
UNION ALL SELECT 1, '    }}' FROM chosen
UNION ALL SELECT 2, '    ' || translate(src, '.- ', '___') || ' ||--o{{ ' || translate(dst, '.- ', '___') || ' : "foreign_key"' FROM fk
UNION ALL SELECT 3, '```'"""
ORACLES["node_documents"] = f"""WITH {CORPUS}, {GRAPH}
SELECT id AS node_id, node_type, 'Procedure: ' || name || chr(10) || 'Schema: ' || schema
       || CASE WHEN complexity_score <> 0 THEN chr(10) || 'Complexity: ' || CAST(complexity_score AS VARCHAR) ELSE '' END AS text
FROM nodes"""
ORACLES["mermaid_table_hierarchy_lines"] = f"""WITH RECURSIVE {CATALOG},
e AS (SELECT DISTINCT src, dst FROM fke WHERE src <> dst),
paths(node, depth) AS (SELECT tbl, 0 FROM tabs UNION SELECT e.src, p.depth + 1 FROM paths p JOIN e ON e.dst = p.node),
lv AS (SELECT node AS tbl, CAST(max(depth) AS BIGINT) AS level FROM paths GROUP BY node),
t AS (SELECT lv.tbl, lv.level, s.n_fks, s.complexity_score AS sc FROM lv JOIN scored s ON s.table_schema || '.' || s.table_name = lv.tbl)
SELECT CAST(0 AS BIGINT) AS section, '```mermaid' || chr(10) || {_q(K.MERMAID_INIT_FLOWCHART)} || chr(10) || 'graph TD' AS line
UNION ALL SELECT DISTINCT 1, '    subgraph Level' || CAST(level AS VARCHAR) || '["Nível ' || CAST(level AS VARCHAR) || '"]' FROM lv
UNION ALL SELECT 1, '        ' || translate(tbl, '.- ', '___') || '["' || translate(tbl || '\\n[Complex: ' || CAST(sc AS VARCHAR) || ', FKs: '
          || CAST(n_fks AS VARCHAR) || ']', '"[]', '''()') || '"]:::' || {CLASS_SQL.format(s='sc')} FROM t
UNION ALL SELECT 1, '    end' FROM (SELECT DISTINCT level FROM lv)
UNION ALL SELECT 2, '    ' || translate(src, '.- ', '___') || ' --> ' || translate(dst, '.- ', '___') FROM fke
UNION ALL SELECT 3, {_q(K.MERMAID_CLASS_DEFS)}"""


_NL = "chr(10)"
ORACLES["report_lines"] = f"""WITH {RELS},
kinds(obj_type, kidx) AS (VALUES {', '.join(f"('{k}', {i})" for i, k in enumerate(K.OBJECT_KINDS))}),
per AS (SELECT DISTINCT schema, obj_type, name FROM objs),
cnt AS (SELECT s.schema, k.obj_type, k.kidx, (SELECT count(*) FROM per WHERE per.schema = s.schema AND per.obj_type = k.obj_type) AS c
        FROM (SELECT DISTINCT schema FROM objs) s, kinds k),
tot AS (SELECT schema, sum(c) AS n_obj FROM cnt GROUP BY schema),
nrel AS (SELECT schema, count(*) AS n_rel FROM rels GROUP BY schema),
tin AS (SELECT * FROM (SELECT schema, name, in_degree AS c, row_number() OVER (PARTITION BY schema ORDER BY in_degree DESC, name) AS r FROM deg) WHERE r <= 10),
tout AS (SELECT * FROM (SELECT schema, name, out_degree AS c, row_number() OVER (PARTITION BY schema ORDER BY out_degree DESC, name) AS r FROM deg) WHERE r <= 10),
iso AS (SELECT schema, name FROM deg WHERE in_degree + out_degree = 0),
byt AS (SELECT schema, type, count(*) AS c FROM rels GROUP BY ALL),
ordered AS (SELECT schema, source, type, target,
                   row_number() OVER (PARTITION BY schema ORDER BY kind_idx, source, stage, sub) AS r FROM rels)
SELECT t.schema, CAST(0 AS BIGINT) AS section,
       '# Mapa de Relacionamentos - Schema: ' || t.schema || {_NL} || {_NL} || '**Gerado em:** 2024-01-01 00:00:00' || {_NL} || {_NL}
       || '## Estatísticas' || {_NL} || {_NL} || '- **Total de objetos:** ' || CAST(t.n_obj AS VARCHAR) || {_NL}
       || '- **Total de relacionamentos:** ' || CAST(coalesce(n.n_rel, 0) AS VARCHAR) || {_NL} || {_NL} || '### Objetos por Tipo' || {_NL} || {_NL}
       || '| Tipo | Quantidade |' || {_NL} || '|------|------------|' AS line
FROM tot t LEFT JOIN nrel n USING (schema)
UNION ALL SELECT schema, 1, '| ' || upper(left(obj_type, 1)) || lower(substr(obj_type, 2)) || ' | ' || CAST(c AS VARCHAR) || ' |' FROM cnt
UNION ALL SELECT DISTINCT schema, 2, {_NL} || '### Objetos Mais Referenciados' || {_NL} || {_NL} || '| Objeto | Referências |' || {_NL} || '|--------|-------------|' FROM objs
UNION ALL SELECT schema, 3, '| ' || name || ' | ' || CAST(c AS VARCHAR) || ' |' FROM tin
UNION ALL SELECT DISTINCT schema, 4, {_NL} || '### Objetos que Mais Referenciam Outros' || {_NL} || {_NL} || '| Objeto | Referências |' || {_NL} || '|--------|-------------|' FROM objs
UNION ALL SELECT schema, 5, '| ' || name || ' | ' || CAST(c AS VARCHAR) || ' |' FROM tout
UNION ALL SELECT schema, 6, {_NL} || '### Objetos Isolados (' || CAST(count(*) AS VARCHAR) || ')' || {_NL} FROM iso GROUP BY schema
UNION ALL SELECT schema, 7, name FROM iso
UNION ALL SELECT DISTINCT schema, 8, {_NL} || '### Relacionamentos por Tipo' || {_NL} || {_NL} || '| Tipo | Quantidade |' || {_NL} || '|------|------------|' FROM objs
UNION ALL SELECT schema, 9, '| ' || type || ' | ' || CAST(c AS VARCHAR) || ' |' FROM byt
UNION ALL SELECT DISTINCT schema, 10, {_NL} || '## Relacionamentos' || {_NL} || {_NL} || '| Origem | Tipo | Destino |' || {_NL} || '|--------|------|---------|' FROM objs
UNION ALL SELECT schema, 11, '| ' || source || ' | ' || type || ' | ' || target || ' |' FROM ordered"""


# ---------------------------------------------------------------- whole answers beside the single ones above
ORACLES["trace_field_all"] = f"""WITH RECURSIVE {CORPUS}, {CALL_EDGES}, {FIELD_USAGE}, {ACCESS_CATALOG}, traw AS ({_T_RAW}),
ce AS (SELECT DISTINCT proc AS src, callee AS dst FROM calls),
walk(root, node, depth) AS (SELECT proc, proc, 0 FROM corpus WHERE CAST(substr(proc, 2) AS BIGINT) % 100 = 0
    UNION SELECT w.root, ce.dst, w.depth + 1 FROM walk w JOIN ce ON ce.src = w.node AND ce.dst <> ce.src),
reach AS (SELECT root, node AS proc, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL),
hit AS (SELECT r.root, u.field, r.proc, r.depth, u.operation, u.transformation FROM reach r JOIN usage u ON u.proc = r.proc)
SELECT root, field, 'step' AS kind, proc AS procedure, operation, depth, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS column_info FROM hit
UNION ALL SELECT DISTINCT r.root, c.col, 'source', r.proc, 'read_from_table', r.depth, c.tbl || ' (table)',
    '{{"data_type":"' || CASE WHEN c.col = 'STATUS' THEN 'text' ELSE 'numeric' END || '"}}'
  FROM reach r JOIN traw t ON t.proc = r.proc JOIN tcols c ON upper(split_part(c.tbl, '.', 2)) = t.v WHERE c.col IN (SELECT field FROM usage)
UNION ALL SELECT DISTINCT root, field, 'source', proc, 'write', depth, NULL, NULL FROM hit WHERE operation = 'write'
UNION ALL SELECT DISTINCT root, field, 'destination', proc, 'read', depth, NULL, NULL FROM hit WHERE operation = 'read'
UNION ALL SELECT root, field, 'transformation', NULL, 'transform', min(depth), transformation, NULL FROM hit WHERE operation = 'transform' GROUP BY root, field, transformation"""
ORACLES["field_sources_first"] = f"""WITH {CORPUS}, {FIELD_USAGE},
u AS (SELECT DISTINCT field, proc FROM usage),
f AS (SELECT field, proc FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY proc) AS k FROM u) WHERE k <= 10)
SELECT DISTINCT usage.field, 'procedure' AS source_type, usage.proc AS name FROM usage JOIN f ON f.field = usage.field AND f.proc = usage.proc
WHERE usage.operation = 'write'"""
ORACLES["node_documents_full"] = f"""WITH {CORPUS}, {CATALOG},
t AS (SELECT table_schema, table_name, CAST(substr(table_name, 2) AS BIGINT) AS k,
             string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal, column_name, data_type) AS columns FROM cols GROUP BY ALL),
f AS (SELECT src, string_agg(dst, ', ' ORDER BY dst) AS dsts FROM (SELECT DISTINCT src, dst FROM fke) GROUP BY src),
p AS (SELECT proc, CAST({SCORE_SQL} AS BIGINT) AS score, regexp_extract_all(code, {_PAR}, 1) AS params FROM corpus)
SELECT t.table_schema || '.' || t.table_name AS node_id, 'table' AS node_type,
       concat_ws(chr(10), 'Table: ' || t.table_name, 'Schema: ' || t.table_schema,
                 CASE WHEN k % 3 = 0 THEN 'Purpose: Keeps ' || t.table_name END, 'Columns: ' || t.columns,
                 'References: ' || f.dsts, CASE WHEN k % 4 = 1 THEN 'Logic: Filled once for ' || t.table_name END,
                 CASE WHEN k % 11 <> 0 THEN 'Complexity: ' || CAST(k % 11 AS VARCHAR) END) AS text
FROM t LEFT JOIN f ON f.src = t.table_schema || '.' || t.table_name
UNION ALL
SELECT 'UNKNOWN.' || proc, 'procedure',
       concat_ws(chr(10), 'Procedure: ' || proc, 'Schema: UNKNOWN', CASE WHEN len(params) > 0 THEN 'Parameters: ' || array_to_string(params, ', ') END,
                 CASE WHEN score <> 0 THEN 'Complexity: ' || CAST(score AS VARCHAR) END) FROM p"""
ORACLES["llm_prompts_all"] = f"""WITH {CORPUS}, {CATALOG},
ddl AS ({ORACLES["table_ddl"]}),
names AS (SELECT table_schema, table_name, string_agg(column_name, ', ' ORDER BY ordinal, column_name) AS columns FROM cols GROUP BY ALL)
SELECT 'business_logic' AS kind, proc AS name, 'Describe the business logic of procedure ' || proc || '.' || chr(10) || 'Code:' || chr(10) || code AS prompt FROM corpus
UNION ALL SELECT 'dependencies', proc, 'List the procedures and tables used by this code as JSON.' || chr(10) || 'Code:' || chr(10) || code FROM corpus
UNION ALL SELECT 'table_purpose', d.table_schema || '.' || d.table_name,
    'Describe the purpose of table ' || d.table_schema || '.' || d.table_name || '.' || chr(10) || 'Columns: ' || n.columns || chr(10) || 'DDL:' || chr(10) || d.ddl
FROM ddl d JOIN names n USING (table_schema, table_name)"""
ORACLES["merged_dependencies"] = f"""WITH {CORPUS}, {CALL_EDGES}
SELECT proc, callee FROM calls
UNION SELECT proc, unnest(['MODEL_' || CAST(CAST(substr(proc, 2) AS BIGINT) % 13 AS VARCHAR), 'P1']) FROM corpus WHERE CAST(substr(proc, 2) AS BIGINT) % 2 = 0"""
ORACLES["document_previews"] = f"""SELECT doc_id, CASE WHEN length(text) > {K.PREVIEW_CHARS} THEN substr(text, 1, {K.PREVIEW_CHARS}) || '...' ELSE text END AS preview
FROM documents"""
ORACLES["non_empty_procedures"] = "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 3"

ORACLES["ddl_files"] = f"""WITH {OBJS}
SELECT schema || '/' || obj_type || '/' || name || CASE obj_type WHEN 'procedures' THEN '.prc' WHEN 'functions' THEN '.fnc' ELSE '.sql' END AS path, ddl AS content
FROM objs
"""

# The newest version of a procedure: the nested corpus where it came last, else the corpus; none where it was deleted.
STREAM_CORPUS = f"""corpus AS (
  SELECT {CORPUS_NAME_SQL} AS proc, CASE WHEN o_orderkey % 5 = 0 THEN {CYCLES_TEXT_SQL} ELSE {CORPUS_TEXT_SQL} END AS code
  FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 1))"""
ORACLES["graph_stream"] = f"""WITH {STREAM_CORPUS}, {CALL_EDGES}, t_raw AS ({_unnest_union(K.TABLE_PATTERNS)})
SELECT 'UNKNOWN.' || proc AS id, callee AS dst, 'calls' AS edge_type FROM calls
UNION SELECT 'UNKNOWN.' || proc, v, 'accesses' FROM t_raw
UNION SELECT 'UNKNOWN.' || proc, 'UNKNOWN.' || proc, 'node' FROM corpus
"""
