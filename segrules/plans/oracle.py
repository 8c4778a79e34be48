"""Plain-SQL statements (DuckDB dialect) computing the same results as the registered queries.

The tables ``lineitem orders customer nation part pages events`` are views
over the driver's parquet files.  Category indexes, value lists, rule text,
coverages and leaf statistics are recomputed here from those tables.  The trees
are grown in SQL as well: level by level the best gini cut of every node over all
features, then each row goes to its side.  Nothing is taken from a fitted model.

Random-forest importance has no entry here; invariants in the tests check it.
"""

from __future__ import annotations

# The regular expressions of the path cleaning, as in
# segrules.functions.paths.
_LAST_PIPE_PAIR = r"([\s\p{P}\w<>=+]*\|?[\s\p{P}\w<>=+]+$)"
_PAGE_NAME_TAIL = r"([\s\p{P}\w<>=]*\|?[\s\p{P}\w]+$)"

_FX = """fx AS (
  SELECT l_orderkey, l_linenumber, p.p_type, p.p_brand, c.c_mktsegment AS segment,
         n.n_name AS nation, o.o_orderpriority AS priority,
         l_quantity AS quantity, l_discount AS discount,
         concat(p.p_type, '|', p.p_brand, '|', p.p_name) AS first_page,
         CASE WHEN l_linenumber = 7 THEN ''
              ELSE concat('->', p.p_type, '//', p.p_name, '->', c.c_mktsegment) END AS path,
         CASE WHEN l_orderkey % 10 = 0 THEN (CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)
              WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND l_quantity > 30 THEN 1
              WHEN p.p_type = 'PROMO' AND l_discount > 0.055 THEN 1 ELSE 0 END AS converted
  FROM lineitem l
  JOIN orders o ON l_orderkey = o_orderkey
  JOIN customer c ON o_custkey = c_custkey
  JOIN nation n ON c_nationkey = n_nationkey
  JOIN part p ON l_partkey = p_partkey
)"""


def _first_step(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(list_filter(string_split({x}, '->'), lambda s: s <> '')[1], '') END"


def _normalize(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '//', '|'), '/', '|'), '| |', '|'), '||', '|')"


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_extract({_normalize(_first_step(x))}, '{_LAST_PIPE_PAIR}', 1), '^[^a-zA-Z]*', '')"


def _idx_block(columns: dict[str, str], src: str = "fx") -> str:
    """Frequency-descending index per feature, ties alphabetical (0-based, double)."""
    parts = [f"SELECT '{name}' AS feature, {expr} AS value, count(*) AS cnt FROM {src} GROUP BY 1, 2" for name, expr in columns.items()]
    union = "\n    UNION ALL ".join(parts)
    return f"""idx AS MATERIALIZED (
  SELECT feature, value, cnt,
         CAST(row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value) - 1 AS DOUBLE) AS idx
  FROM ({union}) c
)"""


_CATS = {"p_type": "p_type", "priority": "priority", "segment": "segment", "converted": "CAST(converted AS VARCHAR)"}
_IDX = _idx_block(_CATS)
_FXI = """fxi AS (
  SELECT fx.*, pt.idx AS p_type_index, pr.idx AS priority_index, sg.idx AS segment_index, cv.idx AS label
  FROM fx
  JOIN idx pt ON pt.feature = 'p_type' AND pt.value = fx.p_type
  JOIN idx pr ON pr.feature = 'priority' AND pr.value = fx.priority
  JOIN idx sg ON sg.feature = 'segment' AND sg.value = fx.segment
  JOIN idx cv ON cv.feature = 'converted' AND cv.value = CAST(fx.converted AS VARCHAR)
)"""

_DEPTH = 5

#: (vector slot, source column, indexed category?) of the rule queries' tree, in slot order.
_SLOTS = [
    ("quantity", "quantity", False),
    ("discount", "discount", False),
    ("priority_index", "priority", True),
    ("p_type_index", "p_type", True),
    ("segment_index", "segment", True),
]


def _grow(src: str, slots: list[tuple[str, str, bool]], depth: int = _DEPTH, pre: str = "", only: str = "") -> str:
    """CTEs splits (node, feature, col, threshold, nominal), seg (rows of ``src`` with their leaf),
    leaves (node, depth) and conds: the gini tree over ``src``, whose columns hold the slots and the 0/1 label.

    A cut lies halfway between a value of the node and the next value of the whole
    table; ties go to the earlier slot, then to the lower threshold.  ``pre`` goes before the names of the CTEs;
    ``only`` is a query of the slots' numbers that may be split on (all without it).
    """
    among = f" AND f IN ({only})" if only else ""
    long = " UNION ALL ".join(f"SELECT {{n}} AS n, {i} AS f, CAST({c} AS DOUBLE) AS v, label AS y FROM {{t}}" for i, (c, _, _) in enumerate(slots))
    names = ", ".join(f"({i}, '{c}', '{col}', {str(nom).lower()})" for i, (c, col, nom) in enumerate(slots))
    value = "CASE b.f " + " ".join(f"WHEN {i} THEN w.{c}" for i, (c, _, _) in enumerate(slots)) + " END"
    parts = [
        f"{pre}cuts AS MATERIALIZED (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS threshold\n"
        f"  FROM (SELECT DISTINCT f, v FROM ({long.format(n=0, t=src)})))",
        f"{pre}w0 AS MATERIALIZED (SELECT {src}.*, 1 AS n FROM {src})",
    ]
    for k in range(depth):
        parts.append(f"""{pre}b{k} AS MATERIALIZED (
  SELECT n, f, threshold FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY gain DESC, f, threshold) AS rn FROM (
      SELECT n, f, threshold, round(2 * (pt / ct) * (1 - pt / ct) - cl / ct * 2 * (pl / cl) * (1 - pl / cl)
               - (ct - cl) / ct * 2 * ((pt - pl) / (ct - cl)) * (1 - (pt - pl) / (ct - cl)), 12) AS gain
      FROM (
        SELECT h.n, h.f, c.threshold,
               sum(h.c) OVER (PARTITION BY h.n, h.f ORDER BY h.v) AS cl, sum(h.p) OVER (PARTITION BY h.n, h.f ORDER BY h.v) AS pl,
               sum(h.c) OVER (PARTITION BY h.n, h.f) AS ct, sum(h.p) OVER (PARTITION BY h.n, h.f) AS pt
        FROM (SELECT n, f, v, CAST(count(*) AS DOUBLE) AS c, CAST(sum(y) AS DOUBLE) AS p
              FROM ({long.format(n='n', t=f'{pre}w{k}')}) WHERE n >= {2**k}{among} GROUP BY n, f, v) h
        JOIN {pre}cuts c ON c.f = h.f AND c.v = h.v
      ) WHERE cl < ct
    ) WHERE gain > 0
  ) WHERE rn = 1
)""")
        parts.append(
            f"{pre}w{k + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (n), CASE WHEN b.n IS NULL THEN w.n WHEN {value} <= b.threshold "
            f"THEN 2 * w.n ELSE 2 * w.n + 1 END AS n FROM {pre}w{k} w LEFT JOIN {pre}b{k} b ON b.n = w.n)"
        )
    union = " UNION ALL ".join(f"SELECT * FROM {pre}b{k}" for k in range(depth))
    levels = ", ".join(f"({k})" for k in range(1, depth + 1))
    parts.append(f"""{pre}slots(f, feature, col, nominal) AS (VALUES {names}),
{pre}splits AS MATERIALIZED (
  SELECT b.n AS node, s.f, s.feature, s.col, b.threshold, s.nominal FROM ({union}) b JOIN {pre}slots s ON s.f = b.f),
{pre}seg AS MATERIALIZED (SELECT w.* EXCLUDE (n), n AS leaf FROM {pre}w{depth} w),
{pre}leaves AS MATERIALIZED (SELECT DISTINCT leaf AS node, CAST(floor(log2(leaf)) AS INTEGER) AS depth FROM {pre}seg),
{pre}levels(level) AS (VALUES {levels}),
{pre}conds AS MATERIALIZED (
  SELECT l.node, l.depth, v.level, s.feature, s.col, s.threshold, s.nominal,
         CASE WHEN (l.node >> (l.depth - v.level)) % 2 = 0 THEN '<=' ELSE '>' END AS op
  FROM {pre}leaves l JOIN {pre}levels v ON v.level <= l.depth JOIN {pre}splits s ON s.node = l.node >> (l.depth - v.level + 1)
)""")
    return ",\n".join(parts)


def _pruned(pre: str = "", depth: int = _DEPTH) -> str:
    """CTEs pstat (node, c, p: rows and share of label 1 of every node), gone (inner nodes whose two children are leaves of one
    class, from the bottom up, which a classification tree makes leaves), kept (splits that stay, with their gain) and
    imp (f, w: gain times count by slot) of the tree that ``_grow`` left."""
    parts = [f"""{pre}pstat AS MATERIALIZED (
  SELECT leaf >> k AS node, CAST(count(*) AS DOUBLE) AS c, avg(label) AS p FROM {pre}seg, range(0, {depth + 1}) t(k) WHERE leaf >> k > 0 GROUP BY 1),
{pre}x{depth} AS (SELECT 0 AS node WHERE false)"""]
    for k in range(depth - 1, -1, -1):  # a child is a leaf if it is not split, or gone on the level below
        alive = f"(SELECT node FROM {pre}splits WHERE node NOT IN (SELECT node FROM {pre}x{k + 1}))"
        parts.append(f"""{pre}x{k} AS MATERIALIZED (
  SELECT node FROM {pre}x{k + 1} UNION ALL
  SELECT s.node FROM {pre}splits s JOIN {pre}pstat l ON l.node = 2 * s.node JOIN {pre}pstat r ON r.node = 2 * s.node + 1
  WHERE s.node >= {2**k} AND s.node < {2 ** (k + 1)} AND 2 * s.node NOT IN {alive} AND 2 * s.node + 1 NOT IN {alive} AND (l.p > 0.5) = (r.p > 0.5))""")
    parts.append(f"""{pre}kept AS MATERIALIZED (
  SELECT s.*, t.c, 2 * t.p * (1 - t.p) - l.c / t.c * 2 * l.p * (1 - l.p) - r.c / t.c * 2 * r.p * (1 - r.p) AS gain
  FROM {pre}splits s JOIN {pre}pstat t ON t.node = s.node JOIN {pre}pstat l ON l.node = 2 * s.node JOIN {pre}pstat r ON r.node = 2 * s.node + 1
  WHERE s.node NOT IN (SELECT node FROM {pre}x0)),
{pre}imp AS MATERIALIZED (
  SELECT s.f, s.feature, s.col, coalesce(sum(k.gain * k.c), 0) AS w, count(k.node) AS splits FROM {pre}slots s LEFT JOIN {pre}kept k ON k.f = s.f GROUP BY s.f, s.feature, s.col)""")
    return ",\n".join(parts)


_CONDS = """ctext AS (
  SELECT c.*,
    CASE WHEN c.nominal THEN upper(c.col) || ' : ["' || coalesce((SELECT string_agg(i.value, '","' ORDER BY i.idx) FROM idx i
             WHERE i.feature = c.col AND CASE WHEN c.op = '<=' THEN i.idx <= c.threshold ELSE i.idx > c.threshold END), '') || '"]'
         ELSE upper(c.col) || ' ' || c.op || ' ' || CAST(c.threshold AS VARCHAR) END AS ptxt,
    CASE WHEN c.nominal THEN '(' || c.col || ' in (' || coalesce((SELECT string_agg(i.value, ',' ORDER BY i.idx) FROM idx i
             WHERE i.feature = c.col AND CASE WHEN c.op = '<=' THEN i.idx <= c.threshold ELSE i.idx > c.threshold END), '') || '))'
         ELSE '(' || c.col || ' ' || c.op || ' ' || CAST(c.threshold AS VARCHAR) || ')' END AS stxt,
    CASE WHEN c.nominal THEN '(`' || c.col || '` in (' || coalesce((SELECT string_agg(
                 '''' || replace(replace(i.value, '\\', '\\\\'), '''', '\\''') || '''', ', ' ORDER BY i.idx) FROM idx i
             WHERE i.feature = c.col AND CASE WHEN c.op = '<=' THEN i.idx <= c.threshold ELSE i.idx > c.threshold END), '') || '))'
         ELSE '(`' || c.col || '` ' || c.op || ' ' || CAST(c.threshold AS VARCHAR) || ')' END AS wtxt
  FROM conds c
),
rules AS (SELECT node, string_agg(ptxt, '  &&  ' ORDER BY level DESC) AS rules FROM ctext GROUP BY node),
lstat AS (SELECT leaf AS node, count(*) AS coverage, avg(label) AS p FROM seg GROUP BY leaf),
tot AS (SELECT count(*) AS total FROM fx)"""

_TREE = f"WITH {_FX},\n{_IDX},\n{_FXI},\n{_grow('fxi', _SLOTS)},\n{_CONDS}\n"


def _pred(p: str = "p") -> str:
    return f"CAST(CASE WHEN {p} > 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE)"


def _prob(p: str = "p") -> str:
    return f"round(greatest({p}, 1 - {p}), 6)"


def _freq(cov: str, total: str) -> str:
    return f"round(CAST({cov} AS DOUBLE) * 100.0 / {total}, 6)"


def _freq_pct(cov: str, total: str) -> str:
    return f"CAST(({cov} * 100) // {total} AS BIGINT)"


_SPLIT_BEST = f"""WITH {_FX},
{_IDX},
{_FXI},
long AS (
  SELECT 'quantity' AS feature, quantity AS value, converted AS y FROM fxi
  UNION ALL SELECT 'discount', discount, converted FROM fxi
  UNION ALL SELECT 'priority_index', priority_index, converted FROM fxi
  UNION ALL SELECT 'p_type_index', p_type_index, converted FROM fxi
  UNION ALL SELECT 'segment_index', segment_index, converted FROM fxi
),
hist AS (SELECT feature, value, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM long GROUP BY 1, 2),
cum AS (
  SELECT feature, (value + lead(value) OVER w) / 2 AS threshold,
         sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nl,
         sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pl,
         sum(n) OVER (PARTITION BY feature) AS nt,
         sum(pos) OVER (PARTITION BY feature) AS pt
  FROM hist WINDOW w AS (PARTITION BY feature ORDER BY value)
),
scored AS (
  SELECT feature, threshold,
         2.0 * (pt / nt) * (1 - pt / nt)
         - nl / nt * (2.0 * (pl / nl) * (1 - pl / nl))
         - (nt - nl) / nt * (2.0 * ((pt - pl) / (nt - nl)) * (1 - (pt - pl) / (nt - nl))) AS gain,
         nl, nt - nl AS nr
  FROM cum WHERE threshold IS NOT NULL
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) AS rn FROM scored)
  WHERE rn = 1
)
"""

_REDUCE_TOP = """SELECT value, true AS kept FROM (
    SELECT {expr} AS value, count({expr}) AS c FROM {src} GROUP BY 1
  ) ORDER BY c DESC, value DESC NULLS LAST LIMIT {n}"""


def _reduced(col: str, top: str) -> str:
    return f"CASE WHEN {top}.kept IS NULL THEN 'Other' WHEN {col} = '' THEN 'Unknown' ELSE {col} END"


_SEGMENT_CATS = ["priority", "p_type", "segment", "nation", "p_brand", "first_hit_pagename", "post_prop11_concat"]
_SEGMENT_NUMS = ["quantity", "discount"]
#: The categories in the order of the funnel view's columns, which is the slots' order.
_SEGMENT_ORDER = ["p_type", "p_brand", "segment", "nation", "priority", "first_hit_pagename", "post_prop11_concat"]
def _segment_report_sql(top: int | None = None) -> str:
    """With ``top`` the tree is grown on the features with the greatest importances of an unrestricted classification tree."""
    label = ""
    joins = "\n".join(
        f"JOIN idx i_{c} ON i_{c}.feature = '{c}' AND i_{c}.value = red.{c}" for c in _SEGMENT_CATS
    )
    idx_cols = ", ".join(f"i_{c}.idx AS {c}_i" for c in _SEGMENT_CATS)
    slots = [(c, c, False) for c in _SEGMENT_NUMS] + [(f"{c}_i", c, True) for c in _SEGMENT_ORDER]
    grown = _grow("r", slots)
    if top:
        ranked = f"SELECT f FROM (SELECT f, row_number() OVER (ORDER BY w DESC, col) AS k FROM i_imp) WHERE k <= {top}"
        grown = f"{_grow('r', slots, pre='i_')},\n{_pruned('i_')},\n{_grow('r', slots, only=ranked)}"
        label = ", CASE WHEN s.p > 0.5 THEN '1.0' ELSE '0.0' END AS predicted_label"
    return f"""WITH {_FX},
base AS (
  SELECT p_type, p_brand, segment, nation, priority, quantity, discount,
         regexp_extract(first_page, '{_PAGE_NAME_TAIL}', 1) AS fh, {_clean('path')} AS pp,
         CAST(converted AS DOUBLE) AS y
  FROM fx
),
t1 AS ({_REDUCE_TOP.format(expr='fh', src='base', n=15)}),
t2 AS ({_REDUCE_TOP.format(expr='pp', src='base', n=25)}),
red AS (
  SELECT b.*, {_reduced('b.fh', 't1')} AS first_hit_pagename, {_reduced('b.pp', 't2')} AS post_prop11_concat
  FROM base b LEFT JOIN t1 ON b.fh IS NOT DISTINCT FROM t1.value LEFT JOIN t2 ON b.pp IS NOT DISTINCT FROM t2.value
),
{_idx_block({c: c for c in _SEGMENT_CATS}, src="red")},
r AS (SELECT red.*, red.y AS label, {idx_cols} FROM red
{joins}),
{grown},
ctext AS (
  SELECT c.*,
    CASE WHEN c.nominal THEN upper(c.col) || ' : ["' || coalesce((SELECT string_agg(i.value, '","' ORDER BY i.idx) FROM idx i
             WHERE i.feature = c.col AND CASE WHEN c.op = '<=' THEN i.idx <= c.threshold ELSE i.idx > c.threshold END), '') || '"]'
         ELSE upper(c.col) || ' ' || c.op || ' ' || CAST(c.threshold AS VARCHAR) END AS ptxt
  FROM conds c
),
rules AS (SELECT node, string_agg(ptxt, '  &&  ' ORDER BY level DESC) AS rules FROM ctext GROUP BY node),
lstat AS (SELECT leaf AS node, count(*) AS coverage, avg(y) AS p FROM seg GROUP BY leaf),
tot AS (SELECT count(*) AS total FROM red)
SELECT CAST(s.node AS INTEGER) AS node, {_pred('s.p')} AS prediction, {_prob('s.p')} AS probability, r.rules,
       CAST(s.coverage AS BIGINT) AS coverage, {_freq('s.coverage', 't.total')} AS frequency,
       {_freq_pct('s.coverage', 't.total')} AS frequency_pct{label}
FROM lstat s JOIN rules r ON r.node = s.node, tot t
"""


_CATEGORICAL_FEATURES = ["quantity", "discount", "priority", "p_type", "segment", "nation"]


def _categorical_rules_sql() -> str:
    feats = _CATEGORICAL_FEATURES
    joins = "\n".join(f"JOIN idx i_{c} ON i_{c}.feature = '{c}' AND i_{c}.value = CAST(fx.{c} AS VARCHAR)" for c in feats)
    idx_cols = ", ".join(f"i_{c}.idx AS {c}_i" for c in feats)
    unpivot = "\n    UNION ALL ".join(f"SELECT rid, '{c}' AS col, {c}_i AS idx FROM seg" for c in feats)
    slots = [(f"{c}_i", c, True) for c in feats]
    side = "CASE WHEN {a}.op = '<=' THEN {b}.idx <= {a}.threshold ELSE {b}.idx > {a}.threshold END"
    return f"""WITH {_FX},
{_idx_block({c: f"CAST({c} AS VARCHAR)" for c in feats})},
r AS MATERIALIZED (SELECT row_number() OVER () AS rid, fx.converted AS label, {idx_cols} FROM fx
{joins}),
{_grow('r', slots)},
merged AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, col ORDER BY level DESC) AS k FROM conds WHERE level < depth) WHERE k = 1
),
ctext AS (
  SELECT m.*, '(' || m.col || ' in (' || coalesce((SELECT string_agg(i.value, ',' ORDER BY i.idx) FROM idx i
           WHERE i.feature = m.col AND {side.format(a='m', b='i')}), '') || '))' AS txt
  FROM merged m
),
rules AS MATERIALIZED (SELECT node, string_agg(txt, ' and ' ORDER BY level) AS rules, count(*) AS n_conds FROM ctext GROUP BY node),
long AS MATERIALIZED (
    {unpivot}
),
sat AS MATERIALIZED (
  SELECT m.node, m.col, i.idx FROM merged m JOIN idx i ON i.feature = m.col WHERE {side.format(a='m', b='i')}
),
hits AS MATERIALIZED (
  SELECT s.node, l.rid, count(*) AS met FROM long l JOIN sat s ON s.col = l.col AND s.idx = l.idx GROUP BY s.node, l.rid
),
cov AS (SELECT h.node, count(*) AS coverage FROM hits h JOIN rules q ON q.node = h.node AND q.n_conds = h.met GROUP BY h.node),
lstat AS (SELECT leaf AS node, avg(label) AS p FROM seg GROUP BY leaf),
tot AS (SELECT count(*) AS total FROM fx)
SELECT CAST(q.node AS INTEGER) AS node, {_pred('s.p')} AS prediction, {_prob('s.p')} AS probability, q.rules,
       CAST(coalesce(c.coverage, 0) AS BIGINT) AS coverage, {_freq('coalesce(c.coverage, 0)', 't.total')} AS frequency,
       {_freq_pct('coalesce(c.coverage, 0)', 't.total')} AS frequency_pct
FROM rules q JOIN lstat s ON s.node = q.node LEFT JOIN cov c ON c.node = q.node, tot t
"""


_EXACT_CATS = {"priority": "priority", "p_type": "p_type", "segment": "segment", "nation": "nation", "p_brand": "p_brand"}
_EXACT_SLOTS = [("quantity", "quantity", False), ("discount", "discount", False)] + [(f"{c}_index", c, True) for c in _EXACT_CATS]
_EXACT = f"""WITH {_FX},
{_idx_block(_EXACT_CATS)},
r AS (SELECT quantity, discount, converted AS label, {', '.join(f"i_{c}.idx AS {c}_index" for c in _EXACT_CATS)} FROM fx
{' '.join(f"JOIN idx i_{c} ON i_{c}.feature = '{c}' AND i_{c}.value = fx.{c}" for c in _EXACT_CATS)}),
{_grow('r', _EXACT_SLOTS)},
{_pruned()}
"""


def _score_saved_sql() -> str:
    """The tree of the rule queries, walked by rows of which one category is new: it takes the number after the last."""
    value = "CASE b.feature " + " ".join(f"WHEN '{c}' THEN w.{c}" for c, _, _ in _SLOTS) + " END"
    walk = ",\n".join(
        f"v{k + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (pos), CASE WHEN b.node IS NULL THEN pos WHEN {value} <= b.threshold THEN 2 * pos ELSE 2 * pos + 1 END AS pos "
        f"FROM v{k} w LEFT JOIN splits b ON b.node = w.pos)"
        for k in range(_DEPTH)
    )
    return f"""{_TREE}, v0 AS (
  SELECT * EXCLUDE (priority_index), 1 AS pos,
    CASE WHEN l_linenumber = 7 THEN (SELECT count(*) FROM idx WHERE feature = 'priority') ELSE priority_index END AS priority_index FROM fxi),
{walk}
SELECT l_orderkey, l_linenumber, CAST(pos AS INTEGER) AS node, {_pred('s.p')} AS prediction, CASE WHEN s.p > 0.5 THEN '1' ELSE '0' END AS predicted_label,
       {_prob('s.p')} AS probability
FROM v{_DEPTH} JOIN lstat s ON s.node = pos
"""


ORACLE_SQL: dict[str, str] = {
    "catalog_scan": """
SELECT o_orderkey, o_orderpriority, 'text' AS part FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment LIKE '%MACHIN%' AND o_custkey <> 0 AND o_totalprice > 1000 AND o_orderkey IS NOT NULL AND o_orderpriority IS NOT NULL
UNION ALL
SELECT o_orderkey, o_orderpriority, 'name' FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderkey IS NOT NULL AND o_orderpriority IS NOT NULL
""",
    "interval_values": _TREE
    + """, cuts2 AS (SELECT DISTINCT col AS feature, threshold FROM splits WHERE nominal),
placed AS (
  SELECT i.feature, i.value, i.idx, (SELECT count(*) FROM cuts2 c WHERE c.feature = i.feature AND c.threshold < i.idx) AS k
  FROM idx i WHERE i.feature IN (SELECT feature FROM cuts2))
SELECT feature, k AS interval, string_agg(value, ',' ORDER BY idx) AS value_list FROM placed GROUP BY feature, k
""",
    "importance_exact": _EXACT
    + "SELECT col AS feature_name, round(w / (SELECT sum(w) FROM imp), 6) AS importance, splits FROM imp\n",
    "ensemble_nodes": _EXACT
    + """, alive AS (SELECT node FROM pstat WHERE node = 1 OR node >> 1 IN (SELECT node FROM kept))
SELECT CAST(t.node AS INTEGER) AS node, k.node IS NULL AS is_leaf, CAST(CASE WHEN t.p > 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS prediction,
       round(2 * t.p * (1 - t.p), 6) AS impurity, round(k.gain, 6) AS gain, k.feature AS feature_name, k.threshold,
       CAST(t.c AS BIGINT) AS count, CAST(t.c AS BIGINT) AS rows
FROM alive a JOIN pstat t ON t.node = a.node LEFT JOIN kept k ON k.node = t.node
""",
    "score_saved": _score_saved_sql(),
    "scan_filter_cast": """
SELECT o_orderkey, o_totalprice, priority_level FROM (
  SELECT o_orderkey, o_totalprice, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS priority_level
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_custkey <> 0 AND c_mktsegment LIKE '%MACHIN%'
) WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)
    AND priority_level IS NOT NULL AND NOT isnan(priority_level)
""",
    "project_columns": """
SELECT "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag" FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL
  AND NOT isnan(l_quantity) AND l_returnflag IS NOT NULL
""",
    "csv_source": "SELECT * FROM part",
    "replace_table_sink": "SELECT * FROM nation",
    "drop_nulls": """
SELECT event_id, user_id, event_type, value, props FROM (
  SELECT event_id, user_id, nullif(event_type, 'error') AS event_type,
         CASE WHEN value > 50 THEN NULL ELSE value END AS value, props
  FROM events
) WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
    AND value IS NOT NULL AND NOT isnan(value) AND props IS NOT NULL
""",
    "rule_filter": f"""WITH {_FX}
SELECT l_orderkey, l_linenumber, p_type, quantity, discount FROM fx
WHERE p_type IN ('PROMO', 'SMALL') AND quantity > 30.5 AND discount <= 0.055
""",
    "first_path_step": f"""WITH {_FX}
SELECT l_orderkey, l_linenumber, path, {_first_step('path')} AS first_step FROM fx
""",
    "normalize_path": f"""WITH {_FX}
SELECT l_orderkey, l_linenumber, path, {_normalize(_first_step('path'))} AS normalized FROM fx
""",
    "last_pipe_pair": f"""WITH {_FX}
SELECT l_orderkey, l_linenumber, first_page, regexp_extract(first_page, '{_LAST_PIPE_PAIR}', 1) AS pair FROM fx
""",
    "page_name_tail": f"""WITH {_FX}
SELECT l_orderkey, l_linenumber, first_page, regexp_extract(first_page, '{_PAGE_NAME_TAIL}', 1) AS tail FROM fx
""",
    "clean_path_column": f"""
SELECT page_id, url, {_clean('url')} AS cleaned FROM pages
""",
    "value_counts_window": f"""WITH {_FX}
SELECT l_orderkey, l_linenumber, first_page AS value, count(first_page) OVER (PARTITION BY first_page) AS count FROM fx
""",
    "value_rank": f"""WITH {_FX}
SELECT first_page AS value, count(first_page) AS count,
       row_number() OVER (ORDER BY count(first_page) DESC, first_page DESC NULLS LAST) AS rank
FROM fx GROUP BY first_page
""",
    "reduce_topn": f"""WITH {_FX},
top AS ({_REDUCE_TOP.format(expr='first_page', src='fx', n=15)})
SELECT l_orderkey, l_linenumber, {_reduced('fx.first_page', 'top')} AS first_page
FROM fx LEFT JOIN top ON fx.first_page IS NOT DISTINCT FROM top.value
""",
    "reduce_topn_multi": f"""WITH {_FX},
cl AS (SELECT l_orderkey, l_linenumber, first_page, {_clean('path')} AS path FROM fx),
t1 AS ({_REDUCE_TOP.format(expr='first_page', src='cl', n=15)}),
t2 AS ({_REDUCE_TOP.format(expr='path', src='cl', n=25)})
SELECT l_orderkey, l_linenumber, {_reduced('cl.first_page', 't1')} AS first_page, {_reduced('cl.path', 't2')} AS path
FROM cl LEFT JOIN t1 ON cl.first_page IS NOT DISTINCT FROM t1.value
        LEFT JOIN t2 ON cl.path IS NOT DISTINCT FROM t2.value
""",
    "category_index": f"""WITH {_FX},
{_IDX}
SELECT feature, value, cnt AS count, idx FROM idx WHERE feature IN ('p_type', 'priority', 'segment')
""",
    "category_lookup": f"""WITH {_FX},
{_IDX}
SELECT feature, value, idx FROM idx WHERE feature IN ('p_type', 'priority', 'segment')
""",
    "category_condition": f"""WITH {_FX},
{_IDX},
cats AS (SELECT * FROM idx WHERE feature IN ('p_type', 'priority', 'segment')),
cuts AS (SELECT * FROM cats i WHERE idx < (SELECT max(idx) FROM cats k WHERE k.feature = i.feature))
SELECT feature, idx + 0.5 AS threshold, '<=' AS op,
       (SELECT string_agg('"' || j.value || '"', ',' ORDER BY j.idx) FROM cats j WHERE j.feature = c.feature AND j.idx <= c.idx) AS value_list
FROM cuts c
UNION ALL
SELECT feature, idx + 0.5 AS threshold, '>' AS op,
       (SELECT string_agg('"' || j.value || '"', ',' ORDER BY j.idx) FROM cats j WHERE j.feature = c.feature AND j.idx > c.idx) AS value_list
FROM cuts c
""",
    "feature_matrix": f"""WITH {_FX},
{_IDX},
{_FXI}
SELECT l_orderkey, l_linenumber, quantity, discount, priority_index, p_type_index, segment_index, label FROM fxi
""",
    "feature_matrix_categorical": f"""WITH {_FX},
{_idx_block({
    "quantity": "CAST(quantity AS VARCHAR)",
    "discount": "CAST(discount AS VARCHAR)",
    "priority": "priority",
    "p_type": "p_type",
    "segment": "segment",
    "converted": "CAST(converted AS VARCHAR)",
})}
SELECT l_orderkey, l_linenumber, q.idx AS quantity_index, d.idx AS discount_index, pr.idx AS priority_index,
       pt.idx AS p_type_index, sg.idx AS segment_index, cv.idx AS label
FROM fx
JOIN idx q ON q.feature = 'quantity' AND q.value = CAST(fx.quantity AS VARCHAR)
JOIN idx d ON d.feature = 'discount' AND d.value = CAST(fx.discount AS VARCHAR)
JOIN idx pr ON pr.feature = 'priority' AND pr.value = fx.priority
JOIN idx pt ON pt.feature = 'p_type' AND pt.value = fx.p_type
JOIN idx sg ON sg.feature = 'segment' AND sg.value = fx.segment
JOIN idx cv ON cv.feature = 'converted' AND cv.value = CAST(fx.converted AS VARCHAR)
""",
    "categorical_slots": f"""WITH {_FX},
d AS (
  SELECT 'quantity' AS feature, count(DISTINCT quantity) AS n_distinct FROM fx
  UNION ALL SELECT 'discount', count(DISTINCT discount) FROM fx
  UNION ALL SELECT 'priority_index', count(DISTINCT priority) FROM fx
  UNION ALL SELECT 'p_type_index', count(DISTINCT p_type) FROM fx
  UNION ALL SELECT 'segment_index', count(DISTINCT segment) FROM fx
)
SELECT feature, n_distinct, n_distinct <= 10 AS is_categorical FROM d
""",
    "split_search": _SPLIT_BEST.replace("\n),\nhist AS", "\n  UNION ALL SELECT 'l_orderkey', l_orderkey, converted FROM fxi\n),\nhist AS", 1)
    + """SELECT feature, threshold, round(gain, 6) AS gain, CAST(nl AS BIGINT) AS left_count, CAST(nr AS BIGINT) AS right_count
FROM best
""",
    "select_top_features": _SPLIT_BEST
    + """, ranked AS (
  SELECT feature AS feature_name, CAST(row_number() OVER (ORDER BY round(gain, 6) DESC, feature) AS INTEGER) AS position FROM best
)
SELECT feature_name, position FROM ranked WHERE position <= 3
UNION ALL SELECT 'converted', CAST(4 AS INTEGER)
""",
    "train_test_split": f"""WITH {_FX},
placed AS (
  SELECT CAST('0x' || substr(md5(concat_ws(chr(1), '11', l_orderkey, l_linenumber, converted)), 1, 8) AS BIGINT) / 4294967296.0 AS place FROM fx
)
SELECT CASE WHEN place < 0.6 THEN 'train' ELSE 'test' END AS part, count(*) AS rows FROM placed GROUP BY 1
""",
    "tree_nodes": _TREE
    + f""", anc AS (SELECT leaf >> k AS node, label FROM seg, range(0, {_DEPTH + 1}) t(k) WHERE leaf >> k > 0),
nstat AS (SELECT node, avg(label) AS p FROM anc GROUP BY node)
SELECT CAST(n.node AS INTEGER) AS node, s.node IS NULL AS is_leaf, {_pred()} AS prediction, {_prob()} AS probability,
       round(2 * p * (1 - p), 6) AS impurity, s.feature AS feature_name, s.threshold AS threshold
FROM nstat n LEFT JOIN splits s ON s.node = n.node
""",
    "leaf_paths": _TREE
    + """SELECT CAST(node AS INTEGER) AS node,
       string_agg(feature || ' ' || op || ' ' || CAST(threshold AS VARCHAR), ' ; ' ORDER BY level) AS path
FROM conds GROUP BY node
""",
    "leaf_paths_parent": _TREE
    + """, scoped AS (
  SELECT 'parent' AS scope, * FROM conds WHERE level < depth
  UNION ALL SELECT 'leaf' AS scope, * FROM conds
),
merged AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, node, feature ORDER BY level DESC) AS rn FROM scoped)
  WHERE rn = 1
)
SELECT scope, CAST(node AS INTEGER) AS node,
       string_agg(feature || ' ' || op || ' ' || CAST(threshold AS VARCHAR), ' ; ' ORDER BY level) AS path
FROM merged GROUP BY scope, node
""",
    "rule_text": _TREE
    + """SELECT CAST(node AS INTEGER) AS node, 'print' AS style, rules FROM rules
UNION ALL
SELECT CAST(node AS INTEGER), 'sql', string_agg(stxt, ' and ' ORDER BY level) FROM ctext GROUP BY node
UNION ALL
SELECT CAST(node AS INTEGER), 'html', string_agg(replace(stxt, '(p_type in', '(product_type in'), ' <br> ' ORDER BY level)
FROM ctext GROUP BY node
UNION ALL
SELECT CAST(node AS INTEGER), 'where', string_agg(wtxt, ' and ' ORDER BY level) FROM ctext GROUP BY node
""",
    "rule_coverage": _TREE
    + f"""SELECT 'full' AS scope, CAST(s.node AS INTEGER) AS node, CAST(s.coverage AS BIGINT) AS coverage,
       {_freq('s.coverage', 't.total')} AS frequency, {_freq_pct('s.coverage', 't.total')} AS frequency_pct
FROM lstat s, tot t
UNION ALL
SELECT 'parent', CAST(l.node AS INTEGER), CAST(pc.coverage AS BIGINT),
       {_freq('pc.coverage', 't.total')}, {_freq_pct('pc.coverage', 't.total')}
FROM leaves l JOIN (SELECT leaf >> k AS node, count(*) AS coverage FROM seg, range(1, {_DEPTH + 1}) t(k) GROUP BY 1) pc
     ON pc.node = l.node >> 1, tot t
WHERE l.depth > 1
""",
    "leaf_stats": _TREE
    + f"""SELECT CAST(node AS INTEGER) AS node, {_pred()} AS prediction, {_prob()} AS probability,
       round(2 * p * (1 - p), 6) AS impurity, CAST(coverage AS BIGINT) AS coverage
FROM lstat
""",
    "node_rule_join": _TREE
    + f"""SELECT CAST(s.node AS INTEGER) AS node, {_pred('s.p')} AS prediction, {_prob('s.p')} AS probability, r.rules
FROM lstat s JOIN rules r ON r.node = s.node
""",
    "score_rows": _TREE
    + f"""SELECT g.l_orderkey, g.l_linenumber, {_pred('s.p')} AS prediction, {_prob('s.p')} AS probability
FROM seg g JOIN lstat s ON s.node = g.leaf
""",
    "rule_report": _TREE
    + f"""SELECT CAST(s.node AS INTEGER) AS node, {_pred('s.p')} AS prediction, {_prob('s.p')} AS probability, r.rules,
       CAST(s.coverage AS BIGINT) AS coverage, {_freq('s.coverage', 't.total')} AS frequency,
       {_freq_pct('s.coverage', 't.total')} AS frequency_pct
FROM lstat s JOIN rules r ON r.node = s.node, tot t
""",
    "segment_report": _segment_report_sql(),
    "segment_report_selected": _segment_report_sql(top=3),
    "rule_report_all_categorical": _categorical_rules_sql(),
    "rules_degenerate": """
SELECT * FROM (VALUES ('single_leaf', CAST(0 AS BIGINT)), ('depth1_min4', CAST(0 AS BIGINT)), ('depth1_min2', CAST(2 AS BIGINT)))
  AS t(scenario, report_rows)
""",
}
