"""Queries of the core's data problems (numbers 4 to 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import hierarchy, nested, snapshots


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = hierarchy.hierarchy(_t(spark, sf, "dependency"), "dep_id", "scan_id", "name", "parent")
    return rows.where("has_parent").select(F.col("row_id").alias("dep_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"))


def p4_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every dependency row with its node, root, depth and full path of nodes from the root."""
    rows = hierarchy.hierarchy(_t(spark, sf, "dependency"), "dep_id", "scan_id", "name", "parent", with_path=True)
    path = F.when(F.col("depth") < 0, F.lit("cycle")).otherwise(F.concat_ws("/", F.col("root"), F.reverse("chain")))
    return rows.select(F.col("row_id").alias("dep_id"), "node", "root", "depth", path.alias("path"))


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every ancestor with each of its descendants and the number of links between them."""
    links = hierarchy.link_nodes(_t(spark, sf, "dependency"), "dep_id", "scan_id", "name", "parent")
    _, solved = hierarchy.resolve_links(links, with_path=True)
    return hierarchy.descendants(solved)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flat_positions(_t(spark, sf, "package_analysis"), _t(spark, sf, "report_document"))


def p5_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct object once, with its Merkle identity and content."""
    a, b = nested.usage_forest(_t(spark, sf, "package_analysis")), nested.report_forest(_t(spark, sf, "report_document"))
    return a.nodes.unionByName(b.nodes)


def p5_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """The members of each distinct object with their ordinals."""
    a, b = nested.usage_forest(_t(spark, sf, "package_analysis")), nested.report_forest(_t(spark, sf, "report_document"))
    return a.bridges.unionByName(b.bridges)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.package_list_changes(_t(spark, sf, "kb_snapshot"))


QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p5_found, p5_nodes, p5_bridges, p6_found)}

_CLEAN6 = """
WITH s AS (
  SELECT row_id, db_version, try_cast(updated_at AS TIMESTAMPTZ) AS at_,
         lower(regexp_replace(coalesce(ecosystem,''), '^\\s+|\\s+$', '', 'g')) AS eco,
         lower(regexp_replace(coalesce(package,''), '^\\s+|\\s+$', '', 'g')) AS pkg,
         concat_ws(chr(30), trim(coalesce(pkg_version,'')), trim(coalesce(license,'')),
           coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(algorithms, lambda x: trim(x)), lambda x: x <> ''))), chr(31)), ''),
           coalesce(n_vulnerable::VARCHAR,''), coalesce(n_partial::VARCHAR,''), coalesce(n_safe::VARCHAR,''), coalesce(n_unknown::VARCHAR,'')) AS body
  FROM kb_snapshot),
l AS (SELECT db_version, eco, pkg, arg_max(body, row_id) AS body FROM s GROUP BY 1,2,3),
v AS (SELECT db_version, row_number() OVER (ORDER BY min(at_), db_version) AS n FROM s GROUP BY 1),
k AS (SELECT v.n, l.* FROM l JOIN v USING (db_version)),
j AS (SELECT coalesce(a.n, b.n - 1) AS n, coalesce(a.eco, b.eco) AS eco, coalesce(a.pkg, b.pkg) AS pkg, a.body AS x, b.body AS y
      FROM (SELECT * FROM k WHERE n < (SELECT max(n) FROM v)) a
      FULL OUTER JOIN (SELECT * FROM k WHERE n > 1) b ON a.n = b.n - 1 AND a.eco = b.eco AND a.pkg = b.pkg)
SELECT f.db_version AS from_version, t.db_version AS to_version, j.eco AS ecosystem, j.pkg AS package,
       CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM j JOIN v f ON f.n = j.n JOIN v t ON t.n = j.n + 1
WHERE x IS NULL OR y IS NULL OR x <> y
"""

_P4 = """
WITH RECURSIVE r AS (SELECT dep_id, scan_id, lower(trim(name, ' ')) AS k, CASE WHEN trim(parent) <> '' THEN lower(trim(parent, ' ')) END AS p FROM dependency),
n AS (SELECT scan_id, k, min(dep_id) AS id, arg_min(coalesce(p, ''), dep_id) AS p FROM r GROUP BY 1, 2),
e AS (SELECT n.scan_id, n.k, n.id, m.id AS up FROM n LEFT JOIN n m ON m.scan_id = n.scan_id AND m.k = n.p AND n.p <> ''),
t AS (SELECT id, id AS root, 0 AS d FROM e WHERE up IS NULL UNION ALL SELECT e.id, t.root, t.d + 1 FROM e JOIN t ON e.up = t.id),
c AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM t)),
w AS (SELECT id AS start, up AS at_ FROM c UNION SELECT w.start, c.up FROM w JOIN c ON c.id = w.at_),
o AS (SELECT start AS id FROM w WHERE start = at_),
q AS (SELECT w.start AS id, min(w.at_) AS root FROM w JOIN o ON o.id = w.at_ GROUP BY 1),
z AS (SELECT id, root, d FROM t UNION ALL SELECT id, root, -1 FROM q)
SELECT r.dep_id, z.root AS root_id, z.d::BIGINT AS node_depth
FROM r JOIN n ON n.scan_id = r.scan_id AND n.k = r.k JOIN z ON z.id = n.id WHERE r.p IS NOT NULL
"""

_NODES = _P4[: _P4.index("SELECT r.dep_id")]
_P4_PATHS = _NODES.replace("SELECT id, id AS root, 0 AS d FROM e", "SELECT id, id AS root, 0 AS d, id::VARCHAR AS path FROM e").replace("SELECT e.id, t.root, t.d + 1 FROM e", "SELECT e.id, t.root, t.d + 1, t.path || '/' || e.id FROM e").replace("SELECT id, root, d FROM t UNION ALL SELECT id, root, -1 FROM q", "SELECT id, root, d, path FROM t UNION ALL SELECT id, root, -1, 'cycle' FROM q") + """
SELECT r.dep_id, z.id AS node, z.root, z.d::BIGINT AS depth, z.path FROM r JOIN n ON n.scan_id = r.scan_id AND n.k = r.k JOIN z ON z.id = n.id
"""
_P4_PAIRS = _NODES + """, a AS (SELECT e.up AS ancestor, e.id AS node, 1 AS links FROM e JOIN t ON t.id = e.id WHERE e.up IS NOT NULL UNION ALL SELECT e.up, a.node, a.links + 1 FROM a JOIN e ON e.id = a.ancestor WHERE e.up IS NOT NULL)
SELECT ancestor, node, links::BIGINT AS links FROM a
"""

_P5 = r"""
WITH RECURSIVE us AS (SELECT analysis_id AS id, p.i - 1 AS a, crypto[p.i] AS u FROM package_analysis, unnest(range(1, coalesce(len(crypto), 0) + 1)) p(i) WHERE crypto[p.i] IS NOT NULL),
cs AS (SELECT id, a, p.i - 1 AS b FROM us, unnest(range(1, coalesce(len(u.call_path), 0) + 1)) p(i) WHERE u.call_path[p.i] IS NOT NULL),
tr AS (SELECT id, a, p.i - 1 AS b, u.traces[p.i] AS t FROM us, unnest(range(1, coalesce(len(u.traces), 0) + 1)) p(i) WHERE u.traces[p.i] IS NOT NULL),
ts AS (SELECT id, a, b, p.i - 1 AS c FROM tr, unnest(range(1, coalesce(len(t.call_steps), 0) + 1)) p(i) WHERE t.call_steps[p.i] IS NOT NULL),
w AS (SELECT report_id AS id, regexp_replace(payload, '^[\x{FEFF}\s]+|\s+$', '', 'g') AS s FROM report_document WHERE payload IS NOT NULL
 UNION ALL SELECT id, regexp_replace(CASE WHEN json_valid(s) THEN json(s) ->> '$' END, '^[\x{FEFF}\s]+|\s+$', '', 'g') FROM w WHERE starts_with(s, '"')),
d AS (SELECT id, json(s) AS j FROM w WHERE starts_with(s, '{') AND json_valid(s)),
lists AS (SELECT id, list_r, list_c FROM (SELECT id, CASE json_type(j, '$.runs') WHEN 'ARRAY' THEN json_extract(j, '$.runs[*]') ELSE [json_extract(j, '$.runs')] END AS list_r, CASE json_type(j, '$.components') WHEN 'ARRAY' THEN json_extract(j, '$.components[*]') ELSE [json_extract(j, '$.components')] END AS list_c FROM d)),
runs AS (SELECT id, p.i - 1 AS a, list_r[p.i] AS r FROM lists, unnest(range(1, len(list_r) + 1)) p(i) WHERE list_r[p.i] IS NOT NULL AND json_type(list_r[p.i]) <> 'NULL'),
parts AS (SELECT id, a, CASE json_type(r, '$.tool.driver.rules') WHEN 'ARRAY' THEN json_extract(r, '$.tool.driver.rules[*]') ELSE [json_extract(r, '$.tool.driver.rules')] END AS rules,
 CASE json_type(r, '$.results') WHEN 'ARRAY' THEN json_extract(r, '$.results[*]') ELSE [json_extract(r, '$.results')] END AS results FROM runs),
ru AS (SELECT id, a, p.i - 1 AS b FROM parts, unnest(range(1, len(rules) + 1)) p(i) WHERE rules[p.i] IS NOT NULL AND json_type(rules[p.i]) <> 'NULL'),
re AS (SELECT id, a, p.i - 1 AS b, results[p.i] AS r, coalesce(list_position(list_transform(rules, lambda x: x ->> '$.id'), results[p.i] ->> '$.ruleId') - 1, -1) AS place FROM parts, unnest(range(1, len(results) + 1)) p(i) WHERE results[p.i] IS NOT NULL AND json_type(results[p.i]) <> 'NULL'),
lo AS (SELECT id, a, b, CASE json_type(r, '$.locations') WHEN 'ARRAY' THEN json_extract(r, '$.locations[*]') ELSE [json_extract(r, '$.locations')] END AS ls FROM re),
ll AS (SELECT id, a, b, p.i - 1 AS c FROM lo, unnest(range(1, len(ls) + 1)) p(i) WHERE ls[p.i] IS NOT NULL AND json_type(ls[p.i]) <> 'NULL'),
co AS (SELECT id, p.i - 1 AS a, list_c[p.i] AS x FROM lists, unnest(range(1, len(list_c) + 1)) p(i) WHERE list_c[p.i] IS NOT NULL AND json_type(list_c[p.i]) <> 'NULL'),
fl AS (SELECT id, a, CASE json_type(x, '$.cryptoProperties.algorithmProperties.cryptoFunctions') WHEN 'ARRAY' THEN json_extract(x, '$.cryptoProperties.algorithmProperties.cryptoFunctions[*]') ELSE [json_extract(x, '$.cryptoProperties.algorithmProperties.cryptoFunctions')] END AS fs FROM co),
ff AS (SELECT id, a, p.i - 1 AS b FROM fl, unnest(range(1, len(fs) + 1)) p(i) WHERE fs[p.i] IS NOT NULL AND json_type(fs[p.i]) <> 'NULL')
SELECT 'usage' AS kind, id AS record_id, a AS pos1, -1::BIGINT AS pos2, -1::BIGINT AS pos3 FROM us
UNION ALL SELECT 'call_step', id, a, b, -1 FROM cs UNION ALL SELECT 'trace_step', id, a, b, c FROM ts
UNION ALL SELECT 'sarif_rule', id, a, b, -1 FROM ru UNION ALL SELECT 'sarif_result', id, a, b, place FROM re
UNION ALL SELECT 'sarif_location', id, a, b, c FROM ll UNION ALL SELECT 'cbom_function', id, a, b, -1 FROM ff
"""

ORACLE = {"p5_found": _P5, "p6_found": _CLEAN6, "p4_found": _P4, "p4_paths": _P4_PATHS, "p4_descendants": _P4_PAIRS}
