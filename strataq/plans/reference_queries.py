"""Queries of the inventory's own operators over the project's tables.

A scan's dependencies are rows of ``dependency``; the knowledge base is
``package_analysis``, the entry with the greatest id being written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions import detection, dims, text
from strataq.operators import detect, inventory, reachability, reports
from strataq.sources import manifests


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _eco(col: str):
    return F.lower(F.trim(F.col(col)))


def _deps(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "dependency").select("scan_id", "project", "manifest", "scanned_at", F.col("dep_id").alias("dep_seq"), "name", "version", _eco("ecosystem").alias("ecosystem"), F.coalesce("direct", F.lit(False)).alias("direct"))


def _kb(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "package_analysis")
    return a.select(F.col("analysis_id").alias("seq"), _eco("ecosystem").alias("ecosystem"), F.trim("package").alias("package"), F.coalesce(F.trim("version"), F.lit("")).alias("version"), F.col("crypto").alias("usages"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.resolve(_deps(spark, sf), _kb(spark, sf))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.findings(_found(spark, sf), "scan_id", "project", "dep_seq").where("algorithm is not null")


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = inventory.summarise(_found(spark, sf), "scan_id")
    return s.withColumn("exit_code", inventory.exit_code("any")).withColumn("hints", inventory.hints())


def portfolio_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.roll_up(inventory.summarise(_found(spark, sf), "project", "scan_id"), "project")


def scan_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).select("scan_id", "dep_seq", "usage_seq", "label", "algorithm", "quantum_risk", "severity")


def classified_usages(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.classify(_t(spark, sf, "crypto_usage").where("algorithm is not null").select("usage_id", "algorithm"), "algorithm")


def remediation_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The remediation entry of each distinct algorithm name."""
    names = _t(spark, sf, "crypto_usage").where("algorithm is not null").select("algorithm").distinct()
    return names.select("algorithm", text.remediation_key(F.col("algorithm")).alias("remediation"))


#: tables with names of packages and their ecosystems
_NAMED = {"dependency": "name", "package_info": "name", "package_analysis": "package", "crypto_usage": "package", "kb_snapshot": "package", "documents": "package"}


def import_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The first import pattern of each package name of any table; names without
    one are left out. Patterns distinguish capitals, so names keep theirs."""
    out = None
    for table, col in _NAMED.items():
        one = _t(spark, sf, table).select(F.trim(col).alias("path"), _eco("ecosystem").alias("ecosystem")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.distinct().withColumn("pattern", text.import_match(F.col("path"), F.col("ecosystem"))).where("pattern is not null")


def clean_versions(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "dependency").where("version is not null").select("dep_id", "version")
    ranged = F.concat(F.element_at(F.array(*map(F.lit, ("^", "~", ">=", "> ", "", "<="))), (F.col("dep_id") % 6 + 1).cast("int")), "version", F.when(F.col("dep_id") % 4 == 0, " - 9.0").when(F.col("dep_id") % 4 == 1, " || 8.0").otherwise(""))
    return d.select("dep_id", text.npm_version(ranged).alias("npm"), text.go_version(F.concat("version", F.lit(" => ./local"))).alias("go"))


def requirement_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "dependency").where(_eco("ecosystem") == "pypi")
    line = F.concat("name", F.lit("[extra]=="), F.coalesce("version", F.lit("")), F.lit(" ; python_version > '3' # pinned"))
    name, version = text.requirement_line(line)
    return d.select("dep_id", name.alias("req_name"), version.alias("req_version")).where("req_name is not null")


def _go_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Go dependencies with the reason why a go.mod line can't hold them, null
    where it can. Outer blanks don't count; a version gets its v if it has none."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|(?<!\s)\s+$", "")
    d = _t(spark, sf, "dependency").where(_eco("ecosystem") == "go").withColumn("name", bare("name")).withColumn("version", bare("version"))
    why = F.when(F.coalesce("name", F.lit("")) == "", "no name").when(F.coalesce("version", F.lit("")) == "", "no version")
    why = why.when(F.col("name").rlike(r"\s"), "blank in name").when(F.col("version").rlike(r"\s"), "blank in version")
    # comments, ends of blocks and words of the format; what follows => is a replacement
    why = why.when(F.col("name").rlike(r"^(//|\)|require\(|(require|module|go|toolchain)$)") | F.col("version").contains("=>"), "other meaning in go.mod")
    return d.withColumn("reason", why)


def go_mod_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """go.mod texts made of each scan's Go dependencies and read again; what no
    line can hold is in go_mod_left_out."""
    d = _go_lines(spark, sf).where("reason is null")
    line = F.concat(F.lit("\t"), "name", F.lit(" "), F.regexp_replace("version", "^[vV]?", "v"), F.when(~F.coalesce("direct", F.lit(False)), " // indirect").otherwise(""))
    body = d.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("dep_id", line.alias("l")))).alias("a"))
    files = body.select(F.concat(F.col("scan_id"), F.lit("/go.mod")).alias("path"), F.concat(F.lit("module x\n\ngo 1.21\n\nrequire (\n"), F.concat_ws("\n", F.transform("a", lambda x: x["l"])), F.lit("\n)\n")).alias("text"))
    return manifests.go_mod(files).select("path", (F.col("dep_seq") - 5).alias("seq"), "name", "version", "direct")


def go_mod_left_out(spark: SparkSession, sf: str) -> DataFrame:
    """Go dependencies that no go.mod line can hold, and why."""
    return _go_lines(spark, sf).where("reason is not null").select("scan_id", "dep_id", "name", "version", "reason")


def discovered_manifests(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "dependency").select("project", F.col("manifest").alias("path"))
    return manifests.discover(d, "path", "project")


def preferred_manifests(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "dependency").select("project", F.col("manifest").alias("path"))
    return manifests.preferred(manifests.discover(d, "path", "project"), "project")


def crypto_packages(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "package_info")
    return p.where(text.crypto_related(F.col("name"), F.col("description"), F.col("keywords"))).select("info_id", "name")


def package_risk(spark: SparkSession, sf: str) -> DataFrame:
    u = _t(spark, sf, "crypto_usage").withColumn("quantum_risk", F.upper(F.trim("quantum_risk")))
    return inventory.highest_risk(u, "quantum_risk", "package")


def ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each scan by falling risk, ties in their own order."""
    return inventory.ranked(_findings(spark, sf), "scan_id")


def kb_stats(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.kb_stats(_kb(spark, sf))


def kb_risk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.risk_counts(_kb(spark, sf), "seq")


def kb_export_stats(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.export_stats(_kb(spark, sf))


def remediation_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Algorithms to act on in each package and the pass they belong to."""
    u = _t(spark, sf, "crypto_usage").withColumn("quantum_risk", F.upper(F.trim("quantum_risk")))
    return inventory.remediation_list(u, "package").select("package", "algorithm", F.col("pass").alias("pass_no"))


def package_json_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """package.json texts made of each scan's npm dependencies, and read again."""
    d = _t(spark, sf, "dependency").where((_eco("ecosystem") == "npm") & F.col("name").isNotNull() & F.col("version").isNotNull())
    one = d.groupBy("scan_id", "name").agg(F.max("version").alias("version"))
    body = one.groupBy("scan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.concat(F.lit("^"), "version"))))).alias("dependencies"))
    files = body.select(F.concat("scan_id", F.lit("/package.json")).alias("path"), F.to_json(F.struct("dependencies")).alias("text"))
    return manifests.package_json(files).select("path", "name", "version", "direct")


def kb_export(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.export_kb(_kb(spark, sf)).select("ecosystem", "package", "version")


def kb_merge(spark: SparkSession, sf: str) -> DataFrame:
    found = _t(spark, sf, "package_info").select(_eco("ecosystem").alias("ecosystem"), F.trim("name").alias("package")).distinct()
    return inventory.merge_kb(_kb(spark, sf).select("ecosystem", "package").distinct(), found)


def inference_rules(spark: SparkSession) -> DataFrame:
    """A rule per algorithm of the inventory: its key within the text of a package."""
    rows = [(n, r[0], 0, r[1], r[2]) for n, r in enumerate(dims.algorithm_rows())]
    return spark.createDataFrame(rows, "rule_no int, pattern string, pos int, algorithm string, type string")


def inferred_algorithms(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "package_info").select("info_id", F.concat_ws(" ", "name", "description", "keywords").alias("content"))
    return inventory.infer_algorithms(p, inference_rules(spark), "info_id")


def deduped_usages(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.dedupe_usages(_t(spark, sf, "crypto_usage").drop("severity", "usage_type").where("algorithm is not null"), "usage_id").drop("call_path")


def available_algorithms(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.available_by_dependency(_t(spark, sf, "crypto_usage"), "package")


def sarif_rules(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sarif_rules(_findings(spark, sf), "scan_id").drop("dep_seq", "usage_seq")


def cbom_components(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cbom_components(_findings(spark, sf), "scan_id")


def risk_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return reports.risk_breakdown(_findings(spark, sf), "scan_id")


def _reported(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans with their counters, dependencies, findings."""
    found = _found(spark, sf)
    about = found.groupBy("scan_id").agg(F.min("project").alias("project"), F.min("manifest").alias("manifest"), F.min("ecosystem").alias("ecosystem"), F.max("scanned_at").alias("scanned_at"))
    scans = inventory.summarise(found, "scan_id").withColumn("hints", inventory.hints()).join(about, "scan_id")
    findings = inventory.findings(found, "scan_id", "dep_seq").where("algorithm is not null")
    return scans, found.select("scan_id", "dep_seq", "name", "version", "ecosystem", "direct", "usages", "in_database"), findings


def report_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each scan's JSON, SARIF, CBOM and Markdown reports."""
    scans, found, findings = _reported(spark, sf)
    out = None
    for kind in ("json", "cbom", "sarif", "markdown"):
        one = reports.report(kind, scans, found, findings, "scan_id").withColumn("report", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    """The Markdown report of each scan, line by line or in blocks of lines."""
    scans, found, findings = _reported(spark, sf)
    return reports.report("md", scans, found, findings, "scan_id")


def _calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between neighbours of call paths, entries where paths begin, findings
    at the functions where they were seen; packages are the graphs."""
    u = _t(spark, sf, "crypto_usage").where("package is not null").select("usage_id", F.col("package").alias("graph"), "call_path", F.try_element_at("call_path", F.lit(-1)).alias("node"), "in_exported")
    steps = u.where("size(call_path) > 1").select("graph", F.explode(F.transform(F.sequence(F.lit(1), F.size("call_path") - 1), lambda i: F.struct(F.element_at("call_path", i).alias("caller"), F.element_at("call_path", i + 1).alias("callee")))).alias("e"))
    entries = u.where("in_exported and size(call_path) > 0").select("graph", F.element_at("call_path", 1).alias("node")).where("node is not null")
    return steps.select("graph", "e.*"), entries, u.where("node is not null").select("usage_id", "graph", "node")


def call_reachability(spark: SparkSession, sf: str) -> DataFrame:
    edges, entries, found = _calls(spark, sf)
    return reachability.classify_findings(found, reachability.distances(edges, entries)).select("usage_id", "reached", "nodes_on_path")


def reachability_counts(spark: SparkSession, sf: str) -> DataFrame:
    edges, entries, found = _calls(spark, sf)
    return reachability.count_classes(reachability.classify_findings(found, reachability.distances(edges, entries)), "graph").withColumnRenamed("graph", "package")


def crypto_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Entry points that reach a function with a finding, and the nodes on the path."""
    edges, entries, found = _calls(spark, sf)
    t = reachability.traces(edges, entries, found.select("graph", "node"))
    return t.select(F.col("graph").alias("package"), "entry_point", "target_func", "target_pkg", F.size("call_steps").cast("bigint").alias("nodes_on_path"))


def source_uses(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").where("doc_kind = 'source_file'")
    out = None
    for language in detect.LANGUAGES:
        one = detect.usages(d, language, "doc_id").select("doc_id", F.lit(language).alias("language"), "line_no", "family", "algorithm", "risk")
        out = one if out is None else out.unionByName(one)
    return out


def source_depth(spark: SparkSession, sf: str) -> DataFrame:
    return detect.brace_depth(_t(spark, sf, "documents").where("doc_kind = 'source_file' and text is not null"), "doc_id")


def source_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return detect.scopes(_t(spark, sf, "documents").where("doc_kind = 'source_file' and text is not null"), "python", "doc_id").select("doc_id", "line_no", "function", "exported")


QUERIES = {
    f.__name__: f
    for f in (
        scan_summary, portfolio_summary, scan_findings, classified_usages, remediation_keys, import_matches, clean_versions, requirement_lines, go_mod_dependencies, go_mod_left_out, discovered_manifests, preferred_manifests, crypto_packages, package_risk,
        ranked_findings, kb_stats, kb_risk_counts, kb_export_stats, remediation_targets, package_json_dependencies, kb_export, kb_merge, inferred_algorithms, deduped_usages, available_algorithms, sarif_rules, cbom_components, risk_breakdown, report_documents, markdown_report, call_reachability, reachability_counts, crypto_traces, source_uses, source_depth, source_scopes,
    )
}

# ---- the same in SQL ----

_KB = """
k AS (SELECT analysis_id AS seq, lower(trim(ecosystem, ' ')) AS e, lower(trim(package, ' ')) AS k, coalesce(trim(version, ' '), '') AS v, crypto FROM package_analysis),
x AS (SELECT e, k, v, max(seq) AS seq FROM k GROUP BY ALL), a AS (SELECT e, k, max(seq) AS seq FROM k GROUP BY ALL),
d AS (SELECT scan_id, project, dep_id, name, version, lower(trim(ecosystem, ' ')) AS e, lower(name) AS k, coalesce(version, '') AS v, coalesce(direct, false) AS direct FROM dependency),
j AS (SELECT d.*, coalesce(x.seq, a.seq) AS seq FROM d LEFT JOIN x ON x.e = d.e AND x.k = d.k AND x.v = d.v LEFT JOIN a ON a.e = d.e AND a.k = d.k),
c AS (SELECT seq, coalesce(len(list_filter(crypto, lambda u: u IS NOT NULL)), 0) AS n, coalesce(len(list_filter(crypto, lambda u: u.quantum_risk = 'VULNERABLE')), 0) AS vul, coalesce(len(list_filter(crypto, lambda u: u.quantum_risk = 'PARTIAL')), 0) AS par FROM k)
"""
_SUMS = """count(*) AS total, count(*) FILTER (direct) AS direct_count, count(*) FILTER (coalesce(n, 0) > 0) AS with_crypto, sum(coalesce(vul, 0))::BIGINT AS vulnerable, sum(coalesce(par, 0))::BIGINT AS partial, count(*) FILTER (j.seq IS NULL) AS not_in_database"""
_FIND = f"""WITH {_KB}, o AS (SELECT k.seq, p.i - 1 AS i, crypto[p.i] AS u FROM k, unnest(range(1, len(crypto) + 1)) p(i)),
f AS (SELECT j.scan_id, j.dep_id AS dep_seq, o.i::INT AS usage_seq, CASE WHEN coalesce(j.version, '') <> '' THEN j.name || '@' || j.version ELSE j.name END AS label, j.name, j.version, u.algorithm, u.quantum_risk, u.severity, u.usage_type
      FROM j JOIN o ON o.seq = j.seq WHERE u IS NOT NULL AND u.algorithm IS NOT NULL)"""
_RANK = "CASE {0} WHEN 'VULNERABLE' THEN 3 WHEN 'PARTIAL' THEN 2 WHEN 'SAFE' THEN 1 ELSE 0 END"
_LEVEL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
_REMEDY = "CASE WHEN algorithm IN ({0}) THEN algorithm {1} ELSE 'default' END".format(
    ", ".join(f"'{k}'" for k in dict.fromkeys(k for _, k in dims.REMEDIATION_PATTERNS)),
    " ".join(f"WHEN contains(upper(trim(algorithm)), '{p}') THEN '{k}'" for p, k in dims.REMEDIATION_PATTERNS),
)
_DIM = "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in dims.algorithm_rows()) + ") t(key, alg_name, alg_type, risk, severity)"
_PATTERNS = "(VALUES " + ", ".join(f"('{e}', '{p}', {i})" for e in dims.IMPORT_PATTERNS for i, (p, _) in enumerate(dims.IMPORT_PATTERNS[e])) + ") p(ecosystem, pattern, ord)"
_IS_MANIFEST = "split_part(manifest, '/', -1) IN ({0}) AND len(list_filter(string_split(manifest, '/')[:-2], lambda x: x IN ({1}) OR (starts_with(x, '.') AND x NOT IN ('.', '..')))) = 0".format(
    ", ".join(f"'{n}'" for n in dims.MANIFEST_NAMES if n != "go.work"), ", ".join(f"'{n}'" for n in dims.SKIP_DIRS)
)

_GO = r"""WITH b AS (SELECT scan_id, dep_id, direct, regexp_replace(name, '^\s+|\s+$', '', 'g') AS name, regexp_replace(version, '^\s+|\s+$', '', 'g') AS version FROM dependency WHERE lower(trim(ecosystem, ' ')) = 'go'),
d AS (SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'no name' WHEN coalesce(version, '') = '' THEN 'no version' WHEN regexp_matches(name, '\s') THEN 'blank in name' WHEN regexp_matches(version, '\s') THEN 'blank in version'
 WHEN regexp_matches(name, '^(//|\)|require\(|(require|module|go|toolchain)$)') OR contains(version, '=>') THEN 'other meaning in go.mod' END AS reason FROM b)"""
_CALLS = """WITH RECURSIVE u AS (SELECT usage_id, package AS g, call_path AS p, call_path[-1] AS node, in_exported FROM crypto_usage WHERE package IS NOT NULL),
e AS (SELECT DISTINCT g, p[i] AS a, p[i + 1] AS b FROM u, unnest(range(1, len(p))) t(i) WHERE p[i] IS NOT NULL AND p[i + 1] IS NOT NULL),
s AS (SELECT DISTINCT g, p[1] AS node FROM u WHERE in_exported AND len(p) > 0 AND p[1] IS NOT NULL),
r AS (SELECT g, node, 1 AS n FROM s UNION SELECT e.g, e.b, r.n + 1 FROM r JOIN e ON e.g = r.g AND e.a = r.node WHERE r.n < 40),
m AS (SELECT g, node, min(n)::BIGINT AS n FROM r GROUP BY ALL)"""
_REACHED = "CASE WHEN m.n IS NULL THEN 'AVAILABLE' WHEN m.n <= 2 THEN 'CONFIRMED' ELSE 'REACHABLE' END"



def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(test: str, names, otherwise: str = "NULL") -> str:
    """CASE over (pattern, name) pairs; test holds {0} for the quoted pattern."""
    pairs = names.items() if isinstance(names, dict) else names
    return "CASE " + " ".join(f"WHEN {test.format(_q(p))} THEN {_q(n)}" for p, n in pairs) + f" ELSE {otherwise} END"


def _uses_sql() -> str:
    d, low, has = detection, "contains(lower(l), {0})", "contains(l, {0})"
    ex = lambda pattern, group=1, col="l": f"nullif(regexp_extract({col}, {_q(pattern)}, {group}), '')"
    gate = lambda pattern, value: f"CASE WHEN regexp_matches(l, {_q(pattern)}) THEN {value} END"
    java = lambda name: "CASE WHEN {0} IS NOT NULL THEN coalesce({1}, {2}, {3}, {0}) END".format(name, _case(f"{name} = {{0}}", d.JAVA_NAMES), _case(f"upper({name}) = {{0}}", d.JAVA_NAMES), "CASE " + " ".join("WHEN " + " AND ".join(f"contains(upper({name}), '{x}')" for x in parts) + f" THEN '{n}'" for parts, n in d.JAVA_PARTS) + " END")
    quoted = f"list_filter(list_transform(regexp_extract_all(l, {_q(d.JS_QUOTED)}, 1), lambda x: {_case('lower(x) = {0}', d.JS_NAMES)}), lambda x: x IS NOT NULL)[1]"
    method = ex(d.JS_CRYPTO)
    pair = f"CASE WHEN {method} IN {d.JS_KEY_PAIRS} THEN {_case(has, d.JS_KEY_PAIR_NAMES, _q('RSA'))} END"
    hint = f"coalesce({ex(d.JAVA_HINT, 1, 'coalesce(cls, chr(0))')}, {ex(d.JAVA_HINT)})"
    uses = {
        "python": {
            "cryptography": gate(d.PY_CRYPTOGRAPHY, _case(low, d.PY_CRYPTOGRAPHY_NAMES)),
            "cryptodome": gate(d.PY_CRYPTODOME, _case(has, d.PY_CRYPTODOME_NAMES)),
            "hashlib": gate(d.PY_HASHLIB, _case(f"{ex(d.PY_HASHLIB)} = {{0}}", d.PY_HASHLIB_NAMES, "'SHA-256'")),
            "hmac": gate(d.PY_HMAC, _case(low, d.PY_HMAC_NAMES, "'HMAC'")),
            "bcrypt": gate(d.PY_BCRYPT, "'bcrypt'"),
            "jwt": gate(d.PY_JWT, f"coalesce(upper({ex(d.PY_QUOTED)}), {_case(low, d.PY_JWT_NAMES, _q('RS256'))})"),
            "passlib": gate(d.PY_PASSLIB, _case(low, d.PY_PASSLIB_NAMES, "'bcrypt'")),
            "nacl": gate(d.PY_NACL, "CASE WHEN contains(lower(l), 'signingkey') THEN 'Ed25519' ELSE 'X25519' END"),
        },
        "javascript": {
            "crypto": gate(d.JS_CRYPTO, f"coalesce({quoted}, {_case(method + ' = {0}', d.JS_METHODS)}, {pair})"),
            "bcrypt": gate(d.JS_BCRYPT, "'bcrypt'"),
            "jwt": gate(d.JS_JWT, _case(low, d.JS_JWT_NAMES, "'RS256'")),
            "cryptojs": gate(d.JS_CRYPTOJS, _case(f"{ex(d.JS_CRYPTOJS)} = {{0}}", d.JS_CRYPTOJS_NAMES)),
            "forge": gate(d.JS_FORGE, _case(low, d.JS_FORGE_NAMES)),
        },
        "java": {
            **{x: java(ex(x + r"""\.getInstance\s*\(\s*["']([^"']+)["']""")) for x in d.JAVA_SERVICES},
            **{f"{x} call": gate(call, f"coalesce({_case(f'upper({hint}) = {{0}}', d.JAVA_HINT_NAMES)}, '{default}')") for x, call, default in d.JAVA_CALLS},
            "bouncycastle": java(ex(d.JAVA_BOUNCY)),
            "spring": _case(f"{ex(d.JAVA_SPRING)} = {{0}}", d.JAVA_SPRING_NAMES),
        },
    }
    skip = {"python": r"^\s*(#|$)", "javascript": r"^\b$", "java": r"^\s*(//|\*|/\*|$)"}
    lines = r"""f AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents WHERE doc_kind = 'source_file' AND text IS NOT NULL), x AS (SELECT doc_id, p.i AS n, ls[p.i] AS l, NULL::VARCHAR AS cls FROM f, unnest(range(1, len(ls) + 1)) p(i))"""
    each = " UNION ALL ".join(f"SELECT doc_id, '{lang}' AS language, n AS line_no, '{family}' AS family, {sql} AS algorithm FROM x WHERE NOT regexp_matches(l, '{skip[lang]}')" for lang, of in uses.items() for family, sql in of.items())
    return f"WITH {lines}, u AS ({each}) SELECT doc_id, language, line_no, family, u.algorithm, coalesce(t.risk, 'UNKNOWN') AS risk FROM u LEFT JOIN {_DIM} ON t.key = lower(replace(u.algorithm, '_', '-')) WHERE u.algorithm IS NOT NULL"


ORACLE = {
    "scan_summary": f"""WITH {_KB}, s AS (SELECT scan_id, {_SUMS} FROM j LEFT JOIN c ON c.seq = j.seq GROUP BY scan_id)
SELECT *, CASE WHEN with_crypto = 0 THEN 0 WHEN vulnerable > 0 THEN 1 ELSE 3 END AS exit_code,
 concat_ws(',', CASE WHEN not_in_database > 0 AND (not_in_database * 2 >= total OR (with_crypto = 0 AND not_in_database > 5)) THEN 'deep:' || round_even(not_in_database * 100.0 / total, 0)::BIGINT END,
   CASE WHEN with_crypto = 0 AND total > 0 AND not_in_database = total THEN 'unknown' END) AS hints FROM s""",
    "portfolio_summary": f"""WITH {_KB}, s AS (SELECT project, scan_id, {_SUMS} FROM j LEFT JOIN c ON c.seq = j.seq GROUP BY ALL)
SELECT project, count(*) AS scans, {", ".join(f"sum({c})::BIGINT AS {c}" for c in inventory.SUMS)} FROM s GROUP BY project""",
    "scan_findings": _FIND + " SELECT scan_id, dep_seq, usage_seq, label, algorithm, quantum_risk, severity FROM f",
    "classified_usages": f"""SELECT usage_id, algorithm, coalesce(t.alg_name, algorithm) AS alg_name, coalesce(t.alg_type, 'unknown') AS alg_type, coalesce(t.risk, 'UNKNOWN') AS risk, coalesce(t.severity, 'INFO') AS severity
FROM crypto_usage u LEFT JOIN {_DIM} ON t.key = lower(replace(u.algorithm, '_', '-')) WHERE algorithm IS NOT NULL""",
    "remediation_keys": f"SELECT DISTINCT algorithm, {_REMEDY} AS remediation FROM crypto_usage WHERE algorithm IS NOT NULL",
    "import_matches": "WITH x AS (" + " UNION ".join(f"SELECT trim({c}, ' ') AS path, lower(trim(ecosystem, ' ')) AS ecosystem FROM {t}" for t, c in _NAMED.items()) + f"""), m AS (SELECT x.path, x.ecosystem, arg_min(p.pattern, p.ord) AS pattern
FROM x JOIN {_PATTERNS} ON p.ecosystem = x.ecosystem WHERE x.path = p.pattern OR starts_with(x.path, p.pattern || '/') GROUP BY ALL) SELECT * FROM m""",
    "requirement_lines": r"""WITH l AS (SELECT dep_id, trim(split_part(split_part(trim(name || '[extra]==' || coalesce(version, '') || ' ; python_version > ''3'' # pinned', ' '), '#', 1), ';', 1), ' ') AS b, trim(name, ' ') AS n FROM dependency WHERE lower(trim(ecosystem, ' ')) = 'pypi')
SELECT dep_id, regexp_extract(b, '^([a-zA-Z0-9_-]+)(?:\[[^\]]*\])?(.*)$', 1) AS req_name,
 trim(regexp_replace(trim(regexp_extract(b, '^([a-zA-Z0-9_-]+)(?:\[[^\]]*\])?(.*)$', 2), ' '), '^(==|>=|<=|~=|!=|>|<)', ''), ' ') AS req_version
FROM l WHERE b <> '' AND NOT regexp_matches(n, '^[#-]') AND regexp_matches(b, '^[a-zA-Z0-9_-]+(?:\[[^\]]*\])?.*$')""",
    "go_mod_dependencies": _GO + r""", g AS (SELECT scan_id, dep_id, name, 'v' || regexp_replace(version, '^[vV]', '') AS version, coalesce(direct, false) AS direct FROM d WHERE reason IS NULL)
SELECT scan_id || '/go.mod' AS path, row_number() OVER w - 1 AS seq, name, version, NOT bool_or(NOT direct) OVER (PARTITION BY scan_id ORDER BY dep_id) AS direct FROM g WINDOW w AS (PARTITION BY scan_id ORDER BY dep_id)""",
    "go_mod_left_out": _GO + " SELECT scan_id, dep_id, name, version, reason FROM d WHERE reason IS NOT NULL",
    "discovered_manifests": f"SELECT DISTINCT project, manifest AS path FROM dependency WHERE {_IS_MANIFEST}",
    "preferred_manifests": f"""WITH m AS (SELECT DISTINCT project, manifest AS path, list_position([{", ".join(f"'{n}'" for n in dims.MANIFEST_PRIORITY)}], split_part(manifest, '/', -1)) AS p,
 CASE WHEN contains(manifest, '/') THEN regexp_extract(manifest, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder FROM dependency WHERE {_IS_MANIFEST})
SELECT project, folder, arg_min(path, p) AS path FROM m WHERE p > 0 GROUP BY ALL""",
    "crypto_packages": "SELECT info_id, name FROM package_info WHERE {0} OR {1} OR len(list_filter(keywords, lambda x: {2})) > 0".format(*[f"coalesce(regexp_matches(lower({c}), '{text.CRYPTO_REGEX}'), false)" for c in ("name", "description", "x")]),
    "package_risk": f"SELECT package, arg_max(CASE WHEN r IN ('VULNERABLE', 'PARTIAL', 'SAFE') THEN r ELSE 'UNKNOWN' END, {_RANK.format('r')}) AS highest_risk FROM (SELECT package, upper(trim(quantum_risk)) AS r FROM crypto_usage) GROUP BY package",
    "ranked_findings": _FIND + f" SELECT scan_id, dep_seq, usage_seq, row_number() OVER (PARTITION BY scan_id ORDER BY {_RANK.format('quantum_risk')} DESC, dep_seq, usage_seq) AS place FROM f",
    "kb_stats": "WITH r AS (SELECT DISTINCT lower(trim(ecosystem, ' ')) AS ecosystem, lower(trim(package, ' ')) AS k, coalesce(trim(version, ' '), '') AS v FROM package_analysis) SELECT ecosystem, count(DISTINCT k) + count(DISTINCT CASE WHEN v <> '' THEN k || chr(1) || v END) AS keys FROM r GROUP BY 1",
    "kb_export": "SELECT lower(trim(ecosystem, ' ')) AS ecosystem, arg_max(trim(package, ' '), analysis_id) AS package, arg_max(coalesce(trim(version, ' '), ''), analysis_id) AS version FROM package_analysis WHERE NOT contains(package, '@') GROUP BY 1, lower(trim(package, ' '))",
    "kb_merge": """WITH c AS (SELECT DISTINCT lower(trim(ecosystem, ' ')) AS ecosystem, trim(package, ' ') AS package FROM package_analysis), f AS (SELECT DISTINCT lower(trim(ecosystem, ' ')) AS ecosystem, trim(name, ' ') AS package FROM package_info)
SELECT *, 'curated' AS origin FROM c UNION ALL SELECT f.*, 'inferred' FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.ecosystem = f.ecosystem AND c.package = f.package)""",
    "inferred_algorithms": f"""WITH p AS (SELECT info_id, lower(concat_ws(' ', name, description, array_to_string(keywords, ' '))) AS c FROM package_info), r AS (SELECT row_number() OVER () - 1 AS rule_no, * FROM {_DIM})
SELECT info_id, alg_name AS algorithm, alg_type AS type, min(rule_no)::INT AS rule_no FROM p JOIN r ON contains(c, r.key) GROUP BY ALL""",
    "available_algorithms": "SELECT package, string_agg(algorithm, ', ' ORDER BY algorithm) AS algorithms FROM (SELECT DISTINCT package, algorithm FROM crypto_usage WHERE upper(reachability) = 'AVAILABLE' AND algorithm IS NOT NULL) GROUP BY package",
    "sarif_rules": _FIND + f""", g AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY scan_id, algorithm) AS results FROM f WINDOW w AS (PARTITION BY scan_id, algorithm ORDER BY dep_seq, usage_seq))
SELECT scan_id, 'CRYPTO-' || algorithm AS rule_id, algorithm || ' Usage' AS rule_name, 'Dependency uses ' || algorithm AS short_description,
 'The dependency ' || coalesce(name, '') || ' uses ' || algorithm || ' which has quantum risk: ' || coalesce(quantum_risk, '') AS full_description, {_LEVEL} AS level, results FROM g WHERE rn = 1""",
    "cbom_components": _FIND + " SELECT scan_id, dep_seq, usage_seq, 'cryptographic-asset' AS component_type, algorithm AS component_name, coalesce(version, '') AS component_version, coalesce(usage_type, '') AS primitive FROM f",
    "risk_breakdown": _FIND + ", r AS (SELECT *, CASE WHEN quantum_risk IN ('VULNERABLE', 'PARTIAL', 'SAFE') THEN quantum_risk ELSE 'UNKNOWN' END AS risk FROM f)" + f" SELECT scan_id, risk, count(*) AS findings, count(DISTINCT algorithm) AS algorithms, count(DISTINCT dep_seq) AS dependencies, {_RANK.format('risk')}::INT AS rank FROM r GROUP BY scan_id, risk",
    "markdown_report": _FIND + f""", s AS (SELECT scan_id, {_SUMS} FROM j LEFT JOIN c ON c.seq = j.seq GROUP BY scan_id), b AS (SELECT s.*, m.manifest, m.ecosystem FROM s JOIN (SELECT scan_id, min(manifest) AS manifest, min(lower(trim(ecosystem, ' '))) AS ecosystem FROM dependency GROUP BY 1) m USING (scan_id))
SELECT scan_id, 0 AS section, -1::BIGINT AS dep_seq, -1::BIGINT AS usage_seq, concat_ws(chr(10), '# Scan Report', '', '## Summary', '', '| Metric | Value |', '|--------|-------|', '| **Manifest** | `' || coalesce(manifest, '') || '` |', '| **Ecosystem** | ' || coalesce(ecosystem, '') || ' |',
 '| **Total Dependencies** | ' || total || ' |', '| **Using Crypto** | ' || with_crypto || ' |', '| **Quantum Vulnerable** | ' || vulnerable || ' |', '| **Quantum Partial** | ' || partial || ' |', '| **Not in Database** | ' || not_in_database || ' |', '') AS piece FROM b
UNION ALL SELECT scan_id, 1, -1, -1, 'No cryptographic usage detected in dependencies.' FROM b WHERE with_crypto = 0
UNION ALL SELECT scan_id, 2, -1, -1, '## Findings' || chr(10) || chr(10) || '### Quantum Vulnerable' || chr(10) || chr(10) || CASE WHEN vulnerable > 0 THEN '| Dependency | Algorithm | Type | Severity |' || chr(10) || '|------------|-----------|------|----------|' ELSE 'No quantum-vulnerable algorithms found.' END FROM b WHERE with_crypto > 0
UNION ALL SELECT scan_id, 4, -1, -1, chr(10) || '### Quantum Partial Risk' || chr(10) || chr(10) || CASE WHEN partial > 0 THEN '| Dependency | Algorithm | Type | Severity |' || chr(10) || '|------------|-----------|------|----------|' ELSE 'No partial-risk algorithms found.' END FROM b WHERE with_crypto > 0
UNION ALL SELECT scan_id, CASE quantum_risk WHEN 'VULNERABLE' THEN 3 ELSE 5 END, dep_seq, usage_seq, '| ' || coalesce(name, '') || '@' || coalesce(version, '') || ' | ' || algorithm || ' | ' || coalesce(usage_type, '') || ' | ' || coalesce(severity, '') || ' |' FROM f WHERE quantum_risk IN ('VULNERABLE', 'PARTIAL')
UNION ALL SELECT scan_id, 8, -1, -1, concat_ws(chr(10), '', '## NIST Post-Quantum Cryptography Standards', '', '| Standard | Algorithm | Use Case |', '|----------|-----------|----------|', '| [FIPS 203](https://csrc.nist.gov/pubs/fips/203/final) | ML-KEM (Kyber) | Key Encapsulation |', '| [FIPS 204](https://csrc.nist.gov/pubs/fips/204/final) | ML-DSA (Dilithium) | Digital Signatures |', '| [FIPS 205](https://csrc.nist.gov/pubs/fips/205/final) | SLH-DSA (SPHINCS+) | Stateless Hash Signatures |') FROM b WHERE with_crypto > 0
UNION ALL SELECT scan_id, 9, -1, -1, chr(10) || '## Notes' || chr(10) || chr(10) || '> **' || not_in_database || ' packages (' || round_even(not_in_database * 100.0 / total, 0)::BIGINT || '%) were not in the crypto database.**' || chr(10) || '> Run with `--deep` flag to analyze these packages via source code inspection.' FROM b WHERE with_crypto > 0 AND not_in_database > 0""",
    "call_reachability": _CALLS + f""" SELECT usage_id, {_REACHED} AS reached, m.n AS nodes_on_path FROM u LEFT JOIN m ON m.g = u.g AND m.node = u.node WHERE u.node IS NOT NULL""",
    "reachability_counts": _CALLS + f""", c AS (SELECT u.g, {_REACHED} AS reached FROM u LEFT JOIN m ON m.g = u.g AND m.node = u.node WHERE u.node IS NOT NULL)
SELECT g AS package, count(*) FILTER (reached = 'CONFIRMED') AS confirmed, count(*) FILTER (reached = 'REACHABLE') AS reachable, count(*) FILTER (reached = 'AVAILABLE') AS available FROM c GROUP BY g""",
    "crypto_traces": _CALLS + r""", t AS (SELECT g, node AS entry, node, 1 AS n FROM s UNION SELECT e.g, t.entry, e.b, t.n + 1 FROM t JOIN e ON e.g = t.g AND e.a = t.node WHERE t.n < 40)
SELECT t.g AS package, t.entry AS entry_point, t.node AS target_func, CASE WHEN contains(t.node, '.') THEN regexp_extract(t.node, '^(.*)\.[^.]*$', 1) ELSE '' END AS target_pkg, min(t.n)::BIGINT AS nodes_on_path
FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.g = t.g AND u.node = t.node) GROUP BY t.g, t.entry, t.node""",
    "source_uses": _uses_sql(),
    "source_depth": r"""WITH l AS (SELECT doc_id, p.i AS line_no, regexp_split_to_array(text, '\r?\n')[p.i] AS l FROM documents, unnest(range(1, len(regexp_split_to_array(text, '\r?\n')) + 1)) p(i) WHERE doc_kind = 'source_file' AND text IS NOT NULL)
SELECT doc_id, line_no, sum(length(regexp_replace(l, '[^{]', '', 'g')) - length(regexp_replace(l, '[^}]', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS depth FROM l""",
    "clean_versions": r"""WITH d AS (SELECT dep_id, version AS v, ['^', '~', '>=', '> ', '', '<='][(dep_id % 6 + 1)::INT] || version || CASE WHEN dep_id % 4 = 0 THEN ' - 9.0' WHEN dep_id % 4 = 1 THEN ' || 8.0' ELSE '' END AS r FROM dependency WHERE version IS NOT NULL),
b AS (SELECT dep_id, v, regexp_replace(trim(r, ' '), '^\^?~?(>=)?>?(<=)?<?=?', '') AS x FROM d),
f AS (SELECT dep_id, v, CASE WHEN contains(x, ' - ') THEN trim(string_split(x, ' - ')[1], ' ') ELSE x END AS x FROM b)
SELECT dep_id, CASE WHEN contains(x, ' || ') THEN trim(string_split(x, ' || ')[1], ' ') ELSE x END AS npm, trim(string_split(trim(v || ' => ./local', ' '), '=>')[1], ' ') AS go FROM f""",
    # the fold as a walk: each row of a group either keeps what is held or replaces it
    "deduped_usages": f"""WITH RECURSIVE a AS (SELECT package, file_path, line_no, upper(coalesce(t.alg_name, algorithm)) AS alg, usage_id, algorithm, func_name, CASE WHEN call_path IS NULL THEN 0 ELSE len(call_path) END AS steps FROM crypto_usage u LEFT JOIN {_DIM} ON t.key = lower(replace(u.algorithm, '_', '-')) WHERE algorithm IS NOT NULL),
n AS (SELECT dense_rank() OVER (ORDER BY package NULLS FIRST, file_path NULLS FIRST, line_no NULLS FIRST, alg) AS g, * FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY usage_id, algorithm, func_name NULLS FIRST) AS k, count(*) OVER (PARTITION BY g) AS merged FROM n),
w AS (SELECT g, k, usage_id, algorithm, func_name, steps FROM o WHERE k = 1 UNION ALL
 SELECT o.g, o.k, CASE WHEN b THEN o.usage_id ELSE w.usage_id END, CASE WHEN b THEN o.algorithm ELSE w.algorithm END, CASE WHEN b THEN o.func_name ELSE w.func_name END, CASE WHEN b THEN o.steps ELSE w.steps END
 FROM w JOIN o ON o.g = w.g AND o.k = w.k + 1, LATERAL (SELECT o.steps > w.steps OR (coalesce(w.func_name, '') = '' AND coalesce(o.func_name, '') <> '') AS b))
SELECT o.package, o.file_path, o.line_no, w.usage_id, w.algorithm, w.func_name, o.merged FROM w JOIN o ON o.g = w.g AND o.k = w.k WHERE w.k = o.merged""",
    # per line, the last definition before it with a smaller indent than every line since
    "source_scopes": r"""WITH f AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents WHERE doc_kind = 'source_file' AND text IS NOT NULL), l AS (SELECT doc_id, p.i AS n, ls[p.i] AS l FROM f, unnest(range(1, len(ls) + 1)) p(i)),
x AS (SELECT *, regexp_matches(l, '^\s*(#|$)') AS blank, length(replace(regexp_extract(l, '^([ \t]*)', 1), chr(9), '    ')) AS ind, nullif(regexp_extract(l, '^(\s*)class\s+(\w+)', 2), '') AS cls, nullif(regexp_extract(l, '^(\s*)(?:async\s+)?def\s+(\w+)\s*\(', 2), '') AS fn FROM l),
h AS (SELECT x.doc_id, x.n, x.cls, x.fn, (SELECT min(y.n) FROM x y WHERE y.doc_id = x.doc_id AND y.n > x.n AND NOT y.blank AND y.ind <= x.ind) AS until FROM x WHERE NOT blank AND (cls IS NOT NULL OR fn IS NOT NULL)),
c AS (SELECT d.doc_id, d.n, d.fn, d.until, (SELECT arg_max(k.cls, k.n) FROM h k WHERE k.doc_id = d.doc_id AND k.cls IS NOT NULL AND k.n <= d.n AND (k.until IS NULL OR k.until > d.n)) AS cls FROM h d WHERE d.fn IS NOT NULL),
t AS (SELECT x.doc_id, x.n, (SELECT arg_max({'f': CASE WHEN c.cls IS NULL THEN c.fn ELSE c.cls || '.' || c.fn END, 'e': NOT starts_with(c.fn, '_')}, c.n) FROM c WHERE c.doc_id = x.doc_id AND c.n <= x.n AND (c.until IS NULL OR c.until > x.n)) AS o FROM x)
SELECT doc_id, n AS line_no, coalesce(o.f, '') AS function, coalesce(o.e, false) AS exported FROM t""",
    "kb_risk_counts": "WITH c AS (SELECT analysis_id AS seq, coalesce(list_filter(crypto, lambda u: u IS NOT NULL), []) AS us FROM package_analysis) SELECT seq, " + ", ".join(f"len(list_filter(us, lambda u: u.quantum_risk = '{r}')) AS n_{r.lower()}" for r in ("VULNERABLE", "PARTIAL", "SAFE")) + ", len(list_filter(us, lambda u: u.quantum_risk IS NULL OR u.quantum_risk NOT IN ('VULNERABLE', 'PARTIAL', 'SAFE'))) AS n_unknown FROM c",
    "kb_export_stats": """WITH l AS (SELECT lower(trim(ecosystem, ' ')) AS e, lower(trim(package, ' ')) AS k, arg_max_null(crypto, analysis_id) AS c FROM package_analysis GROUP BY 1, 2), x AS (SELECT e, coalesce(lower(trim(c[1].confidence, ' ')), 'verified') AS f FROM l WHERE NOT contains(k, '@'))
SELECT 'ecosystem' AS measure, e AS value, count(*) AS packages FROM x GROUP BY e UNION ALL SELECT 'confidence', f, count(*) FROM x GROUP BY f""",
    "remediation_targets": """WITH u AS (SELECT package, algorithm, upper(trim(quantum_risk, ' ')) AS r, upper(reachability) AS w FROM crypto_usage WHERE algorithm IS NOT NULL), p AS (SELECT package, algorithm, CASE WHEN w = 'CONFIRMED' AND r IN ('VULNERABLE', 'PARTIAL') THEN 1 WHEN w = 'AVAILABLE' AND r = 'VULNERABLE' THEN 2 END AS n FROM u)
SELECT package, algorithm, min(n) AS pass_no FROM p WHERE n IS NOT NULL GROUP BY ALL""",
    "package_json_dependencies": r"""WITH d AS (SELECT scan_id, name, max(version) AS v FROM dependency WHERE lower(trim(ecosystem, ' ')) = 'npm' AND name IS NOT NULL AND version IS NOT NULL GROUP BY 1, 2),
b AS (SELECT scan_id, name, regexp_replace(trim('^' || v, ' '), '^\^?~?(>=)?>?(<=)?<?=?', '') AS x FROM d), f AS (SELECT scan_id, name, CASE WHEN contains(x, ' - ') THEN trim(string_split(x, ' - ')[1], ' ') ELSE x END AS x FROM b)
SELECT scan_id || '/package.json' AS path, name, CASE WHEN contains(x, ' || ') THEN trim(string_split(x, ' || ')[1], ' ') ELSE x END AS version, true AS direct FROM f""",
}
