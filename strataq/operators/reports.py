"""Reports of scans as rows: each row is a piece of a document with its place.

The pieces of a scan, in the order of (section, dep_seq, usage_seq), make its report
when they are written one below the other. No scan is collected: a document is as
long as it is, and ``write_documents`` writes it while sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import text

TOOL, VERSION = "strataq", "1.0.0"
# fixed values: what the formats demand
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SERIAL = "urn:uuid:00000000-0000-0000-0000-000000000000"
STANDARDS = (
    ("[FIPS 203](https://csrc.nist.gov/pubs/fips/203/final)", "ML-KEM (Kyber)", "Key Encapsulation"),
    ("[FIPS 204](https://csrc.nist.gov/pubs/fips/204/final)", "ML-DSA (Dilithium)", "Digital Signatures"),
    ("[FIPS 205](https://csrc.nist.gov/pubs/fips/205/final)", "SLH-DSA (SPHINCS+)", "Stateless Hash Signatures"),
)
COUNTERS = {"total": "totalDependencies", "direct_count": "directDependencies", "with_crypto": "withCrypto", "vulnerable": "quantumVulnerable", "partial": "quantumPartial", "not_in_database": "notInDatabase"}


def sarif_rules(findings: DataFrame, *keys: str) -> DataFrame:
    """One rule per algorithm of a scan, described by the dependency seen first.
    findings: (keys, dep_seq, usage_seq, name, algorithm, quantum_risk, severity)."""
    rules = findings.groupBy(*keys, "algorithm").agg(F.min(F.struct("dep_seq", "usage_seq", "name", "quantum_risk", "severity")).alias("f"), F.count("*").alias("results"))
    risk = F.coalesce("f.quantum_risk", F.lit(""))
    return rules.select(
        *keys,
        F.col("f.dep_seq").alias("dep_seq"),
        F.col("f.usage_seq").alias("usage_seq"),
        F.concat(F.lit("CRYPTO-"), "algorithm").alias("rule_id"),
        F.concat("algorithm", F.lit(" Usage")).alias("rule_name"),
        F.concat(F.lit("Dependency uses "), "algorithm").alias("short_description"),
        F.concat(F.lit("The dependency "), F.coalesce("f.name", F.lit("")), F.lit(" uses "), "algorithm", F.lit(" which has quantum risk: "), risk).alias("full_description"),
        text.sarif_level(F.col("f.severity")).alias("level"),
        "results",
    )


def sarif_message(remediation: Column | None = None) -> Column:
    out = F.concat(F.coalesce("name", F.lit("")), F.lit("@"), F.coalesce("version", F.lit("")), F.lit(" uses "), "algorithm", F.lit(" (Quantum Risk: "), F.coalesce("quantum_risk", F.lit("")), F.lit(")"))
    return out if remediation is None else F.concat(out, F.when(F.coalesce(remediation, F.lit("")) != "", F.concat(F.lit(". Remediation: "), remediation)).otherwise(""))


def cbom_components(findings: DataFrame, *keys: str) -> DataFrame:
    """One component per dependency and usage, none merged."""
    return findings.select(*keys, "dep_seq", "usage_seq", F.lit("cryptographic-asset").alias("component_type"), F.col("algorithm").alias("component_name"), F.coalesce("version", F.lit("")).alias("component_version"), F.coalesce("usage_type", F.lit("")).alias("primitive"))


def _piece(df: DataFrame, key: str, section: int, body: Column, placed: bool = False) -> DataFrame:
    at = [F.col(c).cast("bigint").alias(c) for c in ("dep_seq", "usage_seq")] if placed else [F.lit(-1).cast("bigint").alias(c) for c in ("dep_seq", "usage_seq")]
    return df.select(key, F.lit(section).alias("section"), *at, body.alias("piece"))


def _listed(df: DataFrame, key: str, section: int, body: Column) -> DataFrame:
    """Members of a JSON list: all but the first have a comma before them."""
    first = df.groupBy(key).agg(F.min(F.struct("dep_seq", "usage_seq")).alias("_first"))
    comma = F.when(F.struct("dep_seq", "usage_seq") == F.col("_first"), "").otherwise(",")
    return _piece(df.join(first, key), key, section, F.concat(comma, body), placed=True)


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sarif(scans: DataFrame, findings: DataFrame, key: str, remediation: Column | None = None) -> DataFrame:
    """scans: one row per scan with key and ``manifest``; every scan has a report."""
    head = F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","version":"{VERSION}","rules":[')
    said = lambda c: F.struct(F.col(c).alias("text")) if isinstance(c, str) else F.struct(c.alias("text"))
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), said("short_description").alias("shortDescription"), said("full_description").alias("fullDescription"), F.struct("level").alias("defaultConfiguration")))
    place = F.array(F.struct(F.struct(F.struct(F.coalesce("manifest", F.lit("")).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.concat(F.lit("CRYPTO-"), "algorithm").alias("ruleId"), text.sarif_level(F.col("severity")).alias("level"), said(sarif_message(remediation)).alias("message"), place.alias("locations")))
    found = findings.join(scans.select(key, "manifest"), key)
    return _all(_piece(scans, key, 0, head), _listed(sarif_rules(findings, key), key, 1, rule), _piece(scans, key, 2, F.lit(']}},"results":[')), _listed(found, key, 3, result), _piece(scans, key, 4, F.lit("]}]}")))


def cbom(scans: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """scans: key and ``scanned_at``."""
    head = F.concat(F.lit(f'{{"bomFormat":"CycloneDX","specVersion":"1.6","serialNumber":"{SERIAL}","version":1,"metadata":{{"timestamp":"'), F.date_format("scanned_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f'","tools":[{{"vendor":"{TOOL}","name":"{TOOL}","version":"{VERSION}"}}]}},"components":['))
    component = F.to_json(F.struct(F.col("component_type").alias("type"), F.col("component_name").alias("name"), F.col("component_version").alias("version"), F.struct(F.lit("algorithm").alias("assetType"), F.struct("primitive").alias("algorithmProperties")).alias("cryptoProperties")))
    return _all(_piece(scans, key, 0, head), _listed(cbom_components(findings, key), key, 1, component), _piece(scans, key, 2, F.lit("]}")))


def scan_json(scans: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """scans: key, project, manifest, ecosystem, scanned_at, the counters and hints;
    found: dependencies with their usages and in_database."""
    told = F.to_json(F.struct("project", "manifest", "ecosystem", F.date_format("scanned_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scanDate")))
    head = F.concat(F.regexp_replace(told, r"\}$", ""), F.when(told == "{}", "").otherwise(","), F.lit('"dependencies":['))
    dependency = F.struct("name", "version", "ecosystem", "direct")
    body = F.to_json(F.struct(dependency.alias("dependency"), F.when(F.col("usages").isNotNull(), F.struct(F.col("usages").alias("crypto"))).alias("analysis"), F.col("in_database").alias("inDatabase")))
    tail = F.concat(F.lit('],"summary":'), F.to_json(F.struct(*[F.col(c).alias(n) for c, n in COUNTERS.items()])), F.lit(',"hints":'), F.to_json(F.filter(F.split("hints", ","), lambda h: h != "")), F.lit("}"))
    return _all(_piece(scans, key, 0, head), _listed(found.withColumn("usage_seq", F.lit(0)), key, 1, body), _piece(scans, key, 2, tail))


def markdown(scans: DataFrame, findings: DataFrame, key: str, remediation: Column | None = None) -> DataFrame:
    """Summary, findings by risk, remediation, standards and notes, one row a line;
    a scan without findings ends after the summary."""
    n = lambda c: F.col(c).cast("string")
    ticked = F.concat(F.lit("`"), F.coalesce("manifest", F.lit("")), F.lit("`"))
    metrics = (("Manifest", ticked), ("Ecosystem", F.coalesce("ecosystem", F.lit(""))), ("Total Dependencies", n("total")), ("Using Crypto", n("with_crypto")), ("Quantum Vulnerable", n("vulnerable")), ("Quantum Partial", n("partial")), ("Not in Database", n("not_in_database")))
    lines = [F.lit("# Scan Report"), F.lit(""), F.lit("## Summary"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|--------|-------|"), *[F.concat(F.lit(f"| **{m}** | "), v, F.lit(" |")) for m, v in metrics], F.lit("")]
    some = F.col("with_crypto") > 0
    parts = [_piece(scans, key, 0, F.concat_ws("\n", *lines)), _piece(scans.where(~some), key, 1, F.lit("No cryptographic usage detected in dependencies."))]
    full = scans.where(some)
    row = F.concat(F.lit("| "), F.coalesce("name", F.lit("")), F.lit("@"), F.coalesce("version", F.lit("")), *[x for c in ("algorithm", "usage_type", "severity") for x in (F.lit(" | "), F.coalesce(c, F.lit("")))], F.lit(" |"))
    for at, (risk, title, none, counter) in enumerate((("VULNERABLE", "### Quantum Vulnerable", "No quantum-vulnerable algorithms found.", "vulnerable"), ("PARTIAL", "### Quantum Partial Risk", "No partial-risk algorithms found.", "partial"))):
        begin = F.concat(F.lit("## Findings\n\n" if at == 0 else "\n"), F.lit(title), F.lit("\n\n"), F.when(F.col(counter) > 0, "| Dependency | Algorithm | Type | Severity |\n|------------|-----------|------|----------|").otherwise(none))
        parts += [_piece(full, key, 2 + 2 * at, begin), _piece(findings.where(F.col("quantum_risk") == risk), key, 3 + 2 * at, row, placed=True)]
    if remediation is not None:
        # of several texts for an algorithm the last one counts
        told = findings.where(F.col("quantum_risk").isin("VULNERABLE", "PARTIAL")).withColumn("_told", remediation).where("_told <> ''")
        last = told.groupBy(key, "algorithm").agg(F.max(F.struct("dep_seq", "usage_seq", F.col("_told").alias("told"))).alias("l")).select(key, "algorithm", "l.*")
        parts += [_piece(last.select(key).distinct(), key, 6, F.lit("\n## Remediation Guidance\n\n| Algorithm | Recommended Action |\n|-----------|--------------------|")), _piece(last, key, 7, F.concat(F.lit("| **"), "algorithm", F.lit("** | "), "told", F.lit(" |")), placed=True)]
    table = "\n".join(["\n## NIST Post-Quantum Cryptography Standards", "", "| Standard | Algorithm | Use Case |", "|----------|-----------|----------|", *(f"| {' | '.join(s)} |" for s in STANDARDS)])
    share = F.bround(F.col("not_in_database") * 100.0 / F.col("total"), 0).cast("bigint").cast("string")
    notes = F.concat(F.lit("\n## Notes\n\n> **"), n("not_in_database"), F.lit(" packages ("), share, F.lit("%) were not in the crypto database.**\n> Run with `--deep` flag to analyze these packages via source code inspection."))
    return _all(*parts, _piece(full, key, 8, F.lit(table)), _piece(full.where("not_in_database > 0"), key, 9, notes))


def risk_breakdown(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings, algorithms and dependencies of each risk, highest first by ``rank``."""
    risk = text.risk_label(F.col("quantum_risk"))
    out = findings.groupBy(*keys, risk.alias("risk")).agg(F.count("*").alias("findings"), F.count_distinct("algorithm").alias("algorithms"), F.count_distinct("dep_seq").alias("dependencies"))
    return out.withColumn("rank", text.risk_rank(F.col("risk")))


def write_documents(pieces: DataFrame, key: str, path: str) -> None:
    """One folder of text per scan, its pieces in order."""
    pieces.repartition(key).sortWithinPartitions(key, "section", "dep_seq", "usage_seq").select(key, F.col("piece").alias("value")).write.partitionBy(key).text(path)


FORMATS = {"": "markdown", "md": "markdown", "markdown": "markdown", "json": "json", "cbom": "cbom", "sarif": "sarif"}


def report(kind: str, scans: DataFrame, found: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """The pieces of a format, by its name or 'md'; without a name the readable one."""
    if kind.lower() not in FORMATS:
        raise ValueError(f"unknown report kind {kind!r}")
    name = FORMATS[kind.lower()]
    return scan_json(scans, found, key) if name == "json" else {"markdown": markdown, "cbom": cbom, "sarif": sarif}[name](scans, findings, key)
