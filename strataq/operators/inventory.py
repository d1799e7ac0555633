"""Knowledge-base lookup, classification, summaries and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions import dims, text
from strataq.materialize import Scratch
from strataq.skew import look_up, small

#: dependency numbers that are ranked together
BLOCK = 4096


def index_kb(kb: DataFrame) -> DataFrame:
    """kb: (seq, ecosystem, package, version, usages). Out, per ecosystem and
    lower-case name: ``latest`` (usages of the entry written last) and
    ``by_version`` (map version -> usages of the last entry of that version). One
    row per name lets a lookup with fallback be one join. Null versions are ''."""
    rows = kb.select("seq", "ecosystem", F.lower("package").alias("key"), F.coalesce("version", F.lit("")).alias("version"), "usages")
    each = rows.groupBy("ecosystem", "key", "version").agg(F.max("seq").alias("seq"), F.max_by("usages", "seq").alias("usages"))
    return each.groupBy("ecosystem", "key").agg(F.max_by("usages", "seq").alias("latest"), F.map_from_entries(F.collect_list(F.struct("version", "usages"))).alias("by_version"))


def lookup(deps: DataFrame, index: DataFrame) -> DataFrame:
    """deps with ``usages`` (null where the name is unknown) and ``in_database``:
    the entry of the dependency's version, else the latest of its name. One join for
    each row, for streams; ``resolve`` is the way for tables."""
    k = index.select(F.col("ecosystem").alias("_e"), F.col("key").alias("_k"), "latest", "by_version")
    joined = deps.join(k, (F.col("ecosystem") == F.col("_e")) & (F.lower("name") == F.col("_k")), "left")
    version = F.coalesce("version", F.lit(""))
    exact = F.when(F.map_contains_key("by_version", version), F.try_element_at("by_version", version)).otherwise(F.col("latest"))
    return joined.withColumn("usages", exact).withColumn("in_database", F.col("_k").isNotNull()).drop("_e", "_k", "latest", "by_version")


def resolve(deps: DataFrame, kb: DataFrame) -> DataFrame:
    """The same as ``lookup`` on the rows of ``index_kb``'s input. Each distinct name
    and version is looked up once, by two equi-joins; the rows then meet the answers,
    of which the commonest are broadcast, so no package is a hot key."""
    absent = F.lit("\x00")  # no entry has it, so rows without a name or ecosystem find nothing
    keyed = deps.withColumns({"_e": F.coalesce("ecosystem", absent), "_k": F.coalesce(F.lower("name"), absent), "_v": F.coalesce("version", F.lit(""))})
    asked = keyed.groupBy("_e", "_k", "_v").agg(F.count("*").alias("_n"))
    rows = kb.select(F.col("ecosystem").alias("_e"), F.lower("package").alias("_k"), F.coalesce("version", F.lit("")).alias("_v"), "seq", F.struct("usages").alias("u"))
    exact = rows.groupBy("_e", "_k", "_v").agg(F.max_by("u", "seq").alias("_exact"))
    latest = rows.groupBy("_e", "_k").agg(F.max_by("u", "seq").alias("_latest"))
    found = asked.join(exact, ["_e", "_k", "_v"], "left").join(latest, ["_e", "_k"], "left")
    answers = Scratch(deps.sparkSession, "lookup").put(found.select("_e", "_k", "_v", "_n", F.coalesce("_exact", "_latest")["usages"].alias("usages"), F.col("_latest").isNotNull().alias("in_database")))
    return look_up(keyed, answers, ["_e", "_k", "_v"], "_n").drop("_e", "_k", "_v")


def ranked(findings: DataFrame, key: str) -> DataFrame:
    """(key, dep_seq, usage_seq, place): the findings of a scan by falling risk, then
    in their own order. Places are counted in blocks of BLOCK dependency numbers, so
    a scan with a third of all findings is no single task."""
    rows = findings.select(key, "dep_seq", "usage_seq", (-text.risk_rank(F.col("quantum_risk"))).alias("_r"), F.floor(F.col("dep_seq") / BLOCK).alias("_b"))
    block = [key, "_r", "_b"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_r", "_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*block, F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*block).orderBy("dep_seq", "usage_seq")))
    return numbered.join(offsets, block).select(key, "dep_seq", "usage_seq", (F.col("_before") + F.col("_row")).cast("bigint").alias("place"))


def classify(df: DataFrame, alg_col: str) -> DataFrame:
    """Adds alg_name, alg_type, risk, severity of an algorithm name; names not in
    the table keep themselves, with type 'unknown', risk UNKNOWN, severity INFO."""
    d = F.broadcast(dims.algorithm_dim(df.sparkSession))  # 64 rows
    joined = df.join(d, text.algorithm_key(F.col(alg_col)) == F.col("key"), "left").drop("key")
    fill = {"alg_name": F.col(alg_col), "alg_type": F.lit("unknown"), "risk": F.lit("UNKNOWN"), "severity": F.lit("INFO")}
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def summarise(found: DataFrame, *keys: str) -> DataFrame:
    """Counters per scan: dependencies count once, usages each. The columns stay
    at dependency grain, so nothing is counted after an explosion."""
    n = F.coalesce(F.size(F.filter("usages", lambda u: u.isNotNull())), F.lit(0))
    of = lambda r: F.coalesce(F.size(F.filter("usages", lambda u: u["quantum_risk"] == r)), F.lit(0))
    return found.select(*keys, "direct", "in_database", F.when(F.col("usages").isNull(), 0).otherwise(n).alias("_n"), F.when(F.col("usages").isNull(), 0).otherwise(of("VULNERABLE")).alias("_v"), F.when(F.col("usages").isNull(), 0).otherwise(of("PARTIAL")).alias("_p")).groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("direct").alias("direct_count"),
        F.count_if(F.col("_n") > 0).alias("with_crypto"),
        F.sum("_v").alias("vulnerable"),
        F.sum("_p").alias("partial"),
        F.count_if(~F.col("in_database")).alias("not_in_database"),
    )


SUMS = ("total", "direct_count", "with_crypto", "vulnerable", "partial", "not_in_database")


def roll_up(summary: DataFrame, *keys: str) -> DataFrame:
    return summary.groupBy(*keys).agg(F.count("*").alias("scans"), *[F.sum(c).alias(c) for c in SUMS])


def exit_code(threshold: str = "vulnerable") -> Column:
    """0 nothing to report, 1 vulnerable, 3 partial; with 'any' also 3 for other
    cryptography. 2 is for errors, which no row stands for."""
    v, p, c = F.col("vulnerable") > 0, F.col("partial") > 0, F.col("with_crypto") > 0
    if threshold.lower() == "none":
        return F.lit(0)
    if threshold.lower() == "any":
        return F.when(~c, 0).when(v, 1).otherwise(3)
    code = F.when(v, 1)
    return (code.when(p, 3) if threshold.lower() == "partial" else code).otherwise(0)


def hints(deep: bool = False) -> Column:
    """Which hints a summary calls for: 1 many packages unknown (try a deeper
    scan), 2 nothing known at all; null where none. Halves round to even."""
    share = F.bround(F.col("not_in_database") * 100.0 / F.col("total"), 0).cast("bigint")
    first = F.lit(not deep) & (F.col("not_in_database") > 0) & ((F.col("not_in_database") * 2 >= F.col("total")) | ((F.col("with_crypto") == 0) & (F.col("not_in_database") > 5)))
    second = (F.col("with_crypto") == 0) & (F.col("total") > 0) & (F.col("not_in_database") == F.col("total"))
    return F.concat_ws(",", F.when(first, F.concat(F.lit("deep:"), share)), F.when(second, F.lit("unknown")))


def findings(found: DataFrame, *keys: str) -> DataFrame:
    """One row per dependency and usage, in order."""
    return found.select(*keys, "name", "version", F.posexplode("usages").alias("usage_seq", "u")).where("u is not null").select(*keys, "name", "version", text.package_label(F.col("name"), F.col("version")).alias("label"), "usage_seq", "u.*")


def highest_risk(df: DataFrame, risk_col: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(text.risk_label(F.col(risk_col)), text.risk_rank(F.col(risk_col))).alias("highest_risk"))


def kb_stats(kb: DataFrame) -> DataFrame:
    """Index keys per ecosystem: a name and each of its versions count."""
    rows = kb.select("ecosystem", F.lower("package").alias("k"), F.coalesce("version", F.lit("")).alias("v")).distinct()
    return rows.groupBy("ecosystem").agg((F.count_distinct("k") + F.count_distinct(F.when(F.col("v") != "", F.struct("k", "v")))).alias("keys"))


def export_kb(kb: DataFrame) -> DataFrame:
    """The entry written last per ecosystem and name; names with an @ are left out."""
    last = kb.groupBy("ecosystem", F.lower("package").alias("key")).agg(F.max_by(F.struct("package", "version", "usages"), "seq").alias("e"))
    return last.where("not contains(key, '@')").select("ecosystem", "e.*")


def merge_kb(curated: DataFrame, found: DataFrame) -> DataFrame:
    """Curated entries and those found elsewhere whose exact ecosystem and name no
    curated entry has; origin says which."""
    new = found.join(curated.select("ecosystem", "package").distinct(), ["ecosystem", "package"], "left_anti")
    return curated.select("ecosystem", "package", F.lit("curated").alias("origin")).unionByName(new.select("ecosystem", "package", F.lit("inferred").alias("origin")))


def risk_counts(kb: DataFrame, *keys: str) -> DataFrame:
    """The usages of each entry by risk; null members and null lists count nothing."""
    of = lambda test: F.coalesce(F.size(F.filter("usages", test)), F.lit(0)).cast("bigint")
    risk = lambda r: of(lambda u: u["quantum_risk"] == r)
    known = ("VULNERABLE", "PARTIAL", "SAFE")
    size = of(lambda u: u.isNotNull())
    listed = F.col("usages").isNotNull()
    counts = {f"n_{r.lower()}": F.when(listed, risk(r)).otherwise(F.lit(0)).cast("bigint") for r in known}
    rest = F.when(listed, size).otherwise(F.lit(0)).cast("bigint") - counts["n_vulnerable"] - counts["n_partial"] - counts["n_safe"]
    return kb.select(*keys, *[c.alias(n) for n, c in counts.items()], rest.alias("n_unknown"))


def export_stats(kb: DataFrame) -> DataFrame:
    """(measure, value, packages): exported packages by ecosystem and by the
    confidence of their first usage; without one they count as 'verified'."""
    last = kb.groupBy("ecosystem", F.lower("package").alias("key")).agg(F.max_by("usages", "seq").alias("usages")).where("not contains(key, '@')")
    first = F.coalesce(F.lower(F.trim(F.try_element_at("usages", F.lit(1))["confidence"])), F.lit("verified"))
    each = last.select(F.explode(F.array(F.struct(F.lit("ecosystem").alias("measure"), F.col("ecosystem").alias("value")), F.struct(F.lit("confidence").alias("measure"), first.alias("value")))).alias("m"))
    return each.groupBy("m.measure", "m.value").agg(F.count("*").alias("packages"))


def infer_algorithms(packages: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """packages: (id, content); rules: (rule_no, pattern, pos, algorithm, type).
    Algorithms of every rule any of whose patterns the lower-case content holds; of
    equal algorithm and type the first rule counts. The rules are a short list: they
    become one expression, so each text is read once and nothing is joined."""
    if not small(rules, 10_000):
        raise ValueError("more than 10,000 rules: they are meant to be a short list")
    listed = sorted(map(tuple, rules.select("pattern", "rule_no", "algorithm", "type").collect()))
    content = F.lower("content")
    hits = [F.when(content.contains(p), F.array(*[F.struct(F.lit(n).alias("rule_no"), F.lit(a).alias("algorithm"), F.lit(t).alias("type")) for q, n, a, t in listed if q == p])) for p in dict.fromkeys(x[0] for x in listed)]
    if not hits:
        return packages.select(id_col).limit(0).select(id_col, F.lit("").alias("algorithm"), F.lit("").alias("type"), F.lit(0).alias("rule_no"))
    found = packages.select(id_col, F.explode(F.flatten(F.array_compact(F.array(*hits)))).alias("h")).select(id_col, "h.*")
    return found.groupBy(id_col, "algorithm", "type").agg(F.min("rule_no").alias("rule_no"))


def dedupe_usages(usages: DataFrame, order: str) -> DataFrame:
    """usages: (algorithm, file_path, line_no, func_name, call_path, ..). One per
    package file, line and normalised algorithm: the first, replaced in order by
    one with a longer call path or with a function where the kept one has none.
    The order matters, so it is a fold over each group's rows. A group is what one
    source line yields."""
    keys = ["package", "file_path", "line_no", "_alg"]
    row = F.struct(order, "algorithm", "func_name", "call_path")
    grouped = classify(usages, "algorithm").withColumn("_alg", F.upper("alg_name")).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    length = lambda u: F.when(u["call_path"].isNull(), 0).otherwise(F.size(u["call_path"]))
    none = lambda u: F.coalesce(u["func_name"], F.lit("")) == ""
    better = lambda a, b: F.when((length(b) > length(a)) | (none(a) & ~none(b)), b).otherwise(a)
    kept = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.col("rows")[0], better)
    return grouped.select("package", "file_path", "line_no", kept.alias("k"), F.size("rows").cast("bigint").alias("merged")).select("package", "file_path", "line_no", "k.*", "merged")


def available_by_dependency(found: DataFrame, *keys: str) -> DataFrame:
    """Sorted distinct algorithms that are available but not reached, per dependency."""
    return found.where("upper(reachability) = 'AVAILABLE' and algorithm is not null").groupBy(*keys).agg(F.concat_ws(", ", F.array_sort(F.collect_set("algorithm"))).alias("algorithms"))


def enrich(findings: DataFrame, remediation: DataFrame, alg_col: str = "algorithm") -> DataFrame:
    """Adds summary, timeline, effort and the libraries of the finding's ecosystem
    from remediation: (key, summary, timeline, effort, libraries map<string,
    array<string>>). Keys are found on the distinct algorithms, then joined back."""
    keys = findings.select(alg_col).distinct().withColumn("_key", text.remediation_key(F.col(alg_col)))
    rem = remediation.select(F.col("key").alias("_key"), "summary", "timeline", "effort", "libraries")
    joined = findings.join(keys.join(rem, "_key", "left"), alg_col, "left").drop("_key")
    return joined.withColumn("libraries", F.try_element_at("libraries", "ecosystem")) if "ecosystem" in findings.columns else joined


# fixed values: severities from low to high
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def keep(findings: DataFrame, risk: str | None = None, min_severity: str | None = None, reached: str | None = None) -> DataFrame:
    """Findings of one risk, of a severity or above, of one reachability; each
    filter is off unless given."""
    out = findings
    if risk:
        out = out.where(F.col("quantum_risk") == risk)
    if min_severity:
        out = out.where(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) > SEVERITIES.index(min_severity))
    return out.where(F.col("reachability") == reached) if reached else out


def remediation_list(findings: DataFrame, *keys: str) -> DataFrame:
    """Distinct algorithms to act on, each at its first place: confirmed vulnerable
    or partial ones (pass 1), then available vulnerable ones (pass 2)."""
    first = F.when((F.upper("reachability") == "CONFIRMED") & F.col("quantum_risk").isin("VULNERABLE", "PARTIAL"), 1).when((F.upper("reachability") == "AVAILABLE") & (F.col("quantum_risk") == "VULNERABLE"), 2)
    rows = findings.withColumn("pass", first).where("pass is not null and algorithm is not null")
    return rows.groupBy(*keys, "algorithm").agg(F.min("pass").alias("pass"))
