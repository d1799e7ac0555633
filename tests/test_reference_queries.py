from strataq.functions import dims
from strataq.plans import reference_queries


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_import_matches_reads_names(spark, tmp_path):
    sf, schema = str(tmp_path), "{} string, ecosystem string"
    rows = {t: [] for t in reference_queries._NAMED}
    rows["dependency"] = [(" crypto/rsa ", "GO"), ("crypto/rsa", "go"), ("cryptox", "go"), ("hashlib", " pypi"), ("hashlib", "npm"), (None, "go"), ("jose/x", None)]
    rows["package_info"] = [("github.com/golang-jwt/jwt/v5", "go"), ("Crypto", "pypi"), ("crypto", "pypi")]
    rows["kb_snapshot"] = [("tweetnacl", "npm")]
    for t, c in reference_queries._NAMED.items():
        put(spark, sf, t, rows[t], schema.format(c))
    # by hand: every name against every pattern, without the expressions
    want = set()
    for path, eco in {(n.strip(), e.strip().lower()) for r in rows.values() for n, e in r if n and e}:
        first = next((p for p, _ in dims.IMPORT_PATTERNS.get(eco, ()) if path == p or path.startswith(p + "/")), None)
        want |= {(path, eco, first)} if first else set()
    got = [tuple(r) for r in reference_queries.import_matches(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want == {("crypto/rsa", "go", "crypto"), ("hashlib", "pypi", "hashlib"), ("github.com/golang-jwt/jwt/v5", "go", "github.com/golang-jwt/jwt"), ("Crypto", "pypi", "Crypto"), ("tweetnacl", "npm", "tweetnacl")}


def test_import_matches_without_rows(spark, tmp_path):
    for t, c in reference_queries._NAMED.items():
        put(spark, str(tmp_path), t, [], f"{c} string, ecosystem string")
    assert reference_queries.import_matches(spark, str(tmp_path)).count() == 0


def test_import_patterns_match_themselves(spark):
    """What import_matches gave before: each pattern, what is below it, what only begins like it."""
    from pyspark.sql import functions as F

    from strataq.functions import text

    rows = [(e, p, p + s, s) for e in dims.IMPORT_PATTERNS for p, _ in dims.IMPORT_PATTERNS[e] for s in ("", "/x", "x")]
    df = spark.createDataFrame(rows, "ecosystem string, p string, path string, s string")
    for r in df.withColumn("got", text.import_match(F.col("path"), F.col("ecosystem"))).collect():
        first = next((p for p, _ in dims.IMPORT_PATTERNS[r.ecosystem] if r.path == p or r.path.startswith(p + "/")), None)
        assert r.got == first and (r.s == "x" or r.got)


DEPENDENCY = "dep_id long, scan_id long, name string, version string, ecosystem string, direct boolean"


def test_go_mod_dependencies_reads_all(spark, tmp_path):
    rows = [
        (1, 7, "a.b/c", "1.2.3", "go", True),
        (2, 7, " A.b/C_d\t", " 1.2.3 ", " GO", True),
        (3, 7, "a.b/v", "v5.4.7", "go", True),
        (4, 7, "a.b/w", "V5.4.7\t", "Go", False),
        (5, 7, "a.b/e", "2.0.0-rc.1+incompatible", "go", True),
        (6, 7, "a b", "1.0", "go", True),
        (7, 7, "a.b/n", None, "go", True),
        (8, 7, "a.b/n", " ", "go", True),
        (9, 7, None, "1.0", "go", True),
        (10, 7, "a.b/i", "v 1.0", "go", True),
        (11, 7, "require", "1.0", "go", False),
        (12, 7, "//x", "1.0", "go", False),
        (13, 7, "a.b/r", "1.0=>2", "go", False),
        (14, 8, "a.b/g", "1.0", "go", None),
        (15, 8, "a.b/h", "1.0", "npm", True),
        (16, 8, "a.b/k", "1.0", None, True),
    ]
    put(spark, str(tmp_path), "dependency", rows, DEPENDENCY)
    got = sorted(tuple(r) for r in reference_queries.go_mod_dependencies(spark, str(tmp_path)).collect())
    assert got == [
        ("7/go.mod", 0, "a.b/c", "v1.2.3", True),
        ("7/go.mod", 1, "A.b/C_d", "v1.2.3", True),
        ("7/go.mod", 2, "a.b/v", "v5.4.7", True),
        ("7/go.mod", 3, "a.b/w", "v5.4.7", False),
        ("7/go.mod", 4, "a.b/e", "v2.0.0-rc.1+incompatible", False),  # once indirect, always
        ("8/go.mod", 0, "a.b/g", "v1.0", False),
    ]
    left = {r.dep_id: r.reason for r in reference_queries.go_mod_left_out(spark, str(tmp_path)).collect()}
    assert left == {6: "blank in name", 7: "no version", 8: "no version", 9: "no name", 10: "blank in version", **dict.fromkeys((11, 12, 13), "other meaning in go.mod")}


def test_requirement_lines_any_spelling(spark, tmp_path):
    rows = [(i, 1, f"n{i}", "1.0", eco, True) for i, eco in enumerate(("pypi", "PYPI", " pypi", "Pypi ", "npm", "pypi.", None))]
    put(spark, str(tmp_path), "dependency", rows, DEPENDENCY)
    got = sorted(tuple(r) for r in reference_queries.requirement_lines(spark, str(tmp_path)).collect())
    assert got == [(i, f"n{i}", "1.0") for i in range(4)]
