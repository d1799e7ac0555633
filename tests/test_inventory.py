import json

import pytest
from pyspark.sql import functions as F

from strataq.operators import detect, inventory, reachability, reports

KB = "seq bigint, ecosystem string, package string, version string, usages array<struct<algorithm: string, quantum_risk: string, severity: string, usage_type: string>>"
DEPS = "scan_id bigint, dep_seq bigint, name string, version string, ecosystem string, direct boolean"
RSA, AES, SHA = ("RSA", "VULNERABLE", "HIGH", "encryption"), ("AES", "PARTIAL", "INFO", "encryption"), ("SHA-512", "SAFE", "INFO", "hash")


def found(spark):
    kb = [(1, "go", "x/crypto", "", [RSA]), (2, "go", "X/Crypto", "1.0", [AES, AES]), (3, "npm", "jose", None, [SHA, None]), (4, "npm", "empty", "", None)]
    deps = [(1, 1, "x/CRYPTO", "1.0", "go", True), (1, 2, "x/crypto", "2.0", "go", False), (1, 3, "none", "", "go", True), (2, 1, "jose", "5", "npm", True), (2, 2, "empty", None, "npm", True), (3, 1, "none", None, None, False)]
    return inventory.lookup(spark.createDataFrame(deps, DEPS), inventory.index_kb(spark.createDataFrame(kb, KB)))


def test_lookup_falls_back_to_the_entry_written_last(spark):
    got = {(r.scan_id, r.dep_seq): (r.in_database, [u and u.algorithm for u in r.usages or []]) for r in found(spark).collect()}
    assert got == {(1, 1): (True, ["AES", "AES"]), (1, 2): (True, ["AES", "AES"]), (1, 3): (False, []), (2, 1): (True, ["SHA-512", None]), (2, 2): (True, []), (3, 1): (False, [])}


def test_distinct_names_are_resolved_like_rows(spark):
    kb = [(1, "go", "x/crypto", "", [RSA]), (2, "go", "X/Crypto", "1.0", [AES, AES]), (3, "npm", "jose", None, [SHA, None]), (4, "npm", "empty", "", None), (5, "npm", "jose", "2", None)]
    deps = [(1, i, "jose" if i % 3 else f"n{i}", ("5", "2", "", None)[i % 4], "npm", True) for i in range(40)] + [(2, 1, None, None, "go", True), (2, 2, "x/crypto", "9", None, True), (2, 3, "X/crypto", "1.0", "go", False), (2, 3, "X/crypto", "1.0", "go", False)]
    d, k = spark.createDataFrame(deps, DEPS), spark.createDataFrame(kb, KB)
    rows = lambda df: sorted(str(r) for r in df.select(*d.columns, "usages", "in_database").collect())
    assert rows(inventory.resolve(d, k)) == rows(inventory.lookup(d, inventory.index_kb(k)))


def test_summary_counts_dependencies_once(spark):
    s = inventory.summarise(found(spark), "scan_id").withColumn("any", inventory.exit_code("any")).withColumn("vul", inventory.exit_code()).withColumn("hint", inventory.hints())
    got = {r.scan_id: tuple(r)[1:] for r in s.collect()}
    assert got == {1: (3, 2, 2, 0, 4, 1, 3, 0, ""), 2: (2, 2, 1, 0, 0, 0, 3, 0, ""), 3: (1, 0, 0, 0, 0, 1, 0, 0, "deep:100,unknown")}
    total = inventory.roll_up(s).first()
    assert (total.total, total.partial, total.scans) == (6, 4, 3)


def test_classify_and_highest(spark):
    df = spark.createDataFrame([(1, "sha_256"), (1, "md5"), (2, "nothing"), (3, None)], "p bigint, a string")
    got = {(r.p, r.a): (r.alg_name, r.risk, r.severity) for r in inventory.classify(df, "a").collect()}
    assert got[(1, "sha_256")] == ("SHA-256", "PARTIAL", "INFO") and got[(1, "md5")] == ("MD5", "VULNERABLE", "CRITICAL") and got[(2, "nothing")] == ("nothing", "UNKNOWN", "INFO")
    top = {r.p: r.highest_risk for r in inventory.highest_risk(inventory.classify(df, "a"), "risk", "p").collect()}
    assert top == {1: "VULNERABLE", 2: "UNKNOWN", 3: "UNKNOWN"}


def test_dedupe_keeps_the_better_row_in_order(spark):
    rows = [(1, "p", "sha256", "f", 1, None, ["a"]), (2, "p", "SHA-256", "f", 1, "hash", ["a"]), (3, "p", "aes", "f", 1, "g", None), (4, "p", "sha-256", "f", 1, None, ["a", "b", "c"]), (5, "p", "SHA_256", "f", 1, "late", ["a"])]
    df = spark.createDataFrame(rows, "usage_id bigint, package string, algorithm string, file_path string, line_no int, func_name string, call_path array<string>")
    got = sorted((r.usage_id, r.merged) for r in inventory.dedupe_usages(df, "usage_id").collect())
    assert got == [(3, 1), (5, 4)]


def test_reachability(spark):
    edges = [("g", "main", "a"), ("g", "a", "b"), ("g", "b", "a"), ("g", "b", "c"), ("h", "x", "y"), ("g", "main", None)]
    reached = reachability.distances(spark.createDataFrame(edges, "graph string, caller string, callee string"), spark.createDataFrame([("g", "main")], "graph string, node string"))
    assert {r.node: r.nodes_on_path for r in reached.collect()} == {"main": 1, "a": 2, "b": 3, "c": 4}
    f = spark.createDataFrame([("g", "main"), ("g", "a"), ("g", "c"), ("h", "y")], "graph string, node string")
    assert {r.node: r.reached for r in reachability.classify_findings(f, reached).collect()} == {"main": "CONFIRMED", "a": "CONFIRMED", "c": "REACHABLE", "y": "AVAILABLE"}


def test_kb_building(spark):
    kb = spark.createDataFrame([(1, "npm", "A", "", None), (2, "npm", "a", "1", None), (3, "npm", "@s/x", "", None)], KB)
    assert [tuple(r) for r in inventory.kb_stats(kb).collect()] == [("npm", 3)]
    assert [r.package for r in inventory.export_kb(kb).collect()] == ["a"]
    rules = spark.createDataFrame([(0, "jwt", 0, "RS256", "signature"), (1, "jose", 0, "RS256", "signature"), (2, "bcrypt", 0, "bcrypt", "hash")], "rule_no int, pattern string, pos int, algorithm string, type string")
    packages = spark.createDataFrame([(1, "My-JWT jose"), (2, "none"), (3, None)], "info_id bigint, content string")
    assert [tuple(r) for r in inventory.infer_algorithms(packages, rules, "info_id").collect()] == [(1, "RS256", "signature", 0)]


def test_reports(spark):
    dependencies = found(spark).withColumn("ecosystem", F.lit("npm")) if "ecosystem" not in found(spark).columns else found(spark)
    f = inventory.findings(dependencies, "scan_id", "dep_seq").where("algorithm is not null")
    if "usage_type" not in f.columns:
        f = f.withColumn("usage_type", F.lit("t"))
    scans = inventory.summarise(dependencies, "scan_id").withColumn("hints", inventory.hints()).withColumns({"project": F.lit("p"), "manifest": F.lit("go.mod"), "ecosystem": F.lit("go"), "scanned_at": F.lit("2025-01-02 03:04:05").cast("timestamp")})

    def documents(kind):
        rows = reports.report(kind, scans, dependencies, f, "scan_id").orderBy("scan_id", "section", "dep_seq", "usage_seq").collect()
        out = {}
        for r in rows:
            out.setdefault(r.scan_id, []).append(r.piece)
        return {k: "\n".join(v) for k, v in out.items()}

    sarif = {k: json.loads(v) for k, v in documents("sarif").items()}
    assert set(sarif) == {1, 2, 3} and sarif[3]["runs"][0]["results"] == []
    run = sarif[1]["runs"][0]
    assert "$schema" in sarif[1] and len(run["results"]) == 4 and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CRYPTO-AES"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "go.mod" and "(Quantum Risk: " in run["results"][0]["message"]["text"]
    bom = json.loads(documents("cbom")[1])
    assert bom["metadata"]["timestamp"] == "2025-01-02T03:04:05Z" and len(bom["components"]) == 4 and bom["serialNumber"].startswith("urn:uuid:")
    full = {k: json.loads(v) for k, v in documents("json").items()}
    assert full[1]["summary"]["totalDependencies"] == 3 == len(full[1]["dependencies"]) and full[3]["hints"] == ["deep:100", "unknown"]
    md = documents("md")
    assert md[3].endswith("No cryptographic usage detected in dependencies.") and "### Quantum Partial Risk" in md[1] and "FIPS 203" in md[1]
    with pytest.raises(ValueError):
        reports.report("xml", scans, dependencies, f, "scan_id")


PY = "import hashlib\n# hashlib.md5(\ndef f(x):\n    return hashlib.sha256(x)\nclass C:\n\tdef g(self):\n\t\tjwt.encode(a, algorithm='ES384')\n\nhmac.new(k, m, 'sha1')\n"
JS = "const h = crypto.createHash('sha512');\njwt.sign(a, {algorithm: 'HS384'}); bcrypt.hash(p)\nCryptoJS.TripleDES.encrypt(x)\ncrypto.randomBytes(4)"
JAVA = "// Cipher.getInstance(\"DES\")\nCipher.getInstance(\"AES/GCM/NoPadding\");\nMessageDigest.getInstance(alg);\nnew BCryptPasswordEncoder();\nSecretKeyFactory.getInstance(\"PBKDF2\")"


def test_detectors(spark):
    df = spark.createDataFrame([("p", PY), ("n", None), ("e", "")], "path string, text string")
    got = sorted((r.line_no, r.family, r.algorithm) for r in detect.detect(df, "python").collect())
    assert [x for x in got if x[1] != "cryptography"] == [(4, "hashlib", "SHA-256"), (7, "jwt", "ES384"), (9, "hmac", "HMAC-SHA1")]
    got = sorted((r.line_no, r.family, r.algorithm) for r in detect.detect(spark.createDataFrame([("j", JS)], "path string, text string"), "javascript").collect())
    assert got == [(1, "crypto", "SHA-512"), (2, "bcrypt", "bcrypt"), (2, "jwt", "HS384"), (3, "cryptojs", "3DES")]
    got = sorted((r.line_no, r.family, r.algorithm) for r in detect.detect(spark.createDataFrame([("j", JAVA)], "path string, text string"), "java").collect())
    assert got == [(2, "Cipher", "AES-GCM"), (2, "Cipher call", "AES"), (3, "MessageDigest call", "SHA-256"), (4, "bouncycastle", "BCrypt"), (4, "spring", "bcrypt"), (5, "KeyFactory", "PBKDF2"), (5, "SecretKeyFactory", "PBKDF2")]


NAMES = {
    "SHA256withDSA": "DSA", "PBKDF2WithHmacSHA256": "PBKDF2", "PBEWithMD5AndDES": "DES", "AES/ECB/PKCS5Padding": "AES-ECB", "RSA/ECB/OAEPWithSHA-256AndMGF1Padding": "RSA-OAEP", "SHA1": "SHA-1", "EC": "ECDSA", "XDH": "X25519",
    "AES_256/GCM/NoPadding": "AES-GCM", "NONEwithRSA": "RSA", "sha-512": "SHA-512", "HmacSHA1": "HMAC-SHA1", "DESede/ECB/NoPadding": "3DES", "Weird": "Weird",
}


def test_java_names(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "name string")
    assert {r.name: r.a for r in df.withColumn("a", detect.java_algorithm(F.col("name"))).collect()} == NAMES


def test_javascript_and_python_names(spark):
    js = {"crypto.createHash('sha3-256')": "SHA3-256", "crypto.createCipheriv('des-ede3-cbc', k)": "3DES", "crypto.createCipheriv('aes-256-gcm', k)": "AES-256-GCM", "crypto.createCipheriv('unknown', k)": None, "crypto.generateKeyPair('ec', o)": "ECDSA", "crypto.createHash(x)": "SHA-256", "crypto.createSign('RSA-SHA256')": "RSA"}
    df = spark.createDataFrame([(k, k) for k in js], "path string, text string")
    got = {r.path: r.algorithm for r in detect.detect(df, "javascript").collect()}
    assert got == {k: v for k, v in js.items() if v}
    py = spark.createDataFrame([("a", "k = serialization.load_rsa(x)"), ("b", "jwt.decode(t, 'EdDSA')"), ("c", "nacl.secret.SecretBox(k)")], "path string, text string")
    assert {(r.path, r.algorithm) for r in detect.detect(py, "python").collect()} == {("a", "RSA"), ("b", "EDDSA"), ("b", "DSA"), ("c", "X25519")}


def test_java_hints(spark):
    text = "public class AesTool {\n  public void run() {\n    Cipher.getInstance(name);\n  }\n}\nclass B {\n  void go() {\n    Mac.getInstance(hmacName);\n  }\n}"
    rows = detect.detect(spark.createDataFrame([("src/Plain.java", text), ("src/Blowfish.java", text)], "path string, text string"), "java").collect()
    assert sorted((r.path, r.line_no, r.algorithm, r.function, r.exported) for r in rows) == [
        ("src/Blowfish.java", 3, "AES", "AesTool.run", True),
        ("src/Blowfish.java", 8, "Blowfish", "B.go", False),
        ("src/Plain.java", 3, "AES", "AesTool.run", True),
        ("src/Plain.java", 8, "HMAC", "B.go", False),
    ]


def test_on_demand(spark):
    go = 'package p\n\nimport "crypto/md5"\n\nfunc F() { md5.Sum(nil) }\n'
    rows = [("go", "g", "a.go", go), ("go", "g", "a_test.go", go), ("npm", "n", "lib/x.js", "bcrypt.hash(p)"), ("npm", "n", "test/x.js", "bcrypt.hash(p)"), ("pypi", "p", "m.py", "hashlib.md5(x)"), ("pypi", "p", "test_m.py", "hashlib.md5(x)"), ("maven", "j", "A.kt", "new SecretKeySpec(k)"), ("cargo", "c", "m.rs", "x")]
    got = detect.on_demand(spark.createDataFrame(rows, "ecosystem string, package string, path string, text string")).collect()
    assert sorted((r.package, r.file_path, r.algorithm, r.risk) for r in got) == [("g", "a.go", "MD5", "VULNERABLE"), ("g", "a.go", "MD5", "VULNERABLE"), ("j", "A.kt", "AES", "PARTIAL"), ("n", "lib/x.js", "bcrypt", "UNKNOWN"), ("p", "m.py", "MD5", "VULNERABLE")]


def test_exit_codes(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0)], "vulnerable int, partial int, with_crypto int")
    got = {t: [r.c for r in df.select(inventory.exit_code(t).alias("c")).collect()] for t in ("vulnerable", "partial", "any", "none")}
    assert got == {"vulnerable": [1, 0, 0, 0], "partial": [1, 3, 0, 0], "any": [1, 3, 3, 0], "none": [0, 0, 0, 0]}


def test_scopes_and_depth(spark):
    df = spark.createDataFrame([("p", PY)], "path string, text string")
    assert [r.function for r in detect.scopes(df).orderBy("line_no").collect()] == ["", "", "f", "f", "", "C.g", "C.g", "C.g", "", ""]
    java = spark.createDataFrame([("j", "a {\n b { c }\n}\n")], "path string, text string")
    assert [r.depth for r in detect.brace_depth(java).orderBy("line_no").collect()] == [1, 1, 0, 0]
    assert detect.brace_depth(java).select(F.max("depth")).first()[0] == 1
