import json
from datetime import datetime

from pyspark.sql import functions as F

from strataq.operators import detect, inventory
from strataq.sources import releases

JS = "const a = 1;\nfunction outer(x) {\n  const inner = (y) => {\n    return crypto.createHash('md5');\n  }\n  bcrypt.hash(x);\n}\njwt.sign(x);"
JAVA = "class A {\n  // void no() {\n  public void run(int x) {\n    if (x) { Mac.getInstance(\"HmacSHA256\"); }\n  }\n  void late()\n  {\n    Cipher.getInstance(\"DES\");\n  }\n}"


def test_brace_scopes(spark):
    frame = lambda t: spark.createDataFrame([("f", t), ("n", None)], "path string, text string")
    js = [r.function for r in detect.scopes(frame(JS), "javascript").where("path = 'f'").orderBy("line_no").collect()]
    assert js == ["", "outer", "inner", "inner", "outer", "outer", "", ""]
    java = {(r.line_no, r.algorithm): (r.function, r.exported) for r in detect.detect(frame(JAVA), "java").collect()}
    assert java[(4, "HMAC-SHA256")] == ("A.run", True) and java[(8, "DES")] == ("", False)


def test_enrich_and_filters(spark):
    f = spark.createDataFrame([("RSA-4096", "go", "VULNERABLE", "HIGH", "CONFIRMED"), ("SHA-1", "npm", "VULNERABLE", "LOW", "AVAILABLE"), ("AES", "go", "PARTIAL", "INFO", "AVAILABLE")], "algorithm string, ecosystem string, quantum_risk string, severity string, reachability string")
    rem = spark.createDataFrame([("RSA", "use a lattice", "immediate", "medium", {"go": ["circl"]})], "key string, summary string, timeline string, effort string, libraries map<string,array<string>>")
    got = {r.algorithm: (r.summary, r.libraries) for r in inventory.enrich(f, rem).collect()}
    assert got == {"RSA-4096": ("use a lattice", ["circl"]), "SHA-1": (None, None), "AES": (None, None)}
    assert inventory.keep(f).count() == 3 and inventory.keep(f, risk="PARTIAL").count() == 1 and inventory.keep(f, min_severity="LOW").count() == 2 and inventory.keep(f, reached="AVAILABLE").count() == 2
    assert sorted(map(tuple, inventory.remediation_list(f).collect())) == [("RSA-4096", 1), ("SHA-1", 2)]


def test_kb_files_and_releases(spark, tmp_path):
    for n, version in ((1, ""), (2, "2")):
        (tmp_path / f"{n}.json").write_text(json.dumps({"version": "1", "packages": [{"package": "P", "ecosystem": "go", "version": version, "crypto": [{"algorithm": f"A{n}", "type": "hash", "quantumRisk": "SAFE", "severity": "INFO"}]}]}))
    kb = releases.read_kb(spark, str(tmp_path / "1.json"), str(tmp_path / "2.json"))
    deps = spark.createDataFrame([("p", "2", "go"), ("p", "1", "go")], "name string, version string, ecosystem string")
    assert [[u.algorithm for u in r.usages] for r in inventory.lookup(deps, inventory.index_kb(kb)).collect()] == [["A2"], ["A2"]]
    rows = [(0, "v1", [("kb.json", "u0")]), (1, "db-1", [("other", "x")]), (2, "db-0", [("kb.json", "u2")])]
    frame = spark.createDataFrame(rows, "pos int, tag string, assets array<struct<name: string, url: string>>")
    assert tuple(releases.release_asset(frame, "kb.json").first()) == ("db-0", "u2")
    assert releases.release_asset(frame.where("pos = 0"), "kb.json").first().url == "u0" and releases.release_asset(frame, "no").count() == 0
    ages = spark.createDataFrame([(datetime(2025, 1, 1),), (datetime(2025, 1, 7),), (None,)], "m timestamp")
    assert [r[0] for r in ages.select(releases.is_stale(F.col("m"), F.lit(datetime(2025, 1, 9)))).collect()] == [True, False, True]
