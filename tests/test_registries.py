import json

from strataq.sources import registries

NPM = {"objects": [{"package": {"name": "jose", "version": "5", "description": "JSON", "keywords": ["jwt"], "links": {"repository": "r"}}}, {"package": {"name": "left-pad"}}, {"package": {"name": "jose", "version": "5"}}]}
PYPI = {"info": {"name": "bcrypt", "version": "4.1", "summary": "hashing", "keywords": "a, b;c d", "license": "L"}}
GO = {"Path": "golang.org/x/crypto", "Version": "v0.17.0", "Time": "2024-01-02T03:04:05Z"}
MAVEN = {"response": {"docs": [{"g": "org.bouncycastle", "a": "bcprov", "latestVersion": "1.77", "timestamp": 1700000000000}, {"g": "org.x", "a": "y", "latestVersion": "1"}, {"g": "com.z", "a": "openpgp", "latestVersion": "2"}]}}


def test_packages_of_snapshots(spark):
    rows = [("npm", json.dumps(NPM)), ("pypi", json.dumps(PYPI)), ("go", json.dumps(GO)), ("maven", json.dumps(MAVEN)), ("npm", "oops"), ("pypi", None)]
    answers = spark.createDataFrame(rows, "source string, text string")
    got = {(r.ecosystem, r.name): (r.version, r.keywords) for r in registries.all_packages(answers).collect()}
    assert got == {("npm", "jose"): ("5", ["jwt"]), ("pypi", "bcrypt"): ("4.1", ["a", "b", "c", "d"]), ("go", "golang.org/x/crypto"): ("v0.17.0", None), ("maven", "com.z:openpgp"): ("2", None)}
    known = registries.maven(answers.where("source = 'maven'"), known=("org.bouncycastle:bcprov",))
    assert {r.name: r.updated_at is not None for r in known.collect()} == {"org.bouncycastle:bcprov": True, "com.z:openpgp": False}
    assert registries.failed(answers).count() == 2
    assert registries.all_packages(answers.limit(0)).count() == 0
