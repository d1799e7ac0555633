from pyspark.sql import functions as F

from strataq.functions import text
from strataq.sources import manifests

FILES = "path string, text string"
GO = """module example.org/app

go 1.21

require github.com/a/single v1.2.3 // indirect
require (
\tgithub.com/a/b v1.0.0
\t// a comment
\tgithub.com/c/d/v2 v2.0.0 // indirect
\tgithub.com/e/f v3.0.0 => ./local
)
exclude (
\tgithub.com/no/no v0.0.1
)
require(
\tgithub.com/g/h v4.0.0
)
"""
NPM = '{"name": "x", "dependencies": {"a": "^1.0.0", "b": ">= 1.0"}, "devDependencies": {"c": "1.0.0 - 2.0.0"}, "optionalDependencies": {"a": "1.0.0 || 2.0.0"}, "peerDependencies": null}'
PIP = "requests==2.31.0\n# note\n-r other.txt\n\nPyJWT[crypto]>=2.8.0 ; python_version > '3'\nzope.interface==5 # x\nplain\n"
POM = """<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>me</groupId><version>9</version>
<properties><bc.version>1.77</bc.version><loop>${bc.version}</loop></properties>
<dependencyManagement><dependencies><dependency><groupId>no</groupId><artifactId>no</artifactId></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>org.b</groupId><artifactId>bc</artifactId><version>${bc.version}</version></dependency>
<dependency><groupId>${project.groupId}</groupId><artifactId>t</artifactId><version>${loop}${gone}</version><scope>test</scope></dependency></dependencies></project>"""


def deps(spark, *files):
    rows = manifests.parse_all(spark.createDataFrame(list(files), FILES)).orderBy("path", "dep_seq").collect()
    return [(r.name, r.version, r.ecosystem, r.direct) for r in rows]


def test_go_mod(spark):
    assert deps(spark, ("a/go.mod", GO)) == [
        ("github.com/a/single", "v1.2.3", "go", False),
        ("github.com/a/b", "v1.0.0", "go", True),
        ("github.com/c/d/v2", "v2.0.0", "go", False),
        ("github.com/e/f", "v3.0.0", "go", False),
        ("github.com/g/h", "v4.0.0", "go", True),
    ]


def test_package_json(spark):
    assert deps(spark, ("package.json", NPM)) == [("a", "1.0.0", "npm", True), ("b", " 1.0", "npm", True), ("c", "1.0.0", "npm", True), ("a", "1.0.0", "npm", True)]


def test_requirements(spark):
    assert deps(spark, ("x/requirements.txt", PIP)) == [("requests", "2.31.0", "pypi", True), ("PyJWT", "2.8.0", "pypi", True), ("zope", ".interface==5", "pypi", True), ("plain", "", "pypi", True)]


def test_pom(spark):
    assert deps(spark, ("pom.xml", POM)) == [("org.b:bc", "1.77", "maven", True), ("me:t", "${bc.version}${gone}", "maven", False)]


def test_invalid_and_empty(spark):
    files = spark.createDataFrame([("go.mod", "nothing"), ("package.json", "[1]"), ("pom.xml", " "), ("b/package.json", None), ("c/package.json", "{}")], FILES)
    assert sorted(r.path for r in manifests.invalid(files).collect()) == ["b/package.json", "go.mod", "package.json", "pom.xml"]
    assert manifests.parse_all(files).count() == 0


def test_discovery(spark):
    names = ["go.mod", "package.json", "a/pom.xml", "a/Gemfile", "node_modules/x/package.json", "a/.git/go.mod", "go.work", "b/readme.md", "go.mod", "./c/go.mod"]
    found = manifests.discover(spark.createDataFrame([(n,) for n in names], "path string"))
    assert sorted(r.path for r in found.collect()) == ["./c/go.mod", "a/Gemfile", "a/pom.xml", "go.mod", "package.json"]
    assert sorted(r.path for r in manifests.preferred(found).collect()) == ["./c/go.mod", "a/pom.xml", "go.mod"]


def test_workspaces_and_references(spark):
    files = [("package.json", '{"workspaces": ["packages/*", "apps/web"]}'), ("o/package.json", '{"workspaces": {"packages": ["libs/*"]}}'), ("pnpm-workspace.yaml", "packages:\n  - 'p/*'\n  - '!p/no'\n"), ("go.work", "go 1.21\nuse ./one\nuse (\n\t./two\n\t\"./three\" // c\n)\n")]
    rows = manifests.workspace_globs(spark.createDataFrame(files, FILES)).orderBy("layer", "path", "seq").collect()
    assert [r.pattern for r in rows] == ["libs/*", "packages/*", "apps/web", "p/*", "./one", "./two", "./three"]
    refs = ["https://github.com/o/r", "https://github.com/o/r.git", "https://github.com/o/r/tree/main/sub/dir", "github.com/o/r", "./local"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(x,) for x in refs], "r string").select(manifests.github_reference(F.col("r"))).collect()]
    assert got == [("o", "r", "", ""), ("o", "r", "", ""), ("o", "r", "main", "sub/dir"), ("o", "r", "", ""), None]
    regex = spark.createDataFrame([("packages/*", "packages/a", True), ("packages/*", "packages/a/b", False), ("a.b", "axb", False)], "g string, p string, want boolean")
    got = [(r.ok, r.want) for r in regex.select(F.regexp_like("p", manifests.glob_regex(F.col("g"))).alias("ok"), "want").collect()]
    assert all(a == b for a, b in got)


def test_names_and_paths(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.package_alias(F.lit("github.com/golang-jwt/jwt/v5"))) == "jwt" and value(text.package_alias(F.lit("crypto/rsa"))) == "rsa"
    assert value(text.call_package(F.lit("a.b/c.D"))) == "a.b/c" and value(text.short_function(F.lit("a/b.C"))) == "b.C"
    assert value(text.relative_path(F.lit("/r/a/b"), F.lit("/r"))) == "./a/b" and value(text.relative_path(F.lit("/r"), F.lit("/r"))) == "."
    for alg, want in (("XCHACHA20", "ChaCha20"), ("HMAC-SHA384", "SHA-384"), ("RC4", "default"), ("bcrypt", "bcrypt"), ("rsa_4096", "RSA")):
        assert value(text.remediation_key(F.lit(alg))) == want
    for path, eco, want in (("crypto/hmac", "go", "crypto"), ("cryptography", "npm", None), ("hashlib", "pypi", "hashlib"), ("org.bouncycastle.jce", "maven", "org.bouncycastle.jce")):
        assert value(text.import_match(F.lit(path), F.lit(eco))) == want


def test_workspaces_come_first(spark):
    files = spark.createDataFrame(
        [
            ("package.json", '{"workspaces": {"packages": ["packages/*", "./apps/web/", "none/*"]}}'),
            ("packages/a/package.json", "{}"),
            ("packages/a/deep/package.json", "{}"),
            ("packages/b/package.json", "[1]"),
            ("apps/web/package.json", "{}"),
            ("go.work", "go 1.21\nuse (\n\t./svc\n)\nuse missing\n"),
            ("svc/go.mod", "module m\n"),
            ("node_modules/x/package.json", "{}"),
            ("other/pom.xml", ""),
        ],
        "path string, text string",
    )
    got = {(r.path, r.layer) for r in manifests.workspace_manifests(files).collect()}
    assert got == {("packages/a/package.json", 1), ("packages/b/package.json", 1), ("apps/web/package.json", 1), ("package.json", 1), ("svc/go.mod", 3)}
    every = {(r.path, r.layer) for r in manifests.all_manifests(files).collect()}
    assert every == {("packages/a/package.json", 1), ("apps/web/package.json", 1), ("package.json", 1), ("svc/go.mod", 3), ("packages/a/deep/package.json", 4)}
    bad = {(r.path, r.problem) for r in manifests.parse_report(files.unionByName(spark.createDataFrame([("x/Cargo.toml", "x")], files.schema))).collect()}
    assert bad == {("packages/b/package.json", "malformed"), ("other/pom.xml", "malformed"), ("x/Cargo.toml", "unsupported"), ("go.work", "unsupported")}


def test_github_references(spark):
    refs = {
        "https://github.com/o/r": ("o", "r", "", ""),
        "http://github.com/o/r.git": ("o", "r", "", ""),
        "https://github.com/o/r/tree/main": ("o", "r", "main", ""),
        "https://github.com/o/r/tree/main/a/b": ("o", "r", "main", "a/b"),
        "github.com/o/r": ("o", "r", "", ""),
        "o-1/r.x": ("o-1", "r.x", "", ""),
        "https://github.com/o/r/blob/main/a": None,
        "plain": None,
    }
    df = spark.createDataFrame([(k,) for k in refs], "ref string")
    got = {r.ref: r.g and tuple(r.g) for r in df.withColumn("g", manifests.github_reference(F.col("ref"))).collect()}
    assert got == refs
