"""Go source files as rows: imports, functions, calls and selectors.

There is no Go parser at hand, so a small scanner runs per file in Arrow batches:
comments and literals are taken out, functions are matched by their braces, and
calls and selectors are found within and outside them. Files whose braces don't
balance give no rows, as files that don't parse. Closures count as the function
they stand in.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import detection as fixed
from strataq.functions import text

ROWS = "path string, kind string, func string, a string, b string, line int"

# fixed values: import path prefixes and the algorithm a call into them stands for
TARGETS = (
    ("crypto/rsa", "RSA"),
    ("crypto/ecdsa", "ECDSA"),
    ("crypto/ed25519", "Ed25519"),
    ("crypto/dsa", "DSA"),
    ("crypto/aes", "AES"),
    ("crypto/des", "DES"),
    ("crypto/rc4", "RC4"),
    ("crypto/sha1", "SHA-1"),
    ("crypto/sha256", "SHA-256"),
    ("crypto/sha512", "SHA-512"),
    ("crypto/md5", "MD5"),
    ("crypto/hmac", "HMAC"),
    ("golang.org/x/crypto/bcrypt", "bcrypt"),
    ("golang.org/x/crypto/argon2", "Argon2"),
    ("golang.org/x/crypto/chacha20poly1305", "ChaCha20-Poly1305"),
    ("golang.org/x/crypto/curve25519", "X25519"),
    ("golang.org/x/crypto/ed25519", "Ed25519"),
    ("golang.org/x/crypto/nacl", "NaCl"),
    ("golang.org/x/crypto/scrypt", "scrypt"),
    ("golang.org/x/crypto/ssh", "SSH"),
    ("github.com/cloudflare/circl", "PQC"),
    ("filippo.io/age", "age"),
    ("filippo.io/edwards25519", "Ed25519"),
)
# fixed values: signing-method constants of the JWT packages; PS is recorded as RS
SIGNING = {
    "SigningMethodHS256": "HS256",
    "SigningMethodHS384": "HS384",
    "SigningMethodHS512": "HS512",
    "SigningMethodRS256": "RS256",
    "SigningMethodRS384": "RS384",
    "SigningMethodRS512": "RS512",
    "SigningMethodPS256": "RS256",
    "SigningMethodPS384": "RS384",
    "SigningMethodPS512": "RS512",
    "SigningMethodES256": "ES256",
    "SigningMethodES384": "ES384",
    "SigningMethodES512": "ES512",
    "SigningMethodEdDSA": "Ed25519",
}
# fixed values: packages that have these constants
JWT_PACKAGES = ("github.com/golang-jwt/jwt", "github.com/golang-jwt/jwt/v4", "github.com/golang-jwt/jwt/v5", "github.com/dgrijalva/jwt-go")

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S)
_IMPORT = re.compile(r"(?m)^\s*import\s+(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"]+\"))")
_ONE = re.compile(r"(?:([\w.]+)\s+)?\"([^\"]+)\"")
_FUNC = re.compile(r"(?m)^func\s+(?:\(\s*(?:\w+\s+)?(\*?)\s*(\w+)[^)]*\)\s*)?(\w+)")
_USE = re.compile(r"(?<![\w.])([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*))?(\s*\()?")
_WORDS = set("if for switch select return func go defer range map chan struct interface var const type make new len cap append copy delete panic recover print println string int int64 byte error".split())


def _ends(clean: str) -> dict[int, int]:
    """Place of each opening brace to the place behind its closing one."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def scan(path: str, source: str) -> list[tuple]:
    """Rows of one file, read a fixed number of times; [] where its braces don't
    balance. A function is named with its receiver's type, its row says in ``b``
    how the receiver is written."""
    bare = _SKIP.sub(lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), source)
    starts = [0, *(m.end() for m in re.finditer("\n", bare))]
    line = lambda at: bisect_right(starts, at)
    out = []
    for m in _IMPORT.finditer(bare):
        for alias, target in _ONE.findall(m[1] or m[2]):
            out.append((path, "import", None, alias or None, target, line(m.start())))
    clean = re.sub(r'"(?:\\.|[^"\\\n])*"', lambda m: " " * len(m[0]), bare)
    if clean.count("{") != clean.count("}") or clean.count("(") != clean.count(")"):
        return []
    ends, spans = _ends(clean), []
    for m in _FUNC.finditer(clean):
        name = f"{m[2]}.{m[3]}" if m[2] else m[3]
        out.append((path, "func", name, m[3], f"{m[1]}{m[2]}" if m[2] else None, line(m.start())))
        at, depth = m.end(), 0
        while at < len(clean) and not (clean[at] == "{" and depth == 0) and not (clean[at] == "\n" and depth == 0):  # over the signature
            depth += {"(": 1, ")": -1}.get(clean[at], 0)
            at += 1
        spans.append((m.start(), at, ends.get(at, at), name))
    froms = [s[0] for s in spans]
    for u in _USE.finditer(clean):
        if u[1] in _WORDS or not (u[2] or u[3]):
            continue
        k = bisect_right(froms, u.start()) - 1
        name = spans[k][3] if k >= 0 and u.start() < spans[k][2] else None
        if not u[2] and (name is None or u.start() < spans[k][1]):  # no call without a package outside bodies
            continue
        out.append((path, "call" if u[3] else "select", name, u[1], u[2], line(u.start())))
    return out


def go_rows(files: DataFrame) -> DataFrame:
    """(path, kind, func, a, b, line) of (path, text): imports (alias, target),
    functions (name, receiver), calls and selectors (left, right). Null texts give
    no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["text"]) for r in scan(p, t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "func", "a", "b", "line"])

    return files.where("text is not null").select("path", "text").mapInPandas(run, ROWS)


def own_files(files: DataFrame) -> DataFrame:
    """Go files of a project, test files and folders of others' code left out."""
    return files.where("path like '%.go' and path not like '%\\_test.go'").where(~F.col("path").rlike(r"(^|/)(vendor|testdata|\.git|node_modules)/"))


def go_algorithm(target: Column, name: Column) -> Column:
    """Algorithm of a function or type ``name`` of the package ``target``."""
    out, low = None, F.lower(name)
    for path, algorithm in fixed.GO_PATHS:
        more = text.first_match(lambda p: low.contains(p), fixed.GO_FUNCTIONS.get(path, ()), F.lit(algorithm)) if path in fixed.GO_FUNCTIONS else F.lit(algorithm)
        out = F.when(target.contains(path), more) if out is None else out.when(target.contains(path), more)
    return out


def go_uses(files: DataFrame) -> DataFrame:
    """(path, line_no, algorithm, function, exported): calls into cryptographic
    packages, and their types and functions named with or without a call. A call
    whose function tells nothing counts as the first algorithm of its import."""
    from strataq.functions import dims

    rows = go_rows(files)
    imports = rows.where("kind = 'import'").select(F.col("path").alias("_p"), F.coalesce("a", F.substring_index("b", "/", -1)).alias("_alias"), F.col("b").alias("target"))
    uses = rows.where("kind in ('call', 'select') and b is not null")
    joined = uses.join(imports, (F.col("path") == F.col("_p")) & (F.col("a") == F.col("_alias")))
    pattern = text.import_match(F.col("target"), F.lit("go"))
    first = text.first_match(lambda p: pattern == p, [(p, a[0]) for p, a in dims.IMPORT_PATTERNS["go"] if a])
    told = go_algorithm(F.col("target"), F.col("b"))
    operation = F.lit(False)
    for word in fixed.GO_OPERATIONS:
        operation = operation | F.lower("b").contains(word)
    both = F.array(F.when(F.col("kind") == "call", F.coalesce(told, first)), F.when(operation, told))
    found = joined.where(pattern.isNotNull()).select("path", F.col("line").cast("bigint").alias("line_no"), F.explode(F.array_compact(both)).alias("algorithm"), "func")
    receivers = rows.where("kind = 'func'").select(F.col("path").alias("_p"), F.col("func").alias("_f"), F.col("a").alias("_name"), F.col("b").alias("_receiver")).distinct()
    named = found.join(receivers, (F.col("path") == F.col("_p")) & (F.col("func") == F.col("_f")), "left")
    function = F.when(F.col("func").isNull(), "").when(F.col("_receiver").isNull(), F.col("_name")).otherwise(F.concat(F.lit("("), "_receiver", F.lit(")."), "_name"))
    return named.select("path", "line_no", "algorithm", function.alias("function"), F.coalesce(F.col("_name").rlike("^[A-Z]"), F.lit(False)).alias("exported"))


def module_name(content: Column) -> Column:
    return F.trim(F.regexp_extract(content, r"(?m)^module (.*)$", 1))


def call_graph(files: DataFrame, module: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges (graph, caller, callee), entries (graph, node), crypto calls (graph,
    node, algorithm) of one module; nodes are package path and function. A call on
    a variable has no import and gives no edge."""
    rows = go_rows(own_files(files))
    inner = F.regexp_extract(F.regexp_replace("path", r"^\./", ""), r"^(.*)/[^/]*$", 1)
    package = F.when(inner == "", F.lit(module)).otherwise(F.concat(F.lit(module + "/"), inner))
    rows = rows.withColumn("graph", F.lit(module)).withColumn("package", package)
    node = lambda c: F.concat("package", F.lit("."), c)
    funcs = rows.where("kind = 'func'")
    entries = funcs.where(F.col("a").isin("main", "init") | F.col("a").rlike("^[A-Z]")).select("graph", node("func").alias("node")).distinct()
    imports = rows.where("kind = 'import'").select(F.col("path").alias("_p"), F.coalesce("a", text.package_alias(F.col("b"))).alias("_alias"), F.col("b").alias("target"))
    uses = rows.where("kind in ('call', 'select') and func is not null").select("graph", "path", "package", node("func").alias("node"), "kind", "a", "b")
    outside = uses.join(imports, (F.col("path") == F.col("_p")) & (F.col("a") == F.col("_alias"))).where("b is not null")
    edges = outside.where("kind = 'call'").select("graph", F.col("node").alias("caller"), F.concat("target", F.lit("."), "b").alias("callee"))
    bare = uses.where("kind = 'call' and b is null").select("graph", F.col("node").alias("caller"), node("a").alias("callee"))
    known = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("a")) for p, a in TARGETS])
    hits = outside.where("kind = 'call'").select("graph", "node", F.explode(F.filter(known, lambda k: F.col("target").startswith(k["p"]))).alias("k")).select("graph", "node", F.col("k.a").alias("algorithm"))
    signing = outside.where(F.col("target").rlike(f"^({'|'.join(JWT_PACKAGES)})")).select("graph", "node", text.first_match(lambda n: F.col("b") == n, SIGNING.items()).alias("algorithm")).where("algorithm is not null")
    return edges.unionByName(bare), entries, hits.unionByName(signing)
