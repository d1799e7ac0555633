from strataq.operators import reachability
from strataq.sources import gosource

MAIN = '''package main

import (
	"crypto/rsa"
	"fmt" // "crypto/md5"
	jwt "github.com/golang-jwt/jwt/v5"
	"example.org/m/util"
)

func main() {
	fmt.Println("crypto.md5(")
	helper(func() { rsa.GenerateKey(nil, 2048) })
}

func helper(f func()) { util.Deep() }

func unused() { _ = jwt.SigningMethodPS256 }
'''
UTIL = 'package util\n\nimport "crypto/sha256"\n\ntype T struct{}\n\nfunc Deep() { low() }\n\nfunc low() { lower() }\n\nfunc lower() { t := T{}; t.m(); sha256.Sum256(nil) }\n\nfunc (t *T) m() {}\n'


def test_call_graph_of_a_module(spark):
    files = spark.createDataFrame([("main.go", MAIN), ("util/u.go", UTIL), ("vendor/x/x.go", MAIN), ("a_test.go", MAIN), ("bad.go", "package main\nfunc X() {"), ("n.go", None)], "path string, text string")
    edges, entries, crypto = gosource.call_graph(files, "example.org/m")
    assert sorted(r.node for r in entries.collect()) == ["example.org/m.main", "example.org/m/util.Deep"]
    pairs = {(r.caller, r.callee) for r in edges.collect()}
    assert ("example.org/m.main", "example.org/m.helper") in pairs and ("example.org/m.helper", "example.org/m/util.Deep") in pairs and ("example.org/m/util.low", "example.org/m/util.lower") in pairs
    assert {(r.node, r.algorithm) for r in crypto.collect()} == {("example.org/m.main", "RSA"), ("example.org/m.unused", "RS256"), ("example.org/m/util.lower", "SHA-256")}
    got = {r.algorithm: r.reached for r in reachability.classify_findings(crypto, reachability.distances(edges, entries)).collect()}
    assert got == {"RSA": "CONFIRMED", "RS256": "AVAILABLE", "SHA-256": "REACHABLE"}
    found = reachability.traces(edges, entries, crypto)
    t = {(r.algorithm, r.entry_point): (list(r.call_steps), r.target_pkg) for r in found.collect()}
    u = "example.org/m/util"
    assert t == {
        ("RSA", "example.org/m.main"): (["example.org/m.main"], "example.org/m"),
        ("SHA-256", "example.org/m.main"): (["example.org/m.main", "example.org/m.helper", f"{u}.Deep", f"{u}.low", f"{u}.lower"], u),
        ("SHA-256", f"{u}.Deep"): ([f"{u}.Deep", f"{u}.low", f"{u}.lower"], u),
    }
    findings = spark.createDataFrame([("RSA",), ("SHA-256",), ("sha-256",)], "algorithm string")
    assert {r.algorithm: (r.reached, r.traces) for r in reachability.classify_by_algorithm(findings, found).collect()} == {"RSA": ("CONFIRMED", 1), "SHA-256": ("REACHABLE", 2), "sha-256": ("AVAILABLE", 0)}


USES = '''package p

import (
	"crypto/des"
	"crypto/elliptic"
	"crypto/hmac"
	r "crypto/rsa"
	"crypto/sha256"
)

var h = sha256.New()

func (t *T) Enc(k r.PublicKey) { des.NewTripleDESCipher(nil); elliptic.P384() }

func low() { hmac.New(h, nil); _ = r.PrivateKey{}; x.New() }
'''


def test_go_uses(spark):
    files = spark.createDataFrame([("a.go", USES), ("n.go", None)], "path string, text string")
    got = sorted((r.line_no, r.algorithm, r.function, r.exported) for r in gosource.go_uses(files).collect())
    assert got == [(11, "SHA-256", "", False), (11, "SHA-256", "", False), (13, "3DES", "(*T).Enc", True), (13, "3DES", "(*T).Enc", True), (13, "P-384", "(*T).Enc", True), (13, "RSA", "(*T).Enc", True), (15, "RSA", "low", False)]


def test_signing_constants():
    assert gosource.SIGNING["SigningMethodEdDSA"] == "Ed25519" and len(gosource.SIGNING) == 13
