import pytest

from strataq.llm import canonical

ENTRIES = "ref_id string, title string, version string"


def mapped(spark, values, entries, kind, **kw):
    from pyspark.sql import functions as F

    kinds = lambda df: df.withColumn("kind", F.lit(kind))
    entries = entries if hasattr(entries, "schema") else spark.createDataFrame(entries, ENTRIES)
    return canonical.map_values(kinds(values), kinds(entries), **kw)


LICENSES = [("LWPL-1.0", "Lanternworks Public License", "1.0"), ("LWPL-2.0", "Lanternworks Public License", "2.0"), ("HGCL-2.0", "Harrowgate Community License", "2.0"), ("HGLCL-2.1", "Harrowgate Lesser Community License", "2.1"), ("FFSG-1.0", "Ferncliff Free Software Grant", "1.0")]
ALGORITHMS = [("AES-128-GCM", "Advanced Encryption Standard with 128 bit key in Galois counter mode", None), ("SHA-256", "Second family secure hash with 256 bit digest", None), ("SHA3-256", "Third family sponge hash with 256 bit digest", None), ("HMAC-SHA-256", "Keyed authentication code over the 256 bit second family hash", None), ("scrypt", "Memory hard password derivation named scrypt", None), ("ML-KEM-768", "Module lattice key encapsulation, middle strength", None), ("RSA-2048", "Rivest Shamir Adleman with 2048 bit modulus", None)]

LICENSE_CASES = {
    "lwpl 1": "LWPL-1.0", "LWPLv2.0": "LWPL-2.0", "the (LWPL-2.0) license": "LWPL-2.0", "Lantenrworks Pub. Licence, Ver 2.0": "LWPL-2.0", "Ｌａｎｔｅｒｎｗｏｒｋｓ Ｐｕｂｌｉｃ v. 1": "LWPL-1.0",
    "Community License-version 2.0, Hаrrowgate": "HGCL-2.0", "harrowgate lesser comm. lic 2.1": "HGLCL-2.1", "Harrowgate Community License 2.1": "none", "LWPL-3.0": "none", "Lanternworks Public License": "none",
    "ferncliff free softwware grant": "FFSG-1.0", "FFSG": "FFSG-1.0", "public": "none", "see LICENSE file": "none", "Thornfield Trial Contract 2.0": "none",
}
ALGORITHM_CASES = {
    "GCM / 128 / AES": "AES-128-GCM", "aes128gcm (default)": "AES-128-GCM", "128-bit AES in GCM mode": "AES-128-GCM", "AES-192-GCM": "none", "sha3256": "SHA3-256", "sha3.256": "SHA3-256", "hashing with sha-256": "SHA-256",
    "HMAC-SHA-384": "none", "hmac sha 256": "HMAC-SHA-256", "bcrypt": "none", "uses scrypt": "scrypt", "modle lattice key encapsulation, midddle strength": "ML-KEM-768", "Rivest Shamir Adleman with 2048 bit moduls": "RSA-2048", "SHA": "none", "?": "none",
}


@pytest.mark.parametrize("kind,entries,cases", [("license", LICENSES, LICENSE_CASES), ("algorithm", ALGORITHMS, ALGORITHM_CASES)])
def test_mapping(spark, kind, entries, cases):
    values = [(i, v) for i, v in enumerate(cases)] + [(100, None), (101, " \t"), (102, entries[0][0]), (0, next(iter(cases)))]
    df = spark.createDataFrame(values, "record_id bigint, raw string")
    rows = mapped(spark, df, entries, kind).collect()
    assert {r.raw: r.ref_id for r in rows} == cases
    assert len(rows) == len(cases) + 1


def test_empty_tables(spark):
    values = spark.createDataFrame([(1, "LWPL")], "record_id bigint, raw string")
    entries = spark.createDataFrame(LICENSES, ENTRIES)
    assert mapped(spark, values.limit(0), entries, "license").count() == 0
    assert [r.ref_id for r in mapped(spark, values, entries.limit(0), "license").collect()] == ["none"]


def test_very_long_value(spark):
    values = spark.createDataFrame([(1, "lanternwrks publc " * 20000)], "record_id bigint, raw string")
    assert [r.ref_id for r in mapped(spark, values, LICENSES, "license").collect()] == ["none"]


def test_two_edits_in_long_words(spark):
    typos = ["lantrnwrks", "lqntermworks", "laanternworkks", "lantxrnwrks", "lanternworksab"]  # missing, changed, added, both, added behind
    cases = {f"{t} public license 2.0": "LWPL-2.0" for t in [*typos, "xanternworks", "xanternxorks"]} | {"lantrnwrk public license 2.0": "none", "lanternworks pblc license 2.0": "none"}
    values = spark.createDataFrame(list(enumerate(cases)), "record_id bigint, raw string")
    rows = mapped(spark, values, LICENSES, "license").collect()
    assert {r.raw: r.ref_id for r in rows} == cases


def test_more_words_than_any_name(spark):
    """Many misspellings of a name's words are still that name."""
    words = ["lanternworks", "lantrnworks", "lanternwrks", "lanternworkss", "lantemworks", "public", "publc", "pubblic", "licence", "license", "licens", "2.0"]
    values = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "3.0"])), (3, " ".join([*words, "other"]))], "record_id bigint, raw string")
    assert {r.record_id: r.ref_id for r in mapped(spark, values, LICENSES, "license").collect()} == {1: "LWPL-2.0", 2: "none", 3: "none"}


def test_rank_decides(spark):
    """Without the exact check the best name by soft TF-IDF comes out."""
    cases = {"lanternwrks publc license 2": "LWPL-2.0", "harrowgate lesser community license 9": "HGLCL-2.1", "harrowgat software": "FFSG-1.0", "thornfield": "none"}
    values = spark.createDataFrame(list(enumerate(cases)), "record_id bigint, raw string")
    rows = mapped(spark, values, LICENSES, "license", checked=False).collect()
    assert {r.raw: r.ref_id for r in rows} == cases


def test_hot_value(spark):
    values = spark.createDataFrame([(i, "lwpl 1" if i % 3 else f"x{i} lwpl 2") for i in range(300)], "record_id bigint, raw string")
    rows = mapped(spark, values, LICENSES, "license").collect()
    assert len(rows) == 300 and all(r.ref_id == ("LWPL-1.0" if r.record_id % 3 else "none") for r in rows)
