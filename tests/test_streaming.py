from strataq.streaming import findings

KB = "seq bigint, ecosystem string, package string, version string, usages array<struct<algorithm: string, quantum_risk: string, severity: string, usage_type: string>>"
DEPS = "scan_id bigint, dep_seq bigint, name string, version string, ecosystem string, direct boolean, at timestamp"


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime

    kb = spark.createDataFrame([(1, "go", "a", "", [("RSA", "VULNERABLE", "HIGH", "encryption"), ("AES", "PARTIAL", "INFO", "encryption")])], KB)
    deps = spark.createDataFrame([(1, 1, "A", "1", "go", True, datetime(2025, 1, 1, 1)), (1, 2, "b", "1", "go", True, datetime(2025, 1, 1, 2))], DEPS)
    deps.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(deps.schema).parquet(str(tmp_path / "in"))
    query = findings.write_findings(stream, kb, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(spark.read.parquet(str(tmp_path / "out"))) == order(findings.stream_findings(deps, kb))
    summary = findings.stream_summary(deps, kb, "at").collect()
    assert sum(r.total for r in summary) == 2 and sum(r.vulnerable for r in summary) == 1
