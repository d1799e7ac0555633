from datetime import datetime

from pyspark.sql import functions as F

from strataq.operators import snapshots

SCHEMA = "row_id bigint, db_version string, updated_at string, package string, pkg_version string, ecosystem string, license string, algorithms array<string>, n_vulnerable int, n_partial int, n_safe int, n_unknown int"


def row(i, v, at, p, version="1", lic=None, algs=None, eco="npm"):
    return (i, v, at, p, version, eco, lic, algs, 0, 0, 0, 0)


def test_changes_ordered_by_moment(spark):
    rows = [
        row(1, "2", "2025-01-02T00:00:00Z", "a"),
        row(2, "10", "2025-01-01T23:30:00-05:00", " A ", version="2"),
        row(3, "2", "2025-01-02 01:00:00+01:00", "b", lic=""),
        row(4, "10", "2025-01-02T04:30:00.000Z", "b ", lic=None, algs=[]),
        row(5, "10", "2025-01-02T04:30:00Z", "c"),
        row(6, "2", "2025-01-02T00:00:00Z", "d", version="0"),
        row(7, "2", "2025-01-02T00:00:00Z", "d", version="9"),
        row(8, "10", "2025-01-02T04:30:00Z", "d", version=" 9 "),
        row(9, "2", "2025-01-02T00:00:00Z", "e", algs=["x", "y", "x", None]),
        row(10, "10", "2025-01-02T04:30:00Z", "e", algs=["y", " x"]),
        row(11, "2", "2025-01-02T00:00:00Z", "gone", eco=None),
    ]
    got = sorted(map(tuple, snapshots.package_list_changes(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [("2", "10", "", "gone", "removed"), ("2", "10", "npm", "a", "changed"), ("2", "10", "npm", "c", "added")]


def test_empty_and_single_snapshot(spark):
    assert snapshots.package_list_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([row(1, "1", "2025-01-01T00:00:00Z", "a")], SCHEMA)
    assert snapshots.package_list_changes(one).count() == 0


def test_moment_reads_offsets(spark):
    texts = ["2025-04-10T19:30:00-05:00", "2025-04-11 00:30:00Z", "2025-04-11T06:00:00+05:30", "2025-04-11T00:30:00.000Z", "no time", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(snapshots.moment(F.col("t"))).collect()]
    assert got[:4] == [datetime(2025, 4, 11, 0, 30)] * 4 and got[4:] == [None, None]
