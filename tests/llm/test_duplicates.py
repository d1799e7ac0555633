from datetime import datetime

from strataq.llm import duplicates

PACKAGES = "info_id bigint, name string, version string, description string, ecosystem string, downloads bigint, keywords array<string>, ingested_at timestamp, bucket string, n string"
DEPENDENCIES = "dep_id bigint, scan_id bigint, name string, version string, ecosystem string, ingested_at timestamp"
OLD, NEW = datetime(2025, 5, 1), datetime(2026, 5, 1)


def package(i, name="A-b", version="1.0", description="Some text", ecosystem="npm", downloads=5, keywords=("x", "Y z"), at=OLD):
    return (i, name, version, description, ecosystem, downloads, None if keywords is None else list(keywords), at, "clash", "clash")


def found(spark, packages, dependencies=()):
    p, d = spark.createDataFrame(list(packages), PACKAGES), spark.createDataFrame(list(dependencies), DEPENDENCIES)
    return sorted(map(tuple, duplicates.formatting_copies(p, d).collect()))


def test_what_counts_as_formatting(spark):
    rows = [
        package(7),
        package(3, name=" a_B ", version="v 1.0", description="SOME  text!", ecosystem="[npm]", keywords=["y-Z", "x."], at=NEW),
        package(9, version="10", at=NEW),
        package(10, downloads=None),
        package(11, downloads=None, description="some text"),
        package(12, keywords=None, version=None),
        package(13, keywords=[], version=" "),
        package(14, keywords=["x"]),
        package(15, name=None, description=None, ecosystem=None, at=None),
        package(16, name="", description="", ecosystem=" ", at=None),
    ]
    assert found(spark, rows) == [("package_info", 3, 7), ("package_info", 10, 11), ("package_info", 12, 13), ("package_info", 15, 16)]


def test_dependencies_within_a_scan_and_hot_keys(spark):
    rows = [(i, 1, "hot-name", "1", "npm", OLD if i % 2 else NEW) for i in range(60)] + [(100, 2, "Hot Name", "v1", "NPM", OLD), (101, 1, "hot-name", "1.0", "npm", OLD)]
    assert found(spark, [], rows) == [("dependency", 0, i) for i in range(1, 60)]


def test_empty(spark):
    assert found(spark, []) == []


def test_ledger_on_disk_equals_one_count(spark, tmp_path):
    rows = [package(i, name=f"n{i % 7}", at=OLD) for i in range(40)]
    keyed = duplicates.package_keys(spark.createDataFrame(rows, PACKAGES))
    ledger = duplicates.Ledger(spark, str(tmp_path / "ledger"))
    for part in range(3):
        assert ledger.apply(keyed.where(f"id % 3 = {part}"), f"day/{part}")
    assert ledger.apply(keyed.limit(0), None)
    assert not ledger.apply(keyed.where("id % 3 = 1"), "day/1")  # a batch repeated counts once
    order = lambda df: sorted(map(tuple, df.select("k1", "k2", "keep_id", "n").collect()))
    assert order(ledger.read()) == order(duplicates.count_keys(keyed))
    # what two later generations have replaced is gone
    kept = [b.name for g in (tmp_path / "ledger").iterdir() for b in g.iterdir() if b.name.startswith("bucket=")]
    assert max(map(kept.count, kept)) <= 2
    # a generation that was not finished is not read
    (tmp_path / "ledger" / "gen=00000099-x" / "bucket=1").mkdir(parents=True)
    assert order(ledger.read()) == order(duplicates.count_keys(keyed))


def test_records_with_their_copies(spark):
    p = spark.createDataFrame([package(7), package(3, name=" a_B ", at=NEW), package(9, name="other", at=None)], PACKAGES)
    d = spark.createDataFrame([(1, 1, "x", "1", "npm", NEW), (2, 1, "X", "v1", "NPM", OLD), (4, 2, "x", "1", "npm", OLD)], DEPENDENCIES)
    assert sorted(map(tuple, duplicates.formatting_records(p, d).collect())) == [("dependency", 1, 2), ("dependency", 4, 1), ("package_info", 3, 2), ("package_info", 9, 1)]
