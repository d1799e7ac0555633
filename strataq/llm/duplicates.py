"""Records that differ only in formatting, collapsed by an incremental ledger.

A record's canonical key is a 128-bit hash of its fields with whitespace, letter
case, punctuation and the order of list entries taken out. The ledger holds one
row per key: bucket, key, number of copies and the representative (the smallest
record id). A new batch is aggregated by key first, then joined full-outer with
the buckets it touches; counts add up and the earlier representative stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.materialize import Scratch
from strataq.skew import look_up

BUCKETS = 16
#: ledger rows that one task writes of a bucket; larger buckets are written by several
TASK_ROWS = 2_000_000
KEY = ["bucket", "k1", "k2"]
LEDGER = "bucket int, k1 bigint, k2 bigint, keep_id bigint, n bigint"


def letters_and_digits(text: Column) -> Column:
    """Lower-case letters and digits only; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def version_key(text: Column) -> Column:
    """Without blanks and a leading v, dots kept; null equals blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\s\\p{Z}\\p{Cf}]", ""), "^v", "")


def list_key(items: Column) -> Column:
    """Entries in any order, each as letters and digits; null, empty and lists of
    empty entries are the same."""
    clean = F.transform(F.coalesce(items, F.array().cast("array<string>")), letters_and_digits)
    return F.concat_ws("\x1f", F.array_sort(F.filter(clean, lambda x: x != "")))


def keyed(df: DataFrame, id_col: str, fields: Iterable[Column], *extra: Column) -> DataFrame:
    """(id, bucket, k1, k2, extra..): the canonical key of each row."""
    text = F.concat_ws("\x1e", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields])
    two = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), *extra)
    return two.withColumn("bucket", F.pmod("k1", F.lit(BUCKETS)).cast("int"))


def count_keys(rows: DataFrame) -> DataFrame:
    """Ledger rows of one batch; partial counts are built before the shuffle."""
    return rows.groupBy(*KEY).agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))


def merge(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch of ledger rows."""
    b = batch.select(*[F.col(c).alias(f"_{c}") for c in [*KEY, "keep_id", "n"]])
    on = [F.col(c) == F.col(f"_{c}") for c in KEY]
    joined = ledger.join(b, on, "full_outer")
    count = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) for c in KEY], F.least("keep_id", "_keep_id").alias("keep_id"), count.alias("n"))


class Ledger:
    """A ledger kept in a folder. Each batch writes a new generation of the
    buckets it touches, in a folder named after the generation and the batch; one
    that was not finished is ignored and a batch already in the ledger is not
    counted again, so a batch may be repeated after a failure."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _generations(self) -> dict[int, tuple[str, list[int]]]:
        """Number of each finished generation to its folder and buckets, in order."""
        out = {}
        for name in sorted(n for n in self._names(self.path) if n.startswith("gen=")):
            inside = self._names(f"{self.path}/{name}")
            if "_SUCCESS" in inside:
                out[int(name[4:12])] = (name, [int(n[7:]) for n in inside if n.startswith("bucket=")])
        return out

    def _current(self) -> dict[int, str]:
        """Bucket to the folder of its latest generation."""
        return {b: name for name, buckets in self._generations().values() for b in buckets}

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        current = self._current()
        wanted = current if buckets is None else {b: current[b] for b in buckets if b in current}
        if not wanted:
            return self.spark.createDataFrame([], LEDGER)
        paths = [f"{self.path}/{name}/bucket={b}" for b, name in wanted.items()]
        stored = self.spark.read.option("basePath", self.path).schema("k1 bigint, k2 bigint, keep_id bigint, n bigint, gen string, bucket int").parquet(*paths)
        return stored.select("bucket", "k1", "k2", "keep_id", "n")

    def apply(self, rows: DataFrame, batch_id: object) -> bool:
        """Adds a batch of keyed rows; False where a batch of that id is in the
        ledger already."""
        tag, done = quote(str(batch_id), safe=""), self._generations()
        if any(name[13:] == tag for name, _ in done.values()):
            return False
        scratch = Scratch(self.spark, "ledger")
        batch = scratch.put(count_keys(rows))
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        old = self.read(touched)
        # the rows of a bucket are written by as many tasks as they need
        slices = 1 + (old.count() + batch.count()) // (BUCKETS * TASK_ROWS)
        merged = merge(old, batch).repartition("bucket", *([F.pmod("k2", F.lit(slices))] if slices > 1 else []))
        path = f"{self.path}/gen={max(done, default=0) + 1:08d}-{tag}"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(path)
        scratch.clear()
        self._clean()
        return True

    def _clean(self) -> None:
        """Removes buckets that two later generations have replaced; the one before
        the latest stays for readers at work."""
        seen: dict[int, int] = {}
        for name, buckets in reversed(list(self._generations().values())):
            for b in buckets:
                seen[b] = seen.get(b, 0) + 1
                if seen[b] > 2:
                    self._fs.delete(self._path(f"{self.path}/{name}/bucket={b}"), True)


def ledger_of(rows: DataFrame, batch_col: str, scratch: Scratch) -> Ledger:
    """A ledger that takes keyed rows batch by batch, in order of ``batch_col`` (a
    coarse value such as the year of delivery, so the list of batches is short).
    Where the rows are partitioned by it, each batch reads its own files only."""
    ledger = Ledger(rows.sparkSession, f"{scratch.root}/ledger")
    for r in rows.select(batch_col).distinct().orderBy(F.col(batch_col).asc_nulls_first()).collect():
        ledger.apply(rows.where(F.col(batch_col).isNull() if r[0] is None else F.col(batch_col) == r[0]), r[0])
    return ledger


def copies(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of every row that isn't its key's representative."""
    repeated = ledger.where("n > 1").select("k1", "k2", "keep_id", "n")
    return look_up(rows.select("id", "k1", "k2"), repeated, ["k1", "k2"], "n").where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def package_keys(packages: DataFrame) -> DataFrame:
    fields = [letters_and_digits(F.col(c)) for c in ("name", "ecosystem", "description")]
    fields += [list_key(F.col("keywords")), F.col("downloads"), version_key(F.col("version"))]
    return keyed(packages, "info_id", fields, F.year("ingested_at").alias("batch"))


def dependency_keys(dependencies: DataFrame) -> DataFrame:
    fields = [F.col("scan_id"), letters_and_digits(F.col("name")), letters_and_digits(F.col("ecosystem")), version_key(F.col("version"))]
    return keyed(dependencies, "dep_id", fields, F.year("ingested_at").alias("batch"))


def _ledgers(packages: DataFrame, dependencies: DataFrame) -> Iterator[tuple[str, DataFrame, Ledger]]:
    """Kind, keyed rows and ledger of both tables. The keys are computed once and
    written by batch, as counting and looking up both read them."""
    for kind, rows in (("package_info", package_keys(packages)), ("dependency", dependency_keys(dependencies))):
        scratch = Scratch(rows.sparkSession, "records")
        rows = scratch.put(rows, "batch")
        yield kind, rows, ledger_of(rows, "batch", scratch)


def formatting_copies(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(kind, keep_id, copy_id) of both tables."""
    out = [copies(rows, ledger.read()).select(F.lit(kind).alias("kind"), "keep_id", "copy_id") for kind, rows, ledger in _ledgers(packages, dependencies)]
    return out[0].unionByName(out[1])


def formatting_records(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(kind, keep_id, n): one row per record with its number of copies, itself
    among them."""
    out = [ledger.read().select(F.lit(kind).alias("kind"), "keep_id", "n") for kind, _, ledger in _ledgers(packages, dependencies)]
    return out[0].unionByName(out[1])
