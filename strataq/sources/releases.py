"""Knowledge-base files: releases, age, packages of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a cached file older than this is stale
MAX_AGE = "interval 7 days"

KB_FILE = "version string, updatedAt string, packages array<struct<package: string, version: string, ecosystem: string, license: string, crypto: array<struct<algorithm: string, type: string, quantumRisk: string, severity: string>>>>"


def read_kb(spark: SparkSession, *paths: str) -> DataFrame:
    """(seq, ecosystem, package, version, usages) of knowledge-base JSON files;
    later files override earlier ones."""
    out = None
    for n, path in enumerate(paths):
        packages = spark.read.schema(KB_FILE).option("multiLine", "true").json(path).select(F.posexplode("packages").alias("_i", "p"))
        usages = F.transform("p.crypto", lambda u: F.struct(u["algorithm"].alias("algorithm"), u["quantumRisk"].alias("quantum_risk"), u["severity"].alias("severity"), u["type"].alias("usage_type")))
        one = packages.select((F.lit(n).cast("bigint") * 2**40 + F.col("_i")).alias("seq"), "p.ecosystem", "p.package", F.coalesce("p.version", F.lit("")).alias("version"), usages.alias("usages"))
        out = one if out is None else out.unionByName(one)
    return out


def release_asset(releases: DataFrame, asset: str) -> DataFrame:
    """releases: (pos, tag, assets array<struct<name, url>>). The url of the asset
    in the first release tagged db-*, else in the first release that has it."""
    rows = releases.select("pos", "tag", F.explode("assets").alias("a")).where(F.col("a.name") == asset)
    best = rows.agg(F.min_by(F.struct("tag", F.col("a.url").alias("url")), F.struct((~F.col("tag").startswith("db-")).alias("other"), "pos")).alias("b"))
    return best.where("b is not null").select("b.*")


def is_stale(modified: Column, now: Column | None = None) -> Column:
    """Older than a week; a missing file counts as stale."""
    at = F.current_timestamp() if now is None else now
    return F.coalesce(at - modified > F.expr(MAX_AGE), F.lit(True))
