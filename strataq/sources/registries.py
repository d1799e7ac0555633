"""Snapshots of package registries as package rows.

A snapshot is a DataFrame (text) of the registries' JSON answers, one answer a row,
already fetched. Out come name, version, description, ecosystem, downloads,
repository, keywords, license, updated_at, each package once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import text

NPM = "objects array<struct<package: struct<name: string, version: string, description: string, keywords: array<string>, links: struct<repository: string>>, downloads: struct<weekly: bigint>>>"
PYPI = "info struct<name: string, version: string, summary: string, keywords: string, license: string, home_page: string, project_urls: map<string,string>>"
GO = "Path string, Version string, Time timestamp"
MAVEN = "response struct<docs: array<struct<g: string, a: string, latestVersion: string, timestamp: bigint>>>"


def _packages(df: DataFrame, ecosystem: str, **columns: Column) -> DataFrame:
    kinds = {"name": "string", "version": "string", "description": "string", "downloads": "bigint", "repository": "string", "keywords": "array<string>", "license": "string", "updated_at": "timestamp"}
    rows = df.select(F.lit(ecosystem).alias("ecosystem"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    # of answers that name a package twice any may stay; the greatest does
    rest = F.struct(*[c for c in kinds if c != "name"])
    return rows.where("name <> ''").groupBy("ecosystem", "name").agg(F.max(rest).alias("_r")).select("ecosystem", "name", "_r.*")


def npm(answers: DataFrame) -> DataFrame:
    """Search answers; packages that have to do with cryptography."""
    p = answers.select(F.explode(F.from_json("text", NPM)["objects"]).alias("o"))
    c = lambda name: F.col(f"o.package.{name}")
    out = _packages(p, "npm", name=c("name"), version=c("version"), description=c("description"), keywords=c("keywords"), repository=c("links.repository"))
    return out.where(text.crypto_related(F.col("name"), F.col("description"), F.col("keywords")))


def pypi(answers: DataFrame) -> DataFrame:
    """One package an answer; keywords are a text with commas, semicolons or blanks."""
    i = answers.select(F.from_json("text", PYPI)["info"].alias("i"))
    return _packages(i, "pypi", name=F.col("i.name"), version=F.col("i.version"), description=F.col("i.summary"), keywords=text.split_keywords(F.col("i.keywords")), license=F.col("i.license"), repository=F.col("i.home_page"))


def golang(answers: DataFrame) -> DataFrame:
    """Answers of a module proxy: {Path, Version, Time}."""
    m = answers.select(F.from_json("text", GO).alias("m"))
    return _packages(m, "go", name=F.col("m.Path"), version=F.col("m.Version"), updated_at=F.col("m.Time"))


def maven(answers: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Search answers; packages that have to do with cryptography and the ``known``
    group:artifact names, which are taken as they are."""
    d = answers.select(F.explode(F.from_json("text", MAVEN)["response"]["docs"]).alias("d"))
    out = _packages(d, "maven", name=F.concat_ws(":", "d.g", "d.a"), version=F.col("d.latestVersion"), updated_at=F.timestamp_millis("d.timestamp"))
    return out.where(text.crypto_related(F.col("name"), F.col("description"), F.col("keywords")) | F.col("name").isin(*known))


READERS = {"npm": npm, "pypi": pypi, "go": golang, "maven": maven}


def all_packages(answers: DataFrame) -> DataFrame:
    """answers: (source, text); the packages of all registries."""
    out = None
    for source, reader in READERS.items():
        one = reader(answers.where(F.col("source") == source))
        out = one if out is None else out.unionByName(one)
    return out


def failed(answers: DataFrame) -> DataFrame:
    """(source, text) of answers that are no JSON objects."""
    return answers.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False)))
