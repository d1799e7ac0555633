"""Queries of the problems on language-model corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import canonical, duplicates, packing, sentences, survivor, tokenize
from strataq.materialize import Scratch


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.mapped_fields(*(_t(spark, sf, n) for n in ("package_info", "crypto_usage", "license_ref", "algorithm_ref")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("field", "record_id", "ref_id")


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values that mean no entry, with the number of their rows."""
    return _mapped(spark, sf).where("ref_id = 'none'").groupBy("field", "raw").count().withColumnRenamed("count", "n_rows")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.formatting_copies(_t(spark, sf, "package_info"), _t(spark, sf, "dependency"))


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record with its number of copies."""
    return duplicates.formatting_records(_t(spark, sf, "package_info"), _t(spark, sf, "dependency"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.survivors(_t(spark, sf, "package_analysis"))


def p3_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Survivors by Bayesian fusion with copy detection, where confidence is a
    prior that votes can overrule."""
    return survivor.fused(_t(spark, sf, "package_analysis"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_texts(_t(spark, sf, "documents"), "doc_id", "text")


def _capacities(spark: SparkSession, sf: str) -> list[tuple[int, int]]:
    return [(r.capacity_id, r.capacity_tokens) for r in _t(spark, sf, "pack_capacity").orderBy("capacity_id").collect()]


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Container and place of every text or piece for each capacity. The token
    counts are read several times, so they are written once."""
    counts = tokenize.encode_texts(_t(spark, sf, "documents"), "doc_id", "text", counts_only=True)
    counts = Scratch(spark, "packing").put(counts)
    return packing.pack(counts, "doc_id", "n_tokens", _capacities(spark, sf))


def p8_slack(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used for each capacity beside the least number possible."""
    return packing.slack(p8_pack(spark, sf), _capacities(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(sentences.prose(_t(spark, sf, "documents")), "doc_id", "text")


def p9_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences with their texts restored."""
    return sentences.split_sentences(sentences.prose(_t(spark, sf, "documents")), "doc_id", "text", with_text=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_records, p3_found, p3_fused, p7_ids, p8_pack, p8_slack, p9_found, p9_sentences)}

_P2 = """
WITH a AS (SELECT 'package_info' AS kind, info_id AS id, NULL::BIGINT AS scan_id,
  regexp_replace(lower(coalesce(name,'')),'[^\\p{L}\\p{N}]','','g') AS n, regexp_replace(lower(coalesce(ecosystem,'')),'[^\\p{L}\\p{N}]','','g') AS e,
  regexp_replace(lower(coalesce(description,'')),'[^\\p{L}\\p{N}]','','g') AS d,
  coalesce(list_sort(list_filter(list_transform(keywords, lambda x: regexp_replace(lower(coalesce(x,'')),'[^\\p{L}\\p{N}]','','g')), lambda x: x <> '')), []) AS k,
  downloads AS w, regexp_replace(regexp_replace(lower(coalesce(version,'')),'[\\s\\p{Z}\\p{Cf}]','','g'),'^v','') AS v FROM package_info
 UNION ALL SELECT 'dependency', dep_id, scan_id,
  regexp_replace(lower(coalesce(name,'')),'[^\\p{L}\\p{N}]','','g'), regexp_replace(lower(coalesce(ecosystem,'')),'[^\\p{L}\\p{N}]','','g'),
  '', [], NULL, regexp_replace(regexp_replace(lower(coalesce(version,'')),'[\\s\\p{Z}\\p{Cf}]','','g'),'^v','') FROM dependency),
m AS (SELECT kind, id, min(id) OVER (PARTITION BY kind, scan_id, n, e, d, k, w, v) AS keep FROM a)
SELECT kind, keep AS keep_id, id AS copy_id FROM m WHERE id <> keep
"""

_P3 = """
WITH r AS (SELECT analysis_id, license, analysis, crypto,
  lower(trim(coalesce(package,''))) AS p, lower(trim(coalesce(version,''))) AS v, lower(trim(coalesce(ecosystem,''))) AS e,
  coalesce(list_max(list_transform(crypto, lambda u: CASE lower(trim(u.confidence)) WHEN 'verified' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)), 0) AS tier FROM package_analysis),
g AS (SELECT *, min(analysis_id) OVER w AS group_id, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY p, v, e)),
f AS (SELECT group_id, analysis_id, tier, analysis.analysed_at AS at_, u.field, u.val FROM g, unnest([
  {'field': 'license', 'val': license}, {'field': 'tool_version', 'val': analysis.tool_version}, {'field': 'contributor', 'val': analysis.contributor},
  {'field': 'source_hash', 'val': analysis.source_hash}, {'field': 'crypto', 'val': CASE WHEN len(list_filter(crypto, lambda x: x IS NOT NULL)) > 0 THEN 'filled' END}]) t(u) WHERE n > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY tier DESC, at_ DESC NULLS LAST, analysis_id) AS rn FROM f
  WHERE val IS NOT NULL AND lower(trim(val)) NOT IN (%s))
SELECT group_id, field, analysis_id AS source_id FROM k WHERE rn = 1
""" % ", ".join(f"'{w}'" for w in survivor.NOTHING)

ORACLE: dict[str, str] = {"p2_found": _P2, "p3_found": _P3}
