"""Differences between consecutive full snapshots of a keyed table.

A full outer join on the primary key compares canonical row hashes: a missing
left side is an addition, a missing right side a removal, unequal hashes a
change. All consecutive pairs are compared by one join, because the pair number
is part of the join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MOMENT_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]",
)


def moment(text: Column) -> Column:
    """The instant an ISO-like text means, null where it means none."""
    clean = F.trim(text)
    return F.coalesce(F.try_to_timestamp(clean), *[F.try_to_timestamp(clean, F.lit(f)) for f in _MOMENT_FORMATS])


def blank_to_empty(text: Column) -> Column:
    """Outer whitespace removed; null becomes the empty text."""
    return F.coalesce(F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", ""), F.lit(""))


def canonical_hash(texts: Sequence[str] = (), sets: Sequence[str] = (), numbers: Sequence[str] = ()) -> Column:
    """128-bit hash of a row whose fields are brought to one spelling: texts are
    trimmed, arrays count as sets of trimmed non-blank texts, and null, blank and
    empty are the same."""
    parts = [blank_to_empty(F.col(c)) for c in texts]
    for c in sets:
        items = F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), blank_to_empty)
        parts.append(F.concat_ws("\x1f", F.array_sort(F.array_distinct(F.filter(items, lambda x: x != "")))))
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in numbers]
    return F.md5(F.concat_ws("\x1e", *parts))


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; partial aggregation
    runs before the shuffle, so repeated rows of a hot key meet on the map side."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_v")).select(*keys, "_v.*")


def snapshot_changes(rows: DataFrame, version: str, at: Column, keys: Sequence[str], row_hash: str) -> DataFrame:
    """Changes between each two consecutive versions.

    ``rows`` holds one row per version and key with its canonical hash. Versions
    are ordered by the earliest moment ``at`` of their rows, then by name; a
    version without a readable moment comes first. Out come from_version,
    to_version, the keys and change_kind. No version or one version gives no row.
    """
    order = rows.groupBy(version).agg(F.min(at).alias("_at"))
    # one row per delivered snapshot, never per record: this window is over the list of versions only
    ranked = order.withColumn("_n", F.row_number().over(Window.orderBy(F.col("_at").asc_nulls_first(), F.col(version))))
    ranked = ranked.select(F.col(version), "_n", F.lead(version).over(Window.orderBy("_n")).alias("_next"), F.lag(version).over(Window.orderBy("_n")).alias("_prev"))
    named = ranked.withColumnRenamed(version, "_version")
    numbered = rows.join(named, F.col(version).eqNullSafe(F.col("_version"))).select("_n", "_version", "_next", "_prev", *keys, row_hash)
    side = lambda tag, pair: [pair.alias(f"_{tag}_pair"), *[F.col(k).alias(f"_{tag}_{k}") for k in keys], F.col(row_hash).alias(f"_{tag}_hash")]
    old = numbered.where(F.col("_next").isNotNull()).select(*side("o", F.col("_n")), F.lit(True).alias("_old"))
    new = numbered.where(F.col("_prev").isNotNull()).select(*side("n", F.col("_n") - 1), F.lit(True).alias("_new"))
    on = [F.col("_o_pair") == F.col("_n_pair"), *[F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys]]
    both = old.join(new, on=on, how="full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_o_hash") != F.col("_n_hash"), "changed")
    changes = both.select(
        F.coalesce("_o_pair", "_n_pair").alias("_pair"),
        *[F.when(F.col("_old").isNull(), F.col(f"_n_{k}")).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys],
        kind.alias("change_kind"),
    ).where(F.col("change_kind").isNotNull())
    pairs = ranked.select(F.col("_n").alias("_pair"), F.col(version).alias("from_version"), F.col("_next").alias("to_version"))
    return changes.join(pairs, "_pair").select("from_version", "to_version", *keys, "change_kind")


def package_list_changes(kb: DataFrame) -> DataFrame:
    """Packages added, removed or changed between consecutive knowledge-base
    snapshots. A package is ecosystem and package, trimmed and in lower case; of
    several rows of one snapshot the greatest ``row_id`` counts."""
    key = lambda c: F.lower(blank_to_empty(F.col(c)))
    flat = kb.select(
        "row_id",
        "db_version",
        moment(F.col("updated_at")).alias("_at"),
        key("ecosystem").alias("ecosystem"),
        key("package").alias("package"),
        canonical_hash(("pkg_version", "license"), ("algorithms",), ("n_vulnerable", "n_partial", "n_safe", "n_unknown")).alias("_hash"),
    )
    current = latest_rows(flat, ["db_version", "ecosystem", "package"], "row_id", ["_hash", "_at"])
    return snapshot_changes(current, "db_version", F.col("_at"), ["ecosystem", "package"], "_hash")
