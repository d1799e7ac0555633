"""Filling containers of fixed capacity by minimum bin slack.

Items of one length are interchangeable, so the search works on the histogram of
lengths, which has at most as many rows as the capacity, whatever the corpus. Per
container the longest length left is set, then subset sums over the lengths
available (bitsets, one bit per fill level) find the fullest combination; it is
taken off the histogram as often as the counts allow. A combination uses up at
least one length below its own need, so there are at most capacity * ln(capacity)
combinations. Items then find their container through their rank within their
length. No item is split unless it exceeds the capacity; then it gives full
pieces and a remainder. Items of length 0 are spread over the containers, after
the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ranks of a length are counted in so many independent parts, so that a length
#: shared by a third of all items is never sorted in one task
RANK_PARTS = 1024


def fullest(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths and how many of each fill ``capacity`` best together with one item
    of the greatest length; exact for that choice of the first item."""
    first = max(counts)
    room, mask = capacity - first, (1 << (capacity - first + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        n = min(counts[length] - (length == first), room // length)
        part = 1
        while n > 0 and not reach >> room & 1:
            take = min(part, n)
            steps.append((reach, length, take))
            reach |= (reach << length * take) & mask
            n -= take
            part *= 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    chosen = {first: 1}
    for before, length, take in reversed(steps):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + take
            fill -= length * take
    return chosen


def plan(capacity: int, histogram: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, ranks, first container, items of the length
    per container, first place) that assign every rank of every length. Length 0
    gets one segment that names the number of containers."""
    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    assert all(n <= capacity for n in left)
    used: dict[int, int] = dict.fromkeys(left, 0)
    out, container = [], 0
    while left:
        combination = fullest(capacity, left)
        times = min(left[n] // u for n, u in combination.items())
        place = 0
        for n, u in sorted(combination.items(), reverse=True):
            out.append((n, used[n], times * u, container, u, place))
            used[n] += times * u
            left[n] -= times * u
            if not left[n]:
                del left[n]
            place += u
        container += times
    if histogram.get(0):
        out.append((0, 0, histogram[0], 0, max(container, 1), capacity))
    return out


def pieces(sizes: DataFrame, id_col: str, size_col: str, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """(capacity_id, capacity, id, piece, size): each item once per capacity; one
    that exceeds it as full pieces and a remainder. Null sizes count as 0."""
    options = F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities])
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    each = sizes.select(F.col(id_col).alias("_id"), n.alias("_n"), F.explode(options).alias("_c")).select("_id", "_n", "_c.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / F.col("capacity")) - 1).cast("int")
    split = each.select("capacity_id", "capacity", "_id", "_n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return split.select("capacity_id", "capacity", F.col("_id").alias(id_col), "piece", F.least(F.col("capacity"), F.col("_n") - F.col("piece") * F.col("capacity")).alias("size"))


def pack(sizes: DataFrame, id_col: str, size_col: str, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """(capacity_id, container_id, place, id, piece, size) of every item or piece.
    Containers and places count from 0. Repeated ids are packed as often as they
    come. ``capacities`` is a short list of (id, capacity > 0)."""
    items = pieces(sizes, id_col, size_col, capacities)
    keys = ["capacity_id", "size", "_part"]
    items = items.withColumn("_part", F.pmod(F.xxhash64(id_col, "piece"), F.lit(RANK_PARTS)))
    counts = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    histogram = counts.groupBy("capacity_id", "size").agg(F.sum("_n").alias("n"))
    bound = dict(capacities)

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = plan(bound[int(key[0])], dict(zip(pdf["size"].astype(int), pdf["n"].astype(int))))
        return pd.DataFrame([(int(key[0]), *r) for r in rows], columns=["capacity_id", "size", "rank", "n", "container", "per", "place"])

    # at most capacity rows go into a task, at most capacity * ln(capacity) combinations come out
    planned = histogram.groupBy("capacity_id").applyInPandas(solve, "capacity_id int, size bigint, rank bigint, n bigint, container bigint, per bigint, place bigint")
    # a combination of k different lengths fills at least k * (k + 1) / 2, so it has at most
    # sqrt(2 * capacity) segments: the list that comes to the driver is bounded by the capacity
    segments = planned.toPandas().sort_values(["capacity_id", "size", "rank"])
    tables = {k: tuple(g[c].to_numpy() for c in ("rank", "container", "per", "place")) for k, g in segments.groupby(["capacity_id", "size"])}
    shared = sizes.sparkSession.sparkContext.broadcast(tables)

    before = F.sum("_n").over(Window.partitionBy("capacity_id", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = items.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(id_col, "piece")))
    ranked = ranked.join(offsets, keys).select("capacity_id", id_col, "piece", "size", (F.col("_before") + F.col("_row") - 1).alias("rank"))
    columns = ranked.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            capacity, size, rank = (b.column(columns.index(c)).to_numpy(zero_copy_only=False) for c in ("capacity_id", "size", "rank"))
            container, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            kinds, which = np.unique(np.stack([capacity.astype(np.int64), size]), axis=1, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            ends = np.searchsorted(which.ravel()[order], np.arange(kinds.shape[1] + 1))
            for k in range(kinds.shape[1]):
                rows = order[ends[k] : ends[k + 1]]
                r, c, per, first = shared.value[(int(kinds[0, k]), int(kinds[1, k]))]
                s = np.searchsorted(r, rank[rows], side="right") - 1
                at = rank[rows] - r[s]
                if kinds[1, k] == 0:  # round robin behind the containers' own items
                    container[rows], place[rows] = at % per[s], first[s] + at // per[s]
                else:
                    container[rows], place[rows] = c[s] + at // per[s], first[s] + at % per[s]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(container), pa.array(place)], names=[*columns[:4], "container_id", "place"])

    kind = dict(ranked.dtypes)
    out = ranked.mapInArrow(assign, ", ".join(f"`{c}` {kind[c]}" for c in columns[:4]) + ", container_id bigint, place bigint")
    return out.select("capacity_id", "container_id", "place", id_col, "piece", "size")


def slack(packed: DataFrame, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """(capacity_id, capacity, containers, least, unused, overfull): the containers
    used, the least number that the total would fill, the unused tokens, and the
    containers filled beyond the capacity (none)."""
    bound = F.create_map(*[F.lit(x).cast("bigint") for kv in capacities for x in kv])
    fill = packed.groupBy("capacity_id", "container_id").agg(F.sum("size").alias("_fill")).withColumn("capacity", F.element_at(bound, F.col("capacity_id").cast("bigint")))
    out = fill.groupBy("capacity_id", "capacity").agg(F.count("*").alias("containers"), F.sum("_fill").alias("_total"), F.count_if(F.col("_fill") > F.col("capacity")).alias("overfull"))
    return out.select("capacity_id", "capacity", "containers", F.ceil(F.col("_total") / F.col("capacity")).alias("least"), (F.col("containers") * F.col("capacity") - F.col("_total")).alias("unused"), "overfull")
