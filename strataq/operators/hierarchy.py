"""Parent-child rows of unknown depth as full hierarchies.

Frontier joins start from the tops and attach, round by round, the rows whose
chain of parents reaches an attached row. With ``widen`` a round attaches a band of
levels, as wide as all bands before it together (1, 2, 4, ... levels), because rows
not yet attached keep the link that spans all levels tried so far: depth d is
reached after log2(d) + 1 joins. Without it a round attaches one level, as the plain
method does, and takes d joins. Either way a round that attaches nothing proves that
what is left lies on a cycle or below one: by induction, after r rounds every row at
a depth the rounds span (2 ** r - 1, or r) is attached, so if any row had a top above
it, the one of them nearest to an attached row would have been attached.

Only rows that have children take part in the rounds; all others hang on their
parent by one last join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.materialize import Scratch
from strataq.skew import look_up


def _key(text: Column) -> Column:
    return F.lower(F.trim(text))


def _blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^\s*$")


def link_nodes(rows: DataFrame, row_id: str, scope: str, name: str, parent: str) -> DataFrame:
    """Rows with scope, own key (k1, k2) and parent key (p1, p2), each a 128-bit hash
    of scope and name. Names compare within a scope, outer spaces and letter case
    aside. A null name is a name of its own kind, rows without a scope form one."""

    def key(text: Column, null: Column, which: int) -> Column:
        return F.xxhash64(F.lit(which), F.col(scope), F.col(scope).isNull(), _key(text), null)

    child, up = F.col(name), F.col(parent)
    return rows.select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.col(scope).alias("scope"),
        *[key(child, child.isNull(), i).alias(f"k{i}") for i in (1, 2)],
        *[F.when(~_blank(up), key(up, F.lit(False), i)).alias(f"p{i}") for i in (1, 2)],
    )


def _segments(nodes: DataFrame, with_path: bool) -> DataFrame:
    """State of a round: ``up`` is the node that ``span`` links lead to, ``done``
    says that it is a top, ``low`` is the least node of the span without ``up``."""
    done = F.col("up").isNull()
    cols = [F.col("node"), F.coalesce("up", "node").alias("up"), F.when(done, 0).otherwise(1).cast("bigint").alias("span"), done.alias("done"), F.col("node").alias("low")]
    if with_path:
        cols.append(F.when(done, F.array().cast("array<bigint>")).otherwise(F.array("node")).alias("chain"))
    return nodes.select(*cols)


def _advance(state: DataFrame, waiting: DataFrame, with_path: bool) -> DataFrame:
    """Every waiting row takes over the span of the row it points to."""
    t = state.select(F.col("node").alias("_t"), F.col("up").alias("_up"), F.col("span").alias("_span"), F.col("done").alias("_done"), F.col("low").alias("_low"), *([F.col("chain").alias("_chain")] if with_path else []))
    cols = ["node", F.col("_up").alias("up"), (F.col("span") + F.col("_span")).alias("span"), F.col("_done").alias("done"), F.when(F.col("_span") > 0, F.least("low", "_low")).otherwise(F.col("low")).alias("low")]
    if with_path:
        cols.append(F.concat("chain", "_chain").alias("chain"))
    return waiting.join(t, F.col("up") == F.col("_t")).select(*cols)


def resolve_links(links: DataFrame, with_path: bool = False, widen: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes of the rows of ``link_nodes``: (k1, k2, n, node) and (node, root,
    depth[, chain]).

    Rows of one scope and key are one node, known by its least row_id, whose
    parent counts. A node whose parent is null, blank or absent from its scope is
    a top: root itself, depth 0. On a cycle or below one, root is the least node
    on that cycle and depth is -1. ``chain`` holds the nodes from the node itself
    up to below the root; of depth -1 it is empty.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    named = links.groupBy("k1", "k2").agg(F.min("row_id").alias("node"), F.min_by(F.struct("p1", "p2"), "row_id").alias("p"), F.first("scope").alias("scope"), F.count("*").alias("n"))
    named = scratch.put(named.select("k1", "k2", "node", "scope", "n", "p.*"))
    parents = named.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("up"))
    # rows without a parent are tops at once; joined, they would all be one key
    columns = ["k1", "k2", "node", "scope", "n"]
    linked = named.where("p1 is not null").join(parents, ["p1", "p2"], "left").select(*columns, "up")
    nodes = scratch.put(linked.unionByName(named.where("p1 is null").select(*columns, F.lit(None).cast("bigint").alias("up"))))
    scratch.drop(named)
    inner = nodes.join(nodes.select(F.col("up").alias("_p")).where("_p is not null").distinct(), F.col("node") == F.col("_p"), "left_semi")
    state = scratch.put(_segments(inner, with_path))
    attached = [state.where("done")]
    waiting = state.where("not done")
    left = waiting.count()
    kept = [state]
    front = attached[0]
    while left:
        if widen:
            moved = scratch.put(_advance(state, waiting, with_path))
            waiting = moved.where("not done")
            # a pointer of a waiting row leads to an inner row; those that stay put are the tops
            state = _all([*attached, moved.where("done")]).unionByName(waiting)
        else:
            moved = scratch.put(_advance(front, waiting, with_path).unionByName(waiting.join(front.select(F.col("node").alias("up")), "up", "left_anti").select(waiting.columns)))
            waiting, front = moved.where("not done"), moved.where("done")
        kept.append(moved)
        attached.append(moved.where("done"))
        still = waiting.count()
        if still == left:
            break
        left = still
    tops = _all(attached).select("node", F.col("up").alias("root"), F.col("span").alias("depth"), *(["chain"] if with_path else []))
    if left:
        tops = tops.unionByName(_cycles(scratch, nodes, waiting, with_path))
    inner_done = scratch.put(tops)
    scratch.drop(*kept)
    outer = nodes.join(inner_done.select("node"), "node", "left_anti")
    lifted = outer.join(inner_done.withColumnRenamed("node", "_p"), F.col("up") == F.col("_p"), "left").select(
        "node",
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("_p").isNull(), 0).when(F.col("depth") < 0, -1).otherwise(F.col("depth") + 1).cast("bigint").alias("depth"),
        *([F.when(F.col("_p").isNull() | (F.col("depth") < 0), F.array().cast("array<bigint>")).otherwise(F.concat(F.array("node"), "chain")).alias("chain")] if with_path else []),
    )
    return nodes, inner_done.unionByName(lifted)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cycles(scratch: Scratch, nodes: DataFrame, waiting: DataFrame, with_path: bool) -> DataFrame:
    """Rows never attached: spans go on doubling until they exceed the number of
    unattached rows of the largest scope, hence every tail and cycle length; the
    row pointed to is then on the cycle and the least of its span is the least of
    the cycle."""
    spans = waiting.select("node", "up", "span", "done", "low")
    most = spans.join(nodes.select("node", "scope"), "node").groupBy("scope").count().agg(F.max("count")).first()[0]
    start = spans.agg(F.max("span")).first()[0]
    for _ in range(max(1, math.ceil(math.log2(most + 1)) - int(math.log2(max(1, start))) + 1)):
        grown = scratch.put(_advance(spans, spans, False))
        scratch.drop(spans)
        spans = grown
    low = spans.select(F.col("node").alias("_t"), F.col("low").alias("root"))
    out = spans.join(low, F.col("up") == F.col("_t")).select("node", "root", F.lit(-1).cast("bigint").alias("depth"))
    return out.withColumn("chain", F.array().cast("array<bigint>")) if with_path else out


def hierarchy(rows: DataFrame, row_id: str, scope: str, name: str, parent: str, with_path: bool = False, widen: bool = True) -> DataFrame:
    """One row per input row: row_id, node, root, depth, has_parent[, chain]. Empty
    input gives an empty result. Repeated row ids are allowed: each row comes out.
    A name that a third of all rows have is looked up by a broadcast of its node."""
    links = link_nodes(rows, row_id, scope, name, parent)
    nodes, solved = resolve_links(links, with_path, widen)
    chain = ["chain"] if with_path else []
    numbered = Scratch(rows.sparkSession, "numbered").put(nodes.join(solved, "node").select("k1", "k2", "n", "node", "root", "depth", *chain))
    return look_up(links, numbered, ["k1", "k2"], "n").select("row_id", "node", "root", "depth", F.col("p1").isNotNull().alias("has_parent"), *chain)


def descendants(solved: DataFrame) -> DataFrame:
    """(ancestor, node, links) of every pair, from chains: one row per node and
    ancestor, so as many as the sum of depths. A node is no descendant of itself."""
    up = F.concat(F.slice("chain", 2, F.greatest(F.size("chain"), F.lit(1))), F.array("root"))
    pairs = solved.where("depth > 0").select("node", F.posexplode(up).alias("_i", "ancestor"))
    return pairs.select("ancestor", "node", (F.col("_i") + 1).cast("bigint").alias("links"))
