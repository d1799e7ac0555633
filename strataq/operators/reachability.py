"""Which findings a call graph reaches, by frontier joins from its entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import text
from strataq.materialize import Scratch


def distances(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """edges: (graph, caller, callee); entries: (graph, node). Out: (graph, node,
    nodes_on_path), the least number of nodes on a path from any entry, 1 for an
    entry itself. Each round joins only the nodes reached last; cycles end as
    nothing new is reached."""
    scratch = Scratch(edges.sparkSession, "reachability")
    links = scratch.put(edges.where("caller is not null and callee is not null").select("graph", "caller", "callee").distinct())
    seen = scratch.put(entries.select("graph", "node", F.lit(1).cast("bigint").alias("nodes_on_path")).distinct())
    reached, last, n = seen, seen, 1
    while True:
        n += 1
        step = last.select(F.col("graph").alias("_g"), F.col("node").alias("_n")).join(links, (F.col("graph") == F.col("_g")) & (F.col("caller") == F.col("_n")))
        new = step.select("graph", F.col("callee").alias("node")).distinct().join(reached.select("graph", "node"), ["graph", "node"], "left_anti")
        last = scratch.put(new.select("graph", "node", F.lit(n).cast("bigint").alias("nodes_on_path")))
        if not last.head(1):
            return reached
        reached = reached.unionByName(last)


def classify_findings(findings: DataFrame, reached: DataFrame) -> DataFrame:
    """findings: (graph, node, ..). CONFIRMED within two nodes of an entry,
    REACHABLE further away, else AVAILABLE."""
    d = reached.select(F.col("graph").alias("_g"), F.col("node").alias("_n"), "nodes_on_path")
    out = findings.join(d, (F.col("graph") == F.col("_g")) & (F.col("node") == F.col("_n")), "left").drop("_g", "_n")
    kind = F.when(F.col("nodes_on_path").isNull(), "AVAILABLE").when(F.col("nodes_on_path") <= 2, "CONFIRMED").otherwise("REACHABLE")
    return out.withColumn("reached", kind)


def traces(edges: DataFrame, entries: DataFrame, sites: DataFrame) -> DataFrame:
    """One shortest path from every entry to every site it reaches. sites: (graph,
    node, ..); out: its columns with entry_point, call_steps (both ends among them),
    target_func and target_pkg. Each round extends the paths to nodes that their
    entry reached last, so cycles end; of equally short paths the least counts."""
    scratch = Scratch(edges.sparkSession, "traces")
    links = scratch.put(edges.where("caller is not null and callee is not null").select("graph", F.col("caller").alias("node"), "callee").distinct())
    last = scratch.put(entries.select("graph", F.col("node").alias("entry_point"), "node", F.array("node").alias("call_steps")).distinct())
    reached = last
    while last.head(1):
        step = last.join(links, ["graph", "node"]).select("graph", "entry_point", F.col("callee").alias("node"), F.array_append("call_steps", F.col("callee")).alias("call_steps"))
        new = step.groupBy("graph", "entry_point", "node").agg(F.min("call_steps").alias("call_steps"))
        last = scratch.put(new.join(reached.select("graph", "entry_point", "node"), ["graph", "entry_point", "node"], "left_anti"))
        reached = reached.unionByName(last)
    found = sites.distinct().join(reached, ["graph", "node"])
    return found.withColumn("target_func", F.col("node")).withColumn("target_pkg", text.call_package(F.col("node")))


def count_classes(classified: DataFrame, *keys: str) -> DataFrame:
    """Findings by class of reachability."""
    of = lambda c: F.count_if(F.col("reached") == c)
    return classified.groupBy(*keys).agg(of("CONFIRMED").alias("confirmed"), of("REACHABLE").alias("reachable"), of("AVAILABLE").alias("available"))


def classify_by_algorithm(findings: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Findings by the traces of their algorithm, exactly spelled: CONFIRMED if any
    has at most two steps, REACHABLE if there is any, else AVAILABLE."""
    least = found.groupBy(*keys, "algorithm").agg(F.min(F.size("call_steps")).alias("_n"), F.count("*").alias("traces"))
    kind = F.when(F.col("_n").isNull(), "AVAILABLE").when(F.col("_n") <= 2, "CONFIRMED").otherwise("REACHABLE")
    return findings.join(least, [*keys, "algorithm"], "left").withColumn("reached", kind).withColumn("traces", F.coalesce("traces", F.lit(0))).drop("_n")
