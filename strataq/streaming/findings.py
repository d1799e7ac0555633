"""The inventory over a stream of dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataq.operators import inventory


def stream_findings(deps: DataFrame, kb: DataFrame) -> DataFrame:
    """Findings of a streaming DataFrame of dependencies against a static
    knowledge base: a stateless stream-static join."""
    index = inventory.index_kb(kb)
    return inventory.findings(inventory.lookup(deps, index), "scan_id", "dep_seq")


def stream_summary(deps: DataFrame, kb: DataFrame, event_time: str, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Counters per window of event time; dependencies later than the watermark
    are left out."""
    found = inventory.lookup(deps.withWatermark(event_time, late), inventory.index_kb(kb))
    n = F.coalesce(F.size(F.filter("usages", lambda u: u["quantum_risk"] == "VULNERABLE")), F.lit(0))
    return found.groupBy(F.window(event_time, every)).agg(F.count("*").alias("total"), F.sum(F.when(F.col("usages").isNull(), 0).otherwise(n)).alias("vulnerable"), F.count_if(~F.col("in_database")).alias("not_in_database"))


def write_findings(deps: DataFrame, kb: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends findings to a folder of parquet files, each batch exactly once."""
    return stream_findings(deps, kb).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
