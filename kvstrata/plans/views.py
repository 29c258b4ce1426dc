"""Spark SQL over the logs and metadata: temporary views of one data directory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kvstrata.operators.manifest import latest_files
from kvstrata.operators.read import visible
from kvstrata.sources.kv import events_with_files, kv_orders
from kvstrata.sources.tables import table

#: Tables that become views under their own names.
PLAIN = ("kv_log", "edits", "ingest_runs", "filter_blocks", "probe_keys", "column_families", "level_targets")


def register(spark: SparkSession, d: str) -> list[str]:
    """Create the views and return their names: ``kv`` and ``kv_orders`` (versions), ``kv_live`` (newest visible entries), ``files`` (latest revisions), and the plain tables."""
    kv = events_with_files(spark, d, 0)
    views = {"kv": kv, "kv_orders": kv_orders(spark, d), "kv_live": visible(kv), "files": latest_files(table(spark, d, "files"))}
    views |= {name: table(spark, d, name) for name in PLAIN}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
