"""Collects queries and their SQL by name."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Iterative operators cut lineage with checkpoint(): in the folder of spark.checkpoint.dir, or a temporary one where that is unset and Spark
    runs on this machine alone; else a ValueError, as executors wouldn't share it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weft-"))


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f: Callable[[SparkSession, str], DataFrame]):
            @functools.wraps(f)
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                ensure_checkpoints(spark)
                return f(spark, sf_dir)

            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return put
