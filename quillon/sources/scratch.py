"""Folders for what an operator writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from quillon.sources.files import qualified


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests), where that setting is absent, a folder is made and set; on a cluster
    its absence is an error, since executors do not share a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{qualified(spark, base).rstrip('/')}/quillon-{name}-{uuid.uuid4().hex[:12]}"
