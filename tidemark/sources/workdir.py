"""Where intermediate and derived files go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.  Where it is unset a temporary one
    is made, which only a local session may do, as its tasks share one machine."""
    path = spark.sparkContext.getConf().get(CONF) or spark.conf.get(CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CONF} has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(CONF, path)
    return path.rstrip("/")


def unused_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
