"""Folders for what a stream or a stored table needs: below the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one of our own in local mode alone: on a cluster executors
    couldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="daybook-checkpoints-"))
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run."""
    return f"{shared_folder(spark)}/daybook-{name}-{uuid.uuid4().hex}"
