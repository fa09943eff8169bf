"""Where a session keeps what streams and checkpoints leave."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the cluster shares; only a session of one machine may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="loomcast-"))
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def reach_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package; on a cluster it is installed or sent by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
