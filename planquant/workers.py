"""What runs need of a session: Python workers that find this package, and a folder where plans are cut."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it (or from what was shipped to them)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder (`spark.checkpoint.dir`); only a session that runs in one process may name none."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        known = tempfile.mkdtemp(prefix="planquant-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder, so that what follows neither plans nor computes them again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cut, and of a size that the optimizer knows, so that joins with few rows shuffle nothing."""
    at = f"{checkpoint_folder(df.sparkSession)}/planquant-kept-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
