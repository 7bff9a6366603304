"""Tables in the cluster's shared folder, which cut lineage: a lost executor costs a re-read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read back; only a local master, whose tasks see the
    driver's disk, may go without one."""
    spark = df.sparkSession
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{folder or tempfile.mkdtemp(prefix='millrace-')}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
