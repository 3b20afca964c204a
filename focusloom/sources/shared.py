"""Tables written below ``spark.checkpoint.dir``, to cut lineage and work things out once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the folder that all executors share, and returns what is read back."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/focusloom-shared"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
