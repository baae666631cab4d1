"""Results that are computed once and read several times."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder, without lineage.

    The folder is the one that spark.checkpoint.dir names; only a local session without one (as in tests) gets a temporary one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            import tempfile

            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
