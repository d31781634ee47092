"""Cut lineage with tables in the checkpoint folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from heliogale.plans.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.

    A checkpoint of a DataFrame would run its last stage twice; a written table does not, and it survives lost
    executors alike. Like checkpoints, the tables stay until the folder is cleared.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
