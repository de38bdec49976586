"""Cutting of lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored by ``checkpoint()``, in ``spark.checkpoint.dir`` or, if unset, a local folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pagemark-"))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` if it comes from fewer files than there are cores."""
    few = len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df
