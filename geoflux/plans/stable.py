"""Frames whose row ids must not change between two uses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .shared import shared_dir


def stable(df: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the cluster's shared folder, so that ids given to rows survive the loss of an executor."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
