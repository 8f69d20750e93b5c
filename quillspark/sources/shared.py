"""Tables of the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a checkpoint in the folder that spark.checkpoint.dir names (a temporary one where it is
    unset and the driver is the only executor): what reads it several times doesn't derive it again, and it
    survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint()


def portions(batches, rows: int = 200):
    """Arrow batches in portions of so many rows: what Python holds of a batch, and makes of it, stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
