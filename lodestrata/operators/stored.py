"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there: what follows sees the same rows however often it
    reads them, and a lost executor costs no recomputation.

    The folder is the one that the session names in spark.checkpoint.dir. Only a local session may do without: it takes a
    temporary folder of its own. Elsewhere a missing setting is an error, as executors share no local folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a shared folder for checkpoints")
            where = tempfile.mkdtemp(prefix="lodestrata-")
        sc.setCheckpointDir(where)
    return df.checkpoint()
