"""Session helpers: a configured session, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lociq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own master is kept."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # What ``cut`` wrote goes when no plan needs it any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that a lost
    executor costs no recomputation and two passes see the same partitions.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset (tests)
    is one made on this machine.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "lociq-checkpoint"))
    return df.checkpoint(eager=True)
