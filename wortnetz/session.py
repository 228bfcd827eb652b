"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Fixed values that results depend on, and adaptive execution, which deals with skew and small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` names are written with _ for a dot."""
    builder = SparkSession.builder.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where a session names none, a temporary folder serves, but only on a local master.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wortnetz-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: iterations neither repeat earlier steps nor depend on executors that
    hold them. Spark deletes the files when nothing refers to them, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
