"""Session settings the engine relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of ours has; a cluster's own sizes are left alone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


#: Tables written by this process.
WRITTEN: list[str] = []


def get_session(app: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in conf.items()})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where it is unset on one machine (tests) a local folder is made; on a cluster that is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="scriptorium-checkpoint-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def drop_tables(spark: SparkSession) -> None:
    """Deletes what :func:`materialize` has written in this session, once its results are stored elsewhere."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while WRITTEN:
        at = hadoop(WRITTEN.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    ``by``: a column of few values; a filter on it reads only its own files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
