"""Session settings the library relies on, and where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffles at run time and splits skewed join partitions; forcing the split lets it
# happen even where it costs one more exchange.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere (a cluster's own session)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_ready(spark: SparkSession, required: bool = False) -> bool:
    """True when ``checkpoint()`` may be used: a folder is set or named in ``spark.checkpoint.dir``.
    Only a local session, where every task shares one disk, gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="checkpoint-")
        if named is not None:
            sc.setCheckpointDir(named)
    ready = sc.getCheckpointDir() is not None
    if required and not ready:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return ready


#: Where tables written by ``keep`` lie, oldest first.
_KEPT: list[str] = []


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several later steps read, and read it back. It cuts the lineage, survives
    lost executors, and unlike a checkpoint keeps column pruning, filters at the scan and sizes.
    It lies in the shared folder of ``checkpoint_ready``, under a name of its own, until ``drop_kept``.
    Zstandard writes less than Snappy, and from the heap: Snappy's buffers lie outside of it and stay
    until the next full collection."""
    spark = df.sparkSession
    checkpoint_ready(spark, required=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_tables() -> list[str]:
    """Where the tables lie that ``keep`` has written and ``drop_kept`` has not deleted."""
    return list(_KEPT)


def drop_kept(spark: SparkSession, paths, but: DataFrame | None = None) -> None:
    """Delete kept tables that are no longer needed: those of ``paths`` that ``but`` does not read."""
    read = but.inputFiles() if but is not None and paths else []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        bare = hadoop.Path(path).toUri().getPath()
        if path in _KEPT and not any(f"{bare}/" in f for f in read):
            hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop.Path(path), True)
            _KEPT.remove(path)
