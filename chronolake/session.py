"""Session helpers: the shared scratch folder, table reading and the UTC rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a session without the setting (tests on one machine) gets a temporary folder.
    """
    global _local_dir
    path = spark.sparkContext.getConf().get(_CHECKPOINT_DIR) or spark.conf.get(_CHECKPOINT_DIR, None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that every executor can reach")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="chronolake-")
    return _local_dir


def temporary(spark: SparkSession, path: str) -> None:
    """Have a path of the shared folder deleted when the driver ends; until then results may read it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage for good."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    temporary(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least two tasks a core, for work that costs far more than moving its rows.

    Few scan tasks mean few rows, so only small inputs are ever moved; what many tasks read stays where it lies.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle, named to keep small but costly partitions from being joined."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, every timestamp as TIMESTAMP (the session zone is UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df
