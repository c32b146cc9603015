"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word: a run of characters other than space and \t \n \v \f \r. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *taken: DataFrame) -> str:
    """name, with underscores before it until no column of `taken` has it in any case."""
    known = {c.lower() for df in taken for c in df.columns}
    while name.lower() in known:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs in one process
    (tests) a new local one. On a cluster it has to be set: executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read again if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df behind a checkpoint, which ends its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
