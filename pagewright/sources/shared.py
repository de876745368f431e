"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20

#: Folders of applications without one.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a fresh folder of this machine, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        name = spark.sparkContext.applicationId
        found = _own[name] = _own.get(name) or "file://" + tempfile.mkdtemp(prefix="pagewright-")
    return found.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/pagewright/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str, compression: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    write = df.write.option("maxRecordsPerFile", rows_per_file)
    (write.option("compression", compression) if compression else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that sends rows to Python in batches of bounded bytes, not only of bounded rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        path = f.rpartition("/")[0]
        if "/pagewright/" in path:
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has in the shared folder, at its end: results that still read them fail afterwards."""
    _delete(spark, shared_path(spark, "x").rpartition("/")[0])
