"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracemill-")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. In local mode, where all run on one machine, a temporary one
    where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, kind: str = "tables") -> DataFrame:
    """``df`` as a written table: computed once, the same for all that read it, and there after executors are lost."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
