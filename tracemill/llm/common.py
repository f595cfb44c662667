"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracemill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where all run on one machine, it may be unset: a temporary folder is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


def scratch(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, in folders ``by`` a column, and read it back.

    Cuts the lineage: a lost executor costs the tasks it was running, not the stages before,
    and a table read twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    for made in _temporary.get()[-1:]:
        made.append(out)
    return out


#: The tables made in each open block of :func:`only`, of this thread alone.
_temporary: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("temporary", default=())


@contextmanager
def only(name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a result; when the block is left, the tables made in it go, the result stays."""
    made: list[DataFrame] = []
    around = _temporary.get()
    before = _temporary.set((*around, made))
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(scratch(df, name))
        return kept[-1]

    try:
        yield keep
    finally:
        _temporary.reset(before)
        drop_scratch(*[t for t in made if all(t is not k for k in kept)])
        for outer in around[-1:]:
            outer.extend(kept)


def drop_scratch(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`scratch` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Rows hold whole texts, so Arrow batches are kept to 1000 of them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
