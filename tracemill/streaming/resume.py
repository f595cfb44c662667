"""Files that arrive: the stream form of append and resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def arriving_records(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def process_once(records: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Transform every record whose key is not in ``target`` yet and append the results.

    The checkpoint remembers which files are done; the anti-join makes a batch that is run again after a
    failure leave out what it had already written."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates([key])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
            rows = rows.join(spark.read.parquet(target).select(key), key, "left_anti")
        transform(rows).write.mode("append").parquet(target)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
