"""Readers and writers by file suffix, and the file-set operations around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON: an array of records, or one."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """A record per line; blank lines are skipped."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def read_text(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """Each file as one string."""
    return spark.read.text(path, wholetext=True)


def read_lines(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """Raw lines, also of CSV files."""
    return spark.read.text(path)


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header as records."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


READERS = {
    "csv": read_lines,
    "json": read_json,
    "jsonl": read_jsonl,
    "txt": read_text,
    "log": read_text,
    "parquet": lambda spark, path, schema=None: spark.read.parquet(*([path] if isinstance(path, str) else path)),
}


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By suffix; KeyError for others."""
    return READERS[suffix(path)](spark, path, schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A record per line, letters of all scripts as they are."""
    df.write.mode(mode).json(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON array from a partition's records, batch by batch; none without records."""
    lead = "["
    for b in batches:
        lines = []
        for record in b["r"].to_pylist():
            lines.append(lead + record)
            lead = ","
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    if lead == ",":
        yield pa.RecordBatch.from_pydict({"value": ["]"]})


def write_json(df: DataFrame, path: str, mode: str = "overwrite", indent: int | None = None, single: bool = False) -> None:
    """Documents that hold an array of records: each task writes one of its own, in the order of its rows and a batch at a time, and
    :func:`read_json` reads the folder as one table. An empty table has no document. ``single`` puts all rows into one document, which one task then writes."""
    options = {"pretty": "true"} if indent else {}
    rows = df.select(F.to_json(F.struct("*"), options).alias("r"))
    (rows.coalesce(1) if single else rows).mapInArrow(_documents, "value string").write.mode(mode).text(path)


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).text(path)


WRITERS = {"json": write_json, "jsonl": write_jsonl, "txt": write_text, "csv": write_text, "parquet": lambda df, path, mode="overwrite": df.write.mode(mode).parquet(path)}


def write_any(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By suffix; KeyError for others."""
    WRITERS[suffix(path)](df, path, mode)


def append_rows(df: DataFrame, path: str) -> None:
    """Add records to JSON lines; the commit protocol takes the place of a file lock."""
    write_jsonl(df, path, "append")


# File systems --------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; empty when there is none."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def convert_jsonl(spark: SparkSession, source: str, target: str, drop_source: bool = True) -> None:
    """JSON lines to JSON documents; the source goes after the target is committed."""
    write_json(read_jsonl(spark, source), target)
    if drop_source:
        remove(spark, source)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def combine_prefixed(spark: SparkSession, folder: str, prefix: str, n: int | None = None, numbered_only: bool = False, existing: str | None = None) -> DataFrame:
    """The records of the first ``n`` files, by name, that begin with ``prefix_`` (numbered_only:
    ``prefix_<digits>.json`` alone), then those of ``existing``."""
    pattern = re.compile(rf"{re.escape(prefix)}_\d+\.json") if numbered_only else re.compile(rf"{re.escape(prefix)}_.*")
    names = [x for x in list_names(spark, folder) if pattern.fullmatch(x)][:n]
    paths = [f"{folder}/{x}" for x in names] + ([existing] if existing and exists(spark, existing) else [])
    if not paths:
        raise FileNotFoundError(f"no {prefix}_ files in {folder}")
    return _union([read_any(spark, p) for p in paths])


def combine_folders(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """The records of files that all folders have, by name."""
    common = set.intersection(*(set(list_names(spark, f)) for f in folders)) if folders else set()
    return {x: _union([read_any(spark, f"{f}/{x}") for f in folders]) for x in sorted(common)}


def merge_parts(spark: SparkSession, pattern: str, schema=None) -> DataFrame:
    """Chunk outputs that match a glob pattern, as one table."""
    return read_jsonl(spark, pattern, schema)
