"""Tables by file name suffix."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rstrip("/").rsplit("/", 1)[-1] else ""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, CSV (header, quotes, line breaks in quotes), or JSON lines (a broken line fails). Give a schema for the text formats at scale: without one
    a pass over the data infers it."""
    kind = suffix(path)
    if kind not in ("parquet", "pq", "csv", "txt", "jsonl", "json"):
        raise ValueError(f"no reader for {path!r}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("parquet", "pq"):
        return reader.parquet(path)
    if kind in ("csv", "txt"):
        return (reader if schema is not None else reader.option("inferSchema", True)).options(**CSV).csv(path)
    return reader.option("mode", "FAILFAST").json(path)


def read_review(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A review table; an empty one where there is no file."""
    return read_table(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """Written in the format of the suffix; ``by`` partitions the folder (one folder a source)."""
    kind = suffix(path)
    out = df.write.mode(mode)
    out = out.partitionBy(by) if by else out
    if kind in ("parquet", "pq"):
        out.parquet(path)
    elif kind in ("csv", "txt"):
        out.options(header=True, quote='"', escape='"').csv(path)
    elif kind in ("jsonl", "json"):
        out.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no writer for {path!r}")


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows, written once to the folder that the cluster names in spark.checkpoint.dir and read from there; ``by`` partitions it. Where there is none (one
    machine), a temporary folder is set."""
    sc = df.sparkSession.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
        top = sc.getCheckpointDir()
    path = f"{top.rstrip('/')}/textquarry-staged-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    write_table(read_table(spark, source), target)


def source_file_name(source: str) -> str:
    return source.replace("/", "_") + ".parquet"
