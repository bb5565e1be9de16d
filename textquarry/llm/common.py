"""What the operators of this subpackage share: tables, folders that all executors see, Arrow limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that very long texts don't gather in one batch of ten thousand rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir, which all executors share.

    Where the setting is missing (tests on one machine), a temporary folder is made and set.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="textquarry-")
        sc.setCheckpointDir(top)
        top = sc.getCheckpointDir()
    return f"{top.rstrip('/')}/textquarry-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """The rows, written to a shared table once and read from there: lineage ends here, lost executors lose nothing. ``scratch`` gets the table, for deletion."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        scratch.append(out)
    return out


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_names(columns: list[str], taken: Iterable[str] | None = None) -> dict[str, str]:
    """A name for each column that clashes with no other; only those in ``taken`` (whatever their case) are renamed if it is given."""
    low = None if taken is None else {t.lower() for t in taken}
    return {c: f"_own{k}" if low is None or c.lower() in low else c for k, c in enumerate(columns)}


def set_aside(df: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with its columns named as in ``taken`` under other names, and what gives a frame the input's columns back, unchanged and in their order."""
    names = fresh_names(df.columns, taken)
    return df.withColumnsRenamed({c: n for c, n in names.items() if c != n}), lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, A_Z, a_z)


def crc_mod(c: Column | str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % n


def batches(it: Iterator, cut: int = BATCH_BYTES) -> Iterator:
    """Record batches cut so that none holds much more than ``cut`` bytes (one very long row stays whole)."""
    for b in it:
        if b.num_rows <= 1 or b.nbytes <= 2 * cut:
            yield b
            continue
        step = max(1, b.num_rows * cut // b.nbytes)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def as_bytes(column) -> list[bytes | None]:
    """A string column's values as UTF-8, without decoding them."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
