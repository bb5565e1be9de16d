"""Markdown from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, limit: int = 200) -> str:
    """A summary table as Markdown, in the order of its columns."""
    rows = df.orderBy(*df.columns).limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def final(artifacts: dict[str, str], sections: dict[str, DataFrame]) -> str:
    lines = ["# Report", "", "## Artifacts", "", *(f"- {k}: {v}" for k, v in artifacts.items()), ""]
    for name, df in sections.items():
        lines += [f"## {name}", "", table(df), ""]
    return "\n".join(lines)


def write(spark, path: str, text: str) -> None:
    """One text file through Spark's file system, wherever the path is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
