"""Exploratory tables: distributions, lengths, contingency, content words, histograms, samples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact_quantiles, finite
from ..functions.text import TECHNICAL_STOPWORDS, char_length, letter_runs, strip, text_of, word_count

NONE = "<NA>"


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(NONE)).alias(column)).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Long form of the zero-filled contingency table: every row value with every column value."""
    pair = df.select(F.coalesce(F.col(rows).cast("string"), F.lit(NONE)).alias(rows), F.coalesce(F.col(columns).cast("string"), F.lit(NONE)).alias(columns))
    counts = pair.groupBy(rows, columns).agg(F.count("*").alias("n"))
    # the frame is made of distinct values, not of rows; the side of column values is checked before it is sent
    frame = counts.select(rows).distinct().crossJoin(counts.select(columns).distinct())
    return frame.join(counts, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def crosstab_wide(df: DataFrame, rows: str, columns: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(rows), F.lit(NONE)).alias(rows)).pivot(columns).count().fillna(0)


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """feature, min, max, mean, median, std (population) of lengths in characters and words."""
    lengths = df.select(char_length(text).alias("chars"), word_count(text).alias("words"))
    medians = exact_quantiles(lengths, ["chars", "words"], [0.5])
    got = lengths.agg(*[f(c).alias(f"{c}_{n}") for c in ("chars", "words") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"), F.col(f"{c}_mean").alias("mean"), F.lit(medians[c][0]).cast("double").alias("median"), F.coalesce(f"{c}_std", F.lit(0.0)).alias("std")) for c in ("chars", "words")]
    return got.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def seed_role_counts(df: DataFrame, meta: str = "meta") -> DataFrame:
    """Non-blank ``seed_role`` strings in the JSON of ``meta``; numbers and broken JSON don't count."""
    v = F.try_variant_get(F.try_parse_json(meta), "$.seed_role", "variant")
    role = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(meta), "$.seed_role", "string"))
    return df.select(strip(role).alias("seed_role")).filter("seed_role is not null and seed_role <> ''").groupBy("seed_role").agg(F.count("*").alias("n"))


def stopwords(english: bool = True) -> set[str]:
    words = set(TECHNICAL_STOPWORDS)
    for language in ("russian", *(("english",) if english else ())):
        words |= {w.lower() for w in StopWordsRemover.loadDefaultStopWords(language)}
    return words


def top_words(df: DataFrame, text: str = "text", k: int = 20, min_length: int = 3, stop: set[str] | None = None, lemma: Callable[[str], str] | None = None) -> DataFrame:
    """The ``k`` most frequent words of Latin or Cyrillic letters that aren't stop words; ties in order of the word.

    ``lemma`` gives a word's base form (none: the word itself). It sees each distinct word once; base forms that are short or stop words don't count.
    """
    stop = stopwords() if stop is None else stop
    words = df.select(F.explode(letter_runs(text)).alias("word")).filter((F.length("word") >= min_length) & ~F.col("word").isin(sorted(stop)))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    if lemma is not None:
        base = F.pandas_udf(lambda w: w.map(lemma), "string")
        counts = counts.select(base("word").alias("word"), "n").filter((F.length("word") >= min_length) & ~F.col("word").isin(sorted(stop)))
        counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(k)


def histogram(df: DataFrame, value, bins: int = 50, clip_at: float = 0.99) -> DataFrame:
    """bin (1 to ``bins``), lower, n over equal widths between the least value and the clipping quantile; larger values count as that quantile."""
    x = df.select(value.cast("double").alias("x"))
    low, high = (exact_quantiles(x, ["x"], [0.0, clip_at])["x"]) if df.take(1) else (None, None)
    if low is None:
        return df.sparkSession.createDataFrame([], "bin bigint, lower double, n bigint")
    width = (high - low) / bins if high > low else 1.0
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.least(F.col("x"), F.lit(high)) - low) / width)))
    return x.filter(finite("x").isNotNull()).groupBy((place + 1).cast("bigint").alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("lower"), "n")


def samples(df: DataFrame, group: str = "source", n: int = 2, clip: int = 500, text: str = "text", row_id: str = "_row_id") -> DataFrame:
    """The first ``n`` texts of each group, line breaks as spaces, clipped."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(row_id))
    clipped = F.substring(F.replace(text_of(text), F.lit("\n"), F.lit(" ")), 1, clip)
    return df.withColumn("rank", rank).filter(F.col("rank") <= n).select(group, F.col("rank").cast("bigint").alias("rank"), clipped.alias("sample"))


def nunique(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(c) for c in columns])


def report(df: DataFrame, text: str = "text", source: str = "source", label: str = "label", meta: str = "meta", k: int = 20) -> dict[str, DataFrame]:
    """Every table there are columns for."""
    out = {"lengths": length_stats(df, text), "top_words": top_words(df, text, k), "chars_histogram": histogram(df, char_length(text)), "words_histogram": histogram(df, word_count(text))}
    for name, column in (("sources", source), ("labels", label)):
        if column in df.columns:
            out[name] = value_counts(df, column)
    if {source, label} <= set(df.columns):
        out["source_by_label"] = crosstab(df, source, label)
    if meta in df.columns:
        out["seed_roles"] = seed_role_counts(df, meta)
    return out


def markdown(tables: dict[str, DataFrame], limit: int = 50) -> str:
    """The tables as text; each is a summary, and ``limit`` rows of it are shown."""
    lines = ["# Data summary", ""]
    for name, t in tables.items():
        rows = t.orderBy(*t.columns).limit(limit).collect()
        lines += [f"## {name}", "", "| " + " | ".join(t.columns) + " |", "|" + "---|" * len(t.columns)]
        lines += ["| " + " | ".join(reduce(lambda s, c: s.replace(*c), (("|", "\\|"), ("\n", " ")), str(v)) for v in r) + " |" for r in rows] + [""]
    return "\n".join(lines)
