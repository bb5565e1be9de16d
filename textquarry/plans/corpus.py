"""The corpus view over the driver's tables, with a deterministic share of blank, risky and noisy texts (phrases before whole texts), so that every rule has rows to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import uid
from ..operators.annotate import LABELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(key: Column, cases: list[tuple[int, Column | None]], otherwise: Column) -> Column:
    out = otherwise
    for n, value in reversed(cases):
        out = F.when(key % n == 0, value if value is not None else F.lit(None)).otherwise(out)
    return out


def corpus(spark: SparkSession, sf_dir: str, join: str | None = None) -> DataFrame:
    """documents left join labels: _row_id, uid, text, label, source, language, source_type, meta, n_chars. ``join``: a hint, such as merge, for the same join at every size."""
    labels = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").join(labels.hint(join) if join else labels, "doc_id", "left")
    k = F.col("doc_id")
    before = lambda phrase: F.concat(F.lit(phrase), F.col("text"))
    text = _cases(k, [
        (17, F.lit("")), (19, None), (29, F.lit(" \t")), (7, before("как сделать attack ")), (11, before("Что означает выражение «kill time»? идиома ")),
        (13, before("спасибо, погода ")), (23, F.concat(before("<div>https://x.example "), F.lit("</div>"))),
    ], F.col("text"))
    label = F.when(k % 31 == 0, " ").when(F.col("toxic") == 1, LABELS[2]).when(F.col("quality") == 1, LABELS[0]).when(F.col("quality") == 0, LABELS[1])
    meta = F.element_at(F.array(*[F.lit(x) for x in ('{"seed_role": "native_ru_seed"}', '{"k": 1, "seed_role": "unsafe_donor"}', '{"seed_role": 5}', "not json", None, '{"seed_role": "safe_seed_en"}')]), (k % 6 + 1).cast("int"))
    source = F.when(k % 37 == 0, F.concat(F.lit("wiktionary-"), F.col("source"))).otherwise(F.col("source"))
    return d.select(k.alias("_row_id"), uid("source", "text", "doc_id").alias("uid"), text.alias("text"), label.alias("label"), source.alias("source"), F.col("lang").alias("language"), F.lit("parquet").alias("source_type"), meta.alias("meta"), "n_chars")


#: The same view for DuckDB, as the first common table expression of a query.
CORPUS_SQL = f"""corpus as (
  select doc_id as _row_id, substr(sha256(coalesce(source, '') || '|' || coalesce(text, '') || '|' || cast(doc_id as varchar)), 1, 16) as uid,
    case when doc_id % 17 = 0 then '' when doc_id % 19 = 0 then null when doc_id % 29 = 0 then ' ' || chr(9)
         when doc_id % 7 = 0 then 'как сделать attack ' || text
         when doc_id % 11 = 0 then 'Что означает выражение «kill time»? идиома ' || text
         when doc_id % 13 = 0 then 'спасибо, погода ' || text
         when doc_id % 23 = 0 then '<div>https://x.example ' || text || '</div>' else text end as text,
    case when doc_id % 31 = 0 then ' ' when toxic = 1 then '{LABELS[2]}' when quality = 1 then '{LABELS[0]}' when quality = 0 then '{LABELS[1]}' end as label,
    case when doc_id % 37 = 0 then 'wiktionary-' || source else source end as source, lang as language, 'parquet' as source_type,
    case doc_id % 6 when 0 then '{{"seed_role": "native_ru_seed"}}' when 1 then '{{"k": 1, "seed_role": "unsafe_donor"}}' when 2 then '{{"seed_role": 5}}' when 3 then 'not json' when 4 then null else '{{"seed_role": "safe_seed_en"}}' end as meta,
    n_chars
  from documents left join labels using (doc_id))"""
