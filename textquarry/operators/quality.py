"""Data quality: missing values, duplicates, outliers, class balance; cleaning; comparison before and after.

Rows are identified by an explicit column (``_row_id`` by default), which also orders them where "first" matters; it is no feature.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clamp, exact_quantiles, finite
from ..functions.text import char_length, is_blank, word_count
from ..sources.tables import staged

ROW_ID = "_row_id"
MISSING = ("keep", "drop_critical_fill_optional", "drop", "fill", "median")
DUPLICATES = ("keep", "drop")
OUTLIERS = ("keep", "drop_iqr", "clip_iqr")


@dataclass
class QualityOptions:
    text: str = "text"
    label: str = "label"
    duplicate_subset: tuple[str, ...] = ("text",)
    iqr_k: float = 1.5
    z_threshold: float = 3.0
    outlier_method: str = "iqr"  # both, zscore and iqr+zscore count z-scores, too
    task: str = "text_classification"
    row_id: str = ROW_ID

    @property
    def z_scores(self) -> bool:
        return self.outlier_method in ("both", "zscore", "iqr+zscore")


def is_number(kind: T.DataType, with_bool: bool = False) -> bool:
    """Decimals count as numbers here; booleans only on request."""
    return isinstance(kind, T.NumericType) or with_bool and isinstance(kind, T.BooleanType)


def data_columns(df: DataFrame, o: QualityOptions) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != o.row_id]


def numeric_features(df: DataFrame, o: QualityOptions) -> list[str]:
    return [f.name for f in data_columns(df, o) if is_number(f.dataType) and f.name not in (o.text, o.label)]


def is_missing(f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, T.StringType):
        return is_blank(c)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


# reports


def missing_report(df: DataFrame, o: QualityOptions) -> DataFrame:
    """column_name, n_missing, critical: one pass over the table."""
    fields = data_columns(df, o)
    counts = df.agg(*[F.count_if(is_missing(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"c{i}").alias("n_missing"), F.lit(f.name in (o.text, o.label)).alias("critical")) for i, f in enumerate(fields)]))
    return counts.select(rows.alias("r")).select("r.*")


def duplicate_count(df: DataFrame, o: QualityOptions) -> DataFrame:
    """Rows beyond the first of each combination; nulls are equal; columns that aren't there don't count."""
    subset = [c for c in o.duplicate_subset if c in df.columns]
    if not subset:
        return df.sparkSession.createDataFrame([(0,)], "duplicates bigint")
    return df.groupBy(combination(df, subset).alias("k")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def combination(df: DataFrame, subset: list[str]) -> Column:
    """A digest of the values of some columns, so that whole texts aren't shuffled: equal where they are, nulls like nulls."""
    real = lambda c: isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.sha2(F.to_json(F.struct(*[(F.col(c) + F.lit(0.0) if real(c) else F.col(c)).alias(c) for c in subset])), 256)


def features(df: DataFrame, o: QualityOptions) -> dict[str, Column]:
    """What outliers are looked for in: lengths of the text, then numeric columns."""
    out: dict[str, Column] = {}
    if o.text in df.columns:
        out["text_len_chars"], out["text_len_words"] = char_length(o.text), word_count(o.text)
    out.update({c: finite(c) for c in numeric_features(df, o)})
    return out


def fences(df: DataFrame, o: QualityOptions) -> dict[str, tuple[float, float]]:
    """Feature to (low, high); features without any value have none."""
    feats = features(df, o)
    return _fences(staged(df.select(*[c.cast("double").alias(n) for n, c in feats.items()])), list(feats), o) if feats else {}


def _fences(df: DataFrame, names: list[str], o: QualityOptions) -> dict[str, tuple[float, float]]:
    """From a table of features; it is read several times, so it should be a written one."""
    quartiles = exact_quantiles(df, names, [0.25, 0.75])
    return {n: (q1 - o.iqr_k * (q3 - q1), q3 + o.iqr_k * (q3 - q1)) for n, (q1, q3) in quartiles.items() if q1 is not None}


def fence_table(df: DataFrame, o: QualityOptions) -> DataFrame:
    rows = [(n, float(lo), float(hi)) for n, (lo, hi) in fences(df, o).items()]
    return df.sparkSession.createDataFrame(rows, "feature string, low double, high double")


def _outside(feats: dict[str, Column], limits: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {n: F.coalesce((feats[n] < lo) | (feats[n] > hi), F.lit(False)) for n, (lo, hi) in limits.items()}


def outlier_report(df: DataFrame, o: QualityOptions) -> DataFrame:
    """feature, n_iqr, n_zscore (null unless asked for), and a row ``rows_flagged_iqr_union``."""
    feats = features(df, o)
    rows = staged(df.select(*[c.cast("double").alias(n) for n, c in feats.items()])) if feats else df
    return _outlier_report(rows, list(feats), o)


def _outlier_report(df: DataFrame, names: list[str], o: QualityOptions) -> DataFrame:
    feats, limits = {n: F.col(n) for n in names}, _fences(df, names, o) if names else {}
    out = _outside(feats, limits)
    sums = [F.count_if(c).alias(f"i{k}") for k, c in enumerate(out.values())]
    sums.append(F.count_if(reduce(lambda a, b: a | b, out.values(), F.lit(False))).alias("any"))
    z = z_counts(df, feats, o) if o.z_scores else {}
    entries = [F.struct(F.lit(n).alias("feature"), F.col(f"i{k}").alias("n_iqr"), F.lit(z.get(n)).cast("bigint").alias("n_zscore")) for k, n in enumerate(out)]
    entries += [F.struct(F.lit(n).alias("feature"), F.lit(0).cast("bigint").alias("n_iqr"), F.lit(z.get(n)).cast("bigint").alias("n_zscore")) for n in feats if n not in out]
    entries.append(F.struct(F.lit("rows_flagged_iqr_union").alias("feature"), F.col("any").alias("n_iqr"), F.lit(None).cast("bigint").alias("n_zscore")))
    return df.agg(*sums).select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def z_counts(df: DataFrame, feats: dict[str, Column], o: QualityOptions) -> dict[str, int]:
    """Values further than the threshold from the mean, in population standard deviations; 0 where there is no deviation."""
    names = list(feats)
    stats = df.agg(*[F.avg(feats[n]).alias(f"m{k}") for k, n in enumerate(names)], *[F.stddev_pop(feats[n]).alias(f"s{k}") for k, n in enumerate(names)]).first()
    sums = []
    for k, n in enumerate(names):
        m, s = stats[f"m{k}"], stats[f"s{k}"]
        sums.append((F.count_if(F.abs((feats[n] - m) / s) > o.z_threshold) if s else F.lit(0).cast("bigint") + F.count_if(F.lit(False))).alias(f"z{k}"))
    got = df.agg(*sums).first()
    return {n: got[f"z{k}"] for k, n in enumerate(names)}


def imbalance(df: DataFrame, o: QualityOptions) -> DataFrame:
    """majority_class, majority_share, n_classes over labels that aren't blank; no row if there are none. Ties: the smaller label."""
    counts = df.filter(~is_blank(o.label)).groupBy(F.col(o.label).cast("string").alias("k")).count()
    return counts.agg(F.min_by("k", F.struct(-F.col("count"), F.col("k"))).alias("majority_class"), (F.max("count") / F.sum("count")).alias("majority_share"), F.count("*").alias("n_classes")).filter("n_classes > 0")


@dataclass
class Report:
    """The small figures that decisions are made from."""

    n_rows: int
    columns: dict[str, str]
    missing: dict[str, int]
    critical: dict[str, int]
    duplicates: int
    n_iqr: dict[str, int]
    n_zscore: dict[str, int | None]
    flagged: int
    majority: tuple[str, float, int] | None
    total_missing: int = field(init=False)

    def __post_init__(self):
        self.total_missing = sum(self.missing.values())


def detect(df: DataFrame, o: QualityOptions) -> Report:
    """One pass over the rows leaves a narrow written table (features, what is missing, label, digest of the duplicate columns); all figures come from that."""
    fields, feats = data_columns(df, o), features(df, o)
    subset = [c for c in o.duplicate_subset if c in df.columns]
    label = F.col(o.label).cast("string") if o.label in df.columns else F.lit(None).cast("string")
    key = combination(df, subset) if subset else F.lit(None).cast("string")
    # names of features may be those of columns
    names = {n: f"x{i}" for i, n in enumerate(feats)}
    narrow = staged(df.select(*[c.cast("double").alias(names[n]) for n, c in feats.items()], *[is_missing(f).alias(f"m{i}") for i, f in enumerate(fields)], label.alias("label"), key.alias("k")))
    sums = narrow.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"m{i}").alias(f"m{i}") for i in range(len(fields))]).first()
    missing = {f.name: sums[f"m{i}"] for i, f in enumerate(fields)}
    back = {x: n for n, x in names.items()}
    outliers = {back.get(r["feature"], r["feature"]): r for r in _outlier_report(narrow, list(names.values()), o).collect()}
    union = outliers.pop("rows_flagged_iqr_union")
    top = imbalance(narrow, replace(o, label="label")).collect()
    extra = narrow.groupBy("k").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0] if subset else 0
    return Report(
        sums["n"], {f.name: f.dataType.simpleString() for f in fields}, missing, {c: n for c, n in missing.items() if c in (o.text, o.label)},
        extra, {n: r["n_iqr"] for n, r in outliers.items()}, {n: r["n_zscore"] for n, r in outliers.items()}, union["n_iqr"], tuple(top[0]) if top else None,
    )


# cleaning


@dataclass
class Strategy:
    missing: str = "keep"
    duplicates: str = "keep"
    outliers: str = "keep"
    reasoning: list[str] = field(default_factory=list)


def choose_strategy(report: Report, o: QualityOptions) -> Strategy:
    """Cleaning steps from the report's figures, with a reason for each."""
    s, text_task = Strategy(), o.task == "text_classification"
    if any(report.critical.values()):
        s.missing = "drop_critical_fill_optional" if text_task else "drop"
        s.reasoning.append("rows without text or label can't be used")
    elif report.total_missing:
        s.missing = "fill" if text_task else "median"
        s.reasoning.append("only optional values are missing: they are filled")
    else:
        s.reasoning.append("nothing critical is missing")
    s.duplicates = "drop" if report.duplicates else "keep"
    s.reasoning.append("duplicates distort training and evaluation" if report.duplicates else "there are no duplicates")
    lengths = report.n_iqr.get("text_len_chars", 0) + report.n_iqr.get("text_len_words", 0)
    if (lengths if text_task else sum(report.n_iqr.values())) > 0:
        s.outliers = "drop_iqr"
        s.reasoning.append("extreme lengths are mostly noise" if text_task else "numeric outliers found")
    else:
        s.reasoning.append("there are no outliers that matter")
    if report.majority and report.majority[1] >= 0.9 and report.majority[2] > 1:
        s.reasoning.append(f"strong class imbalance: {report.majority[0]} has {report.majority[1]:.2f} of the rows")
    return s


def drop_critical(df: DataFrame, o: QualityOptions) -> DataFrame:
    for f in df.schema.fields:
        if f.name in (o.text, o.label):
            df = df.filter(~is_missing(f))
    return df


def _filled(f: T.StructField) -> Column:
    if is_number(f.dataType, with_bool=True):
        zero = F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(0).cast(f.dataType)
        c = F.nanvl(f.name, zero) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        return F.coalesce(c, zero)
    return F.coalesce(F.col(f.name).cast("string"), F.lit(""))


def fill(df: DataFrame, o: QualityOptions, but: tuple[str, ...] = ()) -> DataFrame:
    """Numbers: 0; everything else becomes a string, empty where missing."""
    return df.select(*[(F.col(f.name) if f.name in (o.row_id, *but) else _filled(f)).alias(f.name) for f in df.schema.fields])


def fill_optional(df: DataFrame, o: QualityOptions) -> DataFrame:
    return fill(df, o, (o.text, o.label))


def fill_median(df: DataFrame, o: QualityOptions) -> DataFrame:
    """Numeric columns get their exact median (0 where there is none)."""
    names = [f.name for f in data_columns(df, o) if is_number(f.dataType)]
    medians = {c: v[0] or 0.0 for c, v in exact_quantiles(df, names, [0.5]).items()}
    return df.withColumns({c: F.coalesce(finite(c), F.lit(float(m))) for c, m in medians.items()})


def apply_missing(df: DataFrame, mode: str, o: QualityOptions) -> DataFrame:
    if mode == "drop_critical_fill_optional":
        return fill_optional(drop_critical(df, o), o)
    if mode == "drop":
        return reduce(lambda d, f: d.filter(~(F.col(f.name).isNull() | F.isnan(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).isNotNull()), data_columns(df, o), df)
    if mode == "fill":
        return fill(df, o)
    if mode == "median":
        return fill_median(df, o)
    if mode != "keep":
        warnings.warn(f"unknown strategy {mode!r}: missing values stay as they are", stacklevel=2)
    return df


def keep_first(df: DataFrame, o: QualityOptions, last: bool = False) -> DataFrame:
    """The first row (by row id, which no two rows share) of each combination; nulls are equal. A partial aggregate finds the ids, so a frequent combination
    isn't sorted in one task."""
    subset = [c for c in o.duplicate_subset if c in df.columns]
    if not subset:
        return df
    pick = (F.max if last else F.min)(o.row_id)
    ids = df.groupBy(combination(df, subset).alias("_k")).agg(pick.alias(o.row_id)).select(o.row_id)
    return df.join(ids, o.row_id, "left_semi")


def keep_first_by_window(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """For rows without a unique id, where groups are known to be small."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_rank = 1").drop("_rank")


def drop_outliers(df: DataFrame, o: QualityOptions) -> DataFrame:
    """Rows with any feature strictly outside its fences go; all fences come from the same input."""
    out = _outside(features(df, o), fences(df, o))
    return df.filter(~reduce(lambda a, b: a | b, out.values(), F.lit(False)))


def clip_outliers(df: DataFrame, o: QualityOptions) -> DataFrame:
    """Texts are cut to the upper fence (rounded half to even); numbers become doubles within their fences."""
    limits = fences(df, o)
    out = {c: clamp(finite(c), float(limits[c][0]), float(limits[c][1])) for c in numeric_features(df, o) if c in limits}
    if "text_len_chars" in limits:
        out[o.text] = F.substring(F.col(o.text).cast("string"), 1, max(0, round(limits["text_len_chars"][1])))
    return df.withColumns(out)


def apply_outliers(df: DataFrame, mode: str, o: QualityOptions) -> DataFrame:
    return {"drop_iqr": drop_outliers, "clip_iqr": clip_outliers}.get(mode, lambda d, _: d)(df, o)


def fix(df: DataFrame, strategy: Strategy, o: QualityOptions) -> DataFrame:
    """Missing values, then duplicates, then outliers."""
    df = apply_missing(df, strategy.missing, o)
    if strategy.duplicates == "drop":
        df = keep_first(df, o)
    return apply_outliers(df, strategy.outliers, o)


def _long(report: Report) -> dict[str, float]:
    out = {"rows": report.n_rows, "duplicates": report.duplicates, "outliers::rows_flagged_iqr_union": report.flagged}
    out |= {f"missing::{k}": v for k, v in report.missing.items()} | {f"outliers::iqr::{k}": v for k, v in report.n_iqr.items()}
    return out | ({"imbalance::majority_share": report.majority[1]} if report.majority else {})


def compare(before: DataFrame, after: DataFrame, o: QualityOptions) -> DataFrame:
    """metric, before, after (doubles). Fences of the cleaned rows are their own."""
    a, b = _long(detect(before, o)), _long(detect(after, o))
    share = "imbalance::majority_share"
    rows = [(m, *(float(x[m]) if m in x else (None if m == share else 0.0) for x in (a, b))) for m in sorted(a.keys() | b.keys())]
    return before.sparkSession.createDataFrame(rows, "metric string, before double, after double")


def pivot(df: DataFrame, strategies: dict[str, Strategy], o: QualityOptions) -> DataFrame:
    """metric and a column a strategy: what ``compare`` says of the rows after it (doubles)."""
    after = {name: _long(detect(fix(df, s, o), o)) for name, s in strategies.items()}
    share = "imbalance::majority_share"
    rows = [(m, *(float(a[m]) if m in a else (None if m == share else 0.0) for a in after.values())) for m in sorted(set().union(*after.values()))]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("metric", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in after]]))


def run(df: DataFrame, o: QualityOptions) -> dict:
    """Detect, choose, fix, compare."""
    report = detect(df, o)
    strategy = choose_strategy(report, o)
    clean = fix(df, strategy, o)
    return {"report": report, "strategy": strategy, "clean": clean, "comparison": compare(df, clean, o)}
