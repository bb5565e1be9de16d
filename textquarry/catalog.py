"""The registered queries and, for each that SQL can express, the DuckDB query that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import cosine, entropy, margin
from .functions.text import DICTIONARY_HINTS, META_PREFIXES, QUERY_HINTS, TECHNICAL_STOPWORDS, WS_CHARS, char_length, uid
from .operators import annotate as A
from .operators import eda, learning, quality, review, sampling
from .operators import rewrite as R
from .plans.corpus import CORPUS_SQL, corpus, table
from .sources import collect
from .sources.tables import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
O = quality.QualityOptions()  # noqa: E741


def query(name: str, sql: str | None = None, with_corpus: bool = True):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"with recursive {CORPUS_SQL}{sql}" if with_corpus else sql
        return f

    return add


# pieces of SQL

NOT_WS = f"[^{WS_CHARS}]+"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{WS_CHARS}]+|[{WS_CHARS}]+\\z', '', 'g')"


def s_words(x: str) -> str:
    return f"cast(len(regexp_extract_all(coalesce({x}, ''), '{NOT_WS}')) as bigint)"


def s_blank(x: str) -> str:
    return f"({s_strip(f'coalesce({x}, {chr(39)*2})')} = '')"


def s_chars(x: str) -> str:
    return f"cast(length(coalesce({x}, '')) as bigint)"


def s_collapse(x: str) -> str:
    return s_strip(f"regexp_replace(coalesce({x}, ''), '[{WS_CHARS}]+', ' ', 'g')")


def s_any(x: str, terms) -> str:
    return "(" + " or ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def s_count(x: str, terms) -> str:
    return "(" + " + ".join(f"(case when contains({x}, '{t}') then 1 else 0 end)" for t in terms) + ")"


def s_hash(seed: int, x: str) -> str:
    return f"sha256('{seed}|' || cast({x} as varchar))"


def s_fences(source: str, features: dict[str, str], k: float = 1.5) -> str:
    """CTEs vals (one row a row) and fence (feature, low, high)."""
    cols = ", ".join(f"cast({e} as double) as {n}" for n, e in features.items())
    rows = " union all ".join(f"select '{n}' as feature, quantile_cont({n}, 0.25) as q1, quantile_cont({n}, 0.75) as q3 from vals" for n in features)
    return f"vals as (select {cols} from {source}), quart as ({rows}), fence as (select feature, q1 - {k}::double * (q3 - q1) as low, q3 + {k}::double * (q3 - q1) as high from quart)"


def s_out(features) -> str:
    return " or ".join(f"coalesce({n} < (select low from fence where feature = '{n}') or {n} > (select high from fence where feature = '{n}'), false)" for n in features)


def s_outliers(features) -> str:
    parts = [f"select '{n}' as feature, count(*) filter (where {s_out([n])}) as n_iqr from vals" for n in features]
    parts.append(f"select 'rows_flagged_iqr_union' as feature, count(*) filter (where {s_out(features)}) as n_iqr from vals")
    return " union all ".join(parts)


TEXT_FEATURES = {"text_len_chars": s_chars("text"), "text_len_words": s_words("text"), "n_chars": "n_chars"}
STRINGS = ("uid", "text", "label", "source", "language", "source_type", "meta")


def r6(*names: str):
    return {n: F.round(F.col(n), 6) for n in names}


# quality


@query("missing_report", ", r as (" + " union all ".join(f"select '{c}' as column_name, count(*) filter (where {s_blank(c)}) as n_missing, {str(c in ('text', 'label')).lower()} as critical from corpus" for c in STRINGS) + " union all select 'n_chars', count(*) filter (where n_chars is null), false from corpus) select * from r")
def _(spark, d):
    return quality.missing_report(corpus(spark, d), O)


@query("critical_missing", f" select count(*) filter (where {s_blank('text')}) as text_missing, count(*) filter (where {s_blank('label')}) as label_missing from corpus")
def _(spark, d):
    r = quality.missing_report(corpus(spark, d), O).filter("critical")
    return r.agg(F.sum(F.when(F.col("column_name") == "text", F.col("n_missing"))).alias("text_missing"), F.sum(F.when(F.col("column_name") == "label", F.col("n_missing"))).alias("label_missing"))


@query("duplicate_count", " select cast(count(*) - (select count(*) from (select distinct text from corpus)) as bigint) as duplicates from corpus")
def _(spark, d):
    return quality.duplicate_count(corpus(spark, d), O)


@query("dedup_keep_first", " select _row_id, text from (select *, row_number() over (partition by text order by _row_id) as rn from corpus) where rn = 1")
def _(spark, d):
    return quality.keep_first(corpus(spark, d), O).select("_row_id", "text")


@query("dedup_keep_last", " select _row_id, source from (select *, row_number() over (partition by source order by _row_id desc) as rn from corpus) where rn = 1")
def _(spark, d):
    return quality.keep_first(corpus(spark, d), quality.QualityOptions(duplicate_subset=("source",)), last=True).select("_row_id", "source")


@query("iqr_fences", ", " + s_fences("corpus", TEXT_FEATURES) + " select feature, round(low, 6) as low, round(high, 6) as high from fence")
def _(spark, d):
    return quality.fence_table(corpus(spark, d), O).withColumns(r6("low", "high"))


@query("iqr_outlier_counts", ", " + s_fences("corpus", TEXT_FEATURES) + f" select * from ({s_outliers(TEXT_FEATURES)}) where feature <> 'rows_flagged_iqr_union'")
def _(spark, d):
    return quality.outlier_report(corpus(spark, d), O).filter("feature <> 'rows_flagged_iqr_union'").select("feature", "n_iqr")


@query("outlier_union_count", ", " + s_fences("corpus", TEXT_FEATURES) + f" select count(*) filter (where {s_out(TEXT_FEATURES)}) as rows_flagged from vals")
def _(spark, d):
    return quality.outlier_report(corpus(spark, d), O).filter("feature = 'rows_flagged_iqr_union'").select(F.col("n_iqr").alias("rows_flagged"))


def _s_z(features, threshold=3.0) -> str:
    return " union all ".join(f"select '{n}' as feature, count(*) filter (where abs(({n} - (select avg({n}) from vals)) / nullif((select stddev_pop({n}) from vals), 0)) > {threshold}) as n_zscore from vals" for n in features)


@query("zscore_counts", ", " + s_fences("corpus", TEXT_FEATURES) + " " + _s_z(TEXT_FEATURES))
def _(spark, d):
    o = quality.QualityOptions(outlier_method="both")
    return quality.outlier_report(corpus(spark, d), o).filter("n_zscore is not null").select("feature", "n_zscore")


@query("class_imbalance", f", c as (select label as k, count(*) as n from corpus where not {s_blank('label')} group by 1) select (select k from c order by n desc, k limit 1) as majority_class, round(max(n) / sum(n)::double, 6) as majority_share, count(*) as n_classes from c")
def _(spark, d):
    return quality.imbalance(corpus(spark, d), O).withColumns(r6("majority_share"))


FILLED = "filled as (select _row_id, coalesce(uid, '') as uid, coalesce(text, '') as text, coalesce(label, '') as label, coalesce(source, '') as source, coalesce(language, '') as language, coalesce(meta, '') as meta, coalesce(n_chars, 0) as n_chars from corpus)"
CRITICAL = f"filled as (select _row_id, coalesce(uid, '') as uid, text, label, coalesce(source, '') as source, coalesce(language, '') as language, coalesce(meta, '') as meta, coalesce(n_chars, 0) as n_chars from corpus where not {s_blank('text')} and not {s_blank('label')})"


def _s_fix(first: str) -> str:
    kept = "once as (select * exclude (rn) from (select *, row_number() over (partition by text order by _row_id) as rn from filled) where rn = 1)"
    feats = {"_id": "_row_id", **TEXT_FEATURES}
    f = s_fences("once", feats).replace("cast(_row_id as double) as _id", "_row_id as _id")
    f = f.replace("select '_id' as feature, quantile_cont(_id, 0.25) as q1, quantile_cont(_id, 0.75) as q3 from vals union all ", "")
    return f", {first}, {kept}, {f} select o._row_id, uid, text, label, meta, o.n_chars from once o where _row_id in (select _id from vals where not ({s_out(TEXT_FEATURES)}))"


@query("quality_fix", _s_fix(FILLED))
def _(spark, d):
    out = quality.fix(corpus(spark, d), quality.Strategy("fill", "drop", "drop_iqr"), O)
    return out.select("_row_id", "uid", "text", "label", "meta", "n_chars")


@query("fix_drop_critical", _s_fix(CRITICAL))
def _(spark, d):
    out = quality.fix(corpus(spark, d), quality.Strategy("drop_critical_fill_optional", "drop", "drop_iqr"), O)
    return out.select("_row_id", "uid", "text", "label", "meta", "n_chars")


@query("fill_optional", " select _row_id, text, label, coalesce(meta, '') as meta, coalesce(n_chars, 0) as n_chars from corpus")
def _(spark, d):
    return quality.fill_optional(corpus(spark, d), O).select("_row_id", "text", "label", "meta", "n_chars")


@query("drop_missing", " select _row_id from corpus where text is not null and label is not null and meta is not null")
def _(spark, d):
    return quality.apply_missing(corpus(spark, d), "drop", O).select("_row_id")


def _holes(spark, d):
    li = table(spark, d, "lineitem")
    q = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, None).otherwise(F.col("l_quantity").cast("double"))
    return li.select(F.col("l_orderkey").alias("_row_id"), "l_linenumber", q.alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"))


@query("median_fill", "with h as (select l_orderkey as _row_id, l_linenumber, case when (l_orderkey + l_linenumber) % 13 = 0 then null else cast(l_quantity as double) end as quantity, cast(l_extendedprice as double) as price from lineitem) select _row_id, cast(l_linenumber as double) as l_linenumber, coalesce(quantity, (select quantile_cont(quantity, 0.5) from h)) as quantity, price from h", False)
def _(spark, d):
    return quality.fill_median(_holes(spark, d), O)


@query("clip_iqr", ", " + s_fences("corpus", TEXT_FEATURES) + """
 select _row_id, substr(text, 1, greatest(0, cast(round_even((select high from fence where feature = 'text_len_chars'), 0) as bigint))) as text,
   least(greatest(cast(n_chars as double), (select low from fence where feature = 'n_chars')), (select high from fence where feature = 'n_chars')) as n_chars from corpus""")  # fmt: skip
def _(spark, d):
    return quality.clip_outliers(corpus(spark, d), O).select("_row_id", "text", "n_chars")


def _s_compare() -> str:
    def side(name: str, source: str, strings) -> str:
        parts = [f"select 'rows' as metric, count(*)::double as v from {source}", f"select 'duplicates', (count(*) - count(distinct coalesce(text, chr(1))))::double from {source}"]
        parts += [f"select 'missing::{c}', count(*) filter (where {s_blank(c)})::double from {source}" for c in strings]
        parts += [f"select 'missing::n_chars', count(*) filter (where n_chars is null)::double from {source}"]
        parts += [f"select 'outliers::iqr::' || feature, n_iqr::double from ({s_outliers(TEXT_FEATURES).replace('vals', f'vals_{name}').replace('fence', f'fence_{name}')}) where feature <> 'rows_flagged_iqr_union'"]
        parts += [f"select 'outliers::rows_flagged_iqr_union', n_iqr::double from ({s_outliers(TEXT_FEATURES).replace('vals', f'vals_{name}').replace('fence', f'fence_{name}')}) where feature = 'rows_flagged_iqr_union'"]
        parts += [f"select 'imbalance::majority_share', max(n)::double / sum(n) from (select count(*) as n from {source} where not {s_blank('label')} group by label)"]
        ctes = s_fences(source, TEXT_FEATURES).replace("vals", f"vals_{name}").replace("quart", f"quart_{name}").replace("fence", f"fence_{name}")
        return f"{ctes}, rep_{name} as ({' union all '.join(parts)})"

    after = "clean as (select uid, coalesce(text, '') as text, coalesce(label, '') as label, coalesce(source, '') as source, coalesce(language, '') as language, coalesce(source_type, '') as source_type, coalesce(meta, '') as meta, n_chars from (select *, row_number() over (partition by coalesce(text, '') order by _row_id) as rn from corpus) where rn = 1)"
    return f", {after}, {side('b', 'corpus', STRINGS)}, {side('a', 'clean', STRINGS)} select metric, round(b.v, 6) as before, round(a.v, 6) as after from rep_b b full join rep_a a using (metric)"


@query("compare_before_after", _s_compare())
def _(spark, d):
    before = corpus(spark, d)
    after = quality.fix(before, quality.Strategy("fill", "drop", "keep"), O)
    return quality.compare(before, after, O).withColumns(r6("before", "after"))


LINEITEM = {c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


@query("numeric_outliers_lineitem", "with " + s_fences("lineitem", LINEITEM) + " " + s_outliers(LINEITEM), False)
def _(spark, d):
    return quality.outlier_report(table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in LINEITEM]), O).select("feature", "n_iqr")


@query("numeric_outliers_customer", "with " + s_fences("customer", {"c_acctbal": "c_acctbal"}) + " " + s_outliers(["c_acctbal"]), False)
def _(spark, d):
    return quality.outlier_report(table(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("c_acctbal")), O).select("feature", "n_iqr")


@query("median_fill_nothing_missing", "select event_id, cast(value as double) as value from events", False)
def _(spark, d):
    return quality.fill_median(table(spark, d, "events").select(F.col("event_id").cast("bigint").alias("_row_id"), F.col("value").cast("double").alias("value")), O).withColumnRenamed("_row_id", "event_id")


@query("strategy_choice")
def _(spark, d):
    c = corpus(spark, d)
    s = quality.choose_strategy(quality.detect(c, O), O)
    return spark.createDataFrame([(s.missing, s.duplicates, s.outliers)], "missing string, duplicates string, outliers string")


# collection


@query("per_source_cap", f" select _row_id, source from (select *, row_number() over (partition by source order by {s_hash(42, '_row_id')}, _row_id) as rn from corpus) where rn <= 5")
def _(spark, d):
    return sampling.cap_per_group(corpus(spark, d), "source", 5).select("_row_id", "source")


TARGET = 60
ALLOC = f""", g as (select source, count(*) as c from corpus group by 1), t as (select sum(c)::double as n, count(*) as s from g),
 raw as (select source, c, n, s, ({TARGET} - s) * c / n as raw, row_number() over (order by source) as place from g, t),
 ex as (select *, cast(greatest(0, least(floor(raw), c - 1)) as bigint) as extra from raw),
 lf as (select *, {TARGET} - s - sum(extra) over () as rest from ex),
 slots as (select source, raw, rest, unnest(generate_series(1, cast(least(c - 1 - extra, rest) as bigint))) as k from lf where rest > 0),
 won as (select source, count(*) as more from (select *, row_number() over (order by k, raw - floor(raw) desc, source) as turn from slots) where turn <= rest group by 1),
 alloc as (select source, c as n_rows, cast(case when n <= {TARGET} then c when s > {TARGET} then (case when place <= {TARGET} then 1 else 0 end) else 1 + extra + coalesce(more, 0) end as bigint) as n_taken from lf left join won using (source))"""


@query("stratified_sample_alloc", ALLOC + " select * from alloc")
def _(spark, d):
    return sampling.allocate(corpus(spark, d), TARGET)


@query("stratified_sample_rows", ALLOC + f" select _row_id, source from (select *, row_number() over (partition by source order by {s_hash(42, '_row_id')}, _row_id) as rn from corpus) join alloc using (source) where rn <= n_taken")
def _(spark, d):
    return sampling.stratified_sample(corpus(spark, d), TARGET).select("_row_id", "source")


@query("uniform_sample", f" select _row_id from corpus order by {s_hash(42, '_row_id')}, _row_id limit 25")
def _(spark, d):
    return sampling.sample(corpus(spark, d), 25).select("_row_id")


@query("uid_assign", " select _row_id, uid from corpus")
def _(spark, d):
    return corpus(spark, d).select("_row_id", "uid")



def now():
    return F.lit("2024-01-01T00:00:00Z")


@query("union_align_sources", f""", m as (
   select substr(sha256('docs|' || {s_strip('text')} || '|' || _row_id), 1, 16) as uid, {s_strip('text')} as text, 'docs' as source, label, 'hf_dataset' as source_type, cast(null as varchar) as extra from corpus where not {s_blank('text')}
   union all select substr(sha256('chat|' || {s_strip('text')} || '|' || (conv_id * 1000 + turn)), 1, 16), {s_strip('text')}, 'chat', role, 'api', 'x' from conversations where not {s_blank('text')})
 select uid, text, source, label, source_type, extra from m""")  # fmt: skip
def _(spark, d):
    docs = corpus(spark, d)
    a = collect.unified(docs, "docs", "hf_dataset", F.col("text"), F.col("label"), F.lit(None).cast("string"), collected_at=now()).drop("_row_id")
    chat = table(spark, d, "conversations").withColumn("_row_id", (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint"))
    b = collect.unified(chat, "chat", "api", F.col("text"), F.col("role"), F.lit(None).cast("string"), collected_at=now()).drop("_row_id").withColumn("extra", F.lit("x"))
    return collect.merge([a, b]).select("uid", "text", "source", "label", "source_type", "extra")


@query("export_filter", f" select _row_id, {s_strip('text')} as text, label from corpus where language in ('en', 'de') and source = 'src3' and not {s_blank('text')}")
def _(spark, d):
    c = corpus(spark, d)
    out = collect.from_export(c, "src3", "text", "label", filters=[{"column": "language", "op": "in", "value": ["en", "de"]}, {"column": "source", "op": "eq", "value": "src3"}], collected_at=now())
    return out.select("_row_id", "text", "label")


WIKI = "'== H ==' || chr(10) || '* item [[a|' || source || ']] ' || chr(10) || '| [[Category:x]] || [[foo|bar ' || _row_id || ']]' || chr(10) || '[[:en:zz]] [[target' || _row_id || ']]' || chr(10) || '{{tpl}}' || chr(10) || '! head' || chr(10) || 'plain' || chr(10) || '#:  ''''b'''' <i>x</i>{{y}}'"


@query("wiki_list_items", " select _row_id, 1 as item_no, 'item ' || source as item from corpus union all select _row_id, 2, 'bar ' || _row_id from corpus union all select _row_id, 3, 'target' || _row_id from corpus union all select _row_id, 7, 'b x' from corpus")
def _(spark, d):
    nl = F.lit("\n")
    c = corpus(spark, d).select("_row_id", "source")
    page = F.concat(F.lit("== H ==\n* item [[a|"), "source", F.lit("]] \n| [[Category:x]] || [[foo|bar "), "_row_id", F.lit("]]\n[[:en:zz]] [[target"), "_row_id", F.lit("]]\n{{tpl}}\n! head\nplain\n#:  ''b'' <i>x</i>{{y}}"), nl)
    return collect.wiki_items(c.select("_row_id", page.alias("wikitext"))).select("_row_id", "item_no", "item")


@query("page_links", """select page_id, cast(i - 1 as bigint) as scrape_index, l[i] as value from (
  select page_id, l, unnest(generate_series(1, len(l))) as i from (
    select page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) as l from pages))""", False)  # fmt: skip
def _(spark, d):
    return collect.scrape(table(spark, d, "pages").select("page_id", "html"), "nav a", "href")


@query("page_titles", None)
def _(spark, d):
    return collect.scrape(table(spark, d, "pages").select("page_id", "html"), "article h1")


# exploration


@query("class_distribution", " select coalesce(label, '<NA>') as label, count(*) as n from corpus group by 1")
def _(spark, d):
    return eda.value_counts(corpus(spark, d), "label")


@query("source_distribution", " select source, count(*) as n from corpus group by 1")
def _(spark, d):
    return eda.value_counts(corpus(spark, d), "source")


def _s_len(n: str, x: str) -> str:
    return f"select '{n}' as feature, min({x}) as min, max({x}) as max, round(avg({x}), 6) as mean, round(quantile_cont({x}, 0.5), 6) as median, round(stddev_pop({x}), 6) as std from corpus"


@query("length_stats", f" {_s_len('chars', s_chars('text'))} union all {_s_len('words', s_words('text'))}")
def _(spark, d):
    return eda.length_stats(corpus(spark, d)).withColumns(r6("mean", "median", "std"))


@query("source_label_crosstab", ", p as (select source, coalesce(label, '<NA>') as label from corpus) select a.source, b.label, count(p.label) as n from (select distinct source from p) a cross join (select distinct label from p) b left join p on p.source = a.source and p.label = b.label group by 1, 2")
def _(spark, d):
    return eda.crosstab(corpus(spark, d), "source", "label")


@query("seed_role_distribution", " select json_extract_string(meta, '$.seed_role') as seed_role, count(*) as n from corpus where json_valid(meta) and json_type(meta, '$.seed_role') = 'VARCHAR' group by 1")
def _(spark, d):
    return eda.seed_role_counts(corpus(spark, d))


STOP = sorted({*TECHNICAL_STOPWORDS, "the", "and", "что", "как", "der", "die", "les"})


def _s_clean(x: str) -> str:
    t = f"lower(case when lower(coalesce({x}, '')) in ('nan', '<na>', 'none', 'nat') then '' else coalesce({x}, '') end)"
    from .functions.text import ENTITIES

    for e, c in ENTITIES:
        t = f"replace({t}, '{e}', '{c.replace(chr(39), chr(39) * 2)}')"
    for p in ("<[^>]+>", f"(?:https?://|www\\.){NOT_WS}", "\\p{Nd}+"):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return s_collapse(t)


@query("top_content_words", f", w as (select unnest(regexp_extract_all({_s_clean('text')}, '[A-Za-zА-Яа-яЁё]+')) as word from corpus) select word, count(*) as n from w where length(word) >= 3 and word not in ({', '.join(repr(s) for s in STOP)}) group by 1 order by n desc, word limit 20")
def _(spark, d):
    return eda.top_words(corpus(spark, d), stop=set(STOP))


@query("length_histogram", f""", v as (select cast({s_chars('text')} as double) as x from corpus), e as (select min(x) as lo, quantile_cont(x, 0.99) as hi from v)
 select cast(1 + least(49, greatest(0, floor((least(x, hi) - lo) / ((hi - lo) / 50)))) as bigint) as bin, count(*) as n from v, e group by 1""")  # fmt: skip
def _(spark, d):
    return eda.histogram(corpus(spark, d), char_length("text")).select("bin", "n")


@query("source_samples", " select source, rank, substr(replace(coalesce(text, ''), chr(10), ' '), 1, 500) as sample from (select *, row_number() over (partition by source order by _row_id) as rank from corpus) where rank <= 2")
def _(spark, d):
    return eda.samples(corpus(spark, d))


@query("nunique", " select count(distinct source) as source, count(distinct label) as label, count(distinct text) as text from corpus")
def _(spark, d):
    return eda.nunique(corpus(spark, d), ["source", "label", "text"])


# annotation


def _s_label() -> str:
    base = f"b0 as (select *, {s_strip(f'coalesce(text, {chr(39)*2})')} as t from corpus), b1 as (select *, lower(t) as low, lower(coalesce(source, '')) as src, case when json_valid(meta) then lower(coalesce(json_extract_string(meta, '$.seed_role'), '')) else '' end as role from b0)"
    terms = f"b2 as (select *, {s_words('low')} as nw, {s_count('low', A.RISK_TERMS)} as r, {s_count('low', A.BENIGN_TERMS)} as b, {s_count('low', A.INSTRUCTION_TERMS)} as i, {s_count('low', A.PLAIN_TERMS)} as p from b1)"
    rules = [
        ("candidate_role", s_any("role", A.CANDIDATE_ROLES), ("2.4::double", None, None), "'seed_role=' || role"),
        ("plain_role", s_any("role", A.PLAIN_ROLES), (None, "2.0::double", None), "'seed_role=' || role"),
        ("unsafe_role", s_any("role", A.UNSAFE_ROLES), (None, None, "2.8::double"), "'seed_role=' || role"),
        ("risk", "r > 0", ("least(2.0::double, 0.4::double + 0.3::double * r)", None, "least(3.0::double, 0.9::double + 0.55::double * r)"), "'risk_terms=' || r"),
        ("benign", "b > 0", ("1.2::double + 0.4::double * b", "0.4::double", "-0.3::double"), "'benign_context=' || b"),
        ("instruction", "i > 0", ("-0.4::double", None, "2.6::double + 0.5::double * i"), "'unsafe_instruction=' || i"),
        ("plain", "(p > 0 and r = 0)", (None, "1.4::double + 0.2::double * p", None), "'plain_terms=' || p"),
        ("short", "(r > 0 and b > 0 and nw <= 12)", ("1.4::double", None, None), "'short_ambiguous_text'"),
        ("source", s_any("src", A.SOURCE_TERMS), ("1.0::double", None, None), "'source=' || src"),
        ("long", "(length(t) > 600 or nw > 120)", (None, None, "1.1::double"), "'too_long'"),
        ("noise", s_any("low", A.NOISE_TERMS), (None, None, "0.8::double"), "'html_or_url_noise'"),
    ]
    fired = ", ".join(f"{c} as f_{n}" for n, c, _, _ in rules)
    nothing = "not (" + " or ".join(f"f_{n}" for n, *_ in rules) + ")"
    rules.append(("default", nothing, (None, "1.0::double", None), "'default_plain'"))
    col = lambda n, c: f"f_{n}" if n != "default" else nothing
    sums = [" + ".join(["0.0::double", *(f"(case when {col(n, c)} then {w[k]} else 0.0::double end)" for n, c, w, _ in rules if w[k])]) for k in range(3)]
    sig = "list_filter([" + ", ".join(f"case when {col(n, c)} then {s} end" for n, c, _, s in rules) + "], lambda x: x is not null)"
    rea = "list_filter([" + ", ".join(f"case when {col(n, c)} then '{A.REASONS[n]}' end" for n, c, _, s in rules) + "], lambda x: x is not null)"
    scored = f"b3 as (select *, {fired} from b2), b4 as (select *, list_sort([{', '.join(f'{{{chr(39)}s{chr(39)}: -({s}), {chr(39)}name{chr(39)}: {chr(39)}{n}{chr(39)}}}' for s, n in zip(sums, A.LABELS, strict=True))}]) as sc, {sig} as sig, {rea} as rea from b3)"
    conf = "least(0.98::double, greatest(0.5::double, 0.5::double + least(0.45::double, 0.1::double * greatest(0.0::double, sc[2].s - sc[1].s) + 0.03::double * len(sig))))"
    out = f"labeled as (select _row_id, uid, text, label, source, meta, case when t = '' then '{A.LABELS[2]}' else sc[1].name end as predicted_label, case when t = '' then 0.99::double else {conf} end as confidence, case when t = '' then '{A.REASONS['empty']}' else array_to_string(rea, ' ') end as label_reason, case when t = '' then 'empty_text' else array_to_string(sig, '; ') end as label_signals from b4)"
    return f", {base}, {terms}, {scored}, {out}"


LABELED = _s_label()


def labeled(spark, d):
    return A.auto_label(corpus(spark, d))


@query("auto_label", LABELED + " select _row_id, predicted_label, round(confidence, 6) as confidence, label_reason, label_signals from labeled")
def _(spark, d):
    return labeled(spark, d).select("_row_id", "predicted_label", F.round("confidence", 6).alias("confidence"), "label_reason", "label_signals")


@query("predicted_label_distribution", LABELED + " select predicted_label, count(*) as n from labeled group by 1")
def _(spark, d):
    return eda.value_counts(labeled(spark, d), "predicted_label")


THRESHOLD = 0.75
REASONED = f""", reasoned as (select *, list_filter([case when confidence < {THRESHOLD}::double then 'low_confidence' end, case when {s_blank('predicted_label')} then 'missing_label' end,
   case when contains(label_signals, 'short_ambiguous_text') or contains(lower(label_reason), 'ambiguous') then 'ambiguous_text' end,
   case when length({s_strip("coalesce(text, '')")}) > 600 or {s_words('text')} > 120 then 'long_text' end], lambda x: x is not null) as rs from labeled)"""


@query("review_queue", LABELED + REASONED + f" select uid as sample_id, uid, {s_strip(chr(99) + 'oalesce(text, ' + chr(39)*2 + ')')} as text, predicted_label as pred_label, round(confidence, 6) as pred_confidence, array_to_string(rs, ';') as review_reason, 'pending' as review_status from reasoned where len(rs) > 0")
def _(spark, d):
    q = A.flag_for_review(labeled(spark, d), THRESHOLD)
    return q.select("sample_id", "uid", "text", "pred_label", F.round("pred_confidence", 6).alias("pred_confidence"), F.array_join("review_reason", ";").alias("review_reason"), "review_status")


@query("review_queue_head", LABELED + REASONED + " select sample_id from (select uid as sample_id, confidence, rs from reasoned where len(rs) > 0 order by confidence, len(rs) desc, uid limit 40)")
def _(spark, d):
    return A.flag_for_review(labeled(spark, d), THRESHOLD, max_items=40).select("sample_id")


@query("review_reason_counts", LABELED + REASONED + " select reason, count(*) as n from (select unnest(rs) as reason from reasoned) group by 1")
def _(spark, d):
    q = A.flag_for_review(labeled(spark, d), THRESHOLD)
    return q.select(F.explode("review_reason").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("label_examples", LABELED + f" select predicted_label as label, rank, substr({s_strip('replace(coalesce(text, ' + chr(39)*2 + '), chr(10), ' + chr(39) + ' ' + chr(39) + ')')}, 1, 220) as example from (select *, row_number() over (partition by predicted_label order by _row_id) as rank from labeled) where rank <= 3")
def _(spark, d):
    return A.label_examples(labeled(spark, d))


# the reviewers' answers: known for two of three rows, different in every fifth
DECIDED_SQL = f"""{LABELED}, dec as (select uid as sample_id, _row_id, case _row_id % 5 when 0 then 'corrected' when 1 then 'accepted_auto' when 2 then 'skipped' when 3 then 'accepted_auto' end as review_status,
   case when _row_id % 10 = 0 then '' when _row_id % 5 = 0 then '{A.LABELS[0]}' end as human_label, 'r1' as reviewer from labeled where _row_id % 3 <> 0)"""


def decisions(spark, d):
    k = F.col("_row_id")
    status = F.when(k % 5 == 0, "corrected").when(k % 5 == 1, "accepted_auto").when(k % 5 == 2, "skipped").when(k % 5 == 3, "accepted_auto")
    human = F.when(k % 10 == 0, "").when(k % 5 == 0, A.LABELS[0])
    return corpus(spark, d).filter(k % 3 != 0).select(F.col("uid").alias("sample_id"), "_row_id", status.alias("review_status"), human.alias("human_label"), F.lit("r1").alias("reviewer"))


MERGED = DECIDED_SQL + f", merged as (select l._row_id, l.uid as sample_id, l.predicted_label as auto_label, case when d.review_status = 'accepted_auto' then l.predicted_label else d.human_label end as human_label, coalesce(d.review_status, 'pending') as review_status, d.reviewer, coalesce(d.review_status = 'accepted_auto' or (d.review_status = 'corrected' and not {s_blank('d.human_label')}), false) as reviewed, case when d.review_status = 'corrected' and not {s_blank('d.human_label')} then d.human_label else l.predicted_label end as final_label from labeled l left join dec d on d.sample_id = l.uid)"


@query("merge_decisions", MERGED + " select * from merged")
def _(spark, d):
    out = review.merge_decisions(labeled(spark, d), decisions(spark, d))
    return out.select("_row_id", "sample_id", "auto_label", "human_label", "review_status", "reviewer", "reviewed", "final_label")


PAIRS = MERGED + f", pairs as (select auto_label as pred, label as ref from merged join corpus using (_row_id) where not {s_blank('label')}), tot as (select count(*)::double as n, (count(*) filter (where pred = ref))::double as same from pairs)"


def pairs(spark, d):
    l = labeled(spark, d).select("predicted_label", F.col("label").alias("final_label"))  # noqa: E741
    return A.paired(l)[0]


@query("confusion_long", PAIRS + " select ref, pred, count(*) as n from pairs group by 1, 2")
def _(spark, d):
    return A.confusion(pairs(spark, d))


@query("agreement_kappa", PAIRS + ", ch as (select sum(r * p) as c from (select (select count(*) from pairs where ref = k)::double as r, (select count(*) from pairs where pred = k)::double as p from (select distinct ref as k from pairs union select distinct pred from pairs))) select cast(n as bigint) as agreement_n, round(same / n, 6) as agreement, round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) as kappa from tot, ch")
def _(spark, d):
    return A.agreement(pairs(spark, d)).withColumns(r6("agreement", "kappa"))


@query("confidence_stats", LABELED + " select round(avg(confidence), 6) as confidence_mean, count(*) filter (where confidence < 0.7::double) as low_confidence_count from labeled")
def _(spark, d):
    return A.confidence_stats(labeled(spark, d)).withColumns(r6("confidence_mean"))


@query("review_rates", MERGED + ", c as (select count(*)::double as n, (count(*) filter (where review_status in ('accepted_auto', 'corrected', 'skipped')))::double as d, (count(*) filter (where review_status = 'accepted_auto'))::double as a, (count(*) filter (where review_status = 'corrected'))::double as c from merged) select round(d / n, 6) as review_rate, round(a / d, 6) as auto_accept_rate, round(c / d, 6) as correction_rate from c")
def _(spark, d):
    return A.review_rates(review.merge_decisions(labeled(spark, d), decisions(spark, d))).withColumns(r6("review_rate", "auto_accept_rate", "correction_rate"))


@query("preserve_review_state", DECIDED_SQL + REASONED + " select q.uid as sample_id, coalesce(d.review_status, 'pending') as review_status, nullif(d.human_label, '') as human_label, d.reviewer from (select * from reasoned where len(rs) > 0) q left join dec d on d.sample_id = q.uid")
def _(spark, d):
    q = A.flag_for_review(labeled(spark, d), THRESHOLD)
    return review.preserve_state(q, decisions(spark, d)).select("sample_id", "review_status", "human_label", "reviewer")


@query("hitl_pending", DECIDED_SQL + REASONED + " select uid as sample_id from reasoned where len(rs) > 0 and uid not in (select sample_id from dec where review_status in ('accepted_auto', 'corrected', 'skipped'))")
def _(spark, d):
    return review.undecided(A.flag_for_review(labeled(spark, d), THRESHOLD), decisions(spark, d)).select("sample_id")


@query("labelstudio_tasks", LABELED + """ select uid, predicted_label as choice, round(confidence, 6) as score, coalesce(text, '') as text from labeled""")
def _(spark, d):
    t = A.labelstudio_tasks(labeled(spark, d))
    j = F.col("task")
    return t.select("uid", F.get_json_object(j, "$.predictions[0].result[0].value.choices[0]").alias("choice"), F.round(F.get_json_object(j, "$.predictions[0].score").cast("double"), 6).alias("score"), F.get_json_object(j, "$.data.text").alias("text"))


# rewriting

ROLE = f"roled as (select *, coalesce(nullif({s_strip('case when json_valid(meta) and json_type(meta, ' + chr(39) + '$.seed_role' + chr(39) + ') = ' + chr(39) + 'VARCHAR' + chr(39) + ' then json_extract_string(meta, ' + chr(39) + '$.seed_role' + chr(39) + ') end')}, ''), nullif({s_strip('coalesce(label, ' + chr(39)*2 + ')')}, '')) as seed_role from corpus)"
MATCHED = f", {ROLE}, matched as (select * from (select *, case " + " ".join(f"when seed_role in ({', '.join(repr(r) for r in p.seed_roles)}) then '{p.name}'" for p in R.POLICIES) + " end as policy from roled) where policy is not null)"
OPTIONS = R.RewriteOptions(policies=tuple(p if p.max_inputs is None else R.replace(p, max_inputs=50) for p in R.POLICIES))


@query("policy_match", MATCHED + " select _row_id, seed_role, policy from matched")
def _(spark, d):
    return R.match_policies(corpus(spark, d), OPTIONS).select("_row_id", "seed_role", "policy")


CAPPED = MATCHED + f", capped as (select * from (select *, row_number() over (partition by policy order by sha256('2026|' || uid), _row_id) as rn from matched) where policy <> 'unsafe_ru_to_ru_borderline' or rn <= 50)"


@query("policy_caps", CAPPED + " select _row_id, policy from capped")
def _(spark, d):
    return R.cap_policies(R.match_policies(corpus(spark, d), OPTIONS), OPTIONS).select("_row_id", "policy")


def _s_hash_int(salt: str, mod: int) -> str:
    return f"(cast('0x' || substr(sha256('2026|' || uid || '|{salt}'), 1, 8) as bigint) % {mod})"


def _s_generate() -> str:
    cases = []
    for p in R.POLICIES:
        options = "[" + ", ".join("'" + t + "'" for t in R.TEMPLATES[p.strategy]) + "]"
        cases.append(f"when '{p.name}' then replace({options}[1 + (case when {_s_hash_int('other', 1000)} < 200 then {_s_hash_int('template', 3)} else 0 end)], '{{seed}}', substr({s_collapse('text')}, 1, 220))")
    return f", gen as (select _row_id, uid, policy, case policy {' '.join(cases)} end as raw from capped where not {s_blank('text')})"


GENERATED = CAPPED + _s_generate()


@query("rule_rewrite", GENERATED + " select _row_id, policy, raw from gen")
def _(spark, d):
    c = R.cap_policies(R.match_policies(corpus(spark, d), OPTIONS), OPTIONS)
    return R.expand(R.rule_generate(c, OPTIONS), OPTIONS).select("_row_id", "policy", "raw")


def _s_query_like(x: str) -> str:
    low = f"lower({s_strip(x)})"
    hints = ", ".join(repr(h) for h in QUERY_HINTS)
    return f"({low} <> '' and (contains({low}, '?') or regexp_extract({low}, '({NOT_WS})', 1) in ({hints}) or {s_any(f'(' + repr(' ') + f' || {low} || ' + repr(' ') + ')', [f' {h} ' for h in QUERY_HINTS])}))"


def _s_validate() -> str:
    t = s_strip("raw")  # the rule generator makes neither quotes nor announcements
    low = "lower(c)"
    n = s_words("c")
    bullet = "(?m)^\\s*(?:[-*]|\\d+[.)])\\s+"
    starts = lambda terms: "(" + " or ".join(f"starts_with({low}, '{x}')" for x in terms) + ")"
    checks = {
        "empty_output": "c = ''", "skip_literal": "upper(c) = '__SKIP__'", "meta_prefix": starts(META_PREFIXES), "too_few_words": f"{n} < 2", "list_output": f"regexp_matches(c, '{bullet}') and contains(c, chr(10))",
        "single_mode_multi_blob": f"contains(c, '---') or regexp_matches(c, '{bullet}') or (regexp_matches(c, '(?i)(?:вариант\\s*\\d+|option\\s*\\d+)') and contains(c, chr(10)))",
        "dictionary_style": f"({low} <> '' and ({starts(DICTIONARY_HINTS)} or ((contains({low}, '— это') or starts_with({low}, 'это ')) and not contains({low}, '?') and not {_s_query_like('c')})))",
        "not_user_query_form": f"not {_s_query_like('c')}", "under_contextualized": f"policy = 'wiki_native_to_ru_borderline' and {n} < 4",
    }
    found = "list_filter([" + ", ".join(f"case when {c} then '{k}' end" for k, c in checks.items()) + "], lambda x: x is not null)"
    return f", cleaned as (select _row_id, uid, policy, raw, {t} as c from gen), checked as (select *, {found} as rs from cleaned), judged as (select _row_id, uid, policy, raw, c as cleaned, case when len(rs) > 0 then array_to_string(rs, ',') when length(c) < 8 or length(c) > 220 then 'length' else '' end as reject from checked)"


JUDGED = GENERATED + _s_validate()


def judged(spark, d):
    c = R.cap_policies(R.match_policies(corpus(spark, d), OPTIONS), OPTIONS)
    return R.validate(R.expand(R.rule_generate(c, OPTIONS), OPTIONS), OPTIONS)


@query("rewrite_validate", JUDGED + " select _row_id, cleaned, reject from judged")
def _(spark, d):
    return judged(spark, d).select("_row_id", "cleaned", F.array_join("reject_reasons", ",").alias("reject"))


_STRATEGY_SQL = "case policy " + " ".join(f"when '{p.name}' then '{p.strategy}'" for p in R.POLICIES) + " end"


@query("rewrite_union", JUDGED + f" select uid, text, label, source from corpus union all select substr(sha256('rewrite|' || j.uid || '|' || {_STRATEGY_SQL} || '|0'), 1, 16), cleaned, '{R.LABEL}', source || ':rewrite' from judged j join corpus using (_row_id) where reject = ''")
def _(spark, d):
    return R.run(corpus(spark, d), OPTIONS, collected_at=now()).select("uid", "text", "label", "source")


# learning

TOKENS = """, tk as (select _row_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') as w from corpus),
 tm as (select _row_id, unnest(w) as term from tk union all select _row_id, w[i] || ' ' || w[i + 1] from (select _row_id, w, unnest(generate_series(1, len(w) - 1)) as i from tk where len(w) > 1)),
 tf as (select _row_id, term, count(*) as tf from tm group by 1, 2), df as (select term, count(*) as df from tf group by 1),
 raw as (select _row_id, term, tf * (ln((1.0::double + (select count(*) from tk)) / (1.0::double + df)) + 1) as raw from tf join df using (term))"""


@query("tfidf_weights", TOKENS + " select _row_id, term, round(raw / sqrt(sum(raw * raw) over (partition by _row_id)), 6) as weight from raw")
def _(spark, d):
    return learning.tfidf(corpus(spark, d)).withColumns(r6("weight"))


# probabilities in closed form: a softmax of the first three components of an embedding
PROBA_SQL = "with p as (select vec_id as _row_id, [exp(4 * cast(embedding[1] as double)), exp(4 * cast(embedding[2] as double)), exp(4 * cast(embedding[3] as double))] as e from embeddings), proba as (select _row_id, list_transform(e, lambda x: x / list_sum(e)) as proba from p), sc as (select _row_id, -list_sum(list_transform(proba, lambda x: x * ln(x + 1e-12::double))) as uncertainty, list_reverse_sort(proba)[1] - list_reverse_sort(proba)[2] as margin from proba)"


def scored(spark, d):
    e = F.array(*[F.exp(4 * F.get("embedding", F.lit(i)).cast("double")) for i in range(3)])
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("_row_id"), e.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return learning.with_uncertainty(df.select("_row_id", F.transform("e", lambda x: x / total).alias("proba")))


@query("entropy_margin_scores", PROBA_SQL + " select _row_id, round(uncertainty, 6) as uncertainty, round(margin, 6) as margin from sc", False)
def _(spark, d):
    return scored(spark, d).select("_row_id", F.round("uncertainty", 6).alias("uncertainty"), F.round("margin", 6).alias("margin"))


def _rounded(df):
    return df.withColumns(r6("uncertainty", "margin"))


_ROUNDED_SQL = PROBA_SQL + ", rd as (select _row_id, round(uncertainty, 6) as uncertainty, round(margin, 6) as margin from sc)"


@query("al_rank_entropy", _ROUNDED_SQL + " select _row_id from (select * from rd order by uncertainty desc, margin, _row_id limit 40)", False)
def _(spark, d):
    return learning.rank(_rounded(scored(spark, d)), "entropy").limit(40).select("_row_id")


@query("al_rank_margin", _ROUNDED_SQL + " select _row_id from (select * from rd order by margin, uncertainty desc, _row_id limit 40)", False)
def _(spark, d):
    return learning.rank(_rounded(scored(spark, d)), "margin").limit(40).select("_row_id")


@query("al_random", f" select _row_id from corpus order by {s_hash(42, '_row_id')}, _row_id limit 30")
def _(spark, d):
    return learning.query(corpus(spark, d), "random", 30)


@query("pool_minus_batch", f" select _row_id from corpus where _row_id not in (select _row_id from corpus order by {s_hash(42, '_row_id')}, _row_id limit 30)")
def _(spark, d):
    pool = corpus(spark, d)
    return pool.join(learning.query(pool, "random", 30), "_row_id", "left_anti").select("_row_id")


@query("train_test_split", f", c as (select *, row_number() over (partition by label order by {s_hash(42, '_row_id')}, _row_id) as rn, count(*) over (partition by label) as n from corpus where not {s_blank('label')}) select _row_id, rn <= ceil(n * 0.2::double) as is_test from c")
def _(spark, d):
    rows = corpus(spark, d).filter(~quality.is_blank("label"))
    return sampling.split(rows, 0.2, 42, "label").select("_row_id", F.col("_test").alias("is_test"))


REPORT = LABELED + f""", pr as (select label as t, predicted_label as p from labeled where not {s_blank('label')}),
 per as (select k as label, (select count(*) from pr where t = k and p = k)::double as tp, (select count(*) from pr where t = k) as support, (select count(*) from pr where p = k)::double as found from (select t as k from pr union select p from pr)),
 m as (select label, coalesce(tp / nullif(found, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2 * tp / nullif(found + support, 0), 0) as f1, support, tp from per),
 out as (select label, precision, recall, f1, support from m
   union all select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) from m
   union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from m
   union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from m)"""


@query("classification_report", REPORT + " select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from out")
def _(spark, d):
    rows = labeled(spark, d).filter(~quality.is_blank("label"))
    return learning.classification_report(rows).withColumns(r6("precision", "recall", "f1")).withColumn("support", F.col("support").cast("bigint"))


HISTORY = "with h as (select case event_id % 3 when 0 then 'random' when 1 then 'entropy' else 'margin' end as strategy, cast(50 + 20 * event_id as bigint) as n_labeled, cast((event_id * 37) % 101 as double) / 101 as f1_macro from events)"


@query("sample_savings", HISTORY + ", tg as (select max(f1_macro) as t from h where strategy = 'random'), r as (select strategy, min(n_labeled) as n_needed from h, tg where f1_macro >= t group by 1) select r.strategy, n_needed, b.n as n_random, b.n - n_needed as saved from r, (select n_needed as n from r where strategy = 'random') b", False)
def _(spark, d):
    k = F.col("event_id")
    h = table(spark, d, "events").select(F.when(k % 3 == 0, "random").when(k % 3 == 1, "entropy").otherwise("margin").alias("strategy"), (50 + 20 * k).cast("bigint").alias("n_labeled"), (((k * 37) % 101).cast("double") / 101).alias("f1_macro"))
    return learning.sample_savings(h)


@query("embedding_cosine_topk", "with q as (select vec_id as q, embedding as x from embeddings where vec_id % 20 = 0) select q, vec_id, rank from (select q, vec_id, row_number() over (partition by q order by round(list_cosine_similarity(list_transform(x, lambda v: cast(v as double)), list_transform(embedding, lambda v: cast(v as double))), 9) desc, vec_id) as rank from q, embeddings where q <> vec_id) where rank <= 5", False)
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return learning.nearest(e, e.filter("vec_id % 20 = 0"), 5)


def _classes(spark, d, join=None):
    return corpus(spark, d, join).filter(~quality.is_blank("label") & F.col("text").rlike(NOT_WS))


@query("al_cycle")
def _(spark, d):
    rows = staged(learning.prepared(_classes(spark, d, "merge")))  # read four times by the split
    parts = staged(sampling.split(rows, 0.2, 42, "label", few=True), "_test")  # three labels; all strategies read it
    pool, test = parts.filter(~F.col("_test")).drop("_test"), parts.filter("_test").drop("_test")
    first = F.col("_row_id").isin([r[0] for r in sampling.sample(pool.select("_row_id"), 50).collect()])
    history = [h for s in ("random", "entropy", "margin") for h in learning.run_cycle(pool.filter(first), pool.filter(~first), test, s)]
    return spark.createDataFrame([(h["strategy"], h["iteration"], h["n_labeled"], float(h["accuracy"]), float(h["f1_macro"])) for h in history], "strategy string, iteration bigint, n_labeled bigint, accuracy double, f1_macro double")


@query("train_baseline")
def _(spark, d):
    return learning.train_baseline(_classes(spark, d), label="label")[1]


@query("al_select_batch")
def _(spark, d):
    rows = _classes(spark, d).select("_row_id", "uid", "text", "label")
    return learning.select_batch(corpus(spark, d).filter("label is null").select("_row_id", "uid", "text"), rows, "entropy", 20).select("_row_id", "uncertainty", "margin", "predicted_label")


__all__ = ["ORACLES", "QUERIES", "entropy", "margin", "uid"]
