"""Collectors: exports of data sets, JSON records, paged listings, wiki pages and web pages, all into one schema, and their union.

Network access is the caller's: paged sources take a function that fetches one page.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite
from ..functions.text import WIKI_NAMESPACES, WS, default_source_name, is_blank, strip, text_of, uid, without_wiki_markup
from ..operators.sampling import cap_per_group, hash_order, row_cap, stratified_sample
from .tables import read_table

COLUMNS = ("uid", "text", "audio", "image", "label", "source", "collected_at", "language", "source_type", "url", "meta")
MAX_PAGES = 5000


def number_rows(df: DataFrame, name: str = "_row_id", order: list[str] | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the order of the file (or of ``order``) without a window over everything: rows are counted by partition first, and a row's
    number is its place in its partition after those before. Both passes have to see the same partitions, as a scan of files does."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    marked = df.withColumn(name, F.monotonically_increasing_id())  # the partition above 33 bits, the place below
    part = F.shiftright(F.col(name), 33)
    sizes = sorted(marked.groupBy(part.alias("p")).count().collect())  # a row a partition
    starts, at = [], 0
    for r in sizes:
        starts.append((r["p"], at))
        at += r["count"]
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint"))
    out = marked.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
    return out.select(*[c for c in df.columns if c != name], name)


def as_label(df: DataFrame, column: str) -> Column:
    """Any type as a string; NaN as null."""
    kind = df.schema[column].dataType
    return finite(column).cast("string") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(column).cast("string")


def unified(df: DataFrame, source: str | Column, source_type: str, text: Column, label: Column, meta: Column, language: str | None = None, url: Column | None = None, collected_at: Column | None = None, row_id: str = "_row_id") -> DataFrame:
    """The eleven columns and the row id; blank texts go after rows are numbered, so ids don't move when a row turns blank."""
    none = F.lit(None).cast("string")
    name = F.lit(source) if isinstance(source, str) else source
    now = collected_at if collected_at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    clean = strip(text.cast("string"))
    out = {"uid": uid(name, clean, F.col(row_id)), "text": clean, "audio": none, "image": none, "label": label.cast("string"), "source": name, "collected_at": now, "language": F.lit(language).cast("string"), "source_type": F.lit(source_type), "url": url if url is not None else none, "meta": meta}
    return df.filter(~is_blank(text)).select(*[out[c].alias(c) for c in COLUMNS], row_id)


def meta_json(**columns: Column) -> Column:
    """A JSON object with sorted keys; null if empty."""
    return F.nullif(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), F.lit("{}"))


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    """[{column, op: eq or in, value}], all of which must hold; null equals null."""
    for f in filters:
        c, v = F.col(f["column"]), f.get("value")
        if f.get("op", "eq") == "eq":
            df = df.filter(c.eqNullSafe(F.lit(v)))
        elif f["op"] == "in":
            known = [x for x in v if x is not None]
            hit = c.isin(*known) if known else F.lit(False)
            df = df.filter(hit | c.isNull() if None in v else hit)
        else:
            raise ValueError(f"filters know eq and in, not {f['op']!r}")
    return df


def from_export(df: DataFrame, source: str, text_column: str, label_column: str | None = None, constant_label: str | None = None, filters: list[dict] = (), max_rows: int | None = None, source_type: str = "hf_dataset", language: str | None = None, seed_role: str | None = None, label_names: dict | None = None, **how) -> DataFrame:
    """A data set's export (rows numbered in file order before blanks go). A constant label wins unless a label column is named."""
    df = apply_filters(df, list(filters))
    rows = df if "_row_id" in df.columns else number_rows(df)
    if label_column is None and constant_label is None and "label" in df.columns:
        label_column = "label"
    label = as_label(rows, label_column) if label_column in rows.columns else F.lit(constant_label).cast("string")
    raw = label
    if label_names and label_column in rows.columns:
        label = reduce(lambda acc, kv: F.when(raw == str(kv[0]), F.lit(kv[1])).otherwise(acc), label_names.items(), raw)
    meta = meta_json(hf_index=F.col("_row_id"), raw_label=raw, **({"raw_label_name": label} if label_names else {}), **({"seed_role": F.lit(seed_role)} if seed_role else {}))
    out = unified(rows, source, source_type, F.col(text_column), label, meta, language, **how)
    cap = row_cap(max_rows)
    return out.orderBy("_row_id").limit(cap) if cap is not None else out


def from_records(spark: SparkSession, payload: str | list | dict, source: str, records_path: str = "", text_field: str = "text", label_field: str | None = None, source_type: str = "api", max_rows: int | None = None, **how) -> DataFrame:
    """Records at a dotted path of a JSON answer; a record that is no object is its own text."""
    data = json.loads(payload) if isinstance(payload, str) else payload
    for part in filter(None, records_path.split(".")):
        data = data.get(part) if isinstance(data, dict) else None
    if not isinstance(data, list):
        raise ValueError(f"{records_path!r} is no list of records")
    get = lambda r, f: r.get(f) if isinstance(r, dict) else (str(r) if f == text_field else None)
    rows = [(i, None if (t := get(r, text_field)) is None else str(t), None if label_field is None or (x := get(r, label_field)) is None else str(x), json.dumps(r, ensure_ascii=False, sort_keys=True)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "_row_id bigint, t string, l string, record string")
    out = unified(df, source, source_type, F.col("t"), F.col("l"), F.col("record"), **how)
    cap = row_cap(max_rows)
    return out.orderBy("_row_id").limit(cap) if cap is not None else out


def from_pages(spark: SparkSession, fetch: Callable[[dict], dict], source: str, list_path: str = "query.categorymembers", text_field: str = "title", max_pages: int = MAX_PAGES, **how) -> DataFrame:
    """Follows ``continue`` tokens until there is none; ``fetch`` gets the token's parameters and returns one page's answer."""
    token, records = {}, []
    for _ in range(max_pages):
        page = fetch(token)
        part = page
        for key in list_path.split("."):
            part = (part or {}).get(key)
        records += part or []
        token = page.get("continue")
        if not token:
            return from_records(spark, records, source, "", text_field, **how)
    raise RuntimeError(f"no end after {max_pages} pages")


# wiki text


def _link(line: Column) -> Column:
    """The text of the first link on a line whose target is no category, file or other language."""
    inner = F.transform(F.regexp_extract_all(line, F.lit(r"\[\[((?:[^|\]]+\|)?[^\]]+)\]\]"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^([^|\]]+)\|", 1).alias("left"), x.alias("all")))
    parts = F.transform(inner, lambda x: F.struct(strip(F.when(x["left"] != "", x["left"]).otherwise(x["all"])).alias("title"), strip(F.when(x["left"] != "", F.substring(x["all"], F.length(x["left"]) + 2, F.length(x["all"]))).otherwise(x["all"])).alias("shown")))

    def useful(x: Column) -> Column:
        t = strip(F.regexp_replace(x["title"], "^:+", ""))
        space = F.lower(strip(F.substring_index(t, ":", 1)))
        return (t != "") & ~(t.contains(":") & space.isin(*WIKI_NAMESPACES)) & ~t.rlike("(?i)^[a-z]{2,3}:")

    return without_wiki_markup_or_null(F.get(F.filter(parts, useful), F.lit(0))["shown"])


def without_wiki_markup_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), without_wiki_markup(c))


def wiki_items(df: DataFrame, wikitext: str = "wikitext", plain_lines: bool = False) -> DataFrame:
    """The input's other columns with item_no (line number) and item: list items, first links of table rows and other lines, optionally plain lines."""
    lines = df.select(*[c for c in df.columns if c != wikitext], F.posexplode(F.split(text_of(wikitext), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("item_no", "_line"))
    s = F.col("_s")
    skip = (s == "") | s.startswith("{|") | s.startswith("|}") | s.startswith("|-") | s.startswith("!") | s.startswith("{{") | (s.startswith("==") & s.endswith("=="))
    item = F.regexp_extract(s, rf"^[*#:;]+{WS}*(.+)$", 1)
    raw = F.when(s.rlike(rf"^[*#:;]+{WS}*."), strip(item)).when(s.contains("[["), _link(s)).when(F.lit(plain_lines) & ~s.startswith("|"), s)
    out = lines.withColumn("_s", strip("_line")).filter(~skip).withColumn("item", without_wiki_markup_or_null(raw))
    return out.filter("item is not null and item <> ''").drop("_line", "_s")


WIKI_MODES = {"mediawiki_wikitext_list": wiki_items}


def from_wiki(df: DataFrame, source: str | Column, mode: str = "mediawiki_wikitext_list", wikitext: str = "wikitext", url: str | None = None, row_id: str = "_row_id", **how) -> DataFrame:
    """Items of wiki pages; a page without text is an error."""
    if mode not in WIKI_MODES:
        raise ValueError(f"parse mode is one of {sorted(WIKI_MODES)}, not {mode!r}")
    if df.filter(is_blank(wikitext)).take(1):
        raise ValueError("a page has no wiki text")
    return unified(WIKI_MODES[mode](df, wikitext), source, "mediawiki_page", F.col("item"), F.lit(None), meta_json(item_no=F.col("item_no"), parse_mode=F.lit(mode)), url=F.col(url) if url else None, row_id=row_id, **how)


# web pages


class _Selector(HTMLParser):
    """Nodes that match a chain of tag, .class and #id parts, each below the one before."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, selector: str, attribute: str | None):
        super().__init__(convert_charrefs=True)
        self.chain = [self._part(p) for p in selector.split()]
        self.attribute, self.stack, self.open, self.found = attribute, [], [], []

    @staticmethod
    def _part(p: str) -> tuple[str, frozenset, str | None]:
        import re

        m = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)", p)
        if not m:
            raise ValueError(f"selectors are made of tag, .class and #id, not {p!r}")
        names = re.findall(r"([.#])([\w-]+)", m[2] or "")
        return (m[1] or "*").lower(), frozenset(n for k, n in names if k == "."), next((n for k, n in names if k == "#"), None)

    @staticmethod
    def _fits(node, part) -> bool:
        (tag, classes, ident), (t, c, i) = node, part
        return t in ("*", tag) and c <= classes and i in (None, ident)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        node = (tag, frozenset((a.get("class") or "").split()), a.get("id"))
        above = [n for n, _ in self.stack]
        if self._fits(node, self.chain[-1]):
            k = len(self.chain) - 2
            for n in reversed(above):
                if k >= 0 and self._fits(n, self.chain[k]):
                    k -= 1
            if k < 0:
                self.found.append([a.get(self.attribute)] if self.attribute else [])
                if not self.attribute and tag not in self.VOID:
                    self.open.append((len(self.stack), len(self.found) - 1))
        if tag not in self.VOID:
            self.stack.append((node, tag))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][1] == tag:
                del self.stack[i:]
                self.open = [(d, k) for d, k in self.open if d < i]
                break

    def handle_data(self, data):
        if (t := data.strip()) and not (self.stack and self.stack[-1][1] in ("script", "style")):
            for _, k in self.open:
                self.found[k].append(t)


def select_nodes(html: str | None, selector: str, attribute: str | None = None) -> list[str]:
    """Text (parts joined by spaces) or an attribute of each node that fits; empty ones are left out."""
    if not html:
        return []
    p = _Selector(selector, attribute)
    p.feed(html)
    p.close()
    return [t for t in (" ".join(x for x in parts if x).strip() for parts in p.found) if t]


def scrape(df: DataFrame, selector: str, attribute: str | None = None, html: str = "html") -> DataFrame:
    """The input's other columns with scrape_index and value: a row a node."""
    keep = [c for c in df.columns if c != html]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("scrape_index", T.LongType()), T.StructField("value", T.StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [select_nodes(h, selector, attribute) for h in pdf[html]]
            rows = pdf[keep].loc[pdf.index.repeat([len(x) for x in found])].reset_index(drop=True)
            rows["scrape_index"] = [i for x in found for i in range(len(x))]
            rows["value"] = [v for x in found for v in x]
            yield rows

    return df.mapInPandas(run, schema)


def from_html(df: DataFrame, source: str | Column | None, selector: str, attribute: str | None = None, url: str = "url", row_id: str = "_row_id", **how) -> DataFrame:
    name = source if source is not None else default_source_name(url, "scrape")
    meta = meta_json(css_selector=F.lit(selector), scrape_index=F.col("scrape_index"))
    return unified(scrape(df, selector, attribute), name, "scrape", F.col("value"), F.lit(None), meta, url=F.col(url), row_id=row_id, **how)


# dispatch and union


def collect_source(spark: SparkSession, config: dict) -> DataFrame:
    """One source by its ``type``; what isn't the type's own goes to its collector as it is."""
    c = dict(config)
    kind, name = c.pop("type", None), c.pop("name", None)
    if kind in ("hf_dataset", "kaggle_dataset"):
        df = read_table(spark, c.pop("path"))
        return from_export(df, name, source_type=kind, **c)
    if kind == "api":
        return from_pages(spark, c.pop("fetch"), name, **c) if "fetch" in c else from_records(spark, c.pop("payload"), name, **c)
    if kind == "scrape":
        return from_html(number_rows(read_table(spark, c.pop("path"))), name, **c)
    if kind == "mediawiki_page":
        return from_wiki(number_rows(spark.read.text(c.pop("path"), wholetext=True).withColumnRenamed("value", "wikitext")), name, **c)
    raise ValueError(f"unknown source type {kind!r}")


def merge(frames: list[DataFrame], max_rows: int | None = None, per_source: dict[str, int] | int | None = None, seed: int = 42) -> DataFrame:
    """Union by name with the eleven columns first and any others kept; caps by source (hash order), then a stratified sample of the whole."""
    if not frames:
        raise ValueError("there is nothing to merge")
    none = F.lit(None).cast("string")
    frames = [f.withColumns({c: none for c in COLUMNS if c not in f.columns}) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    out = out.select(*COLUMNS, *[c for c in out.columns if c not in COLUMNS])
    key = "uid"
    if isinstance(per_source, dict):
        known = {k: row_cap(v) for k, v in per_source.items() if row_cap(v) is not None}
        if known:
            caps = reduce(lambda acc, kv: F.when(F.col("source") == kv[0], F.lit(kv[1])).otherwise(acc), known.items(), F.lit(None).cast("int"))
            capped = F.coalesce(F.col("source").isin(*known), F.lit(False))
            from pyspark.sql import Window

            # the largest cap is a constant, by which Spark cuts groups before the shuffle; sources without a cap aren't ranked
            ranked = out.filter(capped).withColumn("_rank", F.row_number().over(Window.partitionBy("source").orderBy(hash_order(seed, key), key)))
            out = ranked.filter((F.col("_rank") <= max(known.values())) & (F.col("_rank") <= caps)).drop("_rank").unionByName(out.filter(~capped))
    elif per_source is not None:
        out = cap_per_group(out, "source", per_source, seed, key)
    return stratified_sample(out, max_rows, "source", seed, key) if row_cap(max_rows) is not None else out
