"""Benchmark decontamination: word windows of the benchmark in a hash set, which every document is scanned against.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: on UTF-8 these are runs of the bytes 0-9, a-z
and 0x80-0xFF. A window is 10 consecutive words of an item; an item of fewer words, but not none, is one window.
The scan maps a document's words to the benchmark's word numbers, hashes each run of 10 by a rolling polynomial,
looks the hashes up in the sorted set, and verifies each hit word by word. Every document word inside an occurrence is hit.

The set is broadcast in blocks of about ``max_block_bytes`` of benchmark text. One block is the usual case; with more, the documents are numbered and
written, scanned with one block after the other (a block's broadcast is gone before the next is made, and a pass writes hits only), and the hits merged by document.

Null and empty texts have no words and no hits. Items with a null text or no words are never found. Repeated rows are judged
each on its own, very long texts whole. ``find_contamination`` replaces columns of the input that are named like its results; ``decontaminate`` returns the
input's columns unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batches, bounded_batches, set_aside, table, written

WINDOW = 10
MAX_BLOCK_BYTES = 2 << 20  # an index of it takes about 100 MB
FOUND = ("n_words", "n_hit", "n_items", "items", "spans")
ROW = "_decontam_row"
#: Word bytes stay, A-Z become a-z, all else becomes a space.
FOLD = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def build_index(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> dict:
    """vocab: word to number; windows: length to {tuple of numbers: item ids}."""
    vocab: dict[bytes, int] = {}
    windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1 if ids else 0):
            windows.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(str(item))
    return {"vocab": vocab, "windows": windows}


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        out = out * BASE + (ids[j : len(ids) - n + 1 + j].astype(np.uint64) + np.uint64(1))
    return out


def _known_starts(ids: np.ndarray, n: int) -> np.ndarray:
    """Starts of n consecutive known words."""
    if len(ids) < n:
        return np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    return np.flatnonzero(bad[n:] == bad[:-n])


def scan(texts: list[bytes | None], index: dict) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: its words, merged [start, end) spans of hit words, items found."""
    get, get_windows = index["vocab"].get, index["windows"]
    parts, n_words = [], np.zeros(len(texts), np.int64)
    gap = np.array([-1], np.int32)
    for k, t in enumerate(texts):
        w = words_of(t)
        n_words[k] = len(w)
        parts += [np.array([get(x, -1) for x in w], np.int32), gap]
    ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
    begins = np.concatenate([[0], np.cumsum(n_words + 1)])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    found = []
    for n, known in get_windows.items():
        starts = _known_starts(ids, n)
        if not len(starts):
            continue
        table_ = index.setdefault("hashes", {})
        if n not in table_:
            table_[n] = np.unique(_hashes(np.array([x for w in known for x in w], np.int32), n)[::n])
        hashed = _hashes(ids, n)[starts]
        at = np.minimum(np.searchsorted(table_[n], hashed), len(table_[n]) - 1)
        for s in starts[table_[n][at] == hashed].tolist():
            if got := known.get(tuple(ids[s : s + n].tolist())):
                found.append((s, n, got))
    for s, n, got in sorted(found, key=lambda x: (x[0], x[1])):
        k = int(np.searchsorted(begins, s, "right")) - 1
        lo, hi = s - int(begins[k]), s - int(begins[k]) + n
        items[k] |= got
        if spans[k] and lo <= spans[k][-1][1]:
            spans[k][-1] = (spans[k][-1][0], max(spans[k][-1][1], hi))
        else:
            spans[k].append((lo, hi))
    return n_words, spans, items


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _index_blocks(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(size // max_bytes) + 1
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("text is not null")
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit (bigint), n_items (bigint), items (array of item ids as strings, sorted), spans (hit word ranges)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*FOUND)
    blocks = _index_blocks(benchmark, item, item_text, max_block_bytes)
    if len(blocks) == 1:
        return _scanned(docs, blocks[0], text, window)[0]
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
    hits = []
    for k, block in enumerate(blocks):
        found, sent = _scanned(rows.select(ROW, text), block, text, window)
        hits.append(written(found.filter("n_hit > 0" if k else "n_words > 0").select(ROW, "n_words", "items", "spans"), "hits"))
        sent.destroy()
    one = reduce(DataFrame.union, hits).groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def add(acc, x):
        """The span joined to the last one that it touches."""
        last = F.element_at(acc, -1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    merged = F.when(F.size("spans") > 0, F.aggregate("spans", F.slice("spans", 1, 1), add)).otherwise(F.col("spans"))
    one = one.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    none = lambda c: F.coalesce(c, F.array().cast(one.schema[c].dataType))
    out = rows.join(one, ROW, "left").withColumns({"n_words": F.coalesce("n_words", F.lit(0).cast("bigint")), "items": none("items"), "spans": none("spans")})
    return out.select(*docs.columns, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans")


def _scanned(docs: DataFrame, block: DataFrame, text: str, window: int):
    """The rows with what one block of the benchmark hits, and the block's broadcast."""
    items = [(r["item"], r["text"].encode()) for r in block.collect()]  # about max_block_bytes of text
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(build_index(items, window)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(sent.value)
        for b in batches(it):
            n_words, spans, items = scan(as_bytes(b.column(text)), index)
            found = [
                pa.array(n_words, pa.int64()),
                pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], ARROW_SPANS),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *FOUND])

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), SPANS)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(FOUND, kinds, strict=True))])), sent


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its hit words and what stands between them; the parts that remain are joined by one space."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    out.append(text[at:])
    return " ".join(x for x in (p.strip() for p in out) if x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", **how) -> DataFrame:
    """mode documents: rows with a hit go. mode spans: hit words are cut out of the text; rows left without any word go.

    Columns stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    inside, back = set_aside(docs, [*FOUND, ROW])
    text = inside.columns[docs.columns.index(text)]
    found = find_contamination(inside, benchmark, text=text, **how)
    if mode == "documents":
        return back(found.filter("n_hit = 0"))
    cut = F.udf(lambda t, s: cut_spans(t, [(x["start"], x["end"]) for x in s]) if t and s else t, "string", useArrow=True)  # Spark calls it for every row
    kept = found.filter("n_hit = 0 or n_hit < n_words")
    return back(kept.withColumn(text, F.when(F.col("n_hit") > 0, cut(F.col(text), F.col("spans"))).otherwise(F.col(text))))


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
with d as (
  select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as k
  from (select item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as k
  from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, lens where len(w) >= n)),
hits as (select rid, dw.n, i, item from dw join bw using (n, k)),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + n - 1)) as p from hits) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (rid) left join its using (rid)
"""
