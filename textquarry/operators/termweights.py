"""TF-IDF over tables of any size without a shuffled row a term occurrence.

Texts are dealt by id to chunks of about CHUNK_BYTES of the input's files, and no more than CHUNK_ROWS rows on average. A chunk sends each of its distinct terms once,
with the number of its ids that have it, to a bucket by the term's hash, many terms to a compressed message; a bucket sums the numbers and answers each message in
its order, and with the answers the chunk works out its own weights. What moves is the texts once and the distinct terms of a chunk, not a row for each id and
term; a frequent term is one entry a chunk.

Rows of one id (null is one too) are one document of the result, each a row in the number of documents, and are held in one chunk.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 4000
CHUNKS_A_BUCKET = 4
PLACES_A_WORD = 16  # buckets that the pairs of one first word go to, so that they stand together in a message
MOST_PARTITIONS = 4096


def _counted(ids: pa.Array, texts: pa.Array, bigrams: bool) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids; the words in order; the distinct terms in order, as places of the first word and (from 1; 0: none) of the second; and for each pair of an id and its
    term: which id, which term, how often. ``texts``: words joined by spaces."""
    own = ids.dictionary_encode(null_encoding="encode")
    lists = pc.split_pattern(texts, " ")
    words, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    keep = pc.not_equal(words, "")  # a text without words
    words, parent = words.filter(keep), parent[keep.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    vocabulary, place = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code, wide = place[coded.indices.to_numpy()], len(order) + 1
    doc = own.indices.to_numpy().astype(np.int64)[parent]
    keys = code * wide  # then those of pairs of neighbours: first word, second word + 1
    if bigrams and len(code) > 1:
        at = np.flatnonzero(parent[1:] == parent[:-1])
        keys, doc = np.concatenate([keys, keys[at] + code[at + 1] + 1]), np.concatenate([doc, doc[at]])
    terms, term = np.unique(keys, return_inverse=True)
    pairs, tf = np.unique(doc * max(1, len(terms)) + term, return_counts=True)
    doc, term = np.divmod(pairs, max(1, len(terms)))
    first, second = np.divmod(terms, wide)
    return own.dictionary, vocabulary, first, second, doc, term, tf


def _parts(vocabulary: pa.Array, first: np.ndarray, second: np.ndarray, buckets: int) -> tuple[list[int], list[np.ndarray]]:
    """Buckets that the terms go to, and the terms of each, in their order."""
    crc = np.fromiter((crc32(w.encode()) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
    after = np.concatenate([np.zeros(1, np.uint64), crc])[second] % np.uint64(PLACES_A_WORD)
    h = (crc[first] * np.uint64(PLACES_A_WORD) + after) * np.uint64(0x9E3779B97F4A7C15)
    home = (h >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(home, kind="stable")
    used, begins = np.unique(home[order], return_index=True)
    return used.tolist(), np.split(order, begins[1:]) if len(used) else []


def _pack(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.Codec("zstd", 6).compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], "zstd", asbytes=True)


def _spelled(vocabulary: pa.Array, first: np.ndarray, second: np.ndarray) -> bytes:
    """Terms in order as a message: the first words, the second ones (empty: none), and how many terms each first word has."""
    heads, times = np.unique(first, return_counts=True)
    with_none = pa.concat_arrays([pa.array([""], vocabulary.type), vocabulary])
    lines = ["\n".join(x.to_pylist()).encode() for x in (vocabulary.take(pa.array(heads)), with_none.take(pa.array(second)))]
    return _pack(b"\0".join([*lines, times.astype("<u4").tobytes()]))


def _read(message: bytes) -> pa.Array:
    """The terms of a message, all with a space after the first word."""
    heads, seconds, times = _unpack(message).split(b"\0", 2)
    firsts = pa.array(heads.split(b"\n"), pa.binary()).take(pa.array(np.repeat(np.arange(len(times) // 4), np.frombuffer(times, "<u4"))))
    return pc.binary_join_element_wise(firsts, pa.array(seconds.split(b"\n"), pa.binary()), b" ")


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _file_bytes(df: DataFrame) -> int:
    """Size of the files that the rows come from."""
    sc = df.sparkSession.sparkContext
    paths, conf = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()], sc._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def weights(df: DataFrame, words: Column, row_id: str, bigrams: bool) -> DataFrame:
    """row id, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), ids scaled to length 1. ``words``: the array of a text's words, of letters, digits and underscores."""
    n = df.count()
    chunks = int(max(_file_bytes(df) // CHUNK_BYTES, n // CHUNK_ROWS)) + 1
    buckets, places = chunks // CHUNKS_A_BUCKET + 1, min(chunks, MOST_PARTITIONS)
    kind = df.select(row_id).schema[0].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), F.array_join(words, " ").alias("words"), F.pmod(F.xxhash64(row_id), F.lit(chunks)).alias("chunk"))
    dealt = rows.repartition(places, "chunk").groupBy("chunk")  # shuffled once, for both that read it

    def send(key, t):
        _, vocabulary, first, second, _, term, _ = _counted(_one(t.column("id")), _one(t.column("words")), bigrams)
        here = np.bincount(term, minlength=len(first)).astype("<u4")
        used, parts = _parts(vocabulary, first, second, buckets)
        terms = [_spelled(vocabulary, first[x], second[x]) for x in parts]
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(used), pa.int64()), "bucket": pa.array(used, pa.int64()), "terms": pa.array(terms, pa.binary()), "seen": pa.array([_pack(here[x].tobytes()) for x in parts], pa.binary())})

    def answer(key, t):
        lists = [_read(x) for x in t.column("terms").to_pylist()]
        code = pa.concat_arrays(lists).dictionary_encode().indices.to_numpy()
        total = np.bincount(code, np.frombuffer(b"".join(_unpack(x) for x in t.column("seen").to_pylist()), "<u4")).astype("<u8")
        replies = np.split(total[code], np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "seen": pa.array([_pack(x.tobytes()) for x in replies], pa.binary())})

    def weigh(key, t, replies):
        seen_in = dict(zip(replies.column("bucket").to_pylist(), replies.column("seen").to_pylist(), strict=True))
        ids, vocabulary, first, second, doc, term, tf = _counted(_one(t.column("id")), _one(t.column("words")), bigrams)
        seen = np.empty(len(first))
        for b, x in zip(*_parts(vocabulary, first, second, buckets), strict=True):
            seen[x] = np.frombuffer(_unpack(seen_in.pop(b)), "<u8")
        raw = tf * (np.log((1.0 + n) / (1.0 + seen)) + 1)[term]
        norm = np.sqrt(np.bincount(doc, raw * raw, len(ids)))
        spelled = vocabulary.take(pa.array(first))
        two = pc.binary_join_element_wise(spelled, pa.concat_arrays([pa.array([""], vocabulary.type), vocabulary]).take(pa.array(second)), " ")
        spelled = pc.if_else(pa.array(second > 0), two, spelled)
        return pa.table({row_id: ids.take(pa.array(doc)), "term": spelled.take(pa.array(term)), "weight": raw / norm[doc]})

    sent = dealt.applyInArrow(send, "chunk bigint, bucket bigint, terms binary, seen binary").repartition(min(buckets, MOST_PARTITIONS), "bucket")
    replies = sent.groupBy("bucket").applyInArrow(answer, "chunk bigint, bucket bigint, seen binary").repartition(places, "chunk")
    return dealt.cogroup(replies.groupBy("chunk")).applyInArrow(weigh, f"`{row_id}` {kind}, term string, weight double")
