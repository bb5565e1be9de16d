"""Language-model scores by context-tree weighting over bytes, and a smoothed unigram score beside them.

Every byte is eight binary decisions, most significant bit first, each with its own context tree: its context is the bits of the byte so far, and the
tree's nodes are the 0 to ``DEPTH`` = 5 bytes before. A node's counts (n0, n1) give its Krichevsky-Trofimov block probability
P_e = G(n0 + 1/2) G(n1 + 1/2) / (pi G(n0 + n1 + 1)), and the weighted probability mixes all depths:
P_w = P_e at a leaf, (P_e + product of the children's P_w) / 2 inside. As P_e depends on counts alone, the corpus is learned from in any
order: 6-byte counts are summed by Spark over all training texts, and P_w follows from the leaves up. A bit's probability is
w e + (1 - w) (the child's), e the node's KT estimate and w = P_e / (2 P_w), down to the leaf. A text's probability has all its bytes
and one end; before the text stand ends. -log2 of it by the bytes is the code length a byte.

The tree keeps every context that the training texts hold; no part of it that grows with them is broadcast. Texts are dealt to chunks of about
``CHUNK_BYTES``; each chunk sends its distinct codes (a context and the byte after it) with their training counts to buckets by the last two bytes of the context,
so a bucket holds whole subtrees from depth 2 down. Counts of a bucket are summed ``FAN`` chunks at a time, round by round, until one row holds them. The
buckets' log P_w are summed into the 257 nodes above them (65,536 pairs of floats, for all prefixes), and then each bucket gives ``FAN`` chunks at a time the
probabilities of the codes that they sent.

Word counts are never broadcast either: each chunk sends its distinct words, which are summed by partial aggregation, gets their counts back, and scores its texts. A
word or code moves once a chunk, however frequent it is.

Null and empty texts have no words: one token (the end) and the end's probability. Null ids count as the empty id. Repeated rows are texts of their own. A very long
text is scored whole, in one chunk. Without training texts all counts are 0. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, crc_mod, table, written

DEPTH = 5  # 2 to 6
CHUNK_BYTES = 12 << 20
BUCKETS = 256
FAN = 64
END = 0xFF  # no byte of UTF-8


# the model


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(n: np.ndarray) -> np.ndarray:
    return _lgamma(n[0] + 0.5) + _lgamma(n[1] + 0.5) - _lgamma(n[0] + n[1] + 1.0) - np.log(np.pi)


def byte_contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte of the texts and their ends, with the ``DEPTH`` bytes before it above it: codes, where texts begin, lengths with the end."""
    mark = bytes([END]) * DEPTH
    x = np.frombuffer(mark + b"".join(t + mark for t in texts), np.uint8).astype(np.int64)
    code = np.zeros(len(x) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code = code << 8 | x[k : len(x) - DEPTH + k]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + DEPTH) - DEPTH
    keep = np.ones(len(code), bool)  # of the marks after a text only the first is its end
    for k in range(1, DEPTH):
        keep[ends + k] = False
    return code[keep], np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64), lengths + 1


# learning


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but 0x20 and 0x09-0x0D, A-Z lower-cased."""
    return text.lower().split()


def code_counts(texts: list[bytes], learns: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of the texts, sorted, and how often each stands in those that are learned from."""
    codes, counts = [], []
    for part in _slices(texts):
        found, at = np.unique(byte_contexts(texts[part])[0], return_inverse=True)
        weight = np.repeat(np.array(learns[part], float), [len(t) + 1 for t in texts[part]])
        codes.append(found)
        counts.append(np.bincount(at, weight, len(found)))
    return _summed(codes, counts)


def coded(texts: list[bytes]) -> tuple[np.ndarray, list[tuple]]:
    """The distinct codes of the texts, sorted; and for each slice of the texts (slice, its distinct codes, which of them each byte has, where texts begin)."""
    parts = []
    for part in _slices(texts):
        x, begins, _ = byte_contexts(texts[part])
        found, at = np.unique(x, return_inverse=True)
        parts.append((part, found, at.astype(np.int32), begins))
    return np.unique(np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])), parts


def _slices(texts: list[bytes]) -> Iterator[slice]:
    """Slices of the texts of about 1 MB or a longer text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 1 << 20):
            size += len(texts[j]) + DEPTH
            j += 1
        yield slice(i, j)
        i = j


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([np.empty(0), *counts]), len(both)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Integers from 0 up, compressed byte place by byte place."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return struct.pack("<Q", len(x)) + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<Q", data)[0]
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def packed_codes(x: np.ndarray) -> bytes:
    """Ascending codes, by their differences."""
    return packed(np.diff(x, prepend=0))


def unpacked_codes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the context."""
    return ((codes >> 8 & 0xFFFF) * 40503 & 0xFFFF) * buckets >> 16


# A node's key is its context above the prefix of the byte, 8 bits; its parent's key is the same without the first byte.


def _kt1(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _log_kt(np.stack([n0, n1]).astype(float))


def _up(keys: np.ndarray, n: np.ndarray, log_w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys at ``depth``, counts, and the sum of the children's log P_w."""
    k, at = np.unique(keys & (1 << 8 * (depth + 1)) - 1, return_inverse=True)
    return k, np.stack([np.bincount(at, x, len(k)) for x in n]).astype(float), np.bincount(at, log_w, len(k)).astype(float)  # integers if empty


def _inner(n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P_w of inner nodes, and w."""
    own = _kt1(*n)
    log_w = np.logaddexp(own, below) - np.log(2)
    return log_w, np.exp(own - log_w - np.log(2))


def _estimate(n: np.ndarray) -> np.ndarray:
    return (n[1] + 0.5) / (n[0] + n[1] + 1)


def subtrees(codes: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], tuple]:
    """From the codes of some depth-2 contexts: (keys, w, estimate) at each depth from ``DEPTH`` to 2, and their sums at depth 1."""
    c, n = codes[counts > 0], counts[counts > 0].astype(float)
    byte = c & 255
    nodes = np.concatenate([c - byte | 1 << i | byte >> 8 - i for i in range(8)])
    k, at = np.unique(nodes, return_inverse=True)
    bits, n = np.concatenate([byte >> 7 - i & 1 for i in range(8)]), np.tile(n, 8)
    n = np.stack([np.bincount(at, n * (bits == x), len(k)) for x in (0, 1)]).astype(float)
    log_w, levels = _kt1(*n), [(k, np.ones(len(k)), _estimate(n))]
    for d in range(DEPTH - 1, 1, -1):
        k, n, below = _up(k, n, log_w, d)
        log_w, w = _inner(n, below)
        levels.append((k, w, _estimate(n)))
    return levels, _up(k, n, log_w, 1)


def top_nodes(k: np.ndarray, n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a, b for each key at depth 1: a bit is 1 with probability a + b (that of depth 2). From the sums at depth 1 of all subtrees."""
    log_w, w = _inner(n, below)
    w1, e1 = np.full(1 << 16, 0.5), np.full(1 << 16, 0.5)
    w1[k], e1[k] = w, _estimate(n)
    k, n, below = _up(k, n, log_w, 0)
    w0, e0 = np.full(256, 0.5), np.full(256, 0.5)
    w0[k], e0[k] = _inner(n, below)[1], _estimate(n)
    w0, e0 = np.tile(w0, 256), np.tile(e0, 256)
    return w0 * e0 + (1 - w0) * w1 * e1, (1 - w0) * (1 - w1)


def log_probabilities(codes: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each code after the others. A node without counts has estimate 1/2, and so has all below it."""
    c = codes
    byte, out = c & 255, np.zeros(len(c))
    for i in range(8):
        key, p = c - byte | 1 << i | byte >> 8 - i, np.full(len(c), 0.5)
        for j, (k, w, e) in enumerate(levels):
            if len(k):
                x = key & (1 << 8 * (DEPTH - j + 1)) - 1
                at = np.minimum(np.searchsorted(k, x), len(k) - 1)
                p = np.where(k[at] == x, w[at] * e[at] + (1 - w[at]) * p, 0.5)
        top = key & 0xFFFF
        p = a[top] + b[top] * p
        out += np.log10(np.where(byte >> 7 - i & 1, p, 1 - p))
    return out.astype(np.float32)


def in_memory(learned: list[bytes], texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text with its end, for corpora that fit in one process."""
    known = code_counts(learned, [True] * len(learned))
    levels, top = subtrees(*known)
    codes, begins, _ = byte_contexts(texts)
    return np.add.reduceat(log_probabilities(codes, levels, *top_nodes(*top)), begins, dtype=np.float64)


def summed_buckets(grams: DataFrame, chunks: int) -> DataFrame:
    """bucket, codes, counts: a row a bucket, summed ``FAN`` rows at a time."""

    def add(key, t):
        codes, counts = _summed([unpacked_codes(x) for x in t.column("codes").to_pylist()], [unpacked(x) for x in t.column("counts").to_pylist()])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "salt": pa.array([key[1].as_py() // FAN], pa.int64()), "codes": pa.array([packed_codes(codes)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())})

    kind = "bucket bigint, salt bigint, codes binary, counts binary"
    rows, groups = grams.select("bucket", (F.col("chunk") / FAN).cast("bigint").alias("salt"), "codes", "counts"), chunks
    while True:
        rows, groups = written(rows.groupBy("bucket", "salt").applyInArrow(add, kind), "sums"), -(-groups // FAN)
        if groups <= 1:
            return rows.drop("salt")


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """``train``: a condition on the rows that are learned from. Returns id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # the place in the files tells repeated rows apart, so that they can't gather in one chunk
    spread = F.xxhash64(F.col(id_col), F.col(text), F.input_file_name(), F.input_file_block_start())
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), spread.alias("spread"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(size // chunk_bytes) + 1
    buckets = min(1 << 16, max(buckets, chunks // 8))
    dealt = docs.withColumn("chunk", F.pmod("spread", F.lit(chunks))).drop("spread")

    def vocabulary(key, t):
        seen: Counter = Counter()
        texts, train = as_bytes(t.column("text")), t.column("train").to_pylist()
        for x, learns in zip(texts, train, strict=True):
            words = words_of(x)
            words.append(b"")  # the end
            if learns:
                seen.update(words)
            else:
                for w in words:
                    seen.setdefault(w, 0)
        codes, counts = code_counts(texts, train)
        home = bucket_of(codes, buckets)
        order = np.argsort(home, kind="stable")
        used, first = np.unique(home[order], return_index=True)
        n, parts = len(seen), np.split(order, first[1:])
        columns = {
            "chunk": pa.array(np.full(n + len(used), key[0].as_py())),
            "word": pa.array([*seen.keys(), *[None] * len(used)], pa.binary()),
            "n": pa.array([*seen.values(), *[None] * len(used)], pa.int64()),
            "bucket": pa.array([*[None] * n, *used.tolist()], pa.int64()),
            "codes": pa.array([*[None] * n, *(packed_codes(codes[x]) for x in parts)], pa.binary()),
            "counts": pa.array([*[None] * n, *(packed(counts[x]) for x in parts)], pa.binary()),
        }
        return pa.table(columns)

    sent = written(dealt.groupBy("chunk").applyInArrow(vocabulary, "chunk bigint, word binary, n bigint, bucket bigint, codes binary, counts binary"), "sent")
    words = sent.filter("bucket is null")
    counted = written(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    totals = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, v = totals["n"] or 0, totals["v"] or 0
    unit = float(np.log10(n_train + v + 1))

    grams = sent.filter("bucket is not null").select("chunk", "bucket", "codes", "counts")
    model = summed_buckets(grams, chunks)

    def roots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for c, n in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k, n, below = subtrees(unpacked_codes(c), unpacked(n))[1]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[0]), pa.array(n[1]), pa.array(below)], ["key", "n0", "n1", "below"])

    top = model.select("codes", "counts").mapInArrow(roots, "key bigint, n0 double, n1 double, below double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toArrow()  # at most 65,536 rows
    key, n0, n1, below = (top.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
    shared = spark.sparkContext.broadcast(top_nodes(key, np.stack([n0, n1]), below))

    def answer(key, t, m):
        """What a bucket's model says of the codes that some chunks sent."""
        if not len(t):
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "lp": pa.array([], pa.binary())})
        sent = [unpacked_codes(x) for x in t.column("codes").to_pylist()]
        asked = np.unique(np.concatenate(sent))
        levels = subtrees(unpacked_codes(m.column("codes")[0].as_py()), unpacked(m.column("counts")[0].as_py()))[0]
        lp = log_probabilities(asked, levels, *shared.value)
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "lp": pa.array([lp[np.searchsorted(asked, x)].tobytes() for x in sent], pa.binary())})

    salt = (F.col("chunk") / FAN).cast("bigint")
    copies = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // FAN)).cast("array<bigint>")))
    asks = grams.select("chunk", "bucket", "codes", salt.alias("salt"))
    answers = asks.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(answer, "chunk bigint, bucket bigint, lp binary")
    known = words.select("chunk", "word").join(counted, "word").select("chunk", "word", "c").unionByName(answers, allowMissingColumns=True)

    def score(key, left, right):
        reply = right.column("bucket").is_valid()
        replies, right = right.filter(reply), right.filter(pc.invert(reply))
        c = right.column("c").to_numpy()
        log_of = dict(zip(right.column("word").to_pylist(), np.log10(c + 1.0).tolist(), strict=True))
        texts = as_bytes(left.column("text"))
        n_tokens, n_known, base = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64), np.empty(len(texts))
        for i, t in enumerate(texts):
            words = words_of(t)
            words.append(b"")
            x = np.fromiter(map(log_of.__getitem__, words), float, len(words))
            n_tokens[i], n_known[i], base[i] = len(words), np.count_nonzero(x), x.sum() - len(words) * unit
        # a bucket's answer is in the order of the chunk's codes
        del log_of, right
        codes, parts = coded(texts)
        order, lp = np.argsort(bucket_of(codes, buckets), kind="stable"), np.empty(len(codes), np.float32)
        by_bucket = sorted(zip(replies.column("bucket").to_pylist(), replies.column("lp").to_pylist(), strict=True))
        lp[order] = np.concatenate([np.empty(0, np.float32), *(np.frombuffer(x, np.float32) for _, x in by_bucket)])
        del order, by_bucket, replies
        s = np.empty(len(texts))
        for part, found, at, begins in parts:
            s[part] = np.add.reduceat(lp[np.searchsorted(codes, found)][at], begins, dtype=np.float64)
        size = np.array([len(t) for t in texts])
        return pa.table({id_col: left.column("id"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(texts), n_train), "base_score": base, "score": s, "bits_per_byte": -s / np.log10(2) / np.maximum(size, 1)})

    kind = docs.schema["id"].dataType.simpleString()
    out = f"{id_col} {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda key, a, b: score(key, a, b), out)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs.select("doc_id", "text"), crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
