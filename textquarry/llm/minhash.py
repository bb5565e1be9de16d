"""Near-duplicate texts by ProbMinHash over weighted word shingles.

Words are the runs of 0-9, a-z and bytes from 0x80 after lower-casing A-Z; a shingle is 5 consecutive words (a shorter text is one shingle),
its weight how often it occurs. ProbMinHash: each shingle is a Poisson process of arrivals at ``REGISTERS`` registers, seeded by its
hash, with its weight as rate; a register keeps the shingle that arrives first, and a process ends once it is later than the latest
register (early termination). Two texts agree in a register with probability J_P, the probability Jaccard similarity
sum over common d of 1 / sum over d' of max(x_d'/x_d, y_d'/y_d), which is the plain Jaccard similarity where all weights are equal.

1. Texts whose words are the same are one node, so exact copies never meet in a bucket. Rows are numbered when the sketch is written; a node is the least row number
   of its copies, so rows that share an id, or have none, are never mixed up.
2. ``BANDS`` bands of ``REGISTERS / BANDS`` registers; in every bucket each node is paired with the bucket's least node only (no pairs within
   a group), the signatures' estimate drops chance meetings, and exact J_P >= ``threshold`` on whole texts decides.
3. Links make components. Buckets that still hold several components are searched in blocks of at most ``BLOCK`` nodes (or ``BLOCK_BYTES`` of text)
   against each other, for likely pairs of different components, which are verified in place. So no bucket is capped, nor does one lie in one task.

Result classes: class_id is the least id of the component. Null and wordless texts have no shingles and are each a class of their own by id.
Rows that share an id are one document, so the nodes of their texts are linked; a document that stays keeps each of its different texts once (of equal ones the row
with the least hash of its columns). Rows with a null id take part by their words; a class without any id has a null class_id and keeps one row. Very long texts
are shingled whole. Other columns of the input may have any names: ``classes`` leaves them out, ``drop_near_duplicates`` returns them unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batches, bounded_batches, drop_written, fresh_names, table, written
from .components import components
from .decontam import words_of

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS, BANDS = 64, 16
LIKELY = 0.6  # an estimate from 64 registers, 4 standard deviations below the threshold
BLOCK, BLOCK_BYTES = 1024, 32 << 20
SALTS = 256

U = np.uint64
_GOLD, _A, _B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


class Shingler:
    """Weighted shingles of texts; each distinct word is hashed once."""

    def __init__(self, limit: int = 300_000):
        self.cache: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}  # the words of the time before
        self.limit = limit

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, and their counts."""
        if not words:
            return np.zeros(0, U), np.zeros(0, np.int64)
        if len(self.cache) > self.limit // 2:
            self.before, self.cache = self.cache, {}
        cache, before = self.cache, self.before
        for w in set(words):
            if w not in cache:
                cache[w] = before[w] if w in before else int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.array([cache[w] for w in words], U)
        n = min(SHINGLE, len(h))
        out = np.zeros(max(0, len(h) - n + 1), U)
        for j in range(n):
            out = mix(out + h[j : len(h) - n + 1 + j] + _GOLD)
        return np.unique(out, return_counts=True)


def probminhash(hashes: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The registers: 32 bits of the shingle that arrives first at each."""
    q, z = np.full(m, np.inf), np.zeros(m, np.uint32)
    label = (mix(hashes ^ _B) >> U(32)).astype(np.uint32)
    rate, x = weights.astype(float), np.zeros(len(hashes))
    # a few hundred shingles fill the registers; then nearly all others end at their first arrival
    for alive in (np.arange(min(4 * m, len(hashes))), np.arange(4 * m, len(hashes))):
        at = 0
        while len(alive):
            steps = max(1, min(64, 4 * m // len(alive)))  # few shingles: many arrivals at once
            r = mix(hashes[alive][:, None] + _GOLD * np.arange(at + 1, at + 1 + steps, dtype=U))
            u = ((r >> U(11)).astype(float) + 0.5) * 2.0**-53
            t = x[alive][:, None] + np.cumsum(-np.log(u) / rate[alive][:, None], 1)
            row, col = np.nonzero(t < q.max())
            first = t[row, col]
            order = np.argsort(-first, kind="stable")  # the earliest last, so that it stays
            row, col, first = row[order], col[order], first[order]
            place = (mix(r[row, col] ^ _A) >> U(8)).astype(np.int64) % m
            best_t, best_l = np.full(m, np.inf), np.zeros(m, np.uint32)
            best_t[place], best_l[place] = first, label[alive[row]]
            won = best_t < q
            q[won], z[won] = best_t[won], best_l[won]
            x[alive] = t[:, -1]
            alive, at = alive[t[:, -1] < q.max()], at + steps
    return z


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of weighted sets (hashes ascending, weights)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(common) / (len(ha) + len(hb) - len(common))
    x = np.concatenate([wa[ia], np.delete(wa, ia), np.zeros(len(hb) - len(common))]).astype(float)
    y = np.concatenate([wb[ib], np.zeros(len(ha) - len(common)), np.delete(wb, ib)]).astype(float)
    ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    cx, cy = np.cumsum(x[order]), np.cumsum(y[order])
    upto = np.searchsorted(ratio[order], ratio[: len(common)], "right") - 1
    return float((1 / (cx[upto] / x[: len(common)] + (cy[-1] - cy[upto]) / y[: len(common)])).sum())


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """[texts, registers] to [texts, BANDS] keys."""
    s = signatures.reshape(len(signatures), BANDS, -1).astype(U)
    out = np.broadcast_to(mix(np.arange(BANDS, dtype=U) + _GOLD), s.shape[:2]).copy()
    for j in range(s.shape[2]):
        out = mix(out + s[:, :, j] + _GOLD)
    return out.view(np.int64)


def sketch(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The rows with _row (a number), _hash (of the columns), _size (bytes), _words (hash of the text's words, null without words), _sig (registers), _bands; and the
    names that the input's columns have in it."""
    bounded_batches(docs.sparkSession)
    own = fresh_names(docs.columns)
    plain = [F.col(c) for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]  # maps can't be hashed
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.monotonically_increasing_id().alias("_row"), F.xxhash64(*plain).alias("_hash"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches(it):
            digest, sigs, size = [], [], []
            for t in as_bytes(b.column(own[text])):
                w = words_of(t)
                size.append(len(t or b""))
                digest.append(hashlib.blake2b(b" ".join(w), digest_size=16).hexdigest() if w else None)
                sigs.append(probminhash(*shingle(w)) if w else np.zeros(REGISTERS, np.uint32))
            s = np.stack(sigs) if sigs else np.zeros((0, REGISTERS), np.uint32)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * BANDS, pa.int32()), pa.array(band_keys(s).ravel()))
            found = [pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array([x.tobytes() for x in s], pa.binary()), keys]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, "_size", "_words", "_sig", "_bands"])

    more = T.StructType.fromDDL("_size bigint, _words string, _sig binary, _bands array<bigint>")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields])), own


def _alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in at least LIKELY of the registers."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in it:
            x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            keep = pa.array((x == y).mean(1) >= LIKELY)
            yield p.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, scratch: list) -> DataFrame:
    """Pairs of nodes (a, b) with J_P of at least the threshold, from whole texts. b may be frequent; its shingles are kept from row to row."""
    nodes = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), "nodes", scratch)
    texts = written(texts.join(nodes, "node", "left_semi"), "texts", scratch)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, kept = Shingler(), None, None
        for p in batches(it):
            ok = []
            for x, y in zip(as_bytes(p.column("ta")), as_bytes(p.column("tb")), strict=True):
                if y != last:
                    last, kept = y, shingle(words_of(y))
                ok.append(similarity(shingle(words_of(x)), kept) >= threshold)
            yield p.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _likely_pairs(key, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (places in the table) of different components that are likely alike and meet first in this band, and their estimates."""
    band, i, j = (x.as_py() for x in key)
    node, comp, mine, head = (t.column(c).to_numpy() for c in ("node", "component", "mine", "head"))
    s = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, REGISTERS)
    keys = band_keys(s)
    here = int(np.argmax(keys[0] == band))
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    pairs, likely = [np.empty((0, 2), np.int64)], [np.empty(0)]
    for k in left:
        to = right[(comp[right] != comp[k]) & ((node[right] < node[k]) | (i != j)) & (node[right] != head[0])]
        if len(to) and node[k] != head[0]:
            alike = (s[to] == s[k]).mean(1)
            ok = (alike >= LIKELY) & ((keys[to] == keys[k]).argmax(1) == here)
            pairs.append(np.stack([np.full(int(ok.sum()), k), to[ok]], 1))
            likely.append(alike[ok])
    return np.concatenate(pairs), np.concatenate(likely)


def _rest(buckets: DataFrame, linked: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float, scratch: list) -> DataFrame:
    """Verified links between components, from buckets of three or more nodes that hold several.

    A task has a pair of blocks of one bucket. It takes the likely pairs of different components, the likeliest first, and verifies them on
    whole texts unless links found before have joined their components; so a group of near copies costs about a check a member, and only links leave the task.
    A pair that meets in several buckets is taken in its first band alone.
    """
    rows = buckets.filter("n > 2").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = written(rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band"), "mixed", scratch)
    rows = written(rows.join(mixed, "band", "left_semi"), "mixed", scratch)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = rows.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    # a node goes to every pair of blocks that its own is one of; with one block, to that one
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    names = ["band", "i", "j", "node", "component", "mine", "head", "sig"]

    def involved(key, t):
        """The rows that any likely pair holds: only their texts are sent."""
        return t.take(pa.array(np.unique(_likely_pairs(key, t)[0]))).select(names)

    kind = "band bigint, i int, j int, node bigint, component bigint, mine int, head bigint, sig binary"
    some = written(rows.join(sigs, "node").select(*names).groupBy("band", "i", "j").applyInArrow(involved, kind), "likely", scratch)
    texts = written(texts.join(some.select("node").distinct(), "node", "left_semi"), "texts", scratch)

    def run(key, t):
        node, comp = (t.column(c).to_numpy() for c in ("node", "component"))
        pairs, likely = _likely_pairs(key, t)
        links: list[tuple[int, int]] = []
        if len(pairs):
            order = np.argsort(-likely, kind="stable")
            text, shingle = t.column("text"), Shingler()
            up = {int(c): int(c) for c in np.unique(comp)}
            of: dict[int, tuple] = {}

            def root(c: int) -> int:
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            def shingles(k: int):
                if k not in of:
                    of[k] = shingle(words_of(text[k].as_py().encode()))
                return of[k]

            for x, y in pairs[order].tolist():
                cx, cy = root(int(comp[x])), root(int(comp[y]))
                if cx != cy and similarity(shingles(x), shingles(y)) >= threshold:
                    up[max(cx, cy)] = min(cx, cy)
                    links.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return some.join(texts, "node").select(*names, "text").groupBy("band", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _told(rows: DataFrame, key: str, side: DataFrame) -> DataFrame:
    """The rows with what ``side`` (one row a key) says of their key, or nulls. A key's rows are dealt over SALTS places, so those of a frequent key meet in no one task."""
    rows = rows.withColumn("_salt", F.pmod("_row", F.lit(SALTS)))
    places = rows.filter(F.col(key).isNotNull()).select(key, "_salt").distinct().join(side, key)
    return rows.join(places, [key, "_salt"], "left").drop("_salt")


def _classes(sk: DataFrame, id_col: str, text: str, threshold: float, scratch: list) -> DataFrame:
    """``sk``: a written sketch. Returns _row, id, class_id, kept; ``scratch`` gets the tables that it reads."""
    rows = sk.select("_row", F.col(id_col).cast("bigint").alias("id"), "_words", "_hash")
    copies = written(rows.filter("_words is not null").groupBy("_words").agg(F.min("_row").alias("node")), "copies", scratch)
    rows = written(_told(rows, "_words", copies).select("_row", "id", "node", "_hash"), "rows", scratch)
    of_node = sk.withColumnRenamed("_row", "node").join(copies.select("node"), "node")
    sigs = written(of_node.select("node", F.col("_sig").alias("sig"), F.col("_bands").alias("bands"), F.col("_size").alias("size")), "nodes", scratch)
    texts = sk.select(F.col("_row").alias("node"), F.col(text).alias("text"))
    bands = sigs.select("node", "size", F.explode("bands").alias("band"))
    heads = written(bands.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1"), "heads", scratch)
    buckets = written(bands.drop("size").join(heads, "band"), "buckets", scratch)
    tried = written(buckets.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "tried", scratch)
    sigs = sigs.select("node", "sig")
    # texts of one id are one document
    shared = rows.filter("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most").select("id", "b")
    same = rows.join(shared, "id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    linked = components(written(_verified(_alike(tried, sigs), texts, threshold, scratch), "links", scratch).union(same))
    more = written(_rest(buckets, linked, sigs, texts, threshold, scratch), "rest", scratch)
    if more.take(1):
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))  # the stars found so far, not all links again
    worded = written(_told(rows.filter("node is not null"), "node", linked).withColumn("component", F.coalesce("component", "node")), "worded", scratch)
    worded = _told(worded, "component", worded.groupBy("component").agg(F.min("id").alias("class_id")))
    # a class's document keeps each of its different texts; a class without ids keeps one
    key = F.when(F.col("class_id").isNotNull(), F.col("node")).otherwise(F.col("component"))
    wordless = rows.filter("node is null").select("_row", "id", "_hash", F.col("id").alias("class_id"), F.when(F.col("id").isNull(), 2).otherwise(1).alias("kind"), F.coalesce("id", "_row").alias("key"))
    found = written(worded.select("_row", "id", "_hash", "class_id", F.lit(0).alias("kind"), key.alias("key")).union(wordless), "classes", scratch)
    least = found.filter("id <=> class_id").groupBy("kind", "key").agg(F.min(F.struct("_hash", "_row")).alias("least"))
    stays = least.select("least._row", F.lit(True).alias("stays"))
    return found.join(stays, "_row", "left").select("_row", "id", "class_id", F.coalesce("stays", F.lit(False)).alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row a row of ``docs``: id, class_id, kept (whether ``drop_near_duplicates`` keeps the row)."""
    sk, own = sketch(docs.select(id_col, text), text)
    scratch: list[DataFrame] = []
    sk = written(sk, "sketch", scratch)
    out = written(_classes(sk, own[id_col], own[text], threshold, scratch).select(F.col("id").alias(id_col), "class_id", "kept"), "found")
    _forget(scratch)
    return out


def _forget(scratch: list[DataFrame]) -> None:
    for t in scratch:
        drop_written(t.sparkSession, t)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns."""
    sk, own = sketch(docs, text)
    sk, scratch = written(sk, "sketch"), []
    kept = written(_classes(sk, own[id_col], own[text], threshold, scratch).filter("kept").select("_row"), "kept")
    _forget(scratch)
    # the same join at every size
    return sk.join(kept.hint("merge"), "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in own.items()])


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
