"""Token ids in binary files: one array of ids a shard, document boundaries as an Elias-Fano sequence.

A shard file (little-endian throughout):
  8 bytes magic ``TQEFIDS1``; 8 x uint64: documents, null document ids among them (they come first), ids, bytes an id,
  smallest document id (as int64), then the byte lengths of the three sections; then the sections:
  boundaries (Elias-Fano of documents + 1 offsets), document ids (Elias-Fano of id - smallest), ids.
An Elias-Fano section: uint64 count, uint64 low bits l, uint64 high bits, then l low bits of each value packed, the upper
parts as a unary bit vector, and the position of every 256th one as uint32. select(i) starts at the sample before i and counts
bits from there, so offsets come out of about 2 + l bits each without a table of 64-bit offsets; select_range(i, j) reads a stretch of them so.

Documents are dealt by range of (document id, hash of text), so that files hold ascending ids and repeated or null ids can't gather in one
task; a task starts another file at ``max_ids`` ids. A file is written under a task's own name and then renamed: a repeated task leaves
the same file. The manifest (a row a file) gives each file's first offset. Files go through pyarrow's file systems to the shared folder.

Null text is empty. Null ids come first. Repeated ids stay, ordered by the hash of their texts. No documents: no files, an empty result. Very long texts are encoded
whole and stay in one file. Other columns of the input, whatever their names, aren't written.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, as_bytes, batches, bounded_batches, shared_folder, table

MAGIC = b"TQEFIDS1"
SAMPLE = 256
MAX_IDS = 16 << 20
READ_DOCS = 4096
CACHE_WORDS = 600_000
ENCODE_AT_ONCE = 4_000
END_ID = 1


# Elias-Fano


def ef_encode(values: np.ndarray) -> bytes:
    """values: ascending (not strictly) unsigned integers."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) + 1 if len(v) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = b""
    if low and n:
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = int(ones[-1]) + 1 if n else 0
    high = np.zeros(size, np.uint8)
    high[ones] = 1
    return struct.pack("<3Q", n, low, size) + lows + np.packbits(high, bitorder="little").tobytes() + ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    def __init__(self, data: bytes | memoryview):
        self.n, self.low, self.size = struct.unpack_from("<3Q", data)
        at = 24
        self.lows = np.frombuffer(data, np.uint8, (self.n * self.low + 7) // 8, at)
        at += len(self.lows)
        self.high = np.frombuffer(data, np.uint8, (self.size + 7) // 8, at)
        at += len(self.high)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at)

    def __len__(self) -> int:
        return self.n

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low):
            at = i * self.low + b
            out |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, start >> 3
        bits = int(self.high[byte]) >> (start & 7) << (start & 7)
        while (ones := bits.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        at = (byte << 3) + (bits & -bits).bit_length() - 1
        return (at - i << self.low) | int(self._lows(np.array([i]))[0])

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: from the sample before i on, only as many bits are read as they take."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.empty(0, np.uint64)
        start = int(self.samples[i // SAMPLE])
        end = int(self.samples[-(-j // SAMPLE)]) + 1 if -(-j // SAMPLE) < len(self.samples) else self.size
        byte = start >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (end + 7) >> 3], bitorder="little")) + 8 * byte
        ones = ones[ones >= start][i % SAMPLE :][: j - i]
        at = np.arange(i, j)
        return ((ones - at).astype(np.uint64) << np.uint64(self.low)) | self._lows(at)


# shard files


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    nulls = sum(x is None for x in doc_ids)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = ef_encode(np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]))
    docs = ef_encode(known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))
    return MAGIC + struct.pack("<4Qq3Q", len(doc_ids), nulls, sum(lengths), width, least, len(bounds), len(docs), len(ids)) + bounds + docs + ids


class Shard:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.nulls, self.n_ids, self.width, least, *sizes = struct.unpack_from("<4Qq3Q", data, 8)
        view, at = memoryview(data), 72
        self.bounds = EliasFano(view[at : at + sizes[0]])
        self.docs = EliasFano(view[at + sizes[0] : at + sizes[0] + sizes[1]])
        self.least = least
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + sizes[0] + sizes[1])

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Of the documents i to j - 1."""
        known = self.docs.select_range(max(0, i - self.nulls), max(0, j - self.nulls)) + np.uint64(self.least & (1 << 64) - 1)
        return [None] * max(0, min(j, self.nulls) - i) + known.astype(np.int64).tolist()

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Encoder:
    """Encodes texts through the tokenizers library, each distinct run between spaces or newlines once.

    White space separates tokens in this vocabulary and no normalisation reaches across a space, so a text's ids are those of its runs. A run of letters is one
    word of the vocabulary, whose last id is marked as a word's end; such runs go to the library many at once, as one text, and its ids are
    cut at the marks. Signs after a run of letters are a word of their own.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(tokenizer_file)
        kind = (self.t.pre_tokenizer, self.t.normalizer)
        if self.t.encode("a b", add_special_tokens=False).ids != self.t.encode("a\n  b", add_special_tokens=False).ids or None in kind:
            raise ValueError("this vocabulary keeps white space; its texts can't be encoded run by run")
        # A-Z can be lower-cased first, but for texts with marks of U+0300 to U+037F: some letters have a form with a mark in lower case only
        same = self.t.encode_batch_fast(["AZ az", "az az"], add_special_tokens=False)
        self.lowers = same[0].ids == same[1].ids
        vocab = self.t.get_vocab()
        self.most = max(vocab.values())
        self.ends = np.zeros(self.most + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def _one_by_one(self, runs: list[bytes]) -> None:
        for r, e in zip(runs, self.t.encode_batch_fast([x.decode() for x in runs], add_special_tokens=False), strict=True):
            self.cache[r] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _words(self, runs: list[bytes]) -> None:
        """Runs of letters."""
        ids = np.array(self.t.encode_batch_fast([b" ".join(runs).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(runs) or (len(cuts) and cuts[-1] != len(ids)):
            self._one_by_one(runs)
            return
        data, at = ids.tobytes(), 0
        for r, end in zip(runs, (cuts * 4).tolist(), strict=True):
            self.cache[r] = data[at:end]
            at = end

    def learn(self, runs: list[bytes]) -> None:
        words: dict[bytes, None] = {}
        signed, other, cache = [], [], self.cache
        for r in runs:
            core = r.rstrip(b".,;:!?")
            if core.isalpha() or not core.isascii() and core.decode().lower().isalpha():
                if core not in cache:
                    words[core] = None
                if core is not r and len(core) < len(r):
                    signed.append((r, core, r[len(core) :]))
            else:
                other.append(r)
        tails = list({t for _, _, t in signed if t not in cache})
        todo = list(words)
        for i in range(0, len(todo), ENCODE_AT_ONCE):
            self._words(todo[i : i + ENCODE_AT_ONCE])
        for part in (tails, other):
            for i in range(0, len(part), ENCODE_AT_ONCE):  # an encoding is far larger than its ids
                self._one_by_one(part[i : i + ENCODE_AT_ONCE])
        for r, core, tail in signed:
            cache[r] = cache[core] + cache[tail]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has. Runs are told apart by Arrow; each distinct run of a batch is looked up once."""
        plain = [(t.lower() if self.lowers and b"\xcc" not in t and b"\xcd" not in t else t).replace(b"\n", b" ") if t else b"" for t in as_bytes(texts)]
        parts = pc.split_pattern(pa.array(plain, pa.large_binary()), b" ")
        coded = parts.flatten().dictionary_encode()
        runs, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.cache) > CACHE_WORDS:  # what these texts use, too, stays
            self.cache = {r: self.cache[r] for r in runs if r in self.cache}
        if new := [r for r in runs if r not in self.cache]:
            self.learn(new)
        known = list(map(self.cache.__getitem__, runs))
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(n) - n
        size = n[which]
        ends = np.cumsum(size)
        at = np.repeat(starts[which] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        before = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
        return ids[at], np.diff(before[bounds])


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_file: str) -> Encoder:
    """One a worker process, which keeps it from task to task."""
    return Encoder(tokenizer_file)


def check_width(tokenizer_file: str, end_id: int, width: int) -> None:
    if max(Encoder(tokenizer_file).most, end_id) >= 1 << 8 * width:
        raise ValueError(f"this vocabulary's ids need more than {width} bytes")


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, width: int = 2, max_ids: int = MAX_IDS) -> list[dict]:
    """Writes the files and returns the manifest: path, documents, ids and first offset of each, in ascending order of document id. An id that ``width`` bytes
    can't hold is an error."""
    check_width(tokenizer_file, end_id, width)
    bounded_batches(docs.sparkSession)
    _fs(folder)[0].create_dir(_fs(folder)[1], recursive=True)
    tie = F.xxhash64(F.col(text))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), tie.alias("tie")).repartitionByRange(F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    kind = f"<u{width}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        attempt = TaskContext.get().taskAttemptId()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            fs, top = _fs(folder)
            name = f"{top}/ids-{part:06d}-{seq:04d}.efid"
            with fs.open_output_stream(f"{name}.{attempt}.tmp") as f:
                f.write(shard_bytes(doc_ids, lengths, b"".join(ids), width))
            fs.move(f"{name}.{attempt}.tmp", name)
            row = {"part": part, "seq": seq, "path": f"{folder}/ids-{part:06d}-{seq:04d}.efid", "n_docs": len(doc_ids), "n_ids": sum(lengths)}
            return pa.RecordBatch.from_pylist([row])

        held = 0
        for b in batches(it, BATCH_BYTES // 4):
            coded, sizes = encode(b.column("text"))
            doc_ids += b.column("id").to_pylist()
            lengths += (sizes + 1).tolist()
            ids.append(np.insert(coded, np.cumsum(sizes), end_id).astype(kind).tobytes())
            held += len(coded) + len(sizes)
            if held >= max_ids:
                yield flush()
                doc_ids, lengths, ids, seq, held = [], [], [], seq + 1, 0
        if doc_ids:
            yield flush()

    files = rows.mapInArrow(run, "part bigint, seq bigint, path string, n_docs bigint, n_ids bigint").collect()  # a row a file
    out, at = [], 0
    for f in sorted(files, key=lambda f: (f["part"], f["seq"])):
        out.append({"path": f["path"], "n_docs": f["n_docs"], "n_ids": f["n_ids"], "start": at})
        at += f["n_ids"]
    return out


def read_shards(spark, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """A row a document: id, start, n_tokens, ids_crc32; all from the files, with offsets selected from the boundaries ``READ_DOCS`` at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                fs, path = _fs(row["path"])
                with fs.open_input_stream(path) as f:
                    shard = Shard(f.read())
                for i in range(0, shard.n, READ_DOCS):
                    j = min(i + READ_DOCS, shard.n)
                    bounds = shard.bounds.select_range(i, j + 1).astype(np.int64)
                    crc = [zlib.crc32(shard.ids[s:e].astype("<u4").tobytes()) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(i, j), pa.int64()), pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start bigint")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_shards(spark, write_shards(docs, shared_folder(spark, "ids"), public_tokenizers.path("word_bpe_49k.json")))
