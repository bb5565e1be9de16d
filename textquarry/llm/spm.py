"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The vocabulary is a SentencePiece BPE model (identity normalisation, a space before the text, spaces written as U+2581, byte fallback). Merges never reach from
one run of spaces and the word after it into the next, so a text is encoded run by run. In a run the agenda is as in BPE: of all neighbouring symbols whose
join is a piece, the best score first, the leftmost of equals. A candidate merge is skipped if a keyed hash of (seed, occurrence, run, its
start, its end) falls below ``dropout``; a later candidate over another span is hashed anew. An occurrence is a text's id and the place of the run in the text, so
a word is split anew wherever it stands, the same seed always gives the same ids, and another seed (an epoch) gives others. Every segmentation is
made of merges of the vocabulary and spells the same bytes, so decoding gives back the text exactly. Dropout 0 is plain BPE.

The agendas of runs of equal length are run side by side in numpy, every occurrence by itself.
What isn't in the vocabulary becomes its UTF-8 bytes; so does U+2581 itself, which else would decode to a space.

Null and empty texts have no ids and decode to the empty text. Repeated rows (id and text) get the same ids. Null ids count as the empty id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BATCH_BYTES, as_bytes, batches, bounded_batches, table
from .minhash import _GOLD, U, mix

DROPOUT, SEED = 0.1, 2026
SLICE_CHARS, SLICE_RUNS = 1 << 20, 200_000
AT_ONCE = 50_000  # characters whose agendas are run side by side
_STEP = U(0x9E3779B97F4A7C15)
FOUND = ("ids", "n_ids")
SPACE = "▁"
_RUN = re.compile("[ ]*[^ \n]+|[ ]+|\n")


class Vocabulary:
    """Pieces, and the table of merges: (left piece, right piece) to (joined piece, score)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        if any(p.lstrip(SPACE).count(SPACE) for p, ok in zip(self.pieces, plain, strict=True) if ok):
            raise ValueError("this vocabulary has pieces that reach over a word's end")
        if any(len(p) > 1 and "\n" in p for p, ok in zip(self.pieces, plain, strict=True) if ok):
            raise ValueError("this vocabulary has pieces that reach over a line's end")
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.of_code = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_code[ord(p)] = i
        self.of_code[ord(" ")], self.of_code[ord(SPACE)] = self.ids.get(SPACE, -1), -1
        byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() if plain[i] else b"" for i, p in enumerate(self.pieces)]
        # the rank of a piece: 0 is merged first
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable").astype(np.int64)
        merges = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = i
        # open addressing in a table of a power of two places, so that a pair is found in one or two reads
        self.bits = max(4, (2 * len(merges)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys, values = np.array(list(merges), np.int64), np.array(list(merges.values()), np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U) * _STEP >> U(64 - self.bits)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that joins a and b, or -1; a or b may be -1."""
        keys = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) << 32 | b)
        at = self._place(keys)
        got = self.keys.take(at)
        out = np.where(got == keys, self.values.take(at), np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The piece of each character (code points); -1 for those without one, and for U+2581 itself."""
        return self.of_code[codes]


def _codes(runs: list[str]) -> np.ndarray:
    """Code points of runs of one length, a row a run."""
    return np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).reshape(len(runs), -1)


def _run_keys(seed: int, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of (seed, run) for each row of code points."""
    h = np.full(len(codes), int.from_bytes(hashlib.blake2b(str(seed).encode(), digest_size=8).digest(), "little"), U)
    for j in range(codes.shape[1]):
        h = mix(h + codes[:, j].astype(U) * _GOLD + U(1))
    return h


def _keys(seed: int, occurrences: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of (seed, occurrence, run) for each row."""
    return mix(occurrences.astype(U) * _GOLD + _run_keys(seed, codes))


def _skips(key: np.ndarray, s: np.ndarray, e: np.ndarray, bound) -> np.ndarray:
    """Whether the candidate merge from s to e is skipped."""
    return mix(key + (s.astype(U) << U(32) | e.astype(U)) * _STEP) < bound


def merge_runs(v: Vocabulary, runs: list[str], occurrences: np.ndarray | None, seed: int, dropout: float) -> list[bytes]:
    """Ids (little-endian int32) of each run at its occurrence, by the agenda with keyed dropout, side by side for runs of one length."""
    bound = U(int(dropout * 2.0**64)) if dropout < 1 else U(2**64 - 1)
    out: list = [None] * len(runs)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(lengths, kind="stable")
    found, first = np.unique(lengths[order], return_index=True)
    for n, lo, hi in zip(found.tolist(), first.tolist(), [*first.tolist(), len(runs)][1:], strict=True):
        step = max(1, AT_ONCE // n)
        for at in range(lo, hi, step):
            part = order[at : min(hi, at + step)]
            members = part.tolist()
            codes = _codes([runs[k] for k in members])
            key = _keys(seed, occurrences[part], codes) if dropout > 0 else None
            sym = _agenda(v, v.symbols(codes), None if key is None else lambda i, s, e, key=key: _skips(key.take(i), s, e, bound))
            whole = sym >= 0
            ends = np.cumsum(whole.sum(1)) * 4
            ids, odd, start = sym[whole].astype("<i4").tobytes(), (sym == -1).any(1).tolist(), 0
            for row, (k, end) in enumerate(zip(members, ends.tolist(), strict=True)):
                out[k] = _with_bytes(v, runs[k], sym[row]) if odd[row] else ids[start:end]
                start = end
    return out


def _agenda(v: Vocabulary, sym: np.ndarray, skipped) -> np.ndarray:
    """``sym``: the piece of each character, a row a run. Returns in the same form the piece that starts at s after all merges, or -2 inside a piece.

    Arrays lie place by place, so that a step looks at all runs at once; runs without a candidate left drop out.
    """
    rows, n = sym.shape
    if n == 1:
        return sym
    out = np.ascontiguousarray(sym.T)
    kind = np.int32 if len(v.rank) * n < 2**31 else np.int64
    big = np.iinfo(kind).max
    rank = v.rank.astype(kind) * kind(n)
    row = np.arange(rows)  # which run each column is

    def price(i: np.ndarray, s: np.ndarray, sym: np.ndarray, end: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Cost (rank, then place) and piece of joining the piece at s of column i with the next."""
        e = end.take(s * wide + i)
        at = np.flatnonzero(e < n)
        i2, s2, e2 = i.take(at), s.take(at), e.take(at)
        joined = v.joined(sym.take(s2 * wide + i2), sym.take(e2 * wide + i2))
        ok = np.flatnonzero(joined >= 0)
        at, i2, s2, e2, joined = at.take(ok), i2.take(ok), s2.take(ok), e2.take(ok), joined.take(ok)
        if skipped is not None and len(at):
            go = np.flatnonzero(~skipped(row.take(i2), s2, end.take(e2 * wide + i2)))
            at, s2, joined = at.take(go), s2.take(go), joined.take(go)
        cost, piece = np.full(len(i), big, kind), np.full(len(i), -1, np.int32)
        cost[at], piece[at] = rank.take(joined) + s2, joined
        return cost, piece

    end = np.repeat(np.arange(1, n + 1), rows).reshape(n, rows)  # where the piece at s ends
    back = np.repeat(np.arange(-1, n), rows).reshape(n + 1, rows)  # where the piece before s starts
    now = out
    s, i = np.divmod(np.arange((n - 1) * rows), rows)
    cost, joined = price(i, s, now.ravel(), end.ravel(), rows)
    cost, joined = cost.reshape(n - 1, rows), joined.reshape(n - 1, rows)
    while True:
        least = np.minimum.reduce(cost, 0)
        go = least < big
        left = int(np.count_nonzero(go))
        if not left:
            break
        if left < len(row):  # the others are done
            keep = np.flatnonzero(go)
            if now is not out:
                gone = np.flatnonzero(~go)
                out[:, row[gone]] = now[:, gone]
            now, end, back, cost, joined, row, least = (x.take(keep, -1) for x in (now, end, back, cost, joined, row, least))
        elif now is out:
            now = out.copy()
        wide = len(row)
        i, s = np.arange(wide), (least % n).astype(np.int64)
        flat_now, flat_end, flat_cost, flat_joined, flat_back = now.ravel(), end.ravel(), cost.ravel(), joined.ravel(), back.ravel()
        at = s * wide + i
        e = flat_end.take(at)
        flat_now[at] = flat_joined.take(at)
        next_ = e * wide + i
        after = flat_end.take(next_)
        flat_now[next_] = -2
        inner = np.flatnonzero(e < n - 1)
        flat_cost[next_[inner]] = big
        flat_end[at] = after
        flat_back[after * wide + i] = s
        before = flat_back.take(at)
        has = np.flatnonzero(before >= 0)
        # the new piece with the one after it, and the one before it with the new piece
        i2, s2 = np.concatenate([i, has]), np.concatenate([s, before.take(has)])
        last = s2 >= n - 1
        if last.any():
            i2, s2 = i2[~last], s2[~last]
        c, j = price(i2, s2, flat_now, flat_end, wide)
        at = s2 * wide + i2
        flat_cost[at], flat_joined[at] = c, j
    if now is not out:
        out[:, row] = now
    return out.T


def _with_bytes(v: Vocabulary, run: str, sym: np.ndarray) -> bytes:
    """Ids of a run some of whose characters have no piece."""
    out: list[int] = []
    for c, x in zip(run, sym.tolist(), strict=True):
        if x >= 0:
            out.append(x)
        elif x == -1:
            out += v.byte[list(c.encode())].tolist()
    return np.array(out, "<i4").tobytes()


def runs_of(text: str) -> list[str]:
    """The text with a space before it, cut before each run of spaces and around line ends."""
    if not text:
        return []
    if "  " in text or text[0] == " " or "\0" in text or "\n " in text:
        return _RUN.findall(" " + text)
    return [r for r in (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if r]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, dropout: float = DROPOUT):
        self.v, self.seed, self.dropout = vocabulary, seed, dropout

    def __call__(self, names: list[str], texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian int32."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < SLICE_CHARS):
                size += len(texts[j] or "")
                j += 1
            out += self.coded(names[i:j], texts[i:j])
            i = j
        return out

    def coded(self, names: list[str], texts: list[str | None]) -> list[bytes]:
        runs = [runs_of(t) if t else [] for t in texts]
        flat, sizes = [r for rs in runs for r in rs], np.array([len(rs) for rs in runs], np.int64)
        ends = np.cumsum(sizes)
        base = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], U)
        place = (np.arange(len(flat)) - np.repeat(ends - sizes, sizes)).astype(U)
        occurrences = mix(np.repeat(base, sizes) + place * _GOLD)
        coded: list[bytes] = []
        for lo in range(0, len(flat), SLICE_RUNS):
            coded += self.merged(flat[lo : lo + SLICE_RUNS], occurrences[lo : lo + SLICE_RUNS])
        return [b"".join(coded[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def merged(self, runs: list[str], occurrences: np.ndarray) -> list[bytes]:
        if self.dropout > 0:
            return merge_runs(self.v, runs, occurrences, self.seed, self.dropout)
        once = list(dict.fromkeys(runs))
        ids = dict(zip(once, merge_runs(self.v, once, None, self.seed, 0), strict=True))
        return [ids[r] for r in runs]


def decode(v: Vocabulary, ids) -> str:
    """Pieces spelled out, without the space put before the text."""
    text = b"".join(v.spelled[i] for i in ids).decode("utf-8")
    return text[1:] if text.startswith(" ") else text


def _lists(coded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text", seed: int = SEED, dropout: float = DROPOUT, lossless: str | None = None) -> DataFrame:
    """Adds ids (array<int>) and n_ids and, if ``lossless`` names a column, whether the ids decode to the text; the input's other columns stay."""
    bounded_batches(docs.sparkSession)
    added = [*FOUND, *([lossless] if lossless else [])]
    docs = docs.drop(*added)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model_file)
        code = Encoder(v, seed, dropout)
        for b in batches(it, BATCH_BYTES // 2):
            names = ["" if x is None else str(x) for x in b.column(id_col).to_pylist()]
            coded = code(names, b.column(text).to_pylist())
            lists = _lists(coded)
            columns = [*b.columns, lists, pa.array([len(x) // 4 for x in coded], pa.int64())]
            if lossless:
                columns.append(pa.array([x == (t or b"") for x, t in zip(spelled(v, lists), as_bytes(b.column(text)), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *added])

    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.LongType(), lossless: T.BooleanType()}
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, kinds[c]) for c in added)]))


def spelled(v: Vocabulary, lists: pa.Array) -> list[bytes]:
    """The texts that lists of ids spell, in UTF-8, without the space put before them; those of a whole batch at once."""
    flat, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not len(flat):
        return [b""] * len(lists)
    pieces = pa.array(v.spelled, pa.large_binary()).take(flat)
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data, out = memoryview(pieces.buffers()[2]), []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        t = bytes(data[ends[s] : ends[e]]) if e > s else b""
        out.append(t[1:] if t.startswith(b" ") else t)
    return out


def decoded(df: DataFrame, model_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids spell; null and empty lists spell the empty text. Bytes that are no UTF-8 (ids that no text encodes to) become U+FFFD; an
    id that the vocabulary doesn't have is an error."""
    bounded_batches(df.sparkSession)
    df = df.drop(to)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model_file)
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.decode("utf-8", "replace") for x in spelled(v, b.column(ids))], pa.string())], [*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), lossless="lossless").select("doc_id", "ids", "n_ids", "lossless")
