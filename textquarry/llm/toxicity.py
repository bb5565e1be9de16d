"""Toxicity: a support vector machine on a subsequence string kernel, through Nystroem landmarks.

Instances are the words of a text (runs between white space), plus letters spelled out one by one, joined. The kernel counts common
subsequences of ``ORDER`` characters that lie within ``ORDER + GAPS`` positions, each weighted by ``DECAY`` per skipped position, so an insult
with inserted or replaced characters still shares most of its subsequences. Digits and signs that stand for letters count as those letters;
other signs can be skipped but never matched. A text is as toxic as its worst word, and the labels belong to texts: training picks, in
``ROUNDS`` rounds, the worst word of each toxic text as its witness (multiple-instance SVM, squared hinge), among hard words of clean texts,
with witnesses repeated in disguise (a sign or a letter put in). The Nystroem machine is f(x) = sum over landmarks of a_j k(x, l_j) + b; as k is an
inner product of explicit subsequence weights, this sum is folded once into one weight a subsequence (a table of 64^ORDER floats),
which scores a word without touching the landmarks again. Platt's sigmoid turns the worst word's f into a score.

Fitting takes a bounded sample: at most ``per_class`` labelled ids of each class in order of hash, one whole text of each (of several the one with the least hash).
Executors send the distinct words of those texts, never the texts.

Null and empty texts have no words and get the score of ``NOTHING``. Labels that are null, or that contradict each other for one id, aren't learned from.
Without texts of both classes there is no model: every score is 0. Repeated rows are scored alike. Very long texts are scored whole, and long words in overlapping
pieces. Result columns named as in the input replace them.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batches, bounded_batches, crc_mod, table

ORDER, GAPS, DECAY = 3, 2, 0.6
PER_CLASS = 1500
LANDMARKS = (160, 96)
ROUNDS = 5
PLAIN = 10_000
RIDGE = 1e-4
LONGEST = 48
NOTHING = -2.0
CACHE_WORDS = 250_000
FOUND = ("toxic_score", "toxic")

_SAME = dict(zip(b"013457@$", b"oieastas", strict=True))
#: A-Z become a-z; letters and bytes from 0x80 stay; white space becomes a space; digits and signs become what they stand for, or ``*``.
FOLD = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 if i == 0x20 or 9 <= i <= 13 else _SAME.get(i, 0x2A) for i in range(256))
#: 1-26 letters, 27 the start of a word, 32-63 other bytes, 0 never matches.
CODE = np.array([i - 0x60 if 0x61 <= i <= 0x7A else 32 | i & 31 if i >= 0x80 else 27 if i == 0x5E else 0 for i in range(256)], np.int32)
SPELLED = re.compile(rb"(?<![a-z\x80-\xff])(?:[a-z][ *]{1,3}){3,}[a-z](?![a-z\x80-\xff])")
OFFSETS = [(0, *c) for c in combinations(range(1, ORDER + GAPS), ORDER - 1)]
WEIGHTS = [DECAY ** (c[-1] - ORDER + 1) for c in OFFSETS]
PAD = b"\0" * (ORDER + GAPS - 1)


def words_of(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    t = text.translate(FOLD)
    out = t.split()
    out += [re.sub(rb"[ *]", b"", x) for x in SPELLED.findall(t)]
    return out


def _pieces(word: bytes) -> list[bytes]:
    """Long runs in overlapping pieces, so that no part goes unscored."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(words: list[bytes]):
    """For each kind of subsequence: (codes over the stream of all words, mask, weight); and where each word begins."""
    stream = b"".join(b"^" + w + PAD for w in words) + PAD
    x = CODE[np.frombuffer(stream, np.uint8)]
    n = len(x) - len(PAD)
    begins = np.concatenate([[0], np.cumsum([len(w) + 1 + len(PAD) for w in words])[:-1]]).astype(np.int64)
    parts = []
    for c, weight in zip(OFFSETS, WEIGHTS, strict=True):
        code, ok = x[:n], x[:n] > 0
        for o in c[1:]:
            code, ok = code << 6 | x[o : o + n], ok & (x[o : o + n] > 0)
        parts.append((code, ok, weight))
    return parts, begins


def _scale(parts, begins) -> np.ndarray:
    """1 / length of each word's weights: the kernel is normalised by it."""
    square = sum(ok * (weight * weight) for _, ok, weight in parts)
    return 1 / np.sqrt(np.maximum(np.add.reduceat(square, begins), 1e-9))


def linear(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Inner product of each word's normalised subsequence weights with a table."""
    parts, begins = subsequences(words)
    total = sum(np.where(ok, weights[code], 0) * weight for code, ok, weight in parts)
    return np.add.reduceat(total, begins) * _scale(parts, begins)


class Landmarks:
    """k(x, l) for many words and all landmarks."""

    def __init__(self, words: list[bytes]):
        parts, begins = subsequences(words)
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(begins, len(parts[0][0]))))
        code = np.concatenate([c[ok] for c, ok, _ in parts])
        own = np.concatenate([owner[ok] for _, ok, _ in parts])
        value = np.concatenate([np.full(int(ok.sum()), w) for _, ok, w in parts]) * _scale(parts, begins)[own]
        self.keys, at = np.unique(code, return_inverse=True)
        self.rows = np.zeros((len(self.keys), len(words)))
        np.add.at(self.rows, (at, own), value)
        gram = self.rows.T @ self.rows
        values, vectors = np.linalg.eigh(gram)
        kept = values > 1e-6 * values[-1]
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])
        self.index = np.full(64**ORDER, -1, np.int32)
        self.index[self.keys] = np.arange(len(self.keys))

    def features(self, words: list[bytes]) -> np.ndarray:
        """Nystroem features: k(x, landmarks) gram^-1/2, with a last column of ones."""
        out = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            parts, begins = subsequences(part)
            owner = np.repeat(np.arange(len(part)), np.diff(np.append(begins, len(parts[0][0]))))
            x = np.zeros((len(part), len(self.keys)), np.float32)
            for code, ok, weight in parts:
                at = np.where(ok, self.index[code], -1)
                hit = at >= 0
                np.add.at(x, (owner[hit], at[hit]), weight)
            out.append((x * _scale(parts, begins)[:, None]) @ (self.rows @ self.whiten))
        z = np.concatenate(out)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def fold(self, w: np.ndarray) -> np.ndarray:
        """The machine's weights as a table over subsequences."""
        table_ = np.zeros(64**ORDER, np.float32)
        table_[self.keys] = self.rows @ (self.whiten @ w[:-1])
        return table_


def _svm(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Squared hinge with example weights, by Newton steps."""
    w, total = np.zeros(x.shape[1]) if start is None else start, pos.sum() + neg.sum()
    for _ in range(12):
        f = x @ w
        p, q = pos * (f < 1), neg * (f > -1)
        grad = x.T @ (p * (f - 1) + q * (f + 1)) / total + RIDGE * w
        step = np.linalg.solve((x.T * ((p + q) / total)) @ x + RIDGE * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-3 * np.abs(w).max():
            break
    return w


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([s, np.ones_like(s)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _disguises(word: bytes, rng: random.Random) -> list[bytes]:
    if len(word) < 4:
        return []
    i, j = rng.randrange(1, len(word)), rng.randrange(1, len(word))
    return [word[:i] + b"*" + word[i:], word[:j] + bytes([rng.randrange(0x61, 0x7B)]) + word[j:], b"*".join(word[k : k + 1] for k in range(len(word)))]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def worst(self, texts: list[bytes | None], cache: dict[bytes, float]) -> np.ndarray:
        return self.worst_of([words_of(t) for t in texts], cache)

    def worst_of(self, words: list[list[bytes]], cache: dict[bytes, float]) -> np.ndarray:
        seen = {w for ws in words for w in ws}
        if len(cache) > CACHE_WORDS:  # what these texts use, too, stays
            kept = {w: cache[w] for w in seen if w in cache}
            cache.clear()
            cache.update(kept)
        new = [w for w in seen if w not in cache]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            pieces = [(k, p) for k, w in enumerate(part) for p in _pieces(w)]
            f = linear([p for _, p in pieces], self.weights) + self.bias
            best = np.full(len(part), -np.inf)
            np.maximum.at(best, [k for k, _ in pieces], f)
            cache.update(zip(part, best.tolist(), strict=True))
        return np.array([max(map(cache.__getitem__, ws)) if ws else NOTHING for ws in words])

    def score(self, texts: list[bytes | None], cache: dict[bytes, float]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts, cache) + self.shift, -50, 50)))


def bag_of(text: bytes | None) -> list[bytes]:
    """The distinct words of a text, long ones in pieces."""
    return sorted({p for w in words_of(text) for p in _pieces(w)})


def fit(bags: list[list[bytes]], toxic: list[int], seed: int = 7) -> Model | None:
    """From the distinct words of each text."""
    rng = random.Random(seed)
    pos, neg = [b for b, y in zip(bags, toxic, strict=True) if y and b], [b for b, y in zip(bags, toxic, strict=True) if not y and b]
    if not pos or not neg:
        return None
    in_pos, in_neg = Counter(w for b in pos for w in b), Counter(w for b in neg for w in b)
    vocab = sorted(w for w in in_pos.keys() | in_neg.keys() if len(w) > 1)
    by_pos = sorted(vocab, key=lambda w: (3 * in_neg[w] - in_pos[w], w))[: LANDMARKS[0]]
    by_neg = sorted(vocab, key=lambda w: (-in_neg[w], w))[: LANDMARKS[1] // 3]
    some = sorted(w for w in in_neg if len(w) > 1)
    marks = Landmarks(list(dict.fromkeys(by_pos + by_neg + rng.sample(some, min(len(some), LANDMARKS[1] - len(by_neg))))))
    plain = rng.sample(vocab, min(len(vocab), PLAIN))
    words = list(dict.fromkeys(plain + by_pos))
    x = marks.features(words)
    # first, every word has its text's label, clean texts counting for more: common insults come out
    w = _svm(x, np.array([in_pos[k] for k in words], float), np.array([3.0 * in_neg[k] for k in words]))
    for _ in range(ROUNDS):
        model = Model(marks.fold(w), float(w[-1]), 1, 0)
        cache: dict[bytes, float] = {}
        model.worst_of([vocab], cache)
        get = lambda k: cache.get(k, -9.0)
        witness = Counter(max(b, key=get) for b in pos)
        hard = Counter(k for b in neg for k in sorted(b, key=get)[-3:])
        up: Counter = Counter(witness)
        for k, n in witness.items():
            if not in_neg[k]:
                for d in _disguises(k, rng):
                    up[d] += 0.5 * n
        words = list(dict.fromkeys([*up, *hard, *plain]))
        x = marks.features(words)
        w = _svm(x, np.array([float(up[k]) for k in words]), np.array([0.0 if k in up and not in_neg[k] else hard[k] + min(in_neg[k], 50) * 0.2 for k in words]), w)
    model = Model(marks.fold(w), float(w[-1]), 1, 0)
    s = model.worst_of(pos + neg, {})
    y = np.array([1] * len(pos) + [0] * len(neg), float)
    model.slope, model.shift = _platt(s, y)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """Fits on at most ``per_class`` labelled texts a class; ``labels`` holds the rows that may be learned from."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias("a"), F.max(label).alias("b")).filter("a = b")
    chosen = {}
    for y in (0, 1):
        for r in known.filter(F.col("a") == y).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).select(id_col).limit(per_class).collect():
            chosen[r[0]] = y
    if len(set(chosen.values())) < 2:
        return None
    bounded_batches(docs.sparkSession)
    texts = docs.filter(F.col(id_col).isin(sorted(chosen)) & F.col(text).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min_by(text, F.xxhash64(text)).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([bag_of(t) for t in as_bytes(b.column("text"))], pa.list_(pa.binary()))], ["id", "bag"])

    kinds = T.StructType([texts.schema["id"], T.StructField("bag", T.ArrayType(T.BinaryType()))])
    got = texts.mapInArrow(run, kinds).toArrow().combine_chunks()  # a row a chosen id
    coded = got.column("bag").combine_chunks()
    ends, words = np.cumsum(coded.value_lengths().to_numpy()), coded.flatten().dictionary_encode()
    vocabulary, which = words.dictionary.to_pylist(), words.indices.to_numpy()  # bags share their words
    rows = sorted(zip(got.column("id").to_pylist(), np.split(which, ends[:-1]), strict=True), key=lambda r: r[0])
    return fit([[vocabulary[k] for k in bag.tolist()] for _, bag in rows], [chosen[i] for i, _ in rows])


def score_texts(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds toxic_score (0 to 1) and toxic (1 if the score is at least 0.5)."""
    docs = docs.drop(*FOUND)
    if model is None:
        return docs.withColumns({FOUND[0]: F.lit(0.0), FOUND[1]: F.lit(0)})
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))  # 64^ORDER floats

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = Model(*sent.value), {}
        for b in batches(it):
            s = m.score(as_bytes(b.column(text)), cache)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, *FOUND])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(FOUND[0], T.DoubleType()), T.StructField(FOUND[1], T.IntegerType())]))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = crc_mod("doc_id", 5) == 0
    model = learn(docs, labels.filter(~held))
    return score_texts(docs, model).select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"))
