"""The classifier of ``learning.fit`` as arrays: learned from few texts on the driver, applied to texts of any number in tasks.

Texts are given as their words, joined by spaces. Terms are words and pairs of neighbours. A term is a key: place of its first word, place of its second one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import termweights

SLICE_BYTES = 2 << 20  # of texts that are counted at once
DIGITS = 12  # of uncertainty and margin, so that copies of a text tie wherever they are
MARKS = 20  # bits of the table that most pairs which are no term are told by


@dataclass
class WordModel:
    words: pa.Array
    keys: np.ndarray  # ascending
    idf: np.ndarray
    weights: np.ndarray  # class by term
    intercepts: np.ndarray
    labels: list[str]

    def counter(self) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gives, for each pair of a text and its known term, in order: which text, which term, how often."""
        wide, size = len(self.words) + 1, max(1, len(self.keys))
        alone = np.full(len(self.words) + 1, -1)  # the last place is that of an unknown word
        alone[self.keys[self.keys % wide == 0] // wide] = np.flatnonzero(self.keys % wide == 0)
        mark = lambda keys: (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARKS)
        marked = np.zeros(1 << MARKS, bool)
        marked[mark(self.keys)] = True

        def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lists = pc.split_pattern(texts, " ")
            parent = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            code = pc.index_in(pc.list_flatten(lists), value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (parent[:-1] == parent[1:]))
            pairs = code[at] * wide + code[at + 1] + 1
            likely = np.flatnonzero(marked[mark(pairs)])
            at, pairs = at[likely], pairs[likely]
            place = np.searchsorted(self.keys, pairs)
            same = self.keys.take(place, mode="clip") == pairs if len(self.keys) else np.zeros(0, bool)
            found = alone[code]
            known = found >= 0
            both, tf = np.unique(np.concatenate([parent[known] * size + found[known], parent[at[same]] * size + place[same]]), return_counts=True)
            return *np.divmod(both, size), tf

        return count

    def vectors(self, texts: pa.Array, count=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and weight; texts are scaled to length 1."""
        doc, term, tf = (count or self.counter())(texts)
        raw = tf * self.idf[term]
        return doc, term, raw / np.sqrt(np.bincount(doc, raw * raw, len(texts)))[doc]

    def probabilities(self, texts: pa.Array, count=None) -> np.ndarray:
        doc, term, weight = self.vectors(texts, count)
        z = np.stack([np.bincount(doc, weight * w[term], len(texts)) for w in self.weights], 1) + self.intercepts
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def model_of(first: np.ndarray, second: np.ndarray, vocabulary: pa.Array, **rest) -> WordModel:
    """Terms as places of words: the second ones from 1 (0: none), ordered by both."""
    used = np.unique(np.concatenate([first, second[second > 0] - 1]))
    after = np.where(second > 0, np.searchsorted(used, second - 1) + 1, 0)
    return WordModel(vocabulary.take(pa.array(used)), np.searchsorted(used, first) * (len(used) + 1) + after, **rest)


def learn(texts: pa.Array, labels: list[str], train: Callable, max_features: int) -> WordModel:
    """``train`` gets text, term, count, class of each text, number of terms, number of classes. The most frequent terms count; ties: the smaller by its words."""
    _, vocabulary, first, second, doc, term, tf = termweights._counted(pa.array(np.arange(len(texts))), texts, True)
    top = np.sort(np.argsort(-np.bincount(term, tf, len(first)), kind="stable")[:max_features])
    place = np.full(len(first), -1)
    place[top] = np.arange(len(top))
    kept, (names, y) = place[term] >= 0, np.unique(np.array(labels, object), return_inverse=True)
    idf, weights, intercepts = train(doc[kept], place[term[kept]], tf[kept], y, len(top), len(names))
    return model_of(first[top], second[top], vocabulary, idf=idf, weights=weights, intercepts=intercepts, labels=list(names))


def from_terms(terms: list[str], idf: np.ndarray, weights: np.ndarray, intercepts: np.ndarray, labels: list[str]) -> WordModel:
    split = [(*t.split(" "), "")[:2] for t in terms]
    words = sorted({w for t in split for w in t if w})
    at = {"": 0, **{w: i for i, w in enumerate(words, 1)}}
    first, second = np.array([at[a] - 1 for a, _ in split], np.int64), np.array([at[b] for _, b in split], np.int64)
    order = np.lexsort((second, first))
    return model_of(first[order], second[order], pa.array(words, pa.string()), idf=idf[order], weights=weights[:, order], intercepts=intercepts, labels=labels)


def slices(texts: pa.Array) -> Iterator[slice]:
    """Neighbours of about SLICE_BYTES, one text at least."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE_BYTES, "right")))
        yield slice(begin, end)
        begin = end


def uncertain(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy, and best less second best."""
    ranked = np.sort(p, 1)
    return np.round(-(p * np.log(p + 1e-12)).sum(1), DIGITS), np.round(ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0), DIGITS)
