"""TF-IDF, logistic regression, active learning, and classification metrics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import entropy, margin
from ..functions.text import is_blank, text_of
from ..sources.tables import staged
from . import termweights, wordmodel
from .sampling import ROW_ID, hash_order, sample, split

TOKEN = r"[\p{L}\p{N}_]{2,}"
DIVERSITY_POOL = 5
MAX_SIMILARITY = 0.85
HERE_CHARS, HERE_WEIGHTS = 4 << 20, 1 << 20  # a training set of so much text and so many weights fits the driver
STRATEGIES = ("entropy", "margin", "random")
MAX_FEATURES, MAX_ITER = 20_000, 200
WORDS = "_words"


class OneClass(ValueError):
    """There is nothing to tell apart."""


# TF-IDF as tables


def tfidf(df: DataFrame, text: str = "text", row_id: str = ROW_ID, bigrams: bool = True) -> DataFrame:
    """row id, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1. Terms: words of two or more letters, digits or underscores, lower case, and
    pairs of neighbours."""
    return termweights.weights(df, words_of(text), row_id, bigrams)


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(f"({TOKEN})"), F.lit(1))


# the classifier


@dataclass
class TextClassifier:
    pipeline: PipelineModel
    labels: list[str]

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds proba (array, in the order of ``labels``) and predicted_label."""
        out = self.pipeline.transform(df.withColumn("_text", text_of(text)))
        names = F.array(*[F.lit(x) for x in self.labels])
        out = out.withColumns({"proba": vector_to_array("probability"), "predicted_label": F.element_at(names, F.col("prediction").cast("int") + 1)})
        return out.drop("_text", "_w1", "_w2", "_terms", "_tf", "_scaled", "features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def softmax_regression(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, n_classes: int, penalty: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (class by feature) and intercepts that make mean log loss + penalty / 2 * squared coefficients least, by L-BFGS; the same objective as Spark's.

    Entries are in row order, and every row counts, also one without entries.
    """
    n = len(y)
    begins = np.searchsorted(rows, np.arange(n))
    filled = np.flatnonzero(np.diff(np.append(begins, len(rows))))
    hit = np.zeros((n, n_classes))
    hit[np.arange(n), y] = 1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-n_classes].reshape(n_classes, n_features), x[-n_classes:]
        z = np.tile(b, (n, 1))
        if len(filled):
            z[filled] += np.stack([np.add.reduceat(values * w[k].take(columns), begins[filled]) for k in range(n_classes)], 1)
        z -= z.max(1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        off = (np.exp(log_p) - hit) / n
        g = np.stack([np.bincount(columns, values * off[:, k].take(rows), n_features) for k in range(n_classes)]) + penalty * w
        return -log_p[np.arange(n), y].mean() + penalty / 2 * float((w * w).sum()), np.concatenate([g.ravel(), off.sum(0)])

    share = np.log(np.bincount(y, minlength=n_classes) / n)
    x = np.concatenate([np.zeros(n_classes * n_features), share - share.mean()])
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.abs(g).max() < 1e-8:
            break
        d, back = -g, []
        for s, u, r in reversed(past):
            back.append(r * float(s @ d))
            d = d - back[-1] * u
        if past:
            s, u, r = past[-1]
            d = d / (r * float(u @ u))
        for (s, u, r), a in zip(past, reversed(back), strict=True):
            d = d + (a - r * float(u @ d)) * s
        slope, step = float(g @ d), 1.0
        while True:
            f2, g2 = loss(x + step * d)
            if f2 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if f2 >= f:  # no further within the precision of floats
            break
        s, u = step * d, g2 - g
        if float(s @ u) > 0:
            past = [*past[-9:], (s, u, 1 / float(s @ u))]
        x, f, g = x + s, f2, g2
    return x[:-n_classes].reshape(n_classes, n_features), x[-n_classes:] - x[-n_classes:].mean()


def _train(rows: np.ndarray, columns: np.ndarray, tf: np.ndarray, y: np.ndarray, n_features: int, n_classes: int, penalty: float, max_iter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale of the features, coefficients and intercepts; an entry a row and its term."""
    idf = np.log((len(y) + 1) / (np.bincount(columns, minlength=n_features) + 1)) + 1
    values = tf * idf[columns]
    norm = np.sqrt(np.bincount(rows, values * values, len(y)))
    return idf, *softmax_regression(rows, columns, values / norm[rows], y, n_features, n_classes, penalty, max_iter)


def _fit_here(counted: DataFrame, labels: list[str], n_features: int, penalty: float, max_iter: int) -> tuple[np.ndarray, LogisticRegressionModel]:
    """Scale of the features and the model, from rows few enough for the driver: an iteration is a few milliseconds and not a Spark job."""
    got = counted.collect()
    vectors, place = [r["_tf"] for r in got], {x: i for i, x in enumerate(labels)}
    rows = np.repeat(np.arange(len(got)), [len(v.indices) for v in vectors])
    columns = np.concatenate([v.indices for v in vectors]).astype(np.int64)
    y = np.array([place[r["_label"]] for r in got])
    idf, w, b = _train(rows, columns, np.concatenate([v.values for v in vectors]), y, n_features, len(labels), penalty, max_iter)
    blank = LogisticRegression(featuresCol="features", labelCol="_y", family="multinomial")
    sc = counted.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(blank.uid, _py2java(sc, Matrices.dense(*w.shape, w.ravel(order="F"))), _py2java(sc, Vectors.dense(b)), len(labels), True)
    return idf, blank._copyValues(LogisticRegressionModel(java))


def fit(labeled: DataFrame, text: str = "text", label: str = "label", max_features: int = MAX_FEATURES, max_iter: int = MAX_ITER, c: float = 1.0, extra_labels: list[str] | None = None) -> TextClassifier:
    """Needs text and label and two classes. The scaled term counts are kept sparse. Up to HERE_CHARS characters of text are learned from on the driver; of more,
    only the vocabulary's weights come there. The model is the same."""
    missing = [x for x in (text, label) if x not in labeled.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    rows = labeled.filter(F.col(label).isNotNull()).select(text_of(text).alias("_text"), F.col(label).cast("string").alias("_label"))
    sizes = rows.groupBy("_label").agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("chars")).collect()
    present, n = sorted(r["_label"] for r in sizes), sum(r["n"] for r in sizes)
    if len(present) < 2:
        raise OneClass("two classes are needed")
    words = RegexTokenizer(inputCol="_text", outputCol="_w1", gaps=False, pattern=TOKEN, toLowercase=True)
    pairs = NGram(n=2, inputCol="_w1", outputCol="_w2")
    both = SQLTransformer(statement="SELECT *, concat(_w1, _w2) AS _terms FROM __THIS__")
    prepared = both.transform(pairs.transform(words.transform(rows)))
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_features).fit(prepared)
    scaled = lambda idf: ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_scaled")
    unit = Normalizer(inputCol="_scaled", outputCol="features", p=2.0)
    counted = counts.transform(prepared).select("_label", "_tf")
    if sum(r["chars"] for r in sizes) <= HERE_CHARS and len(present) * max_features <= HERE_WEIGHTS:
        idf, lr = _fit_here(counted, present, len(counts.vocabulary), 1 / (c * n), max_iter)
        return TextClassifier(PipelineModel([words, pairs, both, counts, scaled(idf), unit, lr]), present)
    counted = counted.persist()  # read by the document counts and by the features
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted).idf.toArray() + 1
    scale = scaled(idf)
    index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    train = unit.transform(scale.transform(index.transform(counted)))
    lr = LogisticRegression(featuresCol="features", labelCol="_y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, family="multinomial").fit(train)
    counted.unpersist()
    # the training summary holds the session and would go with the model into every task
    lr._java_obj.setSummary(labeled.sparkSession._jvm.scala.Option.empty())
    return TextClassifier(PipelineModel([words, pairs, both, counts, scale, unit, lr]), list(index.labels))


def with_uncertainty(scored: DataFrame, proba: str = "proba") -> DataFrame:
    return scored.withColumns({"uncertainty": entropy(F.col(proba)), "margin": margin(F.col(proba))})


def rank(scored: DataFrame, strategy: str, row_id: str = ROW_ID) -> DataFrame:
    """entropy: the most uncertain first; margin: the narrowest first; ties by the other, then by id."""
    orders = {"entropy": [F.desc("uncertainty"), F.asc("margin")], "margin": [F.asc("margin"), F.desc("uncertainty")], "random": [hash_order(42, row_id)]}
    if strategy not in orders:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    return scored.orderBy(*orders[strategy], row_id)


def diverse(vectors: np.ndarray, batch: int, limit: float = MAX_SIMILARITY) -> list[int]:
    """Places, in rank order, of rows whose similarity to all taken ones is below the limit; then the earliest of the others until the batch is full."""
    taken: list[int] = []
    for i in range(len(vectors)):
        if len(taken) < batch and (not taken or float((vectors[taken] @ vectors[i]).max()) < limit):
            taken.append(i)
    rest = [i for i in range(len(vectors)) if i not in set(taken)]
    return taken + rest[: max(0, batch - len(taken))]


def diverse_ids(head: DataFrame, model: TextClassifier, batch: int, text: str = "text", row_id: str = ROW_ID) -> list:
    """Ids of ``batch`` rows of ``head``, which has 5 * batch at most and is in rank order; only these come to the driver."""
    got = model.pipeline.transform(head.select(row_id, text_of(text).alias("_text"))).select(row_id, "features").collect()
    if len(got) <= batch:
        return [r[row_id] for r in got]
    dims = got[0]["features"].size
    m = np.zeros((len(got), dims), np.float32)
    for k, r in enumerate(got):
        m[k, r["features"].indices] = r["features"].values
    return [got[k][row_id] for k in diverse(m, batch)]


def select_diverse(ranked: DataFrame, model: TextClassifier, batch: int, text: str = "text", row_id: str = ROW_ID) -> DataFrame:
    """``batch`` rows of the first 5 * batch in rank order; only these come to the driver."""
    head = ranked.limit(DIVERSITY_POOL * batch)
    ids = diverse_ids(head, model, batch, text, row_id)
    return head if len(ids) < batch else head.filter(F.col(row_id).isin(ids))


def query(pool: DataFrame, strategy: str, batch: int, model: TextClassifier | None = None, labeled: DataFrame | None = None, row_id: str = ROW_ID) -> DataFrame:
    """The row ids to label next: the first of the ranked pool that are unlike each other."""
    if strategy == "random":
        return sample(pool, batch, 42, row_id).select(row_id)
    model = model or fit(labeled)
    ranked = rank(with_uncertainty(model.transform(pool)), strategy, row_id)
    if "text" not in pool.columns:
        return ranked.limit(batch).select(row_id)
    return select_diverse(ranked, model, batch, row_id=row_id).select(row_id)


def select_batch(pool: DataFrame, labeled: DataFrame, strategy: str = "entropy", batch: int = 100, row_id: str = ROW_ID) -> DataFrame:
    """Pool rows to label next with uncertainty, margin and predicted_label; too little to learn from gives the first rows."""
    none = {"uncertainty": F.lit(None).cast("double"), "margin": F.lit(None).cast("double"), "predicted_label": F.lit(None).cast("string")}
    if labeled.limit(2).count() < 2 or "text" not in pool.columns:
        return pool.orderBy(row_id).limit(batch)
    if strategy == "random":
        return sample(pool, batch, 42, row_id).withColumns(none)
    model = fit(labeled)
    ranked = rank(with_uncertainty(model.transform(pool)), strategy, row_id)
    return select_diverse(ranked, model, batch, row_id=row_id)


def prepared(df: DataFrame, *keep: str, text: str = "text", label: str = "label", row_id: str = ROW_ID) -> DataFrame:
    """row id, label and the text's words joined by spaces, which every pass of a cycle reads; and columns to keep. Texts are taken apart once."""
    truth = F.col(label) if label in df.columns else F.lit(None)
    return df.select(row_id, truth.cast("string").alias("label"), F.array_join(words_of(text), " ").alias(WORDS), *keep)


def _learned(rows: pa.Table) -> wordmodel.WordModel:
    """The model of ``fit`` from prepared rows on the driver."""
    rows = rows.filter(rows["label"].is_valid())
    labels = rows["label"].to_pylist()
    if len(set(labels)) < 2:
        raise OneClass("two classes are needed")
    train = lambda *x: _train(*x, 1 / len(labels), MAX_ITER)
    return wordmodel.learn(termweights._one(rows[WORDS]), labels, train, MAX_FEATURES)


def _learned_by_spark(rows: DataFrame) -> wordmodel.WordModel:
    model = fit(rows, WORDS)
    counts, scale, lr = (model.pipeline.stages[k] for k in (3, 4, -1))
    return wordmodel.from_terms(counts.vocabulary, scale.getScalingVec().toArray(), lr.coefficientMatrix.toArray(), lr.interceptVector.toArray(), model.labels)


def _scored(model: wordmodel.WordModel, test: DataFrame, left: DataFrame | None, strategy: str, head: int, row_id: str) -> tuple[dict, list]:
    """How often the test rows have each true and predicted label, and the ids of the first ``head`` rows of what is left, in the order of ``rank``, from one job.
    Tasks return counts and their own first rows without texts."""
    columns = [row_id, "label", WORDS]
    rows = test.select(*columns, F.lit(True).alias("_test"))
    if left is not None:
        rows = rows.unionByName(left.select(*columns, F.lit(False).alias("_test")))
    order = [("uncertainty", "descending"), ("margin", "ascending")] if strategy == "entropy" else [("margin", "ascending"), ("uncertainty", "descending")]

    def score(batches):
        count, pairs, best = model.counter(), Counter(), []
        for batch in batches:
            for part in wordmodel.slices(batch.column(WORDS)):
                piece = pa.Table.from_batches([batch.slice(part.start, part.stop - part.start)])
                p = model.probabilities(termweights._one(piece[WORDS]), count)
                tested = piece["_test"].to_numpy()
                pairs.update((t, model.labels[k]) for t, k, x in zip(piece["label"].to_pylist(), p.argmax(1), tested, strict=True) if x and t is not None)
                uncertainty, margins = wordmodel.uncertain(p)
                found = pa.table({row_id: piece[row_id], "uncertainty": uncertainty, "margin": margins}).filter(pa.array(~tested))
                best = [pa.concat_tables([*best, found]).sort_by([*order, (row_id, "ascending")]).slice(0, head)]
        ids = best[0] if best else None
        if pairs:
            names, n = list(pairs), len(pairs)
            yield pa.record_batch({row_id: pa.nulls(n, ids[row_id].type), "uncertainty": pa.nulls(n, pa.float64()), "margin": pa.nulls(n, pa.float64()), "truth": pa.array([t for t, _ in names], pa.string()), "predicted": pa.array([x for _, x in names], pa.string()), "n": pa.array([pairs[x] for x in names], pa.int64())})
        if ids is not None and len(ids):
            nothing = {"truth": pa.nulls(len(ids), pa.string()), "predicted": pa.nulls(len(ids), pa.string()), "n": pa.nulls(len(ids), pa.int64())}
            yield from pa.table({c: ids[c] for c in ids.column_names} | nothing).combine_chunks().to_batches()

    got = rows.mapInArrow(score, f"`{row_id}` {rows.schema[row_id].dataType.simpleString()}, uncertainty double, margin double, truth string, predicted string, n bigint").toArrow()
    pairs: Counter = Counter()
    for r in got.filter(got["n"].is_valid()).select(["truth", "predicted", "n"]).to_pylist():
        pairs[r["truth"], r["predicted"]] += r["n"]
    first = got.filter(got["n"].is_null()).sort_by([*order, (row_id, "ascending")]).slice(0, head)
    return pairs, list(dict.fromkeys(first[row_id].to_pylist()))


def run_cycle(labeled: DataFrame, pool: DataFrame, test: DataFrame, strategy: str, iterations: int = 5, batch: int = 20, row_id: str = ROW_ID) -> list[dict]:
    """Fit, evaluate, move the next batch from the pool to the labelled rows; with one class only, a note and no figures. State is a set of ids, so that no lineage
    grows. The labelled rows' words are held on the driver up to HERE_CHARS, and beyond that models are fitted by Spark; each iteration has one job over test rows
    and pool, and one that fetches its best rows. Frames may be ``prepared`` and written; others are here."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    labeled, pool, test = (x if WORDS in x.columns else staged(prepared(x, row_id=row_id)) for x in (labeled, pool, test))
    columns = [row_id, "label", WORDS]
    start = labeled.select(row_id, "label", F.length(WORDS).alias("n")).toArrow()  # start + iterations * batch ids
    chosen, chars, classes = set(start[row_id].to_pylist()), sum(start["n"].to_pylist()), set(start["label"].to_pylist())
    small = lambda: chars <= HERE_CHARS and len(classes) * MAX_FEATURES <= HERE_WEIGHTS
    here = labeled.select(columns).toArrow() if small() else None
    moved: set = set()
    history: list[dict] = []
    for i in range(iterations):
        own = {"strategy": strategy, "iteration": i, "n_labeled": len(chosen)}
        try:
            model = _learned(here) if here is not None else _learned_by_spark(labeled.select(columns).unionByName(pool.filter(F.col(row_id).isin(list(moved))).select(columns)))
        except OneClass:
            history.append({**own, "accuracy": float("nan"), "f1_macro": float("nan"), "note": "two classes are needed"})
            break
        left = pool.filter(~F.col(row_id).isin(list(chosen)))
        ranked = i < iterations - 1 and strategy != "random"
        pairs, ids = _scored(model, test, left if ranked else None, strategy, DIVERSITY_POOL * batch, row_id)
        history.append({**own, **_figures(pairs)})
        if i == iterations - 1:
            break
        if strategy == "random":
            ids = [r[0] for r in left.select(row_id).orderBy(hash_order(42 + i, row_id), row_id).limit(batch).collect()]
        if not ids:
            history[-1]["note"] = "the pool is empty"
            break
        got = left.filter(F.col(row_id).isin(ids)).select(columns).toArrow()
        if len(ids) > batch:
            place = {x: k for k, x in reversed(list(enumerate(got[row_id].to_pylist())))}
            doc, term, weight = model.vectors(termweights._one(got[WORDS].take([place[x] for x in ids])))
            m = np.zeros((len(ids), len(model.idf)), np.float32)
            m[doc, term] = weight
            ids = [ids[k] for k in diverse(m, batch)]
        new = set(ids)
        got = got.filter(pa.array([x in new for x in got[row_id].to_pylist()], pa.bool_()))
        chosen, moved, classes = chosen | new, moved | new, classes | set(got["label"].to_pylist())
        chars += sum(len(x) for x in got[WORDS].to_pylist())
        here = pa.concat_tables([here, got], promote_options="permissive") if here is not None and small() else None
    return history


def nearest(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", block: int = 4096, data_block: int = 65_536) -> DataFrame:
    """q, id, rank: the k rows most like each query by cosine (rounded to 9 places; ties: the smaller id), the query's own id left out.

    Queries are dealt in blocks and so are the rows; a task holds one block of each and returns k rows a query, of which the best k are taken.
    Null, zero and unequally long vectors have no cosine and come last, as nulls do.
    """
    nq, nd = (max(1, -(-x.count() // n)) for x, n in ((queries, block), (df, data_block)))
    part = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    left = queries.select(F.col(id_col).alias("q"), F.col(vec).alias("x"), part(id_col, nq, "q").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("j"))
    right = df.select(F.col(id_col).alias("id"), F.col(vec).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"), part(id_col, nd, "d").alias("j"))

    def unit(vectors) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and which rows have one; the length of most rows counts."""
        sizes = np.array([len(v) if v is not None else 0 for v in vectors])
        d = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        m = np.array([v if n == d and n else np.zeros(max(d, 1)) for v, n in zip(vectors, sizes, strict=True)], float).reshape(len(sizes), -1)
        norm = np.linalg.norm(m, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        return m / np.where(ok, norm, 1)[:, None], ok

    def best(key, a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})
        (x, ok_x), (y, ok_y) = unit(list(a["x"])), unit(list(b["y"]))
        ids, out = b["id"].to_numpy(), []
        for lo in range(0, len(a), 256):
            s = np.round(x[lo : lo + 256] @ y.T, 9) if x.shape[1] == y.shape[1] else np.full((len(x[lo : lo + 256]), len(y)), np.nan)
            s[:, ~ok_y] = s[~ok_x[lo : lo + 256]] = np.nan
            for q, row in zip(a["q"].to_numpy()[lo : lo + 256], s, strict=True):
                row = np.where(np.isnan(row), -np.inf, row)
                row[ids == q] = -np.inf
                top = np.lexsort((ids, -row))[: k + 1]
                out += [(q, i, r if np.isfinite(r) else None) for i, r in zip(ids[top], row[top], strict=True) if i != q][:k]
        return pd.DataFrame(out, columns=["q", "id", "s"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "q bigint, id bigint, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("s"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", F.col("id").alias(id_col), F.col("rank").cast("bigint").alias("rank"))


# metrics


def confusion(df: DataFrame, truth: str = "label", predicted: str = "predicted_label") -> DataFrame:
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """label, precision, recall, f1, support of every label that is true or predicted somewhere, and rows accuracy, macro avg, weighted avg. 0 where there is nothing to divide by."""
    c = confusion(df, truth, predicted)
    sides = c.select("n", (F.col("truth") == F.col("predicted")).alias("hit"), F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("t")))).alias("x"))
    per = sides.groupBy("x.label").agg(F.sum(F.when(F.col("x.t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.t"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("x.t"), F.col("n")).otherwise(0)).alias("found"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    per = per.select("label", zero(F.col("tp"), F.col("found")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("found") + F.col("support")).alias("f1"), "support", "tp")
    total = per.agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")], *[zero(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])
    accuracy = zero(F.col("tp"), F.col("support"))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.col("support")),
        *[F.struct(F.lit(f"{k} avg").alias("label"), F.col(f"{k}_precision").alias("precision"), F.col(f"{k}_recall").alias("recall"), F.col(f"{k}_f1").alias("f1"), F.col("support")) for k in ("macro", "weighted")],
    )
    return per.drop("tp").union(total.select(F.explode(rows).alias("r")).select("r.*"))


def evaluate(model: TextClassifier, test: DataFrame, label: str = "label") -> dict:
    """Accuracy and macro F1 as in ``classification_report``, from the counts of each pair of labels (a row a pair on the driver)."""
    return _figures({(r["truth"], r["predicted"]): r["n"] for r in confusion(model.transform(test.filter(F.col(label).isNotNull())), label).collect()})


def _figures(pairs: dict) -> dict:
    right, sides = {t: n for (t, p), n in pairs.items() if t == p}, Counter()
    for (truth, predicted), n in pairs.items():
        sides.update({truth: n})
        sides.update({predicted: n})
    total = sum(pairs.values())
    return {"accuracy": sum(right.values()) / total if total else 0.0, "f1_macro": sum(2 * right.get(x, 0) / n for x, n in sides.items()) / len(sides) if sides else 0.0}


def sample_savings(history: DataFrame) -> DataFrame:
    """strategy, n_needed, n_random, saved: fewest labels with which each strategy reaches random's best macro F1."""
    target = history.filter("strategy = 'random'").agg(F.max("f1_macro").alias("target"))
    reached = history.join(target).filter("f1_macro >= target").groupBy("strategy").agg(F.min("n_labeled").alias("n_needed"))
    base = reached.filter("strategy = 'random'").select(F.col("n_needed").alias("n_random"))
    return reached.join(base).select("strategy", "n_needed", "n_random", (F.col("n_random") - F.col("n_needed")).alias("saved"))


def train_baseline(df: DataFrame, text: str = "text", label: str = "final_label", fraction: float = 0.2, seed: int = 42, model_path: str | None = None, row_id: str = ROW_ID) -> tuple[TextClassifier, DataFrame]:
    """Model and classification report on a held-out share, stratified where every class has two rows."""
    rows = df.filter(F.col(label).isNotNull() & ~is_blank(text)).select(row_id, text, F.col(label).cast("string").alias("label"))
    sizes = rows.groupBy("label").count().collect()
    if sum(r["count"] for r in sizes) < 4:
        raise ValueError("four labelled rows are needed")
    stratify = "label" if len(sizes) > 1 and min(r["count"] for r in sizes) > 1 else None
    parts = split(rows, fraction, seed, stratify, row_id).persist()
    model = fit(parts.filter(~F.col("_test")), text, "label", max_features=30_000, max_iter=300)
    report = classification_report(model.transform(parts.filter("_test")))
    if model_path:
        model.save(model_path)
    return model, report


def export_candidates(batch: DataFrame) -> DataFrame:
    """JSON of one labelling task a row; NaN becomes null."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("uncertainty", "margin") if c in batch.columns}
    data = F.struct(*[c for c in ("text", "uid", "predicted_label", "uncertainty", "margin") if c in batch.columns])
    return batch.withColumns(clean).select(F.to_json(F.struct(data.alias("data"))).alias("task"))
