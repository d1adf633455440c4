"""Severity of toxic text by cumulative-link ordinal regression.

``P(grade > k) = sigmoid(w . x - t_k)`` with one weight vector for all
thresholds ``t_0 < t_1 < ...``; the expected severity is the sum of these.  The
features are sparse presences of a document's words and of their first four and
five letters (inflected and compounded forms share a stem).

Labels are the grades: their distinct values in order are the levels, one
threshold between every two.  Labels of two values make one threshold, and the
expected severity is then the probability of the upper one.

The model is fitted on at most ``SAMPLE`` labelled documents (the smallest
hashes of their ids), with all features whose presence speaks clearly for a higher label
(no feature speaks against one, so harmless text around an insult hides nothing).
The sample bounds their number, and ``FEATURES`` the model's size should they be more;
both are parameters.  Scoring reads every whole text.

Results for odd input: a null or empty text has no features and the severity of
that; labels that are null or of absent documents are left out; of several
labels of one id the greatest holds; without labels of both kinds all
severities are 0; repeated rows each get their score; an empty table gives an
empty result.  Added columns replace equally named ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, text_or_empty, tidy, worker_state

SAMPLE = 6000
FEATURES = 1 << 16
#: A feature stands in so many sampled documents, and its share differs between labels by so many standard errors.
LEAST_DOCS = 4
LEAST_Z = 5.0
STEPS = 1500
RIDGE = 1e-6
#: Words that a worker remembers, and how long they are at most.
WORDS_KEPT = 200_000
WORD_KEPT = 64

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word's features: itself, and its first letters where it has more."""
    parts = [word] + [f"{word[:n]}-" for n in (4, 5) if len(word) > n]
    return tuple(xxhash.xxh64_intdigest(p) >> 1 for p in parts)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: np.ndarray

    def severities(self, texts: list[str], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Per text the probabilities of a grade above 0, 1, ..."""
        out = np.zeros((len(texts), len(self.thresholds)))
        for i, text in enumerate(texts):
            words = words_of(text)
            new = words.difference(cache)
            if len(cache) + len(new) > WORDS_KEPT:
                cache.clear()
                new = words
            found: set[int] = set()
            for w in new:
                own = tuple(f for f in features_of(w) if f in self.weights)
                found.update(own)
                if len(w) <= WORD_KEPT:
                    cache[w] = own
            for w in words - new:
                found.update(cache[w])
            out[i] = _sigmoid(sum(self.weights[f] for f in sorted(found)) - self.thresholds)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(features: list[np.ndarray], labels: np.ndarray, most: int = FEATURES) -> Model:
    """Fit on documents' feature hashes and labels."""
    none = Model({}, np.array([40.0]))
    if not len(labels) or labels.max() == labels.min():
        return none
    # Copies would make the words of one text look associated.
    single = sorted({(f.tobytes(), y): i for i, (f, y) in reversed(list(enumerate(zip(features, labels.tolist(), strict=True))))}.values())
    features, labels = [features[i] for i in single], labels[single]
    toxic = labels > labels.min()
    values, column = np.unique(np.concatenate(features), return_inverse=True)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    a, b = np.bincount(column[toxic[row]], minlength=len(values)), np.bincount(column[~toxic[row]], minlength=len(values))
    share = (a + b) / len(labels)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (a / toxic.sum() - b / (~toxic).sum()) / np.sqrt(share * (1 - share) * (1 / toxic.sum() + 1 / (~toxic).sum()))
    z[(a + b < LEAST_DOCS) | ~np.isfinite(z) | (z < LEAST_Z)] = 0
    picked = np.argsort(-z, kind="stable")[:most]
    picked = picked[z[picked] > 0]
    if not len(picked):
        return none
    place = np.full(len(values), -1)
    place[picked] = np.arange(len(picked))
    inside = place[column] >= 0
    grade = np.unique(labels, return_inverse=True)[1]
    w, t = _descend(row[inside], place[column[inside]], len(picked), grade)
    return Model({int(values[picked[i]]): float(w[i]) for i in range(len(picked)) if w[i]}, t)


def _descend(row: np.ndarray, column: np.ndarray, width: int, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adam, over the sparse presences (row, column), on the likelihood of all thresholds' indicators; gaps between thresholds are exponentials."""
    levels = int(grade.max())
    above = (grade[:, None] > np.arange(levels)).astype(np.float64)
    mean = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    first = np.log((1 - mean) / mean)
    theta = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, low, gaps = theta[: width], theta[width], np.exp(theta[width + 1 :])
        t = low + np.concatenate([[0], np.cumsum(gaps)])
        error = (_sigmoid(np.bincount(row, w[column], len(grade))[:, None] - t) - above) / len(grade)
        by_t = -error.sum(0)
        gradient = np.concatenate([np.bincount(column, error.sum(1)[row], width) + RIDGE * w, [by_t.sum()], gaps * np.cumsum(by_t[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    t = theta[width] + np.concatenate([[0], np.cumsum(np.exp(theta[width + 1 :]))])
    return theta[: width], t


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    small_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column("text")]
            raw = [np.unique(np.array([f for w in ws for f in features_of(w)], np.int64)).tobytes() for ws in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(raw, pa.binary())], names=["doc_id", "label", "raw"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # At most ``sample`` ids and labels are broadcast, and as many rows of features come back.
    found = rows.join(F.broadcast(picked), "doc_id").mapInArrow(lambda it: tidy(featurize(it)), "doc_id long, label int, raw binary")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("raw")).limit(sample).toPandas()
    return fit_rows([np.frombuffer(r, np.int64) for r in got["raw"]], got["label"].to_numpy(), most)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    small_batches(docs.sparkSession)
    name = repr(sorted(model.weights.items())).encode() + model.thresholds.tobytes()
    key = xxhash.xxh3_128_digest(name)

    @F.pandas_udf("severity double, grade int")
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        p = model.severities(list(texts), worker_state(("toxicity", key), dict))
        give_back()
        return pd.DataFrame({"severity": p.sum(1), "grade": (p >= 0.5).sum(1).astype(np.int32)})

    return docs.withColumn("__bq_severity", run(text_or_empty()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``severity`` (expected grade), ``grade`` (thresholds passed with at least even odds) and ``toxic`` (grade above 0)."""
    base = [c for c in docs.columns if c.lower() not in ("severity", "grade", "toxic")]
    s = F.col("__bq_severity")
    return _scored(docs, model).select(*base, s["severity"].alias("severity"), s["grade"].alias("grade"), (s["grade"] > 0).alias("toxic"))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents of grade 0, unchanged."""
    return _scored(docs, model).filter(F.col("__bq_severity")["grade"] == 0).drop("__bq_severity")
