"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 9).

The statistics come from the whole text only. Training takes a bounded sample of
labelled rows (``sample``), by hash of doc_id, to the driver; everything else runs
where the documents are. The trees are flattened into arrays, and a batch of
documents walks all trees level by level in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from editpulse.llm.common import documents, ship, with_fields
from editpulse.session import configure

SAMPLE, TREES, LEVELS, BINS = 20_000, 80, 5, 48
RATE, L2, LEAST_WEIGHT = 0.15, 1.0, 5.0
MARKS = b"!$%&*#|@~^_=+<>{}[]\\/"
CLOSING = tuple('.!?;:"”’)')
SENTENCE = re.compile(rb"[.!?]+(?:\s|$)")


def statistics(text: str | None) -> list[float]:
    """What is known of a document; an empty or null one has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * N_STATISTICS
    text = text or ""
    n, w = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    lengths = np.fromiter(map(len, words), np.float64, w)
    seen = Counter(words)
    top = max(seen.values())
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    line_lengths = np.fromiter(map(len, lines), np.float64, len(lines))
    inner = np.sum(lengths > 2)
    capital = sum(map(bytes.isupper, words))
    marked = sum(map(ends_odd, words))
    sentences = len(SENTENCE.findall(raw))
    return [
        np.log1p(n), np.log1p(w), lengths.mean(), lengths.std(), lengths.max(), inner / w,
        upper / n, lower / n, digits / n, counts[128:].sum() / n, counts[32] / n, counts[10] / n,
        upper / (upper + lower + 1), capital / w, marked / w,
        counts[44] / w, counts[46] / w, counts[33] / w, counts[63] / w, counts[124] / w, counts[45] / w, counts[58] / w,
        *(counts[m] / n for m in (35, 36, 37, 38, 42)), counts[list(MARKS)].sum() / n,
        len(seen) / w, top / w, sum(c for c in seen.values() if c > 1) / w, pairs / w, sum(map(eq, words, words[1:])) / w,
        np.log1p(len(lines)), line_lengths.mean(), line_lengths.std(), 1 - len(set(lines)) / len(lines),
        np.sum(line_lengths < 30) / len(lines), sum(x.rstrip().endswith(CLOSING) for x in lines) / len(lines),
        sum("|" in x for x in lines) / len(lines), sentences / w, np.count_nonzero(counts) / np.sqrt(n),
    ]


def ends_odd(word: bytes) -> bool:
    """The word ends in two marks or more."""
    return len(word) > 1 and not word[-1:].isalnum() and word[-1] < 128 and not word[-2:-1].isalnum() and word[-2] < 128


N_STATISTICS = 42


@dataclass
class Trees:
    """Trees as arrays: node i of a tree has children 2i+1 and 2i+2; a leaf passes on to its first child."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while node[0:1].size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, bins: int = BINS) -> Trees:
    """Newton boosting of the logistic loss; splits are sought between histogram bins."""
    inner, n_features = 2**levels - 1, x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Trees(
        np.log(share / (1 - share)), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    )
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
    cell = binned + np.arange(n_features) * bins
    last = np.array([len(e) for e in edges])
    allowed = np.arange(bins)[None, :] < last[:, None]
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(levels):
            first, width = 2**level - 1, 2**level
            at = (node - first)[:, None] * (n_features * bins) + cell
            shape = (width, n_features, bins)
            size = width * n_features * bins
            gs = np.bincount(at.ravel(), np.repeat(g, n_features), size).reshape(shape).cumsum(axis=2)
            hs = np.bincount(at.ravel(), np.repeat(h, n_features), size).reshape(shape).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga**2 / (ha + L2)
            gain = np.where((hs >= LEAST_WEIGHT) & (ha - hs >= LEAST_WEIGHT) & allowed, gain, 0).reshape(width, -1)
            best = gain.argmax(axis=1)
            for i in np.flatnonzero(gain[np.arange(width), best] > 1e-6):
                f, b = divmod(int(best[i]), bins)
                model.feature[t, first + i], model.threshold[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        model.value[t] = -RATE * gl / (hl + L2)
        margin += model.value[t][leaf]
    return model


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([rows, batch.column("quality")], ["x", "quality"])


def scored(batches: Iterator[pa.RecordBatch], model: Trees, text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column(text).to_pylist()]).reshape(-1, N_STATISTICS)
        yield batch.append_column(name, pa.array(model.score(x), pa.float64()))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled documents that are not held out.

    Rows without doc_id, quality or a document are of no use. Without rows of
    both labels the score is the share of label 1 (or one half).
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.select("doc_id", F.col("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")
    table = rows.mapInArrow(measured, "x array<double>, quality double").orderBy("quality", "x").toArrow()
    x = np.array(table["x"].to_pylist(), dtype=np.float64).reshape(-1, N_STATISTICS)
    return fit(x, table["quality"].to_numpy())


def score(docs: DataFrame, model: Trees, name: str = "_score") -> DataFrame:
    """``docs`` with the score of each row's text as column ``name``. Null text is scored as empty."""
    ship(docs.sparkSession)
    schema = with_fields(docs.schema, f"`{name}` double")
    return docs.mapInArrow(partial(scored, model=model, text="text", name=name), schema)


def good_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject; all columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name).where(F.col(name) >= 0.5).drop(name)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, configure(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs, model)
    return rows.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
