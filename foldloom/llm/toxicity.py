"""Toxicity by a classifier chain of linear models.

The categories (0/1 columns of the labels, nulls unlabelled) are predicted one after another; each model gets, besides
the words, the probabilities of the categories before it. While training, those are out-of-fold predictions, so a
later model learns from the errors that earlier ones make on texts they haven't seen. The ``features`` are the words
and word beginnings whose presence, or presence in at least one word of a hundred, tells most about a category, by a chi-square count over the sample, made in Spark. Each fold has features of its own, chosen without its labels, so
that an out-of-fold prediction knows nothing of the fold it is for.

The sample is bounded: the ``documents`` labelled documents least by a hash of the id; ``features`` bits of each and
the labels are all that reaches the driver. Every document is scored over its whole text.

Defined results: null or empty text has no words and gets the models' base rates; a label row without a document, or
with null, is left out; without labels of both values a category's probability is its base rate (0 if unlabelled);
rows that share an id are scored each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from foldloom.llm.common import hashed_sample, keyed, row_chunks, staged, text_buffer, word_hashes

#: The chain's order: what is told first helps with what follows.
CATEGORIES = ("quality", "toxic")


#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (5, 6, 7, 8)
#: A feature is there often if it is at least one word in so many.
OFTEN = 100


@dataclass(frozen=True)
class Training:
    documents: int = 8000
    features: int = 512
    folds: int = 5
    steps: int = 400
    penalty: float = 1e-3


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, digits and non-ASCII bytes, in lower case) and of their beginnings, the
    row of each, and the number of words of each row."""
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    solid = ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57)) | (lower >= 128)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (~np.r_[False, solid[:-1]] | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (~np.r_[solid[1:], False] | edge[1:])) + 1 if len(raw) else starts
    bounds = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes, rows = [word_hashes(lower, starts, ends)], [row]
    for size in BEGINNINGS:
        long = ends - starts > size
        hashes.append(word_hashes(lower, starts[long], starts[long] + size) ^ np.uint64(size))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows), np.diff(bounds)


def counted(hashes: np.ndarray, rows: np.ndarray, n_words: np.ndarray, features: np.ndarray) -> np.ndarray:
    """(row, 2 x feature) 0/1: whether a row has the feature, and whether often; ``features`` ascending."""
    size = len(features)
    out = np.zeros((len(n_words), 2 * size), np.float32)
    if size and len(hashes):
        at = np.minimum(np.searchsorted(features, hashes), size - 1)
        hit = features[at] == hashes
        n = np.bincount(rows[hit] * size + at[hit], minlength=len(n_words) * size).reshape(-1, size)
        out[:, :size], out[:, size:] = n > 0, (n > 0) & (n * OFTEN >= n_words[:, None])
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, training: Training) -> np.ndarray:
    """Logistic regression with a constant, by accelerated gradient steps; a category of one value gives its rate."""
    w = np.zeros(x.shape[1] + 1)
    rate = float(np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6))
    w[-1] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return w
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    # The largest curvature, by a few power steps.
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(v @ (x.T @ (x @ v))) / len(y) + training.penalty)
    keep = np.full(len(w), training.penalty)
    keep[-1] = 0
    ahead = w.copy()
    for k in range(training.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (p - y) / len(y) + keep * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def apply_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    categories: tuple[str, ...]
    features: np.ndarray
    models: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(row, category) probabilities, each fed to the models after it."""
        out = np.zeros((len(x), len(self.models)))
        for k, w in enumerate(self.models):
            out[:, k] = apply_linear(w, np.concatenate([x, out[:, :k]], axis=1))
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, used: list[np.ndarray], features: np.ndarray, categories: tuple[str, ...], training: Training) -> Chain:
    """``x``: bits of the features of the chain and of all folds; ``y``: (row, category), NaN where unlabelled;
    ``used``: the columns of ``x`` that each fold's models see, and last those of the chain's."""
    models, before = [], np.zeros((len(x), 0))
    for k in range(len(categories)):
        known = ~np.isnan(y[:, k])
        seen = lambda columns: np.concatenate([x[:, columns], before], axis=1)  # noqa: B023, E731
        models.append(fit_linear(seen(used[-1])[known], y[known, k], training))
        out_of_fold = np.zeros(len(x))
        for f in range(training.folds):
            now, rest = seen(used[f]), known & (fold != f)
            out_of_fold[fold == f] = apply_linear(fit_linear(now[rest], y[rest, k], training), now[fold == f])
        before = np.concatenate([before, out_of_fold[:, None]], axis=1)
    return Chain(categories, features, models)


def telling(counts: DataFrame, totals: Row, names: list[str], without: int | None, folds: int, size: int) -> np.ndarray:
    """The hashes, ascending, of the ``size`` features that tell most, by counts that leave one fold out."""
    kept = [f for f in range(folds) if f != without]
    score, seen = F.lit(0.0), F.lit(0)
    for n in names:
        shown, hits = (reduce(add, (F.col(f"{k}_{n}_{f}") for f in kept), F.lit(0)) for k in ("n", "s"))
        rate = sum(totals[f"s_{n}_{f}"] for f in kept) / max(sum(totals[f"n_{n}_{f}"] for f in kept), 1)
        spread = max(rate * (1 - rate), 1e-9)
        score, seen = F.greatest(score, F.pow(hits - shown * rate, 2) / (F.greatest(shown, F.lit(1)) * spread)), shown
    # A word of few texts tells by chance.
    top = counts.filter(seen >= 8).groupBy("word").agg(F.max(score).alias("score")).orderBy(F.desc("score"), "word").limit(size).collect()
    return np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, folder: str, categories: tuple[str, ...] = CATEGORIES, training: Training = Training()) -> Chain:
    marks = [F.col(c).cast("double").alias(f"label_{k}") for k, c in enumerate(categories)]
    chosen = hashed_sample(labels.filter("doc_id IS NOT NULL").select("doc_id", *marks), training.documents, 11)
    sample = keyed(docs).join(chosen, "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets):
                hashes, rows, n_words = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(hashes) else np.zeros(0, np.int64)
                count = np.diff(np.r_[first, len(hashes)])
                often = first[count * OFTEN >= n_words[rows[first]]]
                lists = [pa.ListArray.from_arrays(np.searchsorted(rows[at], np.arange(j - i + 1)).astype(np.int32), hashes[at].view(np.int64)) for at in (first, often)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(c.slice(i, j - i) for c in batch.columns[2:]), *lists], ["doc_id", *names, "words", "often"])

    names = [f"label_{k}" for k in range(len(categories))]
    rows = staged(sample.select("doc_id", "text", *names).mapInArrow(words, "doc_id long, " + "".join(f"{n} double, " for n in names) + "words array<long>, often array<long>"), f"{folder}/words")
    folds = training.folds
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(folds)).cast("int"))
    cells = [agg(F.when(F.col("fold") == f, F.col(n))).alias(f"{k}_{n}_{f}") for n in names for f in range(folds) for k, agg in (("n", F.count), ("s", lambda c: F.coalesce(F.sum(c), F.lit(0.0))))]
    totals = rows.agg(*cells).first()
    shown = rows.select(F.explode("words").alias("word"), F.lit(0).alias("kind"), "fold", *names).unionByName(rows.select(F.explode("often").alias("word"), F.lit(1).alias("kind"), "fold", *names))
    counts = staged(shown.groupBy("word", "kind").agg(*cells), f"{folder}/counts")
    sets = [telling(counts, totals, names, f, folds, training.features) for f in (*range(folds), None)]
    every = np.unique(np.concatenate(sets))
    chosen_words = F.array(*(F.lit(int(x)) for x in every.view(np.int64).tolist())).cast("array<long>")
    bits = rows.select("doc_id", "fold", *names, F.array_intersect("words", chosen_words).alias("words"), F.array_intersect("often", chosen_words).alias("often")).orderBy("doc_id").toArrow()
    y = np.stack([bits.column(n).to_numpy().astype(float) for n in names], axis=1)
    x = np.zeros((len(y), 2 * len(every)), np.float32)
    for k, name in enumerate(("words", "often")):
        lists = bits.column(name).combine_chunks()
        found = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        x[np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)), np.searchsorted(every, found) + k * len(every)] = 1
    used = [np.r_[at, at + len(every)] for at in (np.searchsorted(every, s) for s in sets)]
    return fit_chain(x, y, bits.column("fold").to_numpy(), used, sets[-1], categories, training)


def predict(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<category> of every row."""
    shared = df.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets):
                x = counted(*tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shared.value.features)
                p = shared.value.predict(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", *names])

    return keyed(df, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
