"""Toxicity: a convolutional text classifier trained in numpy.

Words are embedded by hashing: a word's vector is the sum of those of the word and of its first 4, 5 and 6 bytes, so
that inflected forms share what they have in common. Filters of several widths run over the words of the whole text, the
largest response of each filter is kept, and a logistic layer weighs these. Embeddings start from shrunk log-odds counted
on one half of the training rows; then all layers are trained by gradient descent (Adam) on the other half, so that a
word seen once does not pass for evidence. A threshold for each language, which is told from function words of the text
itself, is calibrated on training rows, and scores are shifted so that 0.5 is that threshold.

Training rows are at most max_rows of each class, those whose id has the smallest hash; scoring covers all rows. In the
loss and in the errors of the calibration each class weighs as much as it has labelled rows, fitted on or not. The id,
the source and the language column are never inputs of a score.

Null and blank texts get a score too, from empty pools. Rows without a label are not trained on. Without rows of both
classes every score is 0. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tables import map_arrow
from .words import SPACE, VALUE, _powers, mix, runs

#: Function words that tell a language.
FUNCTION_WORDS = {
    "en": "the of and to is that was for with this from are",
    "de": "der die und das ist von den mit ein eine nicht für",
    "fr": "le les des et est dans pour pas du sur",
    "es": "el los las es por con del para",
}
PREFIXES = (4, 5, 6)
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Empty words after each text, so that no filter spans two texts.
PAD = max(WIDTHS)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (words x features), the plain word hashes, and where each text's words begin."""
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    size = 1 << 16
    while size <= len(data):
        size *= 2
    up, down = _powers(size)
    wordy = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], wordy, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUE[data] * up[: len(data)], dtype=np.uint64)))
    own = mix((total[ends] - total[starts]) * down[starts])
    columns = [own]
    for n in PREFIXES:
        to = np.minimum(starts + n, ends)
        columns.append(mix((total[to] - total[starts]) * down[starts] + np.uint64(n)))
    at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return np.stack([(c >> np.uint64(32)).astype(np.int64) & (BUCKETS - 1) for c in columns], 1), own, at


@lru_cache(maxsize=1)
def _stop_hashes() -> tuple[np.ndarray, np.ndarray]:
    known = [features([words.encode()])[1] for words in FUNCTION_WORDS.values()]
    hashes, kinds = np.concatenate(known), np.repeat(np.arange(len(known)), [len(k) for k in known])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], kinds[order]


def languages(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of each text's language: the one with the most function words; one past the last if there are none."""
    known, kinds = _stop_hashes()
    spot = np.minimum(np.searchsorted(known, own), len(known) - 1)
    hits = np.flatnonzero(known[spot] == own)
    text = np.searchsorted(at, hits, "right") - 1
    counts = np.zeros((len(FUNCTION_WORDS), len(at) - 1), np.int64)
    np.add.at(counts, (kinds[spot[hits]], text), 1)
    return np.where(counts.max(0) > 0, counts.argmax(0), len(counts))


@dataclass
class Model:
    """Weights of the layers, and a threshold (a logit) for each language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    intercept: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))

    def padded(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors with PAD empty ones after each text; where texts begin there; the place of each word."""
        counts = np.diff(at)
        begins = at[:-1] + PAD * np.arange(len(counts))
        place = np.arange(at[-1]) + PAD * np.repeat(np.arange(len(counts)), counts)
        x = np.zeros((at[-1] + PAD * len(counts), DIM), np.float32)
        x[place] = sum(self.embedding[rows[:, c]] for c in range(rows.shape[1]))
        return x, begins, place

    def pools(self, x: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """Responses of the filters of each width at all places."""
        all_ = x @ np.concatenate([f[j] for w, f in zip(WIDTHS, self.filters) for j in range(w)], 1)
        out, column = [], 0
        for w, b in zip(WIDTHS, self.bias):
            r = np.zeros((len(x), FILTERS), np.float32)
            for j in range(w):
                r[: len(x) - j] += all_[j:, column : column + FILTERS]
                column += FILTERS
            out.append(r + b)
        return out

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, begins, _ = self.padded(rows, at)
        best = [np.maximum(np.maximum.reduceat(r, begins, axis=0), 0) for r in self.pools(x, begins)]
        return np.concatenate(best, 1) @ self.weights + self.intercept

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores from 0 to 1 of whole texts."""
        return np.concatenate([np.zeros(0), *(self._scores(texts[a:b]) for a, b in runs(texts))])

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        rows, own, at = features(texts)
        z = self.logits(rows, at).astype(float) - self.thresholds[languages(own, at)]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _initial(texts: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> Model:
    seen = np.zeros((2, BUCKETS))
    for t, y in zip(texts, labels):
        seen[y, np.unique(features([t])[0])] += 1
    share = labels.mean()
    odds = np.log((seen[1] + 10 * share) / (seen[0] * share / (1 - share) + 10 * share))
    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -1, 4) / 2
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 0.5
    bias = [np.full(FILTERS, -1.0, np.float32) for _ in WIDTHS]
    return Model(embedding, filters, bias, np.full(FILTERS * len(WIDTHS), 0.1, np.float32), np.zeros(1, np.float32))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Model:
    """Fits a model to labelled texts (label 1: toxic), each with the weight of its class."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    half = len(texts) // 2
    model = _initial([texts[i] for i in order[:half]], labels[order[:half]], rng)
    fit = order[half:]
    parts = [model.weights, model.intercept, *model.filters, *model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    made = {i: features([texts[i]])[0].astype(np.int32) for i in fit}
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for a in range(0, len(fit), batch):
            mine = fit[a : a + batch]
            rows = np.concatenate([made[i] for i in mine])
            at = np.cumsum([0, *(len(made[i]) for i in mine)])
            x, begins, place = model.padded(rows, at)
            word = np.full(len(x), -1)
            word[place] = np.arange(len(place))
            responses = model.pools(x, begins)
            ends = np.append(begins[1:], len(x))
            spots = [np.stack([r[b:e].argmax(0) + b for b, e in zip(begins, ends)]) for r in responses]
            best = [np.take_along_axis(r, s, 0) for r, s in zip(responses, spots)]
            hidden = np.concatenate(best, 1)
            z = np.maximum(hidden, 0) @ model.weights + model.intercept
            error = (weights[labels[mine]] * (1 / (1 + np.exp(-z)) - labels[mine]) / len(mine)).astype(np.float32)
            back = error[:, None] * model.weights * (hidden > 0)
            grads = [np.maximum(hidden, 0).T @ error, error.sum(keepdims=True)]
            to_filters, to_bias = [], []
            to_word = np.zeros((len(rows), DIM), np.float32)
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                own = np.zeros_like(f)
                for j in range(w):
                    where = np.minimum(spots[k] + j, len(x) - 1)
                    own[j] = np.einsum("nfd,nf->df", x[where], g)
                    hit = word[where]
                    np.add.at(to_word, hit[hit >= 0], (g[:, :, None] * f[j].T[None])[hit >= 0])
                to_filters.append(own)
                to_bias.append(g.sum(0))
            step += 1
            for p, g, (m, v) in zip(parts, [*grads, *to_filters, *to_bias], moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            touched = np.flatnonzero(np.abs(to_word).sum(1))
            for c in range(rows.shape[1]):
                np.subtract.at(model.embedding, rows[touched, c], rate * 5 * to_word[touched])
    model.thresholds = _calibrated(model, [texts[i] for i in fit], labels[fit], weights)
    return model


def _calibrated(model: Model, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each language the logit that makes the fewest weighted errors, halfway between its neighbours; that of all languages where rows are few."""
    z, g = [], []
    for a in range(0, len(texts), 256):
        rows, own, at = features(texts[a : a + 256])
        z.append(model.logits(rows, at))
        g.append(languages(own, at))
    z, g = np.concatenate(z).astype(float), np.concatenate(g)

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        missed, passed = np.concatenate(([0], np.cumsum(weights[1] * y))), np.concatenate(([0], np.cumsum(weights[0] * (1 - y))))
        wrong = missed + passed[-1] - passed
        least = np.flatnonzero(wrong <= wrong.min() + 1e-6)
        low, high = least[0], least[-1]
        edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
        return float((edges[low] + edges[high + 1]) / 2)

    whole = best(z, labels)
    out = np.full(len(FUNCTION_WORDS) + 1, whole)
    for k in range(len(FUNCTION_WORDS)):
        mine = g == k
        if min(labels[mine].sum(), (1 - labels[mine]).sum()) >= 20:
            out[k] = best(z[mine], labels[mine])
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Trains on at most max_rows labelled documents of each class; None without both classes."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null").dropDuplicates(["_id"])
    counted = {r["_y"]: r["n"] for r in docs.select(F.col(id_col).alias("_id")).join(known, "_id").groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("_id")
    chosen = [known.where(F.col("_y") == y).orderBy(order, "_id").limit(max_rows) for y in (0, 1)]
    rows = F.broadcast(chosen[0].union(chosen[1]))  # 2 x max_rows rows
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(rows, "_id").select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(i, y, t or b"") for batch in batches for i, y, t in zip(*(c.to_pylist() for c in batch.columns))})
        y = np.array([g[1] for g in got], np.int64)
        if len(got) < 4 or y.min() == y.max():
            return
        weights = np.array([counted[0], counted[1]]) / np.bincount(y, minlength=2)
        model = train([g[2] for g in got], y, weights * len(y) / weights[y].sum())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The bounded sample is trained on in a task, so that the driver never holds its texts but only the weights.
    made = map_arrow(found.repartition(1), run, "model binary").first()
    return made and pickle.loads(made["model"])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "_score", predicted_col: str = "_predicted") -> DataFrame:
    """docs with a score, and a prediction (1 from a score of 0.5); columns of these names are replaced."""
    docs = docs.drop(score_col, predicted_col)
    names = [*docs.columns, score_col]
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                scores = np.zeros(len(texts)) if model is None else model.score(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=names)

    return map_arrow(docs, run, schema).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def in_fold(id_column, remainder: int):
    """Whether crc32 of the id as text leaves the remainder modulo 5; a null id is in no fold."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == remainder, F.lit(False))
