"""Language ID: a byte convolutional network, trained in numpy and applied to fixed-length windows.

Filters of several widths run over learnt byte vectors, the strongest answer of each filter in a window
is kept (max pooling), and a softmax names the language. A text is cut into windows of WINDOW bytes, the
last one filled up; its languages' probabilities are averaged over all its windows by their bytes.

Training reads a bounded sample: at most SAMPLE_DOCS distinct rows chosen by a hash of id, text and language, at most
WINDOWS_PER_DOC windows of each, the same number of steps at every size. Prediction reads every byte.

NULL texts and texts without a letter get `und` and score 0; so does every text if no labelled row is
there to learn from. A NULL id is kept. Ties go to the language first in order. Repeated rows get
repeated answers, an empty table gives an empty result. Only the id and text columns are read, so other
columns, whatever their names, have no influence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.tables import hashed_sample, held_out, map_batches, release_memory, text_slices

WINDOW = 240  # a multiple of every width
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDED = 8
SAMPLE_DOCS = 6000
WINDOWS_PER_DOC = 3
STEPS, BATCH, RATE, SEED = 700, 64, 0.01, 42
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# Bytes as the network sees them: A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class ByteCnn:
    """Weights: byte vectors, a (width * EMBEDDED, FILTERS) matrix and bias per width, the softmax layer."""

    languages: list[str]
    vectors: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: (n, WINDOW) bytes; (n, languages)."""
        n = len(windows)
        flat = np.zeros((n * WINDOW + max(WIDTHS), EMBEDDED), np.float32)
        np.take(self.vectors, windows.reshape(-1), axis=0, out=flat[: n * WINDOW])
        pooled = []
        for width in WIDTHS:
            best = None
            for phase in range(width):  # positions phase, phase + width, ... lie in consecutive memory
                rows = flat[phase : phase + n * WINDOW].reshape(-1, width * EMBEDDED)
                answers = (self.filters[width].T @ rows.T).reshape(FILTERS, n, WINDOW // width)
                top = (answers[:, :, :-1] if phase else answers).max(axis=2)  # the last one would leave the window
                best = top if best is None else np.maximum(best, top)
            pooled.append(best + self.biases[width][:, None])
        hidden = np.maximum(np.concatenate(pooled), 0).T
        return softmax(hidden @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    windows = np.zeros(n * WINDOW, np.uint8)
    windows[: len(data)] = FOLD[np.frombuffer(data, np.uint8)]
    return windows.reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> ByteCnn:
    """Adam on cross entropy; every batch draws each language equally often."""
    rng = np.random.default_rng(SEED)
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    hidden = len(WIDTHS) * FILTERS
    model = ByteCnn(
        languages, rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32), {w: scale(w * EMBEDDED, FILTERS) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, scale(hidden, len(languages)), np.zeros(len(languages), np.float32),
    )
    parts = [model.vectors, *model.filters.values(), *model.biases.values(), model.out, model.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    members = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(m, BATCH // len(members) + 1) for m in members])
        gradients = _gradients(model, windows[chosen], labels[chosen])
        rate = RATE * (1 - 0.9 * step / steps)
        for part, gradient, (first, second) in zip(parts, gradients, moments):
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient * gradient - second)
            part -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def _gradients(model: ByteCnn, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n, rows = len(windows), np.arange(len(windows))[:, None]
    embedded = model.vectors[windows]
    pooled, places = [], []
    for width in WIDTHS:
        spread = np.concatenate([embedded[:, j : WINDOW - width + 1 + j] for j in range(width)], axis=2)
        answers = spread @ model.filters[width]
        at = answers.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(answers, at[:, None], 1)[:, 0] + model.biases[width])
    raw = np.concatenate(pooled, axis=1)
    hidden = np.maximum(raw, 0)
    error = softmax(hidden @ model.out + model.out_bias)
    error[np.arange(n), labels] -= 1
    error /= n
    back = (error @ model.out.T) * (raw > 0)
    vectors = np.zeros_like(model.vectors)
    filters, biases = [], []
    for k, width in enumerate(WIDTHS):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        seen = windows[rows[:, :, None], places[k][:, :, None] + np.arange(width)]  # (n, FILTERS, width) bytes at the maxima
        filters.append(np.einsum("nf,nfd->df", part, model.vectors[seen].reshape(n, FILTERS, -1)))
        biases.append(part.sum(axis=0))
        weights = model.filters[width].T.reshape(FILTERS, width, EMBEDDED)
        np.add.at(vectors, seen, part[:, :, None, None] * weights[None])
    return [vectors, *filters, *biases, hidden.T @ error, error.sum(axis=0)]


def _sample(batch: pa.RecordBatch):
    """Windows spread evenly over each text."""
    found, languages = [], []
    for text, language in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
        windows = cut(text.encode())
        for k in np.unique(np.linspace(0, len(windows) - 1, WINDOWS_PER_DOC).astype(int)):
            found.append(windows[k].tobytes())
            languages.append(language)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(languages, pa.string())], ["bytes", "lang"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> ByteCnn | None:
    """Learns from text and lang of the rows that are not held out; None without such a row."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    chosen = hashed_sample(usable, sample_docs)
    rows = map_batches(chosen.select("text", "lang"), _sample, "bytes binary, lang string").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "bytes"])
    languages = sorted(rows["lang"].unique())
    windows = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, WINDOW)
    labels = np.searchsorted(languages, rows["lang"].to_numpy())
    del rows
    model = train(windows, labels, languages, steps)
    release_memory()
    return model


def predict_texts(model: ByteCnn | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    usable = [i for i, text in enumerate(texts) if text and LETTER.search(text)] if model else []
    if not usable:
        return named, scores
    windows, counts, sizes = [], [], []
    for i in usable:
        data = texts[i].encode()
        windows.append(cut(data))
        counts.append(len(windows[-1]))
        sizes.append(len(data))
    windows = np.concatenate(windows)
    found = np.concatenate([model.probabilities(windows[k : k + 512]) for k in range(0, len(windows), 512)])
    ends = np.cumsum(counts)
    weight = np.ones(len(windows))
    weight[ends - 1] = (np.array(sizes) - (np.array(counts) - 1) * WINDOW) / WINDOW
    sums = np.add.reduceat(found * weight[:, None], ends - counts, axis=0)
    mean = sums / np.add.reduceat(weight, ends - counts)[:, None]
    for i, row in zip(usable, mean):
        k = int(row.argmax())
        named[i], scores[i] = model.languages[k], min(1.0, float(row[k]))
    return named, scores


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batch: pa.RecordBatch):
        for part in text_slices(batch, 1 << 20):
            named, scores = predict_texts(model, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(named, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_batches(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")
