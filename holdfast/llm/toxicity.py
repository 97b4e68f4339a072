"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over counts of words and of word beginnings is trained in numpy from confirmed toxic texts and unlabelled ones.
With the class prior p the risk is p * R(toxic as toxic) + max(0, R(unlabelled as clean) - p * R(toxic as
clean)): clean examples are never needed, and the part that stands for them can't become negative; where it
would, the step goes against it. The prior is the share of toxic rows among all labelled rows that may
be learned from.

Bounds of the fit: POSITIVES and UNLABELLED distinct texts, chosen by a hash of id and text; the VOCABULARY most frequent
of these features that at least MIN_TEXTS of them hold; STEPS steps. Scoring reads whole texts.

A document is labelled toxic if any of its label rows is; NULL labels and ids say nothing. NULL and empty
texts have no words and get the score of the bias. Without a toxic label all scores are next to 0 (about 1e-13). Repeated rows
get repeated answers, an empty table an empty result; only id and text of documents and id and toxic of labels
are read, so other columns have no influence.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.tables import hashed_sample, held_out, map_batches, release_memory, text_slices

POSITIVES, UNLABELLED = 2000, 6000
VOCABULARY, MIN_TEXTS = 30000, 20
PREFIXES = range(3, 9)
STEPS, RATE, RIDGE, LASSO = 200, 0.06, 5e-4, 0.05
PART = 500  # texts that a step of the training computes at once
MOST_COUNTED = 4  # further repeats of a word in a text add nothing
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]{}*#%&$|<>-_"


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float

    def shared_scorer(self):
        """One scorer per copy of the model, so that its memory lasts over batches."""
        if not hasattr(self, "_scorer"):
            self._scorer = self.scorer()
        return self._scorer

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def scorer(self, remembered: int = 100_000):
        """Function from a text to its score; which features of a word matter is remembered for so many words."""
        known: dict[str, list[str]] = {}

        def score(text: str | None) -> float:
            counts: dict[str, int] = {}
            for word, n in Counter((text or "").lower().split()).items():
                if (own := known.get(word)) is None:
                    if len(known) >= remembered:
                        known.clear()
                    own = known[word] = [f for f in features(word) if f in self.weights]
                for feature in own:
                    counts[feature] = counts.get(feature, 0) + n
            total = self.bias + sum(self.weights[f] * min(n, MOST_COUNTED) for f, n in sorted(counts.items()))
            return float(1 / (1 + np.exp(-min(max(total, -30.0), 30.0))))

        return score


def features(word: str) -> list[str]:
    """The word without punctuation at its ends, and its beginnings (marked by a hyphen) of PREFIXES letters."""
    word = word.strip(EDGES)
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)] if word else []


def feature_counts(text: str | None) -> Counter:
    found = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        for feature in features(word):
            found[feature] += n
    return found


def _words(batch: pa.RecordBatch):
    for part in text_slices(batch):
        words = [w for text in part.column("text").to_pylist() for w in feature_counts(text)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["feature"])


def _counted(places: dict[str, int]):
    def run(batch: pa.RecordBatch):
        for part in text_slices(batch):
            rows = []
            for text in part.column("text").to_pylist():
                counts = feature_counts(text)
                known = sorted((places[w], min(counts[w], MOST_COUNTED)) for w in counts.keys() & places.keys())
                rows.append(np.array(known, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("positive"), pa.array(rows, pa.binary())], ["doc_id", "positive", "counts"]
            )

    return run


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """Texts (doc_id, positive, text) to learn from, and the class prior.

    Unlabelled texts are those of labelled ids with the label left off, so that the prior holds for them.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    total, toxic = usable.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    order = (F.xxhash64("doc_id", F.lit(1)), "doc_id")
    parts = []
    for ids, most, positive in ((usable.filter("toxic = 1"), positives, True), (usable, unlabelled, False)):
        few = F.broadcast(ids.orderBy(*order).limit(most).select("doc_id"))  # bounded ids; their rows are bounded next
        parts.append(hashed_sample(docs.select("doc_id", "text").join(few, "doc_id"), most).withColumn("positive", F.lit(positive)))
    return parts[0].unionByName(parts[1]).select("doc_id", "positive", "text"), toxic / max(1, total)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicModel:
    texts, prior = sample(docs, labels, positives, unlabelled)
    if not prior:
        return ToxicModel({}, -30.0)
    words = map_batches(texts, _words, "feature string").groupBy("feature").count().filter(F.col("count") >= MIN_TEXTS)
    kept = words.orderBy(F.desc("count"), "feature").limit(VOCABULARY).toPandas()
    vocabulary = kept["feature"].tolist()
    rows = map_batches(
        texts, _counted({w: i for i, w in enumerate(vocabulary)}), "doc_id bigint, positive boolean, counts binary"
    ).toArrow().sort_by([("doc_id", "ascending"), ("positive", "ascending"), ("counts", "ascending")])
    positive = rows.column("positive").to_numpy()
    if not positive.any():
        return ToxicModel({}, -30.0)
    pairs = [np.frombuffer(c.as_buffer(), np.int32).reshape(-1, 2) for c in rows.column("counts")]
    weights, bias = train(pairs, positive.astype(bool), len(vocabulary), prior)
    del rows, pairs
    release_memory()
    return ToxicModel({w: float(v) for w, v in zip(vocabulary, weights) if v}, float(bias))


def _parts(pairs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of PART texts each, in few bytes: what a step computes from them is never held for all at once."""
    parts = []
    for start in range(0, len(pairs), PART):
        own = pairs[start : start + PART]
        both = np.concatenate(own)
        row = np.repeat(np.arange(start, start + len(own), dtype=np.int32), [len(p) for p in own])
        parts.append((row, both[:, 0].copy(), both[:, 1].astype(np.int8)))
    return parts


def train(pairs: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss; weights (shrunk towards 0) and bias."""
    n, parts = len(pairs), _parts(pairs)
    w, bias = np.zeros(size), float(np.log(prior / (1 - min(prior, 0.999))))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    n_pos, n_un = max(1, positive.sum()), max(1, (~positive).sum())
    for step in range(1, steps + 1):
        margin = np.full(n, bias)
        for row, column, value in parts:
            margin += np.bincount(row, value * w[column], n)
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        as_clean = np.logaddexp(0, margin)
        rest = as_clean[~positive].sum() / n_un - prior * as_clean[positive].sum() / n_pos
        negative_part = np.where(positive, -prior * p / n_pos, p / n_un)
        slope = np.where(positive, prior * (p - 1) / n_pos, 0) + negative_part if rest >= 0 else -negative_part
        gradient = np.append(RIDGE * w, slope.sum())
        for row, column, value in parts:
            gradient[:-1] += np.bincount(column, value * slope[row], size)
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient * gradient - second)
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * LASSO, 0)
    return w, bias


def score(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batch: pa.RecordBatch):
        of = model.shared_scorer()
        for part in text_slices(batch):
            scores = np.array([of(text) for text in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_batches(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")
