"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by its surface features; gated attention
(tanh of one projection times the sigmoid of another) weighs the encodings, and a logistic layer scores their weighted
mean. Only document labels are used in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import trimmed
from .tokens import SPACE, text_chunks, word_hashes, words
from .toxicity import labelled_sample

#: Labelled rows that a fit uses at most, by the order of a hash of doc_id.
FIT_ROWS = 8_000
#: Passages that a labelled text may have to be learned from; longer ones are scored but teach nothing.
FIT_PASSAGES = 2_000
PASSAGE = 64
#: Byte classes whose share of a passage is a feature: lower, upper, digit, wide, full stop and comma, shouts, symbols, bars, other.
CLASSES = np.full(256, 8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:], CLASSES[[44, 46]], CLASSES[[33, 63]] = 0, 1, 2, 3, 4, 5
CLASSES[[35, 36, 37, 38, 42, 60, 62]], CLASSES[124] = 6, 7
N_CLASSES, HASHED = 9, 16
N_FEATURES = N_CLASSES + 7 + HASHED
HIDDEN = 16


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a chunk, and each document's bounds among them; an empty text has one passage."""
    starts, ends, bounds = words(data, offsets)
    n_words = np.diff(bounds)
    n = np.maximum(1, -(-n_words // PASSAGE))
    cuts = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(cuts[-1]) - np.repeat(cuts[:-1], n)
    first = np.repeat(bounds[:-1], n) + k * PASSAGE
    last = np.minimum(first + PASSAGE, np.repeat(bounds[1:], n))
    x = np.zeros((cuts[-1], N_FEATURES))
    size = last - first
    full = size > 0
    if not full.any():
        return x, cuts
    a, b = starts[first[full]], ends[last[full] - 1]
    chars = (b - a).astype(float)
    solid = ~SPACE[data]
    kind = np.where(solid, CLASSES[data], -1)

    def within(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[hi] - total[lo]

    for c in range(N_CLASSES):
        x[full, c] = within(kind == c, a, b) / chars
    hashes = word_hashes(data, starts, ends)
    lengths = (ends - starts).astype(float)
    lo, hi, count = first[full], last[full], size[full].astype(float)
    mean = within(lengths, lo, hi) / count
    x[full, 9] = mean / 10
    x[full, 10] = np.sqrt(np.maximum(within(lengths**2, lo, hi) / count - mean**2, 0)) / 10
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
    x[full, 11] = within(stop, lo, hi) / count
    x[full, 12] = within(data == 10, a, b) / count
    owner = np.repeat(np.arange(cuts[-1]), size)
    _, at = np.unique(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
    x[full, 13] = 1 - np.bincount(owner[at], minlength=cuts[-1])[full] / count
    document = np.repeat(np.arange(len(n_words)), n_words)
    _, at = np.unique(hashes + document.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)
    fresh = np.zeros(len(starts))
    fresh[at] = 1
    x[full, 14] = 1 - within(fresh, lo, hi) / count
    x[:, 15] = np.log1p(np.repeat(n_words, n)) / 10
    bucket = (hashes >> np.uint64(60)).astype(np.int64)
    x[:, N_CLASSES + 7 :] = np.bincount(owner * HASHED + bucket, minlength=cuts[-1] * HASHED).reshape(-1, HASHED)
    x[full, N_CLASSES + 7 :] /= count[:, None]
    return x, cuts


class AttentionModel:
    """encode -> gated attention -> weighted mean -> logistic; trained by Adam on whole bags."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        s = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"E": s(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": s(HIDDEN, HIDDEN), "U": s(HIDDEN, HIDDEN), "w": s(HIDDEN), "c": s(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
        p, z = self.p, (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = np.clip((t * g) @ p["w"], -20, 20)
        bag = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        top = np.exp(raw - np.maximum.reduceat(raw, cuts[:-1])[bag])
        a = top / np.add.reduceat(top, cuts[:-1])[bag]
        pooled = np.add.reduceat(a[:, None] * h, cuts[:-1])
        score = 1 / (1 + np.exp(-np.clip(pooled @ p["c"] + p["d"][0], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "bag": bag, "a": a, "pooled": pooled, "score": score}

    def gradient(self, f: dict, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        out = (f["score"] - y) / n
        pooled = out[:, None] * p["c"]
        from_bag = pooled[f["bag"]]
        h = f["a"][:, None] * from_bag
        inner = (from_bag * f["h"]).sum(1)
        mean = np.bincount(f["bag"], f["a"] * inner, n)
        raw = f["a"] * (inner - mean[f["bag"]])
        t, g = raw[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), raw[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        h += t @ p["V"].T + g @ p["U"].T
        e = h * (1 - f["h"] ** 2)
        return {"E": f["z"].T @ e, "e": e.sum(0), "V": f["h"].T @ t, "U": f["h"].T @ g, "w": (f["t"] * f["g"]).T @ raw, "c": f["pooled"].T @ out, "d": np.array([out.sum()])}

    def fit(self, x: np.ndarray, cuts: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> AttentionModel:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        rng, m, v, step = np.random.default_rng(11), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                bags = np.sort(order[at : at + batch])
                rows = np.concatenate([np.arange(cuts[b], cuts[b + 1]) for b in bags])
                own = np.concatenate([[0], np.cumsum(np.diff(cuts)[bags])])
                step += 1
                for k, g in self.gradient(self.forward(x[rows], own), y[bags]).items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit_classifier(sample: DataFrame) -> AttentionModel | float:
    """Train on ``sample`` (text, y). With one label only there is nothing to learn: its share is returned."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in text_chunks(batch.column(0)):
                x, cuts = passages(data, offsets)
                out += [x[a:b].astype(np.float32).tobytes() if b - a <= FIT_PASSAGES else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            bags = pa.array(out, pa.binary())
            yield pa.record_batch([batch.column(1).cast(pa.int64()), batch.column(2), bags], ["doc_id", "y", "bag"]).filter(bags.is_valid())

    rows = sample.select("text", "doc_id", "y").mapInArrow(trimmed(encode), "doc_id long, y int, bag binary").collect()  # FIT_ROWS at most
    rows.sort(key=lambda r: (r.doc_id, bytes(r.bag)))
    y = np.array([r.y for r in rows], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(bytes(r.bag), np.float32).reshape(-1, N_FEATURES) for r in rows]
    return AttentionModel().fit(np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, score, predicted, n_passages, attention) for every row of ``docs``; attention is the largest weight.

    ``labels``: (doc_id, quality). Null texts are empty: one passage of zeros. Repeated rows are scored one by one, rows
    without a doc_id too. Other columns are ignored; an empty table gives an empty result. Without labels of both kinds
    every score is their share, 0.5 without any.
    """
    model = fit_classifier(labelled_sample(docs, labels, "quality", F.lit(True) if train is None else train, FIT_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                x, cuts = passages(data, offsets)
                if isinstance(model, float):
                    score, most = np.full(end - row, model), 1 / np.diff(cuts)
                else:
                    f = model.forward(x, cuts)
                    score, most = f["score"], np.maximum.reduceat(f["a"], cuts[:-1])
                yield pa.record_batch([batch.column(0)[row:end], pa.array(score), pa.array(np.diff(cuts)), pa.array(most)], ["doc_id", "score", "n_passages", "attention"])

    scored = docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, score double, n_passages long, attention double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "score", "predicted", "n_passages", "attention")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from .shared import crc_text, table

    held_out = crc_text("doc_id") % 3 == 1
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages", "attention")
