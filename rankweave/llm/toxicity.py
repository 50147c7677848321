"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding: lower case, homoglyphs to the Latin letters they look like, digit and sign substitutions to letters, all other
characters that are not letters to single spaces. Lexicon entries stand at a word's start: whole words or stems. Their
weights are smoothed log odds learned from labelled training rows; a seed list gives a first guess and exception phrases
take back the hits inside them. A document's summed weight, plain and per word, goes through a logistic curve.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import trimmed
from .tokens import _arrays

#: Labelled rows that a fit uses at most, taken by the order of a hash of doc_id.
FIT_ROWS = 12_000
#: Entries that a lexicon holds at most; the candidates with the most toxic documents are tried.
LEXICON = 4_000
#: Entries with a first weight before any is learned.
SEED = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "stupid": 2.0, "worthless": 2.0, "disgusting": 2.0, "pathetic": 2.0}
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("clown fish", "pond scum", "scum line", "stupid mistake of mine", "trash bag", "trash bin", "trash can")
#: Letters of other scripts that look like Latin ones, and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """Translation table that fills itself: letters stay, the listed ones change, anything else becomes a space."""

    def __missing__(self, code: int) -> str:
        x = chr(code)
        self[code] = HOMOGLYPHS.get(x) or SUBSTITUTIONS.get(x) or (x if x.isalpha() else " ")
        return self[code]


FOLD = _Fold()


def fold(text: str) -> str:
    """Words of folded letters, one space before each: ``You ID10T!`` -> `` you idiot``."""
    return " " + " ".join(text.lower().translate(FOLD).split())


def texts(column: pa.Array) -> list[str]:
    return [x or "" for _, part in _arrays(column) for x in part.to_pylist()]


def candidates(folded: str) -> set[str]:
    """Whole words (closed by a space) and stems of four to eight letters."""
    out = set()
    for word in set(folded.split()):
        if 3 <= len(word) <= 24:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in range(4, min(len(word), 8) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    bias: float = -3.0
    plain: float = 1.0
    dense: float = 0.0

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in EXCEPTIONS:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found

    def measure(self, matcher, folded: str) -> tuple[float, int, int]:
        """Summed weight (the strongest entry counts at each word), hits and words."""
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in matcher.iter(folded + " "):
            at = end - length + 1
            if weight is None:
                excused.append((at, end))
            elif weight > best.get(at, 0.0):
                best[at] = weight
        for a, b in excused:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return sum(best.values()), len(best), folded.count(" ") if len(folded) > 1 else 0

    def features(self, total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(n_words, 20))], 1)

    def score(self, total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        x = self.features(total, n_words)
        return 1 / (1 + np.exp(-np.clip(self.bias + x[:, 0] * self.plain + x[:, 1] * self.dense, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Newton steps for a logistic fit with a small ridge; returns bias and slopes."""
    design = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + penalty * len(y) * w
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + penalty * len(y) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, rows: int = FIT_ROWS) -> DataFrame:
    """At most about ``rows`` labelled training rows (doc_id, y, text), chosen by a hash of doc_id alone.

    A doc_id of several rows gives one, that with the smallest text; the sample's rows alone move.
    """
    usable = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(target).alias("y"))
    n = usable.count()
    share = 1.0 if n <= rows else rows / n
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit_lexicon(sample: DataFrame) -> Lexicon:
    """Learn entries, weights and the curve from ``sample`` (text, y). Without both labels the seed list is returned."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for x in texts(batch.column(0)):
                total.update(candidates(fold(x)))
        kept = list(total.items())
        yield pa.record_batch([pa.array([k for k, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.int64())], ["entry", "n"])

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon(dict((f" {k} ", v) for k, v in SEED.items()))
    positive = sample.where("y = 1").select("text").mapInArrow(trimmed(count), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    floor = max(3, sizes[1] // 400)
    tried = [r.entry for r in positive.where(F.col("n") >= floor).orderBy(F.desc("n"), "entry").limit(20 * LEXICON).collect()]
    tried = list(dict.fromkeys([*tried, *(f" {x} " for x in SEED)]))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(tried)}
        for batch in batches:
            rows, n_words = [], []
            for x in texts(batch.column(0)):
                folded = fold(x)
                rows.append([place[c] for c in candidates(folded) if c in place])
                n_words.append(folded.count(" ") if len(folded) > 1 else 0)
            yield pa.record_batch([batch.column(1).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["y", "n_words", "hits"])

    seen = sample.select("text", "y").mapInArrow(trimmed(hits), "y long, n_words long, hits array<int>")
    # Aggregated first: what reaches the driver is two counts per candidate.
    by_entry = seen.select("y", F.explode("hits").alias("k")).groupBy("k").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).collect()
    weights = {}
    for k, p, q in by_entry:
        rate_p, rate_q = (p + 0.1) / (sizes[1] + 1), (q + 0.5) / (sizes[0] + 1)
        odds = np.log(rate_p / rate_q)
        if odds > 2.0 and p >= floor:
            weights[tried[k]] = (p, q, odds - 1.0)
    chosen: dict[str, float] = {}
    for entry, (p, _, weight) in sorted(weights.items(), key=lambda x: (len(x[0]), x[0])):
        # A stem that says as much as its longer forms stands for them.
        parents = [entry[:k] for k in range(5, len(entry)) if entry[:k] in chosen]
        if not any(weights[x][2] >= weight - 0.3 for x in parents):
            chosen[entry] = weight
        del p
    top = sorted(chosen.items(), key=lambda x: (-weights[x[0]][0] * x[1], x[0]))[:LEXICON]
    lexicon = Lexicon(dict(top))
    measured = _measured(sample.select(F.col("y").alias("doc_id"), "text"), lexicon).select("doc_id", "total", "n_words").toPandas()
    w = _logistic(lexicon.features(measured.total.to_numpy(float), measured.n_words.to_numpy(float)), measured.doc_id.to_numpy(float))
    lexicon.bias, lexicon.plain, lexicon.dense = map(float, w)
    return lexicon


def _measured(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            rows = [lexicon.measure(matcher, fold(x)) for x in texts(batch.column(1))]
            total, n_hits, n_words = (np.array([r[k] for r in rows]) for k in range(3))
            score = lexicon.score(total.astype(float), n_words.astype(float)) if rows else np.zeros(0)
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(total.astype(float)), pa.array(n_hits.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(score)],
                ["doc_id", "total", "n_hits", "n_words", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, total double, n_hits long, n_words long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, score, predicted, n_hits, n_words) for every row of ``docs`` (doc_id, text).

    ``labels``: (doc_id, toxic); ``train`` says which of them may be learned from. Null texts are empty and get the
    curve's score at no hits. Rows with equal doc_id are scored one by one, rows without one too. Other columns are
    ignored; an empty table gives an empty result. Without labels of both kinds the seed list scores. A map over
    partitions, no shuffle of texts.
    """
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if train is None else train)
    scored = _measured(docs, fit_lexicon(sample))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "score", "predicted", "n_hits", "n_words")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from .shared import crc_text, table

    held_out = crc_text("doc_id") % 5 == 0
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "n_words")
