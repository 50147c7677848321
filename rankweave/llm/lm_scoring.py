"""Language-model scores by a weighted backoff automaton.

Tokens are lower-cased words and one end mark a document. States are all histories of one and two words of the training
documents, arcs all their words, pairs and triples: nothing is left out by its count. Absolute discounting, interpolated:
the arc of word w at state h weighs (c(hw) - D) / c(h) plus the failure weight D * followers(h) / c(h) times w's weight
at the shorter history, which a word without an arc gets alone. The empty history has the add-one word distribution, so
the whole is a proper distribution. Before a document's first word stands the end mark.

Nothing that grows with the input is broadcast or meets in one task. Documents are dealt to folds of about one million
tokens. In three rounds (triples, pairs, words) each fold sends its distinct n-grams with their training counts to parts
of the hash space, and each part answers every fold with the whole counts, in the order sent. One of the folds that
trained an n-gram is told that it owns it, and in the next round it adds one to its history's followers. At last each
fold builds the part of the automaton that its documents can reach and traverses it. A very common n-gram is one entry a
fold; the number of parts grows with the bytes of text.

Null texts are empty: one end mark. Without training documents every probability is 1 / (0 + 0 + 1). Repeated rows are
scored one by one; a null doc_id is training data; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import by_part, from_steps, pack, steps, unpack
from .shared import discard, forget_shuffles, trimmed, written
from .tokens import _STEP, LOWER, mix, text_chunks, word_hashes, words

DISCOUNT = 0.6
END = np.uint64(0x1D8AF066E5C5B0AB)
#: Bytes of text to a part of the hash space.
PART_BYTES = 4 << 20
#: Tokens of a fold.
FOLD = 1 << 20
#: Shares of the folds that meet their answers, and of the parts that answer, one after another, so that no more than a
#: share is shuffled at a time.
SHARES = 3


def token_stream(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens with an end mark after each document, bounds) by chunks."""
    for row, _, data, offsets in text_chunks(column):
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets)
        n = np.diff(bounds)
        cuts = np.concatenate([[0], np.cumsum(n + 1)])
        tokens = np.full(cuts[-1], END, np.uint64)
        tokens[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = word_hashes(data, starts, ends)
        yield row, tokens, cuts


def _grams(tokens: np.ndarray, cuts: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """By order the id of the n-gram that ends at each position, and the positions of triples (a document's first has none)."""
    last = np.roll(tokens, 1)
    last[cuts[:-1]] = END
    pair = mix(last * _STEP[0] + tokens)
    deep = np.ones(len(tokens), bool)
    deep[cuts[:-1]] = False
    deep = np.flatnonzero(deep)
    return {1: tokens, 2: pair, 3: mix(pair[deep - 1] * _STEP[1] + tokens[deep])}, deep


_FIELDS = pa.schema([("fold", pa.int64()), ("order", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_MESSAGE = "fold long, order int, part int, n long, data binary, ids array<long>, lengths array<long>"


def _messages(rows: list[tuple]) -> pa.Table:
    rows = [(*r, None, None)[:7] for r in rows]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)] if rows else [pa.array([], f.type) for f in _FIELDS], schema=_FIELDS)


def _by_part(fold: int, order: int, bits: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Sorted keys and what goes with them, cut into parts of the hash space."""
    return _messages([(fold, order, p, e - s, pack(steps(keys[s:e]), *(x[s:e] for x in columns))) for p, s, e in by_part(keys, 64 - bits)])


class Fold:
    """The documents of a fold, their distinct n-grams by order, and what the parts have answered."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, learned: np.ndarray):
        self.tokens, self.lengths, self.learned = tokens, lengths, learned
        self.cuts = np.concatenate([[0], np.cumsum(lengths)])
        self.grams, self.deep = _grams(tokens, self.cuts)
        self.found: dict[int, tuple] = {}

    @classmethod
    def read(cls, part: pa.Table) -> tuple[Fold, list, dict[int, list[np.ndarray]]]:
        """The fold, its doc_ids and the answers by order, each aligned with the order's sorted n-grams."""
        part = part.sort_by([("order", "ascending"), ("part", "ascending")])
        order, sizes, data = part.column("order").to_numpy(), part.column("n").to_numpy(), part.column("data")
        flat = unpack(data[0].as_buffer(), int(sizes[0]), 1)[0]
        v = int(flat[0])
        tokens = from_steps(flat[1 : v + 1])[flat[v + 1 : 2 * v + 1]][flat[2 * v + 1 :]]
        marked = np.array(part.column("lengths")[0].as_py())
        told = {k: list(map(np.concatenate, zip(*(unpack(data[int(r)].as_buffer(), int(sizes[r]), _ANSWERS[k]) for r in np.flatnonzero(order == k)), strict=True))) for k in set(order.tolist()) - {0}}
        return cls(tokens, marked >> 1, (marked & 1).astype(float)), part.column("ids")[0].as_py(), told

    def written(self, fold: int, ids: list) -> pa.Table:
        words_, rank, times = np.unique(self.tokens, return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        flat = np.concatenate([[len(words_)], steps(words_), often, place[rank]])
        return _messages([(fold, 0, 0, len(flat), pack(flat), ids, self.lengths * 2 + self.learned.astype(np.int64))])

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted n-grams, a position of each and the place of each position's n-gram."""
        if order not in self.found:
            keys, first, inverse = np.unique(self.grams[order], return_index=True, return_inverse=True)
            self.found[order] = keys, self.deep[first] if order == 3 else first, inverse
        return self.found[order]

    def before(self, at: np.ndarray) -> np.ndarray:
        """Places (among the words) of the words before positions."""
        words_, _, inverse = self.distinct(1)
        start = np.zeros(len(self.tokens), bool)
        start[self.cuts[:-1]] = True
        return np.where(start[at], np.searchsorted(words_, END), inverse[at - 1])

    def message(self, fold: int, order: int, bits: int, owned: np.ndarray | None = None) -> pa.Table:
        """The n-grams of an order; ``owned``: which of the next order's n-grams this fold owns."""
        keys, _, inverse = self.distinct(order)
        learned = np.repeat(self.learned, self.lengths)
        times = np.bincount(inverse, learned[self.deep] if order == 3 else learned, len(keys)).astype(np.int64)
        if owned is None:
            return _by_part(fold, order, bits, keys, times)
        at = self.distinct(order + 1)[1][owned.astype(bool)]
        return _by_part(fold, order, bits, keys, times, np.bincount(inverse[at - 1] if order == 2 else self.before(at), minlength=len(keys)))


class Automaton:
    """The states, arcs and failure arcs that a fold's documents can reach, with log10 weights from whole counts.

    States are the empty history, each word and each pair that training continues. A state's arcs carry the interpolated
    weight of their word; its failure arc leads to the history without its first word and carries the discounted mass.
    The empty state has an arc for every word. Arcs are arrays by the place of their n-gram among the fold's distinct
    ones, -inf where training does not have it; failure arcs are arrays by the place of the state, nan where it is none.
    """

    def __init__(self, fold: Fold, told: dict[int, list[np.ndarray]], n: int, v: int):
        self.fold, self.word, self.pair = fold, fold.distinct(1)[2], fold.distinct(2)[2]
        (singles, _, after), (pairs, _, after_pairs) = told[1], told[2]
        self.arc1 = np.log10((singles + 1) / (n + v + 1))
        self.fail1 = self._failure(singles, after)
        at = fold.distinct(2)[1]
        state = fold.before(at)
        self.arc2 = self._arcs(pairs, singles[state], self.fail1[state] + self.arc1[self.word[at]])
        self.fail2 = self._failure(pairs, after_pairs)
        self.arc3 = None
        if 3 in told:
            at = fold.distinct(3)[1]
            state = self.pair[at - 1]
            self.arc3 = self._arcs(told[3][0], pairs[state], self.fail2[state] + self._from_word(at))

    @staticmethod
    def _failure(count: np.ndarray, followers: np.ndarray) -> np.ndarray:
        return np.where(followers > 0, np.log10(DISCOUNT * np.maximum(followers, 1) / np.maximum(count, 1)), np.nan)

    @staticmethod
    def _arcs(count: np.ndarray, held: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Weights of arcs from a state met ``held`` times; ``lower``: the failure arc and the word's weight below it."""
        return np.where(count > 0, np.log10(np.maximum(count - DISCOUNT, 0.1) / np.maximum(held, 1) + 10**lower), -np.inf)

    @staticmethod
    def _step(arc: np.ndarray, fail: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The arc, else the failure arc and the step below; where the state is none, the step below."""
        return np.where(np.isfinite(arc), arc, np.nan_to_num(fail) + below)

    def _from_word(self, at: np.ndarray) -> np.ndarray:
        """Weights of the steps at positions, from the state of the one word before."""
        return self._step(self.arc2[self.pair[at]], self.fail1[self.fold.before(at)], self.arc1[self.word[at]])

    def traverse(self) -> np.ndarray:
        """The weight of every step, left to right: documents start in the state of the end mark, and each step leads to
        the state of the last two words. That state is known from the words alone, so all steps are taken at once."""
        weight, deep = self._from_word(np.arange(len(self.word))), self.fold.deep
        if self.arc3 is not None:
            weight[deep] = self._step(self.arc3[self.fold.distinct(3)[2]], self.fail2[self.pair[deep - 1]], weight[deep])
        return weight


#: Columns of the messages and answers by order.
_SENT, _ANSWERS = {3: 2, 2: 3, 1: 3}, {3: 2, 2: 3, 1: 3}


def _folds(docs: DataFrame) -> DataFrame:
    """Documents in folds, one row each. They are written before anything reads them twice: which rows share a fold hangs
    on how a scan was split, which another run of the scan may do otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, []

        def close() -> list[pa.RecordBatch]:
            fold = Fold(*(np.concatenate([x[k] for x in held]) for k in range(3)))
            return fold.written(number, [i for x in held for i in x[3].to_pylist()]).to_batches()

        for batch in batches:
            for row, tokens, cuts in token_stream(batch.column(1)):
                end = row + len(cuts) - 1
                held.append((tokens, np.diff(cuts), batch.column(2)[row:end].to_numpy(zero_copy_only=False).astype(float), batch.column(0)[row:end]))
                size += len(tokens)
                if size >= FOLD:
                    yield from close()
                    number, size, held = number + 1, 0, []
        if held:
            yield from close()

    return docs.mapInArrow(trimmed(run), _MESSAGE)


def _triples(folds: DataFrame, bits: int) -> DataFrame:
    """The messages of each fold's triples, from the written folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = pa.Table.from_batches([batch.slice(k, 1)])
                yield from Fold.read(part)[0].message(part.column("fold")[0].as_py(), 3, bits).to_batches()

    return folds.mapInArrow(trimmed(run), _MESSAGE)


def _answered(sent: DataFrame) -> DataFrame:
    """Each message's n-grams with whole counts: (count, owned, followers), for triples without followers.

    Rows of fold -1 hold the training tokens and distinct words of a part.
    """

    def run(key: tuple, part: pa.Table) -> pa.Table:
        order, place = key[0].as_py(), key[1].as_py()
        folds, sizes = part.column("fold").to_numpy(), part.column("n").to_numpy()
        moves, times, *more = zip(*(unpack(x.as_buffer(), n, _SENT[order]) for x, n in zip(part.column("data"), sizes.tolist(), strict=True)), strict=True)
        found, inverse = np.unique(np.concatenate([from_steps(x) for x in moves]), return_inverse=True)
        times = np.concatenate(times)
        counts = np.bincount(inverse, times, len(found)).astype(np.int64)
        trained = np.flatnonzero(times)
        owned = np.zeros(len(times), np.int64)
        owned[trained[np.unique(inverse[trained], return_index=True)[1]]] = 1
        columns = [counts[inverse], owned, *(np.bincount(inverse, np.concatenate(x), len(found)).astype(np.int64)[inverse] for x in more)]
        ends = np.cumsum(sizes)
        rows = [(f, order, place, e - s, pack(*(x[s:e] for x in columns))) for f, s, e in zip(folds.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)]
        if order == 1:
            rows.append((-1, 1, place, 1, pack(counts.sum(keepdims=True), np.count_nonzero(counts, keepdims=True))))
        return _messages(rows)

    return sent.groupBy("order", "part").applyInArrow(run, _MESSAGE)


def lm_scores(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(True)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, (size // PART_BYTES).bit_length())

    folds = written(_folds(rows), "folds")
    share = lambda df, k: df.where(F.pmod(F.xxhash64("fold"), F.lit(SHARES)) == k)

    def next_order(order: int, answers: DataFrame) -> list[DataFrame]:
        """Whole counts of an order, asked for by folds that know the answers to the order above, share by share; parts
        answer share by share too, so that what was sent is not held a second time as a shuffle."""

        def run(key: tuple, part: pa.Table) -> pa.Table:
            fold, _, told = Fold.read(part)
            # A fold of empty texts has no triples.
            return fold.message(key[0].as_py(), order, bits, told[order + 1][1] if order + 1 in told else np.zeros(0))

        sent = []
        for k in range(SHARES):
            sent.append(written(share(folds, k).unionByName(share(answers, k)).groupBy("fold").applyInArrow(run, _MESSAGE), "sent"))
            forget_shuffles(docs.sparkSession)
        out, whole = [], reduce(DataFrame.unionByName, sent)
        for k in range(SHARES):
            out.append(written(_answered(whole.where(F.pmod("part", F.lit(SHARES)) == k)), "answers"))
            forget_shuffles(docs.sparkSession)
        discard(*sent)
        return out

    # What a round has shuffled is of no more use once its answers are written.
    triples = written(_answered(_triples(folds, bits)), "triples")
    forget_shuffles(docs.sparkSession)
    pair_shares = next_order(2, triples)
    pairs = reduce(DataFrame.unionByName, pair_shares)
    single_shares = next_order(1, pairs)
    singles = reduce(DataFrame.unionByName, single_shares)
    n = v = 0
    for r in singles.where("fold = -1").select("data").toLocalIterator():
        part_n, part_v = unpack(bytes(r.data), 1, 2)
        n, v = n + int(part_n[0]), v + int(part_v[0])

    def finish(key: tuple, part: pa.Table) -> pa.Table:
        fold, ids, told = Fold.read(part)

        automaton = Automaton(fold, told, n, v)
        one = fold.distinct(1)[2]
        owner = np.repeat(np.arange(len(ids)), fold.lengths)
        total = lambda x: np.bincount(owner, x, len(ids))
        columns = [pa.array(ids, pa.int64()), fold.lengths, total(told[1][0][one] > 0).astype(np.int64), np.full(len(ids), n), total(automaton.arc1[one]), total(automaton.traverse())]
        return pa.table(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = []
    for k in range(SHARES):
        told = reduce(DataFrame.unionByName, [share(x, k) for x in (folds, triples, pairs, singles.where("fold >= 0"))])
        scored.append(written(told.groupBy("fold").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scored"))
        forget_shuffles(docs.sparkSession)
    discard(folds, triples, *pair_shares, *single_shares)
    return reduce(DataFrame.unionByName, scored)


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from .shared import crc_text, table

    held_out = F.coalesce(crc_text("doc_id") % 7 == 2, F.lit(False))
    return lm_scores(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", F.coalesce(crc_text("doc_id") % 7 == 2, F.lit(False)))
