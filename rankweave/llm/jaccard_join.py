"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when their sets of distinct 5-word shingles have Jaccard similarity of 0.75 or more.

1. Documents with equal sets fall into one class; one document stands for it.
2. The number of classes that hold a shingle is counted exactly, for every shingle: folds of documents send their
   distinct shingles to parts of the hash space, which answer with whole counts. Shingles are keys of as many bits as
   keep the share of collisions alike at every size; a collision can only make a key more common than its shingles.
3. Rare first: a document's keys are ordered by count, then key. A document of n shingles can reach the threshold only
   with documents that share one of its first n - ceil(3n/4) + 1. Keys of one class alone come first and need no
   posting; of the others those within the prefix become postings (key, document, n, position).
4. Postings are sorted by key and, within a key's list, by each document's least shared key, so that near copies stand
   in one run. Each row is compared with one row before it: in a run the row whose place has the lowest digit (to the
   base ``FAN``) of its own place cleared, so rows hang in a flat tree and none is compared with more than a few times
   ``FAN`` others; the first row of a run with the first row of the run before. A list of m documents gives m - 1 pairs.
   The sort is by ranges, which cut long lists; the rows at the cuts are compared too. Pairs pass the length and
   positional filters, are made distinct, pass the suffix filter (the parities of set sizes within ranges of the hash
   space bound the overlap) and are verified once on whole sets. What they join is one component.
5. Lists of three and more that still hold several components (in a list of two the only pair was compared) are shuffled
   ``SHUFFLES`` times and compared again, each row with the one before it if that is of another component: in a group of
   near copies nearly all links are joined so. Turns end when few pairs are left to compare or a turn no longer helps.
6. In the lists that still hold several components every pair of documents of different components that passes the three
   filters is verified. So no link between different components is missed, while a group of thousands of near copies
   costs pairs in proportion to its size. Long lists are cut into blocks, and every two blocks meet in a task of their own.

Null texts and texts without words have an empty set and link with nothing. The rows of one doc_id act as one document,
which links with whatever any of its texts links with; each row has its own n_shingles. A row without a doc_id is no
document: it links nothing, and its component_id is that of a document with an equal set, null if there is none. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .exchange import by_part, from_steps, pack, steps, unpack
from .shared import checked_broadcast, discard, forget_shuffles, sized_join, small_batches, trimmed, written
from .tokens import shingle_sets

#: Shingles of a fold and of a part: what a task holds, some 160 bytes for each of a fold at its peak. Messages number
#: folds times parts, so raise both for petabytes.
FOLD, PART = 1 << 20, 1 << 21
#: Bits of a key beyond those that number all shingles: one key in 4,096 belongs to two shingles.
SPARE_BITS = 12
#: Ranges of the hash space whose set sizes, odd or even, the suffix filter compares; one bit each.
RANGES = 512
#: Rows of a run that hang on one row, level by level; so many levels are enough for 2 ** 60 rows.
FAN, LEVELS = 64, 10
#: Postings of a block; a longer list is cut before its components are compared.
BLOCK = 2_000
#: Pairs of different components a posting, in its list, that are compared without a further turn of shuffled lists; a turn
#: that leaves more than this share of them is the last, as is the last of ``TURNS``.
CROSSING, LEFT, TURNS, SHUFFLES = 8, 0.75, 3, 4
#: Rows of (doc_id) that may be broadcast, 16 bytes each.
BROADCAST_ROWS = 2_000_000
PAIR_ROWS = 500_000

_SET_SCHEMA = "doc_id long, n long, fp_a long, fp_b long, bits array<long>"
_FOLD_SCHEMA = "fold long, part int, n long, data binary, keys binary, ids array<long>, sizes array<long>"
_POSTING_SCHEMA = "key long, doc_id long, n long, pos long, least long"


def document_sets(docs: DataFrame) -> DataFrame:
    """Per row: set size, fingerprint of the whole set and its parities by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.uint64(64 - RANGES.bit_length() + 1)
        for batch in batches:
            n, fp_a, fp_b, bits = [], [], [], []
            for _, own in shingle_sets(batch.column(1)):
                n.append(len(own))
                fp_a.append(own.sum(dtype=np.uint64))
                fp_b.append(((own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64))
                bits.append(np.packbits(np.bincount((own >> cut).astype(np.int64), minlength=RANGES).astype(np.uint8) & 1).view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            ends = pa.array(np.arange(len(n) + 1) * (RANGES // 64), pa.int32())
            parities = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), signed(fp_a), signed(fp_b), parities], ["doc_id", "n", "fp_a", "fp_b", "bits"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), _SET_SCHEMA)


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["fold", "part", "n", "data", "keys", "ids", "sizes"]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def folds(docs: DataFrame, key_bits: int, part_bits: int) -> DataFrame:
    """Folds of documents: one row (part -1) with each document's places among the fold's distinct keys, and one row a
    part with those keys and how many of the fold's documents hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, sets = TaskContext.get().partitionId() << 32, 0, [], []

        def close() -> list[pa.RecordBatch]:
            sizes = np.array([len(x) for x in sets])
            whole = np.concatenate(sets)
            sets.clear()
            whole >>= np.uint64(64 - key_bits)
            keys, place, times = np.unique(whole, return_inverse=True, return_counts=True)
            del whole
            first = np.cumsum(sizes) - sizes
            gaps = np.diff(place, prepend=0)
            gaps[first] = place[first]
            rows = [(number, -1, len(place), pack(gaps), None, ids, sizes)]
            rows += [(number, p, e - s, pack(steps(keys[s:e]), times[s:e]), None, None, None) for p, s, e in by_part(keys, key_bits - part_bits)]
            return _table(rows).to_batches()

        for batch in batches:
            named = batch.column(0).to_pylist()
            for row, own in shingle_sets(batch.column(1)):
                if len(own):
                    ids.append(named[row])
                    sets.append(own)
                    size += len(own)
                if size >= FOLD:
                    yield from close()
                    number, size, ids, sets = number + 1, 0, [], []
        if sets:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), _FOLD_SCHEMA)


def counted(sent: DataFrame) -> DataFrame:
    """Each message's answer: for all its keys the number of documents that hold it, and the keys that two or more hold."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        sizes = part.column("n").to_numpy()
        moves, times = zip(*(unpack(x.as_buffer(), n, 2) for x, n in zip(part.column("data"), sizes.tolist(), strict=True)), strict=True)
        own = [from_steps(x) for x in moves]
        found, inverse = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(times), len(found)).astype(np.int64)[inverse]
        ends, rows = np.cumsum(sizes), []
        for fold, e, keys in zip(part.column("fold").to_pylist(), ends.tolist(), own, strict=True):
            held = total[e - len(keys) : e]
            rows.append((fold, key[0].as_py(), len(keys), pack(held), pack(steps(keys[held > 1])), None, None))
        return _table(rows)

    return sent.groupBy("part").applyInArrow(run, _FOLD_SCHEMA)


def prefixes(contents: DataFrame, answers: DataFrame) -> DataFrame:
    """Postings of the keys within each document's prefix that another document holds too."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("part")
        n, data, keys = part.column("n").to_pylist(), part.column("data"), part.column("keys")
        ids, sizes = np.array(part.column("ids")[0].as_py(), np.int64), np.array(part.column("sizes")[0].as_py(), np.int64)
        held = np.concatenate([unpack(x.as_buffer(), m)[0] for x, m in zip(data[1:], n[1:], strict=True)])
        shared, at = [], 0
        for x, m in zip(keys[1:], n[1:], strict=True):
            shared.append(from_steps(unpack(x.as_buffer(), int((held[at : at + m] > 1).sum()))[0]))
            at += m
        shared = np.concatenate(shared)
        first = np.cumsum(sizes) - sizes
        place = np.cumsum(unpack(data[0].as_buffer(), n[0])[0])
        # Each document's gaps start anew at its first place.
        place -= np.repeat(np.concatenate([[0], place[first[1:] - 1]]), sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        some = np.flatnonzero(held[place] > 1)
        doc, place = doc[some], place[some]
        count = np.bincount(doc, minlength=len(sizes))
        value = shared[np.cumsum(held > 1)[place] - 1].view(np.int64)
        start = np.cumsum(count) - count
        least = value[np.minimum(start, max(len(value) - 1, 0))] if len(value) else np.zeros(len(sizes), np.int64)
        order = np.lexsort((place, held[place], doc))
        pos = (sizes - count)[doc] + np.arange(len(doc)) - start[doc]
        inside = pos < (sizes - (3 * sizes + 3) // 4 + 1)[doc]
        doc, value = doc[inside], value[order][inside]
        return pa.table([value, ids[doc], sizes[doc], pos[inside], least[doc]], ["key", "doc_id", "n", "pos", "least"])

    both = contents.unionByName(answers)
    return both.groupBy("fold").applyInArrow(run, _POSTING_SCHEMA)


def postings_of(docs: DataFrame, shingles: int) -> DataFrame:
    """Postings of ``docs``, which hold so many shingles in all."""
    key_bits = min(64, max(24, shingles.bit_length() + SPARE_BITS))
    part_bits = max(6, (shingles // PART).bit_length())
    sent = written(folds(docs, key_bits, part_bits), "folds")
    answers = written(counted(sent.where("part >= 0").select("fold", "part", "n", "data")), "answers")
    forget_shuffles(docs.sparkSession)
    out = written(prefixes(sent.where("part = -1"), answers), "postings")
    discard(sent, answers)
    forget_shuffles(docs.sparkSession)
    return out


def _reach(a: str, b: str) -> F.Column:
    """The least overlap with which sets of these sizes have a similarity of 0.75: ceil(3/7 of the sum)."""
    return F.expr(f"ceil(3 * ({a} + {b}) / 7.0D)")


def _alike() -> F.Column:
    """Suffix filter: ranges with an odd difference are no more than all differences, of which a link bounds the number."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(RANGES // 64)))
    return apart <= F.col("n_a") + F.col("n_b") - 2 * _reach("n_a", "n_b")


#: Length filter.
_NEAR = "100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)"


def _filtered(pairs: DataFrame) -> DataFrame:
    """Length and positional filters on (a, n_a, pos_a, b, n_b, pos_b)."""
    room = F.expr("1 + least(n_a - pos_a - 1, n_b - pos_b - 1)")
    # A pair's first common prefix key in both orders satisfies this; later ones may fail without harm.
    return pairs.where(F.expr(_NEAR) & (room >= _reach("n_a", "n_b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def lists_of(postings: DataFrame, order: list[str]) -> DataFrame:
    """Postings sorted by key and ``order`` with the row each is compared with (doc_id_b, n_b, pos_b and, if there,
    component_b), if any; rows of equal ``order[0]`` are a run.

    A posting alone in its list is left out. ``wide``: the list has three postings or more. Ranges cut long lists; rows
    beside a cut count as wide, and ``edge`` is 2p for the first row of range p and 2p + 1 for its last.
    """
    columns = list(dict.fromkeys([*postings.columns, *order]))
    carried = [c for c in ("doc_id", "n", "pos", "component") if c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, opening = TaskContext.get().partitionId(), None, True
        tree = Tree(len(carried))

        def ready(rows: pa.Table, since: int, until: int, closing: bool) -> list[pa.RecordBatch]:
            """Rows from ``since`` to ``until``, whose neighbours two places off are in ``rows``."""
            key, size = rows.column("key").to_numpy(), rows.num_rows
            padded = np.zeros(size + 3, bool)
            padded[2 : size + 1] = key[1:] == key[:-1]  # at i + 1: row i equals the row before it
            up, up2, down, down2 = padded[1 : size + 1], padded[:size], padded[2 : size + 2], padded[3 : size + 3]
            first, last = np.full(size, -1), np.full(size, -1)
            wide = (up & down) | (up & up2) | (down & down2)
            if opening:
                first[0] = 2 * number
                wide[:2] |= key[:2] == key[0]
            if closing:
                wide[-2:] |= key[-2:] == key[-1]
                last[-1] = 2 * number + 1
            chosen = rows.slice(since, until - since)
            own = np.stack([chosen.column(c).to_numpy() for c in carried])
            there, before = tree.parents(chosen.column("key").to_numpy(), chosen.column(order[0]).to_numpy(), own)
            parents = [pa.array(x, mask=~there) for x in before]
            out = pa.table([*(chosen.column(c) for c in columns), *(pa.array(x[since:until]) for x in (wide, first, last)), *parents], [*columns, "wide", "first_edge", "last_edge", *(f"{c}_b" for c in carried)])
            keep = (up | down | wide | (first >= 0) | (last >= 0))[since:until]
            return out.filter(pa.array(keep)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            # ``held`` ends with two rows that wait, before them two that were given out.
            rows = new if held is None else pa.concat_tables([held, new])
            since = 0 if opening else 2
            until = rows.num_rows - 2
            if rows.num_rows >= 4:
                yield from ready(rows, since, until, False)
                held, opening = rows.slice(until - 2), False
            else:
                held = rows
        if held is not None:
            yield from ready(held, 0 if opening else 2, held.num_rows, True)

    schema = ", ".join(f"{c} long" for c in columns) + ", wide boolean, first_edge long, last_edge long" + "".join(f", {c}_b long" for c in carried)
    return postings.select(*columns).repartitionByRange("key", *order).sortWithinPartitions("key", *order).mapInArrow(trimmed(run), schema)


class Tree:
    """Which earlier row each row of a sorted stream is compared with; batch by batch, a few rows are kept."""

    def __init__(self, width: int):
        self.place, self.key, self.mark = -1, None, None  # of the last row
        self.leader = None  # the first row of the last run
        self.anchors: list = [None] * LEVELS  # the last row of the run whose place is a multiple of FAN ** (level + 1)
        self.width = width

    def parents(self, key: np.ndarray, mark: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a row has a parent, the parents' columns)."""
        n = len(key)
        there, out = np.zeros(n, bool), np.zeros((self.width, n), np.int64)
        if not n:
            return there, out
        new_list = np.concatenate([[self.key is None or key[0] != self.key], key[1:] != key[:-1]])
        new_run = new_list | np.concatenate([[self.mark is None or mark[0] != self.mark], mark[1:] != mark[:-1]])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new_run, at, -1))
        place = np.where(start >= 0, at - start, at + self.place + 1)
        # First rows of runs: the leader of the run before, in the same list.
        heads = np.flatnonzero(new_run)
        leaders = np.concatenate([[-1], heads[:-1]])
        linked = heads[~new_list[heads]]
        back = leaders[~new_list[heads]]
        there[linked] = True
        out[:, linked] = np.where(back >= 0, own[:, np.maximum(back, 0)], 0 if self.leader is None else self.leader[:, None])
        for level in range(LEVELS):
            step = FAN**level
            mine = np.flatnonzero((place > 0) & (place % step == 0) & (place // step % FAN != 0))
            if len(mine):
                back = mine - place[mine] % (step * FAN)
                there[mine] = True
                kept = self.anchors[level]
                out[:, mine] = np.where(back >= 0, own[:, np.maximum(back, 0)], 0 if kept is None else kept[:, None])
        for level in range(LEVELS):
            anchors = np.flatnonzero(place % FAN ** (level + 1) == 0)
            if len(anchors):
                self.anchors[level] = own[:, anchors[-1]].copy()
        if len(heads):
            self.leader = own[:, heads[-1]].copy()
        self.place, self.key, self.mark = int(place[-1]), key[-1], mark[-1]
        return there, out


def listed(postings: DataFrame, order: list[str]) -> DataFrame:
    """``lists_of``, written; its rows are a few numbers, so batches may be longer than those of texts."""
    small_batches(postings.sparkSession, 20_000)
    try:
        return written(lists_of(postings, order), "lists")
    finally:
        small_batches(postings.sparkSession)


def neighbours(lists: DataFrame) -> DataFrame:
    """Pairs of rows that are compared in a list, those across a cut too, that pass the first two filters.

    Where components are known, only pairs of different ones.
    """
    carried = [c for c in ("doc_id", "n", "pos", "component") if c in lists.columns]
    # Two rows a range at most; the first row of a range follows the last one of the range before it.
    ends = [lists.where(f"{x} >= 0").select(F.col(x).alias("edge"), "key", *carried) for x in ("first_edge", "last_edge")]
    order = Window.orderBy("edge")
    cut = ends[0].unionByName(ends[1]).select("*", *(F.lag(c).over(order).alias(f"{c}_b") for c in ("key", *carried))).where("edge % 2 = 0 AND key = key_b")
    columns = [*carried, *(f"{c}_b" for c in carried)]
    pairs = lists.where("doc_id_b IS NOT NULL").select(*columns).unionByName(cut.select(*columns)).where("doc_id <> doc_id_b")
    if "component" in carried:
        pairs = pairs.where("component <> component_b")
    return _filtered(pairs.selectExpr("doc_id AS a", "n AS n_a", "pos AS pos_a", "doc_id_b AS b", "n_b", "pos_b"))


def _hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, hashes): each row's whole set, sorted, packed. 48 bits of a hash tell the shingles of two texts apart."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, x in shingle_sets(batch.column(1))]
            packed = [pack(steps(x >> np.uint64(16))) for x in sets]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "hashes"])

    return docs.mapInArrow(trimmed(hashed), "doc_id long, n long, hashes binary")


def verified(likely: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that have a similarity of 0.75 on their whole sets; only the documents of pairs are read into sets."""
    # Beside a broadcast of the (few) likely pairs, only the sets of their documents move.
    near = checked_broadcast(likely, PAIR_ROWS)
    ends = written(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    sets = written(_hashes(docs.join(checked_broadcast(ends, BROADCAST_ROWS), "doc_id", "left_semi")), "hashes")
    own = lambda c: sets.selectExpr(f"doc_id AS {c}", f"n AS n_{c}", f"hashes AS h_{c}").join(near, c)
    both = own("a").join(own("b"), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, x, n, y in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                p, q = (from_steps(unpack(z.as_buffer(), k.as_py())[0]) for z, k in ((x, m), (y, n)))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                shared = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(p) else 0
                keep.append(100 * shared >= 75 * (len(p) + len(q) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = written(both.select("a", "b", "n_a", "h_a", "n_b", "h_b").mapInArrow(trimmed(run), "a long, b long").distinct(), "links")
    discard(ends, sets)
    forget_shuffles(docs.sparkSession)
    return links


def parted(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings (key, doc_id, n, pos) with the component of their document, only in lists that hold several components;
    ``blocks``: into how many blocks their list is cut."""
    named = groups.withColumnRenamed("node", "doc_id")
    labelled = written(lists.select("key", "doc_id", "n", "pos").join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    several = labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    several = written(several.select("key", "size", F.expr(f"1 + (size - 1) DIV {BLOCK}").alias("blocks")), "several")
    out = written(sized_join(labelled, several, ["key"], "size").where("blocks IS NOT NULL"), "parted")
    discard(labelled, several)
    return out


def crossing(rows: DataFrame) -> tuple[int, int]:
    """(postings, pairs of postings of different components that share a list)."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.expr("CAST(m AS DOUBLE) * m")).alias("own"))
    n, pairs = parts.agg(F.sum("n"), F.sum(F.expr("(CAST(n AS DOUBLE) * n - own) / 2"))).first()
    return n or 0, pairs or 0


def shuffled(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of different components, neighbours in lists that are shuffled, each list in its own way each time."""
    times = F.explode(F.sequence(F.lit(SHUFFLES * turn), F.lit(SHUFFLES * (turn + 1) - 1))).alias("time")
    # Lists of one key are told apart by a hash; should two hashes meet, some more pairs are compared.
    mixed = rows.select("key", "doc_id", "n", "pos", "component", times).select(F.xxhash64("key", "time").alias("key"), "doc_id", "n", "pos", "component", F.xxhash64("doc_id", "key", "time").alias("mix"))
    lists = listed(mixed, ["mix", "doc_id"])
    pairs = written(neighbours(lists), "pairs")
    discard(lists)
    return pairs


def across(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of different components that share a list and pass all three filters."""
    rows = rows.join(bits.select("doc_id", "bits"), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    others = F.explode(F.expr("sequence(0L, blocks - 1)"))
    left = rows.select("key", F.col("block").alias("i"), others.alias("j"), *(F.col(x).alias(f"{x}_a") for x in ("component", "n", "pos", "bits")), F.col("doc_id").alias("a"))
    right = rows.select("key", others.alias("i"), F.col("block").alias("j"), *(F.col(x).alias(f"{x}_b") for x in ("component", "n", "pos", "bits")), F.col("doc_id").alias("b"))
    return _filtered(left.join(right, ["key", "i", "j"]).where(F.expr("component_a < component_b AND " + _NEAR) & _alike()))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = written(document_sets(docs), "sets")
    kinds = ["fp_a", "fp_b", "n"]
    classes = written(sets.where("n > 0").groupBy(*kinds).agg(F.min("doc_id").alias("class"), F.count("*").alias("size")), "classes")
    classed = written(sized_join(sets.where("n > 0").select("doc_id", *kinds), classes, kinds, "size").where("doc_id IS NOT NULL").select("doc_id", "class"), "classed")
    by_doc = written(classed.groupBy("doc_id").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first <> doc_id OR first <> last"), "by-doc")
    # Documents all of whose texts stand in an earlier class take no part in the search.
    copies = written(by_doc.where("last < doc_id").select("doc_id"), "copies")
    # Texts of one document are one node, an empty one too.
    mixed = by_doc.where("first <> last").select("doc_id").unionByName(sets.where("n = 0 AND doc_id IS NOT NULL").select("doc_id")).distinct()
    several = classed.join(mixed, "doc_id").select(F.col("doc_id").alias("u"), F.col("class").alias("v")).where("u <> v").distinct()

    without = lambda df: df.where("doc_id IS NOT NULL").join(checked_broadcast(copies, BROADCAST_ROWS), "doc_id", "left_anti")
    total = classes.agg(F.sum("n")).first()[0] or 0
    postings = postings_of(without(docs), total)
    lists = listed(postings, ["least", "n", "doc_id"])
    discard(postings)
    members = written(lists.select("doc_id").distinct(), "members")
    bits = written(without(sets).join(checked_broadcast(members, BROADCAST_ROWS), "doc_id", "left_semi").select("doc_id", "n", "bits").distinct(), "bits")
    side = lambda c: bits.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    alike = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(_alike()).select("a", "b").distinct()

    seen = written(alike(written(neighbours(lists), "pairs")), "likely")
    links = verified(seen, docs)
    groups = connected_components(links.selectExpr("a AS u", "b AS v").unionByName(several))
    grown = lambda: connected_components(links.selectExpr("a AS u", "b AS v").unionByName(groups.selectExpr("node AS u", "component AS v")))
    rows, turn = parted(lists.where("wide"), groups), 0
    size, pairs = crossing(rows)
    while pairs > CROSSING * size and turn < TURNS:
        likely = written(alike(shuffled(rows, turn)).join(seen, ["a", "b"], "left_anti"), "likely")
        links = verified(likely, docs)
        if links.isEmpty():
            break
        seen, groups, before, turn = seen.unionByName(likely), grown(), pairs, turn + 1
        rows = parted(rows, groups)
        size, pairs = crossing(rows)
        if pairs > LEFT * before:
            break
    likely = written(written(across(rows, bits), "pairs").join(seen, ["a", "b"], "left_anti"), "likely")
    links = verified(likely, docs)
    if not links.isEmpty():
        groups = grown()
    # A copy takes its class's component, a document of several texts that of its own node.
    stars = written(groups.withColumnRenamed("component", "own"), "components")
    rooted = written(classes.join(stars.withColumnRenamed("node", "class"), "class", "left").select(*kinds, "size", F.coalesce("own", "class").alias("root")), "roots")
    found = sized_join(sets.select("doc_id", *kinds), rooted, kinds, "size").join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own", "root", "doc_id").alias("component_id"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same rows from all pairs that share a shingle; reachability links them.
ORACLE_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' '))) END AS s FROM worded
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM entries x JOIN entries y ON x.h = y.h AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM sets UNION SELECT r.doc_id, e.v FROM reach r JOIN both_ways e ON r.c = e.u
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
