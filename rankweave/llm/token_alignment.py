"""Alignment of two tokenizers' tokens of one text, and counts of linked ids over a corpus.

Token ends are bits over a text's bytes, one packed bitset a tokenizer. The AND of both marks the cuts at which a token
of either ends; popcount ranks at the cuts give the range of tokens of each side between two cuts, and selecting by
rank gives bytes back. Links expand from the ranges: by rule ``ends`` the two tokens that end together at a cut, by rule
``groups`` every token of the one side with every token of the other between two cuts.

Texts repeat their words, so they are cut at a space that follows a character other than white space. There either
tokenizer starts anew (no piece of the one holds a mark of a space but at its start, no pre-token of the other has white
space but at its start), so ids of a text are those of its segments in order, and such a place is a cut. Each different
segment is encoded and aligned once a worker, many together in one bitset. ``segment_safe`` holds this against a given
vocabulary.

Documents are taken in folds of about ``FOLD`` bytes, each one row of a written table: counts by document, a bag of
segments by document, and the fold's distinct linked id pairs. A fold asks for the corpus-wide count of each of its
pairs once, so a pair that all documents hold is one row a fold, and what a task holds is bounded by a fold (or one
long text). Counts cover all documents; nothing is broadcast or capped.

A text that is null or empty, or whose tokens' bytes are not the text's, has no tokens: zeros and an empty digest. Rows
with a null or repeated doc_id are handled one by one; other columns are ignored. An empty table gives an empty result.
Special tokens' strings are plain text. Long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fill_in_middle import raw_texts
from .shared import small_batches, table, trimmed, written

#: Bytes of text of a fold of documents, and of the documents that are encoded together.
FOLD, BATCH = 8 << 20, 1 << 20
#: Different segments, and their bytes with what is known of them, that a worker keeps from one fold to the next.
CACHE, CACHE_BYTES = 600_000, 64 << 20
#: Segments that are encoded as one text.
PACK = 256
B_BITS = 32
RULES = ("ends", "groups")
_FOLDS = (
    "fold long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "bag_sizes binary, bag_segments binary, bag_counts binary, link_sizes binary, link_pairs binary, pairs array<long>, counts array<long>"
)
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# Bitsets: bit k of word k // 64 says that a token ends after byte k.


def bitset(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """Packed bits of the (exclusive) ends of tokens over ``n_bytes`` bytes."""
    bits = np.zeros(-(-n_bytes // 64) * 64, np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def ranks(bits: np.ndarray) -> np.ndarray:
    """Bits before each word, and their number after the last."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])


def rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits among the first ``at`` bits, for each of ``at``."""
    word, rest = at >> 6, (at & 63).astype(np.uint64)
    padded = np.append(bits, np.uint64(0))[word] & ((np.uint64(1) << rest) - np.uint64(1))
    return before[word] + np.bitwise_count(padded)


def select(bits: np.ndarray) -> np.ndarray:
    """Ends (exclusive) in order: place of the first, second, ... set bit, plus one."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")) + 1


def align(a_ends: np.ndarray, b_ends: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, A tokens before the end of each group, B tokens likewise) from the ends of both sides' tokens."""
    a, b = bitset(a_ends, n_bytes), bitset(b_ends, n_bytes)
    cuts = select(a & b)
    return cuts, rank(a, ranks(a), cuts), rank(b, ranks(b), cuts)


def links(a_upto: np.ndarray, b_upto: np.ndarray, rule: str = "ends") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, index of the A token, index of the B token) of every link, by group."""
    if rule == "ends":
        return np.arange(len(a_upto)), a_upto - 1, b_upto - 1
    a_from, b_from = np.concatenate([[0], a_upto[:-1]]), np.concatenate([[0], b_upto[:-1]])
    wide = b_upto - b_from
    size = (a_upto - a_from) * wide
    group = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    return group, a_from[group] + k // np.maximum(wide, 1)[group], b_from[group] + k % np.maximum(wide, 1)[group]


class Vocabulary:
    """Ids of segments, and the bytes that each id stands for."""

    bytes: list[bytes]
    size: np.ndarray

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, each of which starts with a space."""
        raise NotImplementedError

    def encode_segments(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all segments in order, their number by segment, whether they give the segment's bytes).

        Segments that a space may follow are encoded many together and told apart by the bytes of their tokens; where
        these are not the segments' own, each is encoded by itself.
        """
        packs, at = [], 0
        while at < len(parts):
            end = at + 1
            while end < len(parts) and end - at < PACK and _sure_end(parts[end - 1]):
                end += 1
            packs.append((at, end))
            at = end
        counts, ok, flat = np.zeros(len(parts), np.int64), np.ones(len(parts), bool), []
        joined = [b"".join(parts[a:b]) for a, b in packs]
        for (a, b), raw, ids in zip(packs, joined, self.encode([x.decode("utf-8", "replace") for x in joined]), strict=True):
            own = np.array(ids, np.int64)
            ends, want = np.cumsum(self.size[own]), np.cumsum([len(x) for x in parts[a:b]])
            upto = np.searchsorted(ends, want, "right")
            if b"".join(map(self.bytes.__getitem__, ids)) == raw and (upto > 0).all() and (ends[upto - 1] == want).all():
                counts[a:b] = np.diff(upto, prepend=0)
                flat.append(own)
                continue
            for k, ids_of_one in zip(range(a, b), self.encode([x.decode("utf-8", "replace") for x in parts[a:b]]), strict=True):
                counts[k], ok[k] = len(ids_of_one), b"".join(map(self.bytes.__getitem__, ids_of_one)) == parts[k]
                flat.append(np.array(ids_of_one, np.int64))
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), counts, ok


class ByteLevel(Vocabulary):
    """The byte-level vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The byte alphabet: printable bytes stand for themselves, the others, in order, for code points from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in own]
        byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(others)}
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for piece, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.size = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Vocabulary):
    """The piece vocabulary; a text loses its first space, which the encoder puts before it."""

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace(self.SPACE, " ").encode() for k, x in enumerate(pieces)]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.space = self.model.piece_to_id(self.SPACE)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids if text != " " else [self.space] for text, ids in zip(texts, self.model.encode([x[1:] for x in texts], num_threads=1), strict=True)]


def segment_safe(pieces: Pieces) -> bool:
    """Whether no piece holds the mark of a space but at its start, so that none joins two segments."""
    return not any(b" " in x.lstrip(b" ") for x in pieces.bytes)


def segments(raw: bytes) -> list[bytes]:
    """Parts of a text (which starts with a space), cut at each space after a character that is surely no white space.

    Sure are printable ASCII and two-byte characters led by C3 or more: no white space of any definition is among them.
    """
    data = np.frombuffer(raw, np.uint8)
    sure = (data > 0x20) & (data < 0x7F)
    sure[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    cuts = np.flatnonzero((data[1:] == 0x20) & sure[:-1]) + 1
    return [raw[a:b] for a, b in pairwise([0, *cuts.tolist(), len(raw)])]


def _sure_end(part: bytes) -> bool:
    return 0x20 < part[-1] < 0x7F or (part[-1] >= 0x80 and 0xC3 <= part[-2] < 0xE0)


class Aligner:
    """Aligned segments, each different one once; ``index`` gives the place of its figures."""

    def __init__(self, a_path: str, b_path: str, rule: str):
        self.a, self.b, self.rule = ByteLevel(a_path), Pieces(b_path), rule
        if not segment_safe(self.b):
            raise ValueError("a piece holds a space after its start: segments cannot be encoded apart")
        #: Ids as text with what follows them: A's by "," or, the last of a group, "|"; B's by "," or ";".
        self.rendered = [f"{k}{x}" for v, marks in ((self.a, ",|"), (self.b, ",;")) for k in range(len(v.bytes)) for x in marks]
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        #: By segment: ids of groups as text; (tokens of A, of B, groups, links, whether both sides give its bytes); where its links start.
        self.texts: list[str] = []
        self.figures = np.zeros((1 << 14, 5), np.int64)
        self.starts = np.zeros(1 << 14, np.int64)
        self.pairs, self.n_pairs = np.zeros(1 << 16, np.int64), 0

    def trim(self) -> None:
        if len(self.index) > CACHE or self.held > CACHE_BYTES:
            self.clear()

    def links_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links by segment, their pairs in the order of the segments)."""
        n = self.figures[places, 3]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[places], n)
        return n, self.pairs[at]

    def learn(self, fresh: list[bytes]) -> None:
        """Encode new segments, and align all of them over one bitset, in which each starts where the last one ends."""
        (a, n_a, ok_a), (b, n_b, ok_b) = (v.encode_segments(fresh) for v in (self.a, self.b))
        ok = ok_a & ok_b
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        size = np.where(ok, [len(x) for x in fresh], 0)
        cuts, a_upto, b_upto = align(np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b]), int(size.sum())) if ok.any() else (np.zeros(0, np.int64),) * 3
        group, a_at, b_at = links(a_upto, b_upto, self.rule)
        pair = a[a_at] << B_BITS | b[b_at]
        upto = np.concatenate([[0], np.searchsorted(cuts, np.cumsum(size), "right")])  # groups up to the end of each segment
        link_upto = np.searchsorted(group, upto)
        old, new = len(self.texts), len(fresh)
        while len(self.starts) < old + new:
            self.figures, self.starts = np.concatenate([self.figures, np.zeros_like(self.figures)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.pairs) < self.n_pairs + len(pair):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.figures[old : old + new] = np.stack([n_a, n_b, np.diff(upto), np.diff(link_upto), ok], axis=1)
        self.starts[old : old + new] = self.n_pairs + link_upto[:-1]
        self.pairs[self.n_pairs : self.n_pairs + len(pair)] = pair
        self.n_pairs += len(pair)
        strings = self._strings(a, b, a_upto, b_upto)
        tokens = np.concatenate([[0], np.cumsum(np.where(ok, n_a + n_b, 0))]).tolist()
        self.texts += ["".join(strings[p:q])[:-1] for p, q in pairwise(tokens)]
        self.index.update(zip(fresh, range(old, old + new), strict=True))
        self.held += int(size.sum()) + 8 * len(pair) + sum(map(len, self.texts[old:]))

    def _strings(self, a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> list[str]:
        """Tokens as text in the order of their groups, A's of a group before B's."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a_upto - 1], last_b[b_upto - 1] = 1, 1
        codes = np.concatenate([2 * a + last_a, 2 * (len(self.a.bytes) + b) + last_b])
        group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
        return list(map(self.rendered.__getitem__, codes[np.argsort(group, kind="stable")].tolist()))

    def take(self, texts: list[bytes]) -> list[np.ndarray]:
        """The places of the segments of each text."""
        parts = [segments(raw) for raw in texts]
        fresh = list({x: None for own in parts for x in own if x not in self.index})
        for at in range(0, len(fresh), 32_768):
            self.learn(fresh[at : at + 32_768])
        return [np.fromiter(map(self.index.__getitem__, own), np.int64, len(own)) for own in parts]


@lru_cache(2)
def aligner(a_path: str, b_path: str, rule: str) -> Aligner:
    """One a worker process, so later tasks find the segments of earlier ones."""
    return Aligner(a_path, b_path, rule)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, "<u4").tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd"), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)


class _Fold:
    """Documents of one fold, as they come; they are encoded some ``BATCH`` bytes at a time."""

    def __init__(self, known: Aligner):
        self.known, self.rows, self.bags, self.bytes = known, [], [], 0
        self.waiting, self.waits = [], 0

    def add(self, doc_id, raw: bytes) -> None:
        self.bytes += len(raw) + 64
        self.waits += len(raw)
        self.waiting.append((doc_id, b" " + raw if raw else b""))
        if self.waits >= BATCH:
            self.encode()

    def encode(self) -> None:
        whole = [raw for _, raw in self.waiting if raw]
        found = iter(self.known.take(whole))
        for doc_id, raw in self.waiting:
            self._document(doc_id, next(found) if raw else np.zeros(0, np.int64))
        self.waiting, self.waits = [], 0

    def _document(self, doc_id, places: np.ndarray) -> None:
        bag, counts = np.unique(places, return_counts=True)
        figures = self.known.figures[bag]
        if not len(bag) or not figures[:, 4].all():
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            self.bags.append((bag[:0], counts[:0]))
            return
        digest = hashlib.sha256()
        for at in range(0, len(places), 65536):
            digest.update((";" * (at > 0) + ";".join(map(self.known.texts.__getitem__, places[at : at + 65536].tolist()))).encode())
        self.rows.append((doc_id, *(counts @ figures[:, :4]).tolist(), digest.hexdigest()))
        self.bags.append((bag, counts))

    def row(self, number: int) -> pa.RecordBatch:
        self.encode()
        sizes = np.array([len(x) for x, _ in self.bags])
        counts = np.concatenate([x for _, x in self.bags])
        places, local = np.unique(np.concatenate([x for x, _ in self.bags]), return_inverse=True)
        link_sizes, all_links = self.known.links_of(places)
        pairs, link = np.unique(all_links, return_inverse=True)
        times = np.bincount(local, counts, len(places))
        totals = np.bincount(link, np.repeat(times, link_sizes), len(pairs)).astype(np.int64)
        columns = [list(x) for x in zip(*self.rows, strict=True)]
        longs = pa.list_(pa.int64())
        arrays = [pa.array([number], pa.int64()), *(pa.array([x], longs) for x in columns[:5]), pa.array([columns[5]], pa.list_(pa.string()))]
        arrays += [pa.array([_packed(x)], pa.binary()) for x in (sizes, local, counts, link_sizes, link)] + [pa.array([x.tolist()], longs) for x in (pairs, totals)]
        return pa.record_batch(arrays, [x.split()[0] for x in _FOLDS.split(", ")])


def _folds(a_path: str, b_path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(a_path, b_path, rule), TaskContext.get().partitionId() << 32
        fold = _Fold(known)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                fold.add(doc_id, raw)
                if fold.bytes >= FOLD:
                    yield fold.row(number)
                    known.trim()
                    number, fold = number + 1, _Fold(known)
        if fold.bytes:
            yield fold.row(number)
            known.trim()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds with the answers to their pairs, as documents."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            x = {name: batch.column(name)[k] for name in batch.schema.names}
            n = len(x["doc_ids"])
            asked = x["pairs"].values.to_numpy() if len(x["pairs"]) else np.zeros(0, np.int64)
            answers = x["answers"].values
            found = [answers.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "total", "best")] if answers is not None else [np.zeros(0, np.int64)] * 3
            if len(found[0]) != len(asked):
                raise RuntimeError(f"fold {x['fold'].as_py()} asked for {len(asked)} pairs and got {len(found[0])}")
            order = np.argsort(found[0], kind="stable")
            total, best = found[1][order].astype(np.int64), found[2][order].astype(np.int64)
            bag_sizes = _unpacked(x["bag_sizes"].as_py(), n)
            segment, counts = (_unpacked(x[c].as_py(), int(bag_sizes.sum())) for c in ("bag_segments", "bag_counts"))
            link_sizes = _unpacked(x["link_sizes"].as_py(), int(segment.max(initial=-1)) + 1)
            link = _unpacked(x["link_pairs"].as_py(), int(link_sizes.sum()))
            upto, bag_upto = (np.concatenate([[0], np.cumsum(s)]) for s in (link_sizes, bag_sizes))
            sums = []
            for value in (best, total):
                by_segment = np.diff(np.concatenate([[0], np.cumsum(value[link])])[upto])
                sums.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(by_segment[segment] * counts)])[bag_upto]).astype(np.int64)))
            columns = [x[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.record_batch([*columns, *sums, x["digests"].values], names)


def pair_counts(folds: DataFrame) -> DataFrame:
    """(pair, total, best) over the corpus; ``best`` is 1 where no pair with this B id has a higher count.

    Folds have summed their own pairs, so a pair is at most one row a fold; those of a B id are at most A's vocabulary.
    """
    totals = folds.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))
    return totals.withColumn("b", b_id).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, rule: str = "ends") -> DataFrame:
    """``SCHEMA`` for every row of ``docs`` (doc_id, text)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    folds = written(docs.select("doc_id", "text").mapInArrow(trimmed(_folds(a_path, b_path, rule)), _FOLDS), "folds")
    counts = written(pair_counts(folds), "pairs")
    asked = folds.select("fold", F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").groupBy("fold").agg(F.collect_list(F.struct("pair", "total", "best")).alias("answers"))
    small_batches(docs.sparkSession, 8)  # a row is a fold
    return folds.drop("counts").join(answers, "fold", "left").mapInArrow(trimmed(_documents), SCHEMA)


def linked_ids(docs: DataFrame, a_path: str, b_path: str, *, rule: str = "ends") -> DataFrame:
    """(a_id, b_id, total, best): the corpus-wide table of linked ids."""
    folds = written(docs.select("doc_id", "text").mapInArrow(trimmed(_folds(a_path, b_path, rule)), _FOLDS), "folds")
    return pair_counts(folds).select(F.shiftright("pair", B_BITS).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b_id"), "total", F.col("best").cast("boolean").alias("best"))


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), *vocabularies())
