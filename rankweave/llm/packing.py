"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. The next segment for the open sequence
is the one that fits and whose demand vector has the largest dot product with what is left of the limits (both as
shares of the limits). When nothing fits, or only one more segment may come, a waiting document is cut so that its
piece fills the sequence. The last open sequence of a partition is cut at powers of two, which need no padding.

A plain document bears loss on every id, so for it the third limit is the first. Instruction data names a column with
the place where the response begins; then only the ids from there on bear loss, under a limit of their own.

Documents are packed within their partition, so there is no shuffle, and a recomputed partition gives the same rows.
Null texts are empty: a document of one id, the end mark. Repeated rows are packed once each; a null doc_id stays null;
other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed
from .tokens import text_chunks, word_hashes, words

LIMIT = 2048
MAX_SEGMENTS = 64
END_ID = 1
#: Waiting documents (by tokens) before sequences are formed: a choice of sizes at bounded memory.
WAITING = 256 * LIMIT
#: Entries of the word cache of a task.
CACHE = 600_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class WordEncoder:
    """Ids of whole texts, each different word encoded once a task.

    The vocabulary drops white space, so words are independent of one another. Words are told apart by a 64-bit hash;
    new ones are encoded many at a time, apart by a mark that is a word of its own.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(self.MARK)[0]
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.keys, self.start, self.length, self.ids, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, found: list[str]) -> None:
        """Add words, whose hashes are sorted, to the sorted table."""
        lengths, flat = [], []
        parts = [found[at : at + 64] for at in range(0, len(found), 64)]
        joined = [f" {self.MARK} ".join(x) for x in parts]
        for part, encoded in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part) - 1:  # a word holds the mark itself
                own = [self._ids(x) for x in part]
                lengths.append(np.array([len(x) for x in own]))
                flat.append(np.array([i for x in own for i in x], np.uint32))
                continue
            lengths.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            flat.append(np.delete(ids, marks))
        length, new = np.concatenate(lengths), np.concatenate(flat)
        while len(self.ids) < self.used + len(new):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        start = self.used + np.cumsum(length) - length
        self.used += len(new)
        at = np.searchsorted(self.keys, keys)
        self.start, self.length, self.keys = np.insert(self.start, at, start), np.insert(self.length, at, length), np.insert(self.keys, at, keys)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids with the end mark after them) of every text."""
        for row, _, data, offsets in text_chunks(column):
            if len(self.keys) > CACHE:
                self.clear()
            starts, ends, bounds = words(data, offsets)
            keys, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, keys)
            fresh = np.ones(len(keys), bool)
            if len(self.keys):
                fresh = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
            if fresh.any():
                raw = data.tobytes()
                self._learn(keys[fresh], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)])
                at = np.searchsorted(self.keys, keys)
            start, length = self.start[at][inverse], self.length[at][inverse]
            before = np.concatenate([[0], np.cumsum(length)])
            cuts = before[bounds]
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            out = np.full(before[-1] + len(bounds) - 1, END_ID, np.uint32)
            shift = np.repeat(start - before[:-1], length)
            places = np.arange(before[-1])
            out[places + np.repeat(owner, length)] = self.ids[places + shift]
            for k in range(len(bounds) - 1):
                yield row + k, out[cuts[k] + k : cuts[k + 1] + k + 1]


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so later tasks find the words of earlier ones; its size is bounded by CACHE."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


class Packer:
    """Places (document, ids, loss share) into sequences; ``rows`` holds finished pieces."""

    def __init__(self, first_id: int, limit: int = LIMIT, max_segments: int = MAX_SEGMENTS, max_loss: int = LIMIT):
        self.limit, self.max_segments, self.max_loss = limit, max_segments, max_loss
        self.next_id, self.rows = first_id, []
        self.waiting: dict[int, deque] = defaultdict(deque)  # by the demand vector: tokens * 65536 + loss-bearing ones
        self.tokens = 0

    def add(self, doc, ids: np.ndarray, loss: int | None = None) -> None:
        """``loss``: loss-bearing ids, the last ones of the document (a response follows its prompt); default all."""
        loss = len(ids) if loss is None else loss
        at = 0
        while len(ids) - at >= self.limit and self.max_loss >= self.limit:
            self._emit([(doc, ids, at, self.limit, loss)])
            at += self.limit
        if at < len(ids):
            self._wait((doc, ids, at, len(ids) - at, loss))

    @staticmethod
    def _loss(piece) -> int:
        _, ids, at, n, loss = piece
        return max(0, at + n - max(at, len(ids) - loss))

    def _wait(self, piece) -> None:
        self.waiting[piece[3] << 16 | self._loss(piece)].append(piece)
        self.tokens += piece[3]

    def _take(self, key: int):
        piece = self.waiting[key].popleft()
        if not self.waiting[key]:
            del self.waiting[key]
        self.tokens -= piece[3]
        return piece

    def _emit(self, pieces) -> None:
        offset = 0
        for piece in pieces:
            doc, ids, at, n, _ = piece
            self.rows.append((doc, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), len(ids), self.next_id, offset, self._loss(piece)))
            offset += n
        self.next_id += 1

    def _cut(self, piece, n: int):
        doc, ids, at, m, loss = piece
        if m > n:
            self._wait((doc, ids, at + n, m - n, loss))
        return doc, ids, at, min(n, m), loss

    def pack_one(self) -> list:
        room, left, loss = self.limit, self.max_segments, self.max_loss
        chosen = []
        while room and left and loss and self.waiting:
            keys = np.fromiter(self.waiting, np.int64, len(self.waiting))
            tokens, bearing = keys >> 16, keys & 65535
            fits = (tokens == room if left == 1 else tokens <= room) & (bearing <= loss)
            if fits.any():
                score = tokens / self.limit * (room / self.limit) + left / self.max_segments**2 + bearing / self.max_loss * (loss / self.max_loss)
                piece = self._take(int(keys[np.argmax(np.where(fits, score, -1.0))]))
            else:
                # Nothing fits whole: the largest is cut at what is left of the tighter limit.
                piece = self._take(int(keys[np.argmax(tokens)]))
                n = min(room, piece[3])
                over = self._loss((*piece[:3], n, piece[4])) - loss
                if over >= n:
                    self._wait(piece)
                    break
                piece = self._cut(piece, n - max(0, over))
            chosen.append(piece)
            room, left, loss = room - piece[3], left - 1, loss - self._loss(piece)
        return chosen

    def form(self, last: bool = False) -> None:
        while self.waiting and (last or self.tokens >= WAITING):
            pieces = self.pack_one()
            n = sum(x[3] for x in pieces)
            if n == self.limit or not last or self.waiting:
                self._emit(pieces)
                continue
            sizes = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
            while sizes:
                size, own = sizes.pop(0), []
                while size:
                    doc, ids, at, m, loss = pieces.pop(0)
                    if m > size:
                        pieces.insert(0, (doc, ids, at + size, m - size, loss))
                    own.append((doc, ids, at, min(m, size), loss))
                    size -= own[-1][3]
                self._emit(own)


def pack_documents(docs: DataFrame, tokenizer: str, *, limit: int = LIMIT, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, response_start: str | None = None) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text) with their place; ``tokenizer`` is a vocabulary file's path.

    ``response_start``: a column with the code point from which a text bears loss (a word that it cuts belongs to the
    prompt; null or negative: from the first, beyond the end: the end mark alone). ``max_loss``: loss-bearing ids of a
    sequence, by default ``limit``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, limit, max_segments, max_loss or limit)

        def rows() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                columns = list(zip(*packer.rows, strict=True))
                packer.rows.clear()
                yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            loss = loss_bearing(encoder, batch.column(1).to_pylist(), batch.column(2).to_pylist()) if response_start else None
            for row, tokens in encoder.encode(batch.column(1)):
                packer.add(ids[row], tokens, None if loss is None or loss[row] is None else len(tokens) - loss[row])
                if packer.tokens >= 2 * WAITING:
                    packer.form()
                if len(packer.rows) > 4096:
                    yield from rows()
        packer.form(last=True)
        yield from rows()

    return docs.select("doc_id", "text", *([F.col(response_start).cast("long")] if response_start else [])).mapInArrow(trimmed(run), SCHEMA)


def loss_bearing(encoder: WordEncoder, texts: list[str | None], starts: list[int | None]) -> list[int | None]:
    """By row the ids of its prompt: of the words that begin before the response; null for a text without a prompt."""
    prompts = []
    for text, start in zip(texts, starts, strict=True):
        end = min(max(start or 0, 0), len(text or ""))
        while text and 0 < end < len(text) and not (_is_space(text[end - 1]) or _is_space(text[end])):
            end += 1
        prompts.append((text or "")[:end])
    sizes = {row: len(ids) - 1 for row, ids in encoder.encode(pa.array(prompts, pa.string()))}
    return [sizes[k] if start is not None and start > 0 else None for k, start in enumerate(starts)]


def _is_space(x: str) -> bool:
    return x in " \t\n\v\f\r"


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return pack_documents(table(spark, sf_dir, "documents"), word_vocabulary())
