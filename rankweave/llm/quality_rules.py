"""Line-first quality rules: every line is judged first, then the document by how much of it is left.

A line fails when one of these holds (rules on UTF-8 bytes, whole texts):

* punctuation: symbols ``[#*$%&|<>]`` make up over a tenth of its non-space bytes, or it has a run-on of ``!`` (as many
  as a third of its words, two at least), or it has over ``long_line`` words and does not end in a closing mark;
* navigation: separators (``|``, ``>``, ``/`` or a bullet, standing alone) are three or more and a fifth of its words;
* boilerplate: it holds one of ``BOILERPLATE``, or equals an earlier line of its document.

Failing lines go. A document is kept when the base rules pass and the lines left hold at least ``min_left`` of its
word characters. Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are judged one
by one, rows without a doc_id too; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import trimmed
from .tokens import CHUNK, LOWER, SPACE, mix, shingle_hashes, text_chunks, word_hashes, words

#: Phrases of site furniture, matched in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript", "log in to", "privacy policy",
    "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use",
)
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CLOSING = np.isin(np.arange(256), np.frombuffer(b".!?:;,\"')]}", np.uint8))
#: Closing marks outside ASCII.
CLOSING_WIDE = tuple(x.encode() for x in "。！？…”’»」』）")
BULLETS = tuple(x.encode() for x in ("|", ">", "/", "•", "·", "»", "-"))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, chars_left long"


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _repeats(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether it equals an earlier one of its owner, and whether it occurs twice or more there."""
    keys = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return later, counts[inverse] > 1


def judge(data: np.ndarray, offsets: np.ndarray, long_line: int, min_left: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts and verdicts of each document in a chunk; the start, end and owner of each line and whether it stays."""
    n_docs = len(offsets) - 1
    starts, ends, bounds = words(data, offsets)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n_docs), n_words)
    solid = ~SPACE[data] if len(data) else np.zeros(0, bool)
    points = solid & ((data & 0xC0) != 0x80)
    symbols = SYMBOLS[data]
    out = {"n_words": n_words, "word_chars": _sums(points, offsets[:-1], offsets[1:]), "n_symbols": _sums(symbols, offsets[:-1], offsets[1:])}

    hashes = word_hashes(data, starts, ends)
    windows, cuts = shingle_hashes(hashes, bounds, 3)
    size = np.where(n_words >= 3, np.diff(cuts), 0)  # a shorter text has no window
    of = np.repeat(np.arange(n_docs), np.diff(cuts))
    real = n_words[of] >= 3
    twice = np.zeros(len(windows), bool)
    if real.any():
        twice[real] = _repeats(windows[real], of[real])[1]
    at = (np.arange(len(windows)) - np.repeat(cuts[:-1], np.diff(cuts)) + np.repeat(bounds[:-1], np.diff(cuts)))[twice]
    covered = np.zeros(len(starts) + 3, bool)
    for k in range(3):
        covered[at + k] = True
    out["n_repeat_words"] = _sums(covered[: len(starts)], bounds[:-1], bounds[1:])
    del size

    feeds = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], feeds + 1])
    line_owner = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, feeds, "right") - 1])
    # A feed at the very end of a document starts an empty line of that document, before the next one's first line.
    order = np.lexsort((line_owner, line_start))
    line_start, line_owner = line_start[order], line_owner[order]
    until = np.concatenate([feeds, [len(data)]])
    line_end = np.minimum(until[np.searchsorted(feeds, line_start)], offsets[1:][line_owner])
    w0, w1 = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    count = w1 - w0
    has = count > 0
    later = np.zeros(len(line_start), bool)
    if has.any():
        later[has] = _repeats(word_hashes(data, line_start[has], line_end[has]), line_owner[has])[0]
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n_docs)

    bytes_in = _sums(solid, line_start, line_end)
    shouts = _sums(data == 33, line_start, line_end)
    last = ends[np.maximum(w1 - 1, 0)] - 1 if len(ends) else np.zeros(len(line_start), np.int64)
    closed = CLOSING[data[last]] if len(ends) else np.zeros(len(line_start), bool)
    for k in np.flatnonzero(has & ~closed & (count > long_line)):
        closed[k] = bytes(data[max(last[k] - 2, 0) : last[k] + 1]).endswith(CLOSING_WIDE)
    lone = np.zeros(len(starts), bool)
    short = np.flatnonzero(ends - starts <= 3)
    first = data[starts[short]] if len(short) else np.zeros(0, np.uint8)
    for mark in BULLETS:
        like = short[(first == mark[0]) & (ends[short] - starts[short] == len(mark))]
        for k, byte in enumerate(mark[1:], 1):
            like = like[data[starts[like] + k] == byte]
        lone[like] = True
    separators = _sums(lone, w0, w1)
    bad = (10 * _sums(symbols, line_start, line_end) > bytes_in) | ((shouts >= 2) & (3 * shouts >= count)) | ((count > long_line) & ~closed)
    bad |= (separators >= 3) & (5 * separators >= count)
    bad |= later
    lowered = LOWER[data].tobytes()
    for phrase in BOILERPLATE:
        found = lowered.find(phrase.encode())
        while found >= 0:
            k = int(np.searchsorted(line_start, found, "right")) - 1
            bad[k] |= found + len(phrase) <= line_end[k]
            found = lowered.find(phrase.encode(), found + 1)
    stays = has & ~bad
    left = np.bincount(line_owner, weights=_sums(points, line_start, line_end) * stays, minlength=n_docs).astype(np.int64)
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    out["kept"] = ~out["base_failed"] & (left >= min_left * out["word_chars"])
    out |= {"n_lines": np.bincount(line_owner[has], minlength=n_docs), "n_lines_removed": np.bincount(line_owner[has & bad], minlength=n_docs), "chars_left": left}
    return out, line_start, line_end, line_owner, stays


def quality_rules(docs: DataFrame, *, long_line: int = 80, min_left: float = 0.5, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``kept`` and, if asked, the cleaned text.

    A map over partitions without a shuffle; memory is bounded by a chunk of text or the longest document.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1), CHUNK):
                found, line_start, line_end, owner, stays = judge(data, offsets, long_line, min_left)
                columns = [batch.column(0)[row:end], *(pa.array(found[x]) for x in names)]
                if with_text:
                    lines: list[list[bytes]] = [[] for _ in range(end - row)]
                    for k in np.flatnonzero(stays):
                        lines[owner[k]].append(data[line_start[k] : line_end[k]].tobytes())
                    columns.append(pa.array([b"\n".join(x).decode("utf-8", "replace") for x in lines], pa.string()))
                yield pa.record_batch(columns, ["doc_id", *names, *["clean_text"] * with_text])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA + ", clean_text string" * with_text)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return quality_rules(table(spark, sf_dir, "documents"))
