"""Fill-in-the-middle transformation over run-length classes.

A text is stored as its maximal runs of one character class, each with the number of units that end up to its end. A cut
after k units is found by binary search for the run that contains it, and its place by arithmetic inside that run; no
list of units is made. In units of lines the classes are line ends (each ends a unit) and all else (which ends none,
but for the text's last run). In units of words they are white space and all else, in units of characters the widths in
UTF-8, where a run of m characters holds m units of equal size.

All is done in bytes of UTF-8, so a text costs its bytes and, for its runs, 24 bytes each.

Cuts, the choice to transform at all and the order of the pieces come from the SHA-256 of seed and doc_id, so they do
not depend on order, partition or run. A null text is empty and stays plain, as does a text that holds a sentinel; a row
with a null doc_id has no hash and stays plain. Repeated rows are handled one by one; other columns are ignored, names
that clash included. An empty table gives an empty result. Very long texts are handled whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import table, trimmed
from .tokens import SPACE

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
UNITS = ("lines", "words", "chars")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Runs:
    """``start`` and ``units`` have one entry a run and one more: where it starts, how many units end before it.

    ``step``: bytes of each unit inside the run; 0 where the run as a whole ends one unit at most.
    """

    start: np.ndarray
    units: np.ndarray
    step: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def place(self, k: int) -> int:
        """The byte after the first ``k`` units."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.units, k)) - 1  # units[run] < k <= units[run + 1]
        step = int(self.step[run])
        return int(self.start[run]) + (k - int(self.units[run])) * step if step else int(self.start[run + 1])


def _bounds(classes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1]) if len(classes) else np.zeros(0, np.int64)


def encode_runs(data: np.ndarray, unit: str = "lines") -> Runs:
    """Runs of the bytes of one text; an empty text has none and no units."""
    at = np.arange(0)
    if unit == "chars":  # classes of whole characters: their widths
        at = np.flatnonzero((data & 0xC0) != 0x80)
        classes = np.diff(at, append=len(data)).astype(np.int8)
        first = _bounds(classes)
        units, step = np.diff(first, append=len(classes)), classes[first].astype(np.int64)
        start = at[first]
    else:
        ends = data == 10 if unit == "lines" else SPACE[data]
        start = _bounds(ends.view(np.int8))
        kind, last = ends[start], np.zeros(len(start), bool)
        last[-1:] = True
        if unit == "lines":
            units, step = np.where(kind, np.diff(start, append=len(data)), last), np.where(kind, 1, 0)
        else:  # white space belongs to the word after it, at the end of the text it is a unit of its own
            units, step = np.where(kind, last, 1), np.zeros(len(start), np.int64)
    return Runs(np.append(start, len(data)).astype(np.int64), np.concatenate([[0], np.cumsum(units)]).astype(np.int64), step.astype(np.int64))


@dataclass(frozen=True)
class Rule:
    """``apply_percent`` of the texts are transformed, ``spm_percent`` of these begin with their suffix."""

    seed: str = "7"
    unit: str = "lines"
    apply_percent: int = 100
    spm_percent: int = 50
    prefix: bytes = PREFIX
    suffix: bytes = SUFFIX
    middle: bytes = MIDDLE

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle

    def draws(self, doc_id: int) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{doc_id}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


@dataclass(frozen=True)
class Transformed:
    n: int
    form: str
    output: bytes
    pieces: tuple[bytes, bytes, bytes] | None  # prefix, middle, suffix


def transform(raw: bytes, doc_id: int | None, rule: Rule = Rule()) -> Transformed:
    """One text's output: plain, or its three pieces in the order of its form."""
    runs = encode_runs(np.frombuffer(raw, np.uint8), rule.unit)
    if not raw or doc_id is None or any(mark in raw for mark in rule.marks):
        return Transformed(runs.n, "plain", raw, None)
    h1, h2, h3, h4 = rule.draws(doc_id)
    if h3 % 100 >= rule.apply_percent:
        return Transformed(runs.n, "plain", raw, None)
    low, high = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    a, b = runs.place(low), runs.place(high)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < rule.spm_percent:
        return Transformed(runs.n, "spm", b"".join([rule.suffix, suffix, rule.prefix, prefix, rule.middle, middle]), (prefix, middle, suffix))
    return Transformed(runs.n, "psm", b"".join([rule.prefix, prefix, rule.suffix, suffix, rule.middle, middle]), (prefix, middle, suffix))


def restore(output: bytes, form: str, rule: Rule = Rule()) -> bytes:
    """The text, from output and form alone. A sentinel does not overlap itself and is in no piece, so its first place is the mark."""
    if form == "plain":
        return output
    first, second = (rule.suffix, rule.prefix) if form == "spm" else (rule.prefix, rule.suffix)
    cut = output.index(second, len(first))
    mid = output.index(rule.middle, cut + len(second))
    one, two, middle = output[len(first) : cut], output[cut + len(second) : mid], output[mid + len(rule.middle) :]
    return two + middle + one if form == "spm" else one + middle + two


def _code_points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow string column, null as empty, without decoding."""
    part = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1].tolist()
    data = memoryview(part.buffers()[2] or b"")
    for a, b in pairwise(offsets):
        yield bytes(data[a:b])


def fim_documents(docs: DataFrame, rule: Rule = Rule(), *, with_output: bool = False) -> DataFrame:
    """``SCHEMA`` for every row of ``docs`` (doc_id, text); ``with_output`` adds the training text itself.

    One pass over the rows where they are: no shuffle, and a lost task is simply run again with the same result.
    """
    if rule.unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    marks = rule.marks
    if not all(marks) or any(a != b and b in a for a in marks for b in marks) or len(set(marks)) < 3 or any(m[:k] == m[-k:] for m in marks for k in range(1, len(m))):
        raise ValueError("sentinels are three different strings, none part of another, none beginning as it ends")
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["output"] * with_output
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * with_output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, raw_texts(batch.column(1)), strict=True):
                x = transform(raw, doc_id, rule)
                chars = [_code_points(p) for p in x.pieces[:2]] if x.pieces is not None else [None, None]
                digests = [hashlib.sha256(y).hexdigest() for y in (x.output, restore(x.output, x.form, rule))]
                rows.append([doc_id, x.n, x.form, *chars, *digests] + [x.output.decode()] * with_output)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA + ", output string" * with_output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fim_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), c AS (
    SELECT *, len(l) AS n, ('0x' || h[1:8])::UBIGINT % (len(l) + 1) AS c1, ('0x' || h[9:16])::UBIGINT % (len(l) + 1) AS c2,
           CASE WHEN t = '' OR h IS NULL OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 THEN 'plain'
                WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT *, array_to_string(l[1:CAST(least(c1, c2) AS BIGINT)], '') AS prefix, array_to_string(l[CAST(least(c1, c2) AS BIGINT) + 1:CAST(greatest(c1, c2) AS BIGINT)], '') AS middle,
           array_to_string(l[CAST(greatest(c1, c2) AS BIGINT) + 1:], '') AS suffix
    FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
