"""Contour files: blocks of attributes and points between braces, read strictly.

A block opens with ``{`` and closes with ``}`` or ``},``; inside come attributes ``[Key=value]``, then points ``{ x, y }``
with or without a comma after them, one a line. Empty lines and lines that start with ``;`` say nothing. Every block has
a known label, each at most once; the blocks of both lungs must be there and closed contours. A contour loses repeated
neighbours and an explicit closing point (the places that went are told) and must be simple, with an area, inside the
canvas. A fault ends the file: its kind, and the byte at which its line begins.

Three ways in: ``parsed`` takes contents that are a column already, ``contours`` reads files through Spark's own reader,
so from any store that Spark reaches, and the data source ``pfs`` reads them one split a file where Arrow's file systems
reach (local disks and those Arrow has drivers for).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.raster import pack, polygon_contour, rasterize
from ..operators.contracts import ContractError
from .readers import files

#: Labels of the format, the canvas, and the most bytes of a file.
NAMES = ("right lung", "left lung", "heart", "right clavicle", "left clavicle")
LABELS = frozenset((*NAMES, *(f"{x} fixed" for x in NAMES)))
LUNGS = ("right lung", "left lung")
CANVAS, MOST_BYTES = 1024.0, 2 << 20

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_LINE = re.compile(
    rf"(?P<open>\{{)|(?P<close>\}},?)|\[(?P<key>[A-Za-z][A-Za-z0-9]*)=(?P<value>[^\[\]]*)\]|\{{\s*(?P<x>{_NUMBER})\s*,\s*(?P<y>{_NUMBER})\s*\}}\s*,?"
)
_POINTS = "array<struct<x:double,y:double>>"
SCHEMA = f"sha256 string, fault string, fault_at long, right_lung {_POINTS}, left_lung {_POINTS}, right_removed array<int>, left_removed array<int>, excluded array<string>"


class PfsFault(ValueError):
    def __init__(self, kind: str, at: int):
        super().__init__(f"{kind} at byte {at}")
        self.kind, self.at = kind, at


@dataclass
class Block:
    at: int
    attributes: dict[str, str] = field(default_factory=dict)
    points: list[tuple[float, float]] = field(default_factory=list)


def _lines(raw: bytes) -> Iterator[tuple[int, str]]:
    """(byte offset, text without surrounding white space) of each line that says something."""
    at = 3 if raw.startswith(b"\xef\xbb\xbf") else 0
    for line in raw[at:].splitlines(keepends=True):
        try:
            text = line.decode("utf-8").strip()
        except UnicodeDecodeError:
            raise PfsFault("no UTF-8", at) from None
        if text and not text.startswith(";"):
            yield at, text
        at += len(line)


def blocks(raw: bytes) -> dict[str, Block]:
    """The blocks of a file by label."""
    if not raw or len(raw) > MOST_BYTES:
        raise PfsFault("empty or too large", 0)
    found: dict[str, Block] = {}
    now: Block | None = None
    for at, text in _lines(raw):
        m = _LINE.fullmatch(text)
        if not m:
            raise PfsFault("malformed line" if now else "line outside a block", at)
        if m["open"]:
            if now:
                raise PfsFault("block inside a block", at)
            now = Block(at)
        elif not now:
            raise PfsFault("closing without a block" if m["close"] else "line outside a block", at)
        elif m["close"]:
            label = now.attributes.get("Label")
            if label not in LABELS:
                raise PfsFault("unknown label", now.at)
            if label in found:
                raise PfsFault("label twice", now.at)
            found[label], now = now, None
        elif m["key"]:
            if m["key"] in now.attributes or now.points:
                raise PfsFault("attribute twice or after points", at)
            now.attributes[m["key"]] = m["value"].strip()
        else:
            now.points.append((float(m["x"]), float(m["y"])))
    if now:
        raise PfsFault("block without an end", now.at)
    return found


def removed_points(points: list[tuple[float, float]]) -> list[int]:
    """Places of points that equal the kept one before them, and of a last one that closes the contour."""
    gone = [k for k in range(1, len(points)) if points[k] == points[k - 1]]
    kept = [k for k in range(len(points)) if k not in set(gone)]
    return sorted([*gone, kept[-1]]) if len(kept) > 1 and points[kept[0]] == points[kept[-1]] else gone


def parse(raw: bytes) -> dict:
    """One file as a row of ``SCHEMA``; a fault leaves the rest empty."""
    row = dict.fromkeys(x.strip().split()[0] for x in re.split(r",(?![^<]*>)", SCHEMA)) | {"sha256": hashlib.sha256(raw).hexdigest()}
    try:
        found = blocks(raw)
        for label in LUNGS:
            side = label.split()[0]
            if label not in found:
                raise PfsFault(f"no {label}", len(raw))
            block = found[label]
            if block.attributes.get("LineMode") != "ClosedContour":
                raise PfsFault(f"{label} is no closed contour", block.at)
            try:
                contour = polygon_contour(block.points, CANVAS)
            except ValueError as error:
                raise PfsFault(f"{label}: {error}", block.at) from None
            row[f"{side}_lung"] = [{"x": x, "y": y} for x, y in contour]
            row[f"{side}_removed"] = removed_points(block.points)
        row["excluded"] = sorted(set(found) - set(LUNGS))
    except PfsFault as fault:
        row = dict.fromkeys(row) | {"sha256": row["sha256"], "fault": fault.kind, "fault_at": fault.at}
    return row


def parsed(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, SCHEMA) for each row; ``content`` is binary or text. A null content is a null row with the fault ``missing``."""
    fields = df.select(*key).schema
    names = [x.strip().split()[0] for x in re.split(r",(?![^<]*>)", SCHEMA)]
    spark = df.sparkSession
    out = spark.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x) if x is not None else dict.fromkeys(names) | {"fault": "missing"} for x in batch.column(len(key)).to_pylist()]
            columns = [pa.array([r[n] for r in rows], arrow.field(n).type) for n in names]
            yield pa.record_batch([*(batch.column(k) for k in range(len(key))), *columns], [*key, *names])

    schema = fields
    for f in out.fields:
        schema = schema.add(f)
    return df.select(*key, F.col(content).cast("binary")).mapInArrow(run, schema)


def contours(spark: SparkSession, path: str, glob: str = "*.pfs", strict: bool = True) -> DataFrame:
    """(name, SCHEMA) of all contour files under ``path``; with ``strict`` a fault is an error that names its file."""
    found = parsed(files(spark, path, glob), ["name"], "content")
    return found.where(F.when(F.col("fault").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", "name", F.lit("holds a fault:"), "fault", F.lit("at byte"), "fault_at")).cast("boolean"))) if strict else found


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, strict: bool):
        self.path, self.strict = path, strict

    def _store(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[_File]:
        """One split a file; only names are looked at."""
        from pyarrow import fs

        store, place = self._store(self.path)
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
        names = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".pfs"))
        return [_File(x) for x in names] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = self._store(self.path)
        with store.open_input_stream(partition.path) as stream:
            row = parse(stream.read())
        if self.strict and row["fault"]:
            raise ContractError(f"{partition.path}: {row['fault']} at byte {row['fault_at']}")
        points = lambda v: None if v is None else [(p["x"], p["y"]) for p in v]
        yield partition.path.rsplit("/", 1)[-1], *(points(v) if k.endswith("_lung") else v for k, v in row.items())


class PfsDataSource(DataSource):
    """``spark.read.format("pfs").option("mode", "PERMISSIVE").load(path)``; without that mode a fault is an error."""

    @classmethod
    def name(cls) -> str:
        return "pfs"

    def schema(self) -> str:
        return f"name string, {SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PfsDataSource)


def rasterized(df: DataFrame, key: list[str], size: int = 1024) -> DataFrame:
    """(key, height, width, right_mask, left_mask, right_area, left_area): contours scaled to ``size`` and filled.

    Masks are packed bits. Rows without contours keep null masks; lungs that overlap or cover no pixel are an error.
    """
    fields = df.select(*key).schema
    for name, kind in (("height", T.IntegerType()), ("width", T.IntegerType()), ("right_mask", T.BinaryType()), ("left_mask", T.BinaryType()), ("right_area", T.LongType()), ("left_area", T.LongType())):
        fields = fields.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for right, left in zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist(), strict=True):
                if right is None or left is None:
                    rows.append((None, None, None, None))
                    continue
                masks = [rasterize([(p["x"] * size / CANVAS, p["y"] * size / CANVAS) for p in side], size, size) for side in (right, left)]
                if (masks[0] & masks[1]).any() or not (masks[0].any() and masks[1].any()):
                    raise ContractError("lungs overlap or cover no pixel")
                rows.append((pack(masks[0]), pack(masks[1]), int(masks[0].sum()), int(masks[1].sum())))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            n = pa.array([size] * len(rows), pa.int32())
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.record_batch([*(batch.column(k) for k in range(len(key))), n, n, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], fields.fieldNames())

    return df.select(*key, "right_lung", "left_lung").mapInArrow(run, fields)


def written_form(right: list[tuple[float, float]], left: list[tuple[float, float]], fixed: tuple[str, ...] = ()) -> str:
    """The text of a contour file, for fixtures and round trips."""
    block = lambda label, mode, points: "\n".join(["{", f"[Label={label}]", f"[LineMode={mode}]", *(f"{{ {np.float64(x)!s}, {np.float64(y)!s} }}," for x, y in points), "},"])
    return "; contours\n" + "\n".join([block("right lung", "ClosedContour", right), block("left lung", "ClosedContour", left), *(block(f"{x} fixed", "Points", right[:2]) for x in fixed)]) + "\n"
