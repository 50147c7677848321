"""Challenge slots and rasters as DataFrame operators: each source's pixels and masks in one row, its slots in rows.

Pixels travel as bytes in row order, masks as packed bits. A task holds one source at a time. A source whose slots
cannot be built keeps all its slots, as failed, with the reason.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import imaging
from ..functions.boxes import SIDES, UNSEEN
from ..functions.canonical import array_digest
from ..functions.raster import FINDINGS, background_box, pack, retention, unpack

#: The slots in order with their families, and what padding slots are cut like.
SLOTS = (
    ("original", "anchor"), *((f"{s}_{p:02d}", "unseen_single") for s in SIDES for p in (5, 30)),
    *((x, "unseen_asymmetric") for x in ("left07_right23", "left23_right07", "top07_bottom23", "top23_bottom07")), ("background_only", "background"),
    *((x, "photometric") for x in ("brightness070", "brightness130", "blur_sigma2")), *((f"{s}30_{x}", "padding") for s in ("left", "top") for x in ("gray127", "topleft")),
)
ELIGIBLE, INELIGIBLE, FAILED = "eligible", "construction_ineligible", "construction_failed"
TOLERANCE = 1e-6
_SLOT = "slot int, variant string, family string, anchor string, status string, reason string, x0 int, y0 int, x1 int, y1 int, targets array<double>, effective boolean, pixel_sha256 string, pixels binary"


def crop_boxes(width: int, height: int) -> dict[str, tuple[int, int, int, int]]:
    cut = lambda share, n: round(share * n)
    return {name: (cut(a, width), cut(b, height), width - cut(c, width), height - cut(d, height)) for name, (a, b, c, d) in UNSEEN.items()}


def _part(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    return image[box[1] : box[3], box[0] : box[2]]


def _padding(image: np.ndarray, box: tuple, shown: np.ndarray, variant: str) -> tuple[np.ndarray | None, str | None]:
    """The raster of a ``shown`` crop on grey, or in the corner; without padding, or padding before it, there is nothing to change."""
    w, h, x, y = imaging.fitted(*_part(image, box).shape)
    raster = shown[y : y + h, x : x + w]
    if variant.endswith("gray127"):
        return (None, "no_padding_to_modify") if (w, h) == (256, 256) else (imaging.placed(raster, x, y, fill=127), None)
    return (None, "no_padding_offset_to_move") if (x, y) == (0, 0) else (imaging.placed(raster, 0, 0), None)


def build_slots(image: np.ndarray, masks: np.ndarray) -> list[dict]:
    """The slots of one source. Targets come from the native masks; an ineligible slot has none, and no pixels."""
    height, width = image.shape
    if min(width, height) < 4:
        raise ValueError("the raster is too small to be cut")
    if masks.shape != (2, height, width) or (masks[0] & masks[1]).any() or not (masks[0].any() and masks[1].any()):
        raise ValueError("two aligned, disjoint, nonempty masks are needed")
    boxes = crop_boxes(width, height)
    background = tuple(int(v) for v in background_box(masks))
    share = dict(zip([*boxes, "background_only"], retention(masks, np.array([*boxes.values(), background], float)), strict=True))
    shown = {name: imaging.letterbox(_part(image, box)) for name, box in boxes.items()}
    out, raw, digests = [], {}, {}
    for k, (variant, family) in enumerate(SLOTS):
        anchor = "original" if family != "padding" else "left_30" if variant.startswith("left") else "top_30"
        box, reason, target = boxes.get(variant, boxes[anchor]), None, share.get(variant, share[anchor])
        if variant in shown:
            pixels = shown[variant]
        elif family == "background":
            box = background
            pixels, reason = (None, "no_removable_background_margin") if box == boxes["original"] else (imaging.letterbox(_part(image, box)), None)
            if pixels is not None and np.abs(target - share["original"]).max() > TOLERANCE:
                raise ValueError("a crop of background changed what is kept")
        elif family == "padding":
            pixels, reason = _padding(image, box, shown[anchor], variant)
        else:
            pixels = imaging.blurred(shown["original"], 2.0) if variant.startswith("blur") else imaging.brightened(shown["original"], 0.7 if variant.endswith("070") else 1.3)
        row = {"slot": k, "variant": variant, "family": family, "anchor": anchor, "status": ELIGIBLE if pixels is not None else INELIGIBLE, "reason": reason, **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))}
        done = pixels is not None
        data = raw[variant] = pixels.tobytes() if done else None
        if done and data not in digests:
            digests[data] = hashlib.sha256(data).hexdigest()
        row |= {"targets": [float(v) for v in target] if done else None, "effective": bool(done and variant != "original" and data != raw[anchor])}
        out.append(row | {"pixel_sha256": digests.get(data), "pixels": data})
    kept = {r["variant"]: r["targets"] for r in out}
    for outer, inner in ((a, b) for s in SIDES for a, b in (("original", f"{s}_05"), (f"{s}_05", f"{s}_30"))):
        if (np.array(kept[inner]) > np.array(kept[outer]) + TOLERANCE).any():
            raise ValueError("an inner crop keeps more than its outer one")
    return out


def _mapped(df: DataFrame, key: list[str], columns: list[str], schema: str | T.StructType, make: Callable[..., list[dict]]) -> DataFrame:
    """Rows of ``make`` for each row, with its key before them."""
    spark = df.sparkSession
    kind = spark.createDataFrame([], schema).schema
    whole = T.StructType([df.schema[c] for c in key] + kind.fields)
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, made = None, [], []
        for batch in batches:
            for k in range(batch.num_rows):
                own = [batch.column(j)[k].as_py() for j in range(batch.num_columns)]
                # Copies that follow each other are made once.
                if last != own[len(key) :]:
                    last, rows = own[len(key) :], make(*own[len(key) :])
                    made = [pa.array([r[f.name] for r in rows], arrow.field(f.name).type) for f in kind]
                if rows:
                    yield pa.record_batch([*(pa.array([v] * len(rows), arrow.field(j).type) for j, v in enumerate(own[: len(key)])), *made], schema=arrow)

    return df.select(*key, *columns).mapInArrow(run, whole)


def challenge_slots(df: DataFrame, key: list[str], with_pixels: bool = False) -> DataFrame:
    """(key, slot, variant, family, anchor, status, reason, box, targets, effective, pixel_sha256) from (width, height,
    pixels, right_mask, left_mask); 21 rows a source, whatever becomes of it."""

    def make(width, height, pixels, right, left) -> list[dict]:
        try:
            image = np.frombuffer(pixels, np.uint8).reshape(height, width)
            rows = build_slots(image, np.stack([unpack(right, height, width), unpack(left, height, width)]))
        except (ValueError, TypeError) as error:
            names = [x.split()[0] for x in _SLOT.split(", ")]
            rows = [dict.fromkeys(names) | {"slot": k, "variant": v, "family": f, "status": FAILED, "reason": str(error), "effective": False} for k, (v, f) in enumerate(SLOTS)]
        return rows

    # Pixels are some megabyte a source, so they leave the task only where they are wanted.
    schema = _SLOT if with_pixels else _SLOT.removesuffix(", pixels binary")
    return _mapped(df, key, ["width", "height", "pixels", "right_mask", "left_mask"], schema, make)


def fingerprints(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, raster_sha256, decoded_sha256, gray256_sha256, dhash256, thumbnail) from (width, height, pixels), grey or of three colours."""

    def make(width, height, pixels) -> list[dict]:
        flat = np.frombuffer(pixels, np.uint8)
        return [imaging.fingerprint(flat.reshape(height, width) if len(flat) == width * height else flat.reshape(height, width, 3))]

    return _mapped(df, key, ["width", "height", "pixels"], "raster_sha256 string, decoded_sha256 string, gray256_sha256 string, dhash256 string, thumbnail binary", make)


def presented_masks(df: DataFrame, key: list[str], side: int = 518) -> DataFrame:
    """(key, presented mask, its digest and pixels, the source's digest) from (width, height, mask, x0, y0, x1, y1).

    A mask goes the way that a processor shows its image: the crop's shorter edge resized to ``side`` (nearest, by index
    tables), then the middle square. Nothing left is a result, an empty source mask is an error.
    """

    def make(width, height, data, x0, y0, x1, y1) -> list[dict]:
        mask = unpack(data, height, width)
        if not mask.any() or not (0 <= x0 < x1 <= width and 0 <= y0 < y1 <= height):
            raise ValueError("a mask with foreground and a box inside it are needed")
        w, h = x1 - x0, y1 - y0
        rw, rh = (side, side * h // w) if w <= h else (side * w // h, side)
        left, top = (rw - side) // 2, (rh - side) // 2
        rows, columns = imaging.nearest_table(h, rh)[top : top + side] + y0, imaging.nearest_table(w, rw)[left : left + side] + x0
        shown = mask[np.ix_(rows, columns)]
        digest = hashlib.sha256(shown.astype(np.uint8).tobytes()).hexdigest()
        return [{"presented_mask": pack(shown), "presented_sha256": digest, "presented_pixels": int(shown.sum()), "source_sha256": array_digest(mask, "mask")}]

    return _mapped(df, key, ["width", "height", "mask", "x0", "y0", "x1", "y1"], "presented_mask binary, presented_sha256 string, presented_pixels long, source_sha256 string", make)


def soft_regions(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, lung, finding, mass, valid, summary) from (width, height, probabilities): bytes of 32-bit floats, right lung then left."""

    def make(width, height, data) -> list[dict]:
        p = np.frombuffer(data, "<f4").reshape(2, height, width).astype(float)
        if not (np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()):
            raise ValueError("probabilities are finite and between 0 and 1")
        summary, (region, valid) = imaging.lung_summary(p), imaging.region_weights(p)
        return [{"lung": lung, "finding": finding, "mass": float(region[f, k].sum()), "valid": bool(valid[f, k]), "summary": summary[k].tolist()} for k, lung in enumerate(("right", "left")) for f, finding in enumerate(FINDINGS)]

    return _mapped(df, key, ["width", "height", "probabilities"], "lung string, finding string, mass double, valid boolean, summary array<double>", make)


def box_mask(width: Column, height: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Packed bits of a mask that is one box."""

    @F.arrow_udf("binary")
    def draw(*columns):
        out = []
        for w, h, a, b, c, d in zip(*(x.to_pylist() for x in columns), strict=True):
            mask = np.zeros((h, w), bool)
            mask[b:d, a:c] = True
            out.append(pack(mask))
        return pa.array(out, pa.binary())

    return draw(width, height, x0, y0, x1, y1)
