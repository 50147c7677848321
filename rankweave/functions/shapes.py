"""Shape measures of batches of masks, all read from two profiles: how much of each row and of each column is set.

Area, bounds, centre, contact with the frame and the shares of the upper, middle and lower third need no pixel twice;
only the outline looks at neighbours. Masks are [batch, rows, columns]. An empty mask has the measure 0 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster

#: Names of the measures, in their order.
CONTACTS = ("contact_top", "contact_bottom", "contact_left", "contact_right")
LUNG = ("area_fraction", "centroid_x", "centroid_y", "bbox_width", "bbox_height", "extent", "compactness", *CONTACTS, "foreground_probability_mean", "foreground_entropy_mean", "mass_upper_third", "mass_middle_third", "mass_lower_third")
ALIKE = ("area_fraction", "bbox_width", "bbox_height")
BASE = ("area_fraction", "bbox_x0", "bbox_y0", "bbox_width", "bbox_height", "centroid_x", "centroid_y", *CONTACTS, "empty")


def _extent(profile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last set place of each profile; 0 and 0 for none."""
    running = np.cumsum(profile, -1)
    whole = running[..., -1:]
    start, end = (running == 0).sum(-1), (running < whole).sum(-1) + 1
    some = whole[..., 0] > 0
    return np.where(some, start, 0), np.where(some, end, 0)


def _centre(profile: np.ndarray) -> np.ndarray:
    """Centre of mass as a share of the length."""
    n = profile.shape[-1]
    return (profile * ((np.arange(n) + 0.5) / n)).sum(-1) / np.maximum(profile.sum(-1), 1)


def _until(profile: np.ndarray, at: float) -> np.ndarray:
    """Mass before a fractional place."""
    k = min(int(at), profile.shape[-1] - 1)
    return profile[..., :k].sum(-1) + (at - k) * profile[..., k]


def measures(masks: np.ndarray) -> dict[str, np.ndarray]:
    """All measures that the two profiles give, one value a mask."""
    masks = np.asarray(masks, bool)
    height, width = masks.shape[-2:]
    rows, columns = masks.sum(-1), masks.sum(-2)
    area = rows.sum(-1)
    (y0, y1), (x0, x1) = _extent(rows), _extent(columns)
    box = np.maximum((y1 - y0) * (x1 - x0), 1)
    # Each pixel has four sides; a side shared with a neighbour is no outline.
    shared = (masks[..., 1:, :] & masks[..., :-1, :]).sum((-1, -2)) + (masks[..., :, 1:] & masks[..., :, :-1]).sum((-1, -2))
    outline = 4 * area - 2 * shared
    thirds = np.diff([_until(rows, k * height / 3) for k in range(4)], axis=0) / np.maximum(area, 1)
    return {
        "area_fraction": area / (height * width), "bbox_x0": x0 / width, "bbox_y0": y0 / height, "bbox_width": (x1 - x0) / width, "bbox_height": (y1 - y0) / height,
        "centroid_x": _centre(columns), "centroid_y": _centre(rows), "extent": area / box, "compactness": 4 * np.pi * area / np.maximum(outline, 1) ** 2,
        "contact_top": rows[..., 0] / width, "contact_bottom": rows[..., -1] / width, "contact_left": columns[..., 0] / height, "contact_right": columns[..., -1] / height,
        "mass_upper_third": thirds[0], "mass_middle_third": thirds[1], "mass_lower_third": thirds[2], "empty": (area == 0).astype(float),
    }


def confidence(probability: np.ndarray, masks: np.ndarray) -> dict[str, np.ndarray]:
    """Mean probability and mean binary entropy (bits) over the foreground."""
    p = np.asarray(probability, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.nan_to_num(-p * np.log2(p)) + np.nan_to_num(-(1 - p) * np.log2(1 - p))
    n = np.maximum(masks.sum((-1, -2)), 1)
    return {"foreground_probability_mean": (p * masks).sum((-1, -2)) / n, "foreground_entropy_mean": (bits * masks).sum((-1, -2)) / n}


def bilateral(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of two predicted lungs [batch, 2, rows, columns], image-left first, and how alike the two are.

    Foreground is a probability of 0.5 or more. Lungs whose centres are level or empty lungs are an error.
    """
    masks = pairs >= 0.5
    x = measures(masks)["centroid_x"]
    if (~masks.any((-1, -2))).any() or (np.abs(x[:, 0] - x[:, 1]) <= 1e-12).any():
        raise ValueError("two lungs side by side are needed")
    order = np.argsort(x, 1)[:, :, None, None]
    pairs, masks = np.take_along_axis(pairs, order, 1), np.take_along_axis(masks, order, 1)
    m = measures(masks) | confidence(pairs, masks)
    out = {f"image_{side}_{k}": m[k][:, i] for i, side in enumerate(("left", "right")) for k in LUNG}
    out |= {f"bilateral_{k}_symmetry": m[k].min(1) / m[k].max(1) for k in ALIKE}
    a, b = masks[:, 0], masks[:, 1]
    both = lambda x, y: (x & y).sum((-1, -2))
    out["bilateral_reflected_dice"] = 2 * both(a, b[..., ::-1]) / masks.sum((1, 2, 3))
    out["bilateral_centroid_x_mirror_agreement"] = 1 - np.abs(m["centroid_x"].sum(1) - 1)
    out["bilateral_centroid_y_agreement"] = 1 - np.abs(np.diff(m["centroid_y"], axis=1)[:, 0])
    out["bilateral_overlap_fraction"] = both(a, b) / masks.any(1).sum((-1, -2))
    return {k: np.clip(v, 0.0, 1.0) for k, v in out.items()}


def parts(masks: np.ndarray) -> np.ndarray:
    """[3, ...]: the bottom quarter of each mask's bounds, its rim (2 % of the shorter side of the bounds, a pixel at
    least) and the mask itself, one per finding."""
    rows = np.arange(masks.shape[-2])[:, None]
    (y0, y1), (x0, x1) = _extent(masks.sum(-1)), _extent(masks.sum(-2))
    basal = masks & (rows >= (y0 + 0.75 * (y1 - y0))[..., None, None])
    width = np.maximum(1, np.ceil(0.02 * np.minimum(x1 - x0, y1 - y0))).astype(int)
    inner = np.stack([raster.eroded(m, int(r)) for m, r in zip(masks.reshape(-1, *masks.shape[-2:]), width.ravel(), strict=True)]).reshape(masks.shape)
    return np.stack([basal, masks & ~inner, masks])


def geometry_block(pairs: np.ndarray) -> np.ndarray:
    """[batch, 3, 75]: for each finding 36 measures of the whole pair, 36 of the finding's part, and which finding it is."""
    found = measures(parts(np.asarray(pairs, bool)))
    two = np.moveaxis(np.stack([found[k] for k in BASE], -1), 0, 1)  # [batch, finding, lung, measure]
    block = np.concatenate([two[:, :, 0], two[:, :, 1], np.abs(two[:, :, 0] - two[:, :, 1])], -1)
    whole = np.repeat(block[:, 2:], 3, 1)
    which = np.broadcast_to(np.eye(3), (len(two), 3, 3))
    return np.concatenate([whole, block, which], -1).astype(np.float32)


def block_names() -> list[str]:
    """Names of the 75 measures."""
    sides = [f"{side}_{k}" for side in ("first", "second", "difference") for k in BASE]
    return [*(f"whole_{k}" for k in sides), *(f"part_{k}" for k in sides), *(f"is_{f}" for f in raster.FINDINGS)]


def split_lungs(union: np.ndarray) -> np.ndarray:
    """Two masks, left of the image first: the two largest components, and crumbs with the nearer of them.

    Both must hold a twentieth of the whole, and all crumbs a thousandth at most.
    """
    labels = raster.components(union)
    sums = lambda w=None: np.bincount(labels.ravel(), w)[1:]
    area = sums()
    y, x = (sums(g.ravel()) / area for g in np.indices(labels.shape))
    by_size = np.argsort(-area, kind="stable")
    if len(area) < 2 or 20 * area[by_size[1]] < area.sum() or 1000 * area[by_size[2:]].sum() > area.sum():
        raise ValueError("two clearly separate regions are needed")
    ends = by_size[:2][np.lexsort((by_size[:2], y[by_size[:2]], x[by_size[:2]]))]
    apart = np.hypot(x[:, None] - x[ends], y[:, None] - y[ends])
    side = np.concatenate([[-1], apart.argmin(1)])  # a component is nearest to itself
    return np.stack([side[labels] == k for k in (0, 1)])


def geometry_blocks(df: DataFrame, key: str, left: str, right: str, height: str, width: str) -> DataFrame:
    """(key, finding, features) of mask pairs given as packed bits; a pair that is null has no rows."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, values = [], [], []
            for k, a, b, h, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, row in zip(raster.FINDINGS, geometry_block(np.stack([raster.unpack(a, h, w), raster.unpack(b, h, w)])[None])[0], strict=True):
                    keys.append(k)
                    names.append(name)
                    values.append(row)
            yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(values, pa.list_(pa.float32()))], [key, "finding", "features"])

    whole = df.select(key, left, right, height, width).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return whole.mapInArrow(run, f"`{key}` {kind}, finding string, features array<float>")
