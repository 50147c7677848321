"""Cluster bootstraps whose replicates are vectors.

A group (case) drawn w times in replicate r weighs w there. All its multiplicities are one vector, and what is summed
over groups are vectors: a block of one scope and one score holds the weighted rows and bad rows of every replicate at
once, so replicates add columns and never rows. Entry 0 of each vector is the sample itself (every group once), so point
estimates come out of the same pass.

Blocks are cut into parts by score; parts are summed, their running sums give each part its base, and inside a part one
scan in order of score yields what it adds to each metric. A task holds one part, about ``PART_BYTES``.

Draws: pick j of replicate r is mix(mix(key + r) + j) mod n, with ``mix`` the finaliser of splitmix64 and ``key`` the
first 48 bits of the SHA-256 of the stratum's name and the seed; groups count in their sorted order, those without rows
included. One task makes all n picks of one or more replicates, and counts them in two bytes a group; a stratum of one
group has no replicates, all are undefined. A scored group outside the pool is an error, as is a truth or score that is
not finite. Plain sums need no vector a group: tiles of multiplicities meet the groups' sums block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..staging import written
from .align import numbered
from .ranking import COVERAGES, CUT, only_finite, same_scope

#: Bytes of vectors that meet in one task.
PART_BYTES = 64 << 20
#: Groups and replicates of one tile of drawn multiplicities.
TILE, TILE_REPLICATES = 4096, 32
#: Picks made at a time, and groups of a block whose sums meet its multiplicities in one task.
PICKS, SUM_BLOCK = 1 << 16, 1 << 14
BUDGETS = (0.05, 0.1, 0.2, 0.3, 0.5)
RANKING = ("auroc", "ap", "aurc", "eaurc", *(f"risk_{round(100 * c)}" for c in COVERAGES))
REGRESSION = ("mae", "rmse")
_ARRAY = ArrayType(DoubleType())
WORKLOAD = ("bad_recall", "risk_left", "unnecessary_share", "good_review_rate", "all_report_share")


# Draws.


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multiplicities(key: int, rep: int, n: int) -> np.ndarray:
    """How often each of ``n`` groups is drawn in a replicate."""
    counts = np.zeros(n, np.uint16)
    if n < 2:
        return counts
    start, size = mix(np.array([key + rep], np.uint64)), np.uint64(n)
    for at in range(0, n, PICKS):
        pick = mix(start + np.arange(at, min(at + PICKS, n), dtype=np.uint64))
        pick -= pick // size * size
        np.add.at(counts, pick.view(np.int64), np.uint16(1))
    return counts


def _drawn(key: int, reps: range, n: int) -> np.ndarray:
    out = np.empty((len(reps), n), "<u2")
    for k, r in enumerate(reps):
        out[k] = multiplicities(key, r, n)
    return out


def _fields(df: DataFrame, columns: list[str]) -> list[StructField]:
    return [StructField(c, df.schema[c].dataType) for c in columns]


def _numbers(pool: DataFrame, strata: list[str], group: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(strata, group, k), the place of each group in its stratum, and (strata, first, size, key)."""
    places = numbered(pool.select(*strata, group).distinct(), [*strata, group])
    key = F.conv(F.substring(F.sha2(F.concat_ws(":", *strata, F.lit(str(seed))), 256), 1, 12), 16, 10).cast("long")
    sizes = places.groupBy(*strata).agg(F.min("position").alias("first"), F.count("*").alias("size")).withColumn("key", key)
    joined = places.alias("x").join(sizes.alias("y"), same_scope(strata, "x", "y"))
    return joined.select(*(f"x.{c}" for c in (*strata, group)), (F.col("position") - F.col("first")).alias("k")), sizes


def draw_vectors(pool: DataFrame, strata: list[str], group: str, replicates: int, seed: int = 17) -> DataFrame:
    """(strata, group, weights) for each different group of ``pool``: 16-bit multiplicities of the sample (1) and of each replicate."""
    numbers, sizes = _numbers(pool, strata, group, seed)
    jobs = sizes.select(*strata, "size", "key", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(TILE_REPLICATES))).alias("rep"))
    own = _fields(pool, strata)
    tile = StructType([*own, StructField("block", LongType()), StructField("rep", IntegerType()), StructField("tile", BinaryType())])
    vector = StructType([*own, StructField("k", LongType()), StructField("weights", BinaryType())])
    tile_arrow, vector_arrow = to_arrow_schema(tile), to_arrow_schema(vector)
    spread = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                reps = range(job["rep"], min(job["rep"] + TILE_REPLICATES, replicates))
                drawn = _drawn(job["key"], reps, job["size"])
                for block, at in enumerate(range(0, job["size"], TILE)):
                    values = [[job[c]] for c in strata] + [[block], [job["rep"]], [drawn[:, at : at + TILE].tobytes()]]
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, tile_arrow, strict=True)], schema=tile_arrow)

    def assemble(part: pa.Table) -> pa.Table:
        rows = sorted(part.select(["rep", "tile"]).to_pylist(), key=lambda x: x["rep"])
        tiles = [np.frombuffer(x["tile"], "<u2").reshape(min(TILE_REPLICATES, replicates - x["rep"]), -1) for x in rows]
        whole = np.concatenate([np.ones((1, tiles[0].shape[1]), "<u2"), *tiles]).T.copy()
        first = part.slice(0, 1)
        n, start = len(whole), first.column("block")[0].as_py() * TILE
        columns = [pa.array([first.column(c)[0].as_py()] * n, vector_arrow.field(c).type) for c in strata]
        return pa.table([*columns, pa.array(range(start, start + n), pa.int64()), pa.array([x.tobytes() for x in whole], pa.binary())], schema=vector_arrow)

    vectors = jobs.repartition(spread, *strata, "rep").mapInArrow(draw, tile).groupBy(*strata, "block").applyInArrow(assemble, vector)
    # Vectors come from a few jobs and are packed on disk, so their size is guessed low: they must not pass the driver.
    matched = numbers.alias("x").join(vectors.alias("y").hint("merge"), same_scope([*strata, "k"], "x", "y"))
    return written(matched.select(*(f"x.{c}" for c in (*strata, group)), "y.weights"), "weights")


# Sums of vectors.


class VectorSums:
    """Running sums of row vectors by key, given up in batches when they fill ``PART_BYTES``."""

    def __init__(self, schema: pa.Schema, n_keys: int, width: int):
        self.schema, self.n_keys, self.width = schema, n_keys, width
        self.n_sums = len(schema) - n_keys
        self.most = max(16, PART_BYTES // (8 * width * self.n_sums))
        self.clear()

    def clear(self) -> None:
        self.place: dict[tuple, int] = {}
        self.sums = np.zeros((self.n_sums, 16, self.width))

    def add(self, keys: list[tuple], vectors: list[np.ndarray]) -> None:
        at = np.array([self.place.setdefault(k, len(self.place)) for k in keys], np.int64)
        while self.sums.shape[1] < len(self.place):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], axis=1)
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        for k, x in enumerate(vectors):
            self.sums[k, own] += np.add.reduceat(x[order], first, axis=0)

    def batch(self) -> pa.RecordBatch:
        keys = list(zip(*self.place, strict=True)) or [()] * self.n_keys
        columns = [pa.array(list(c), self.schema.field(k).type) for k, c in enumerate(keys)] if self.n_keys else []
        columns += [pa.array([v.tobytes() for v in self.sums[k, : len(self.place)]], pa.binary()) for k in range(self.n_sums)]
        self.clear()
        return pa.record_batch(columns, schema=self.schema)


def _matrix(column, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _keys(data, names: list[str]) -> list[tuple]:
    return list(zip(*(data.column(c).to_pylist() for c in names), strict=True)) if names else [()] * data.num_rows


def weighted_sums(df: DataFrame, vectors: DataFrame, strata: list[str], group: str, keys: list[str], sums: list[str], width: int) -> DataFrame:
    """Rows (strata, group, keys, sums) to partial sums of value times their group's vector: at most one row a key, task and flush.

    A group's vector and its rows meet in one partition, the vector first, and each vector goes to Python once, not once
    a row. Groups of a batch are multiplied as matrices where most keys occur in most groups. A row whose group is not
    drawn from is an error.
    """
    schema = StructType([*_fields(df, keys), *(StructField(c, BinaryType()) for c in sums)])
    arrow = to_arrow_schema(schema)
    own = [*strata, group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = VectorSums(arrow, len(keys), width)
        step = max(1, PART_BYTES // (32 * width))
        last, last_vector = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                drawn = part.column("weights").is_valid().to_numpy(zero_copy_only=False)
                carried = [last_vector] if last_vector is not None else []
                raw = carried + part.column("weights").drop_null().to_pylist()
                places = np.cumsum(drawn) - 1 + len(carried)
                names = _keys(part, own)
                rows = np.flatnonzero(~drawn)
                heads = ([last] if carried else []) + [names[k] for k in np.flatnonzero(drawn)]
                if any(places[k] < 0 or heads[places[k]] != names[k] for k in rows):
                    raise ValueError("a scored group is not in the pool")
                if heads:
                    last, last_vector = heads[-1], raw[-1]
                if not len(rows):
                    continue
                cells = part.take(pa.array(rows))
                used, which = np.unique(places[rows], return_inverse=True)
                w = np.frombuffer(b"".join(raw[k] for k in used), "<u2").reshape(-1, width).astype(float)
                found: dict[tuple, int] = {}
                which_key = np.array([found.setdefault(k, len(found)) for k in _keys(cells, keys)], np.int64)
                values = [cells.column(c).to_numpy(zero_copy_only=False).astype(float) for c in sums]
                if len(found) * len(used) <= 8 * len(rows):
                    vectors_ = []
                    for v in values:
                        m = np.zeros((len(found), len(used)))
                        np.add.at(m, (which_key, which), v)
                        vectors_.append(m @ w)
                    held.add(list(found), vectors_)
                else:
                    held.add(_keys(cells, keys), [w[which] * v[:, None] for v in values])
                if len(held.place) >= held.most:
                    yield held.batch()
        if held.place:
            yield held.batch()

    columns = list(dict.fromkeys([*own, *keys, *sums]))
    cells = df.select(*columns, F.lit(None).cast("binary").alias("weights"))
    drawn = vectors.select(*own, *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns if c not in own), "weights")
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = drawn.unionByName(cells).repartition(spread, *own).sortWithinPartitions(*own, F.col("weights").isNull())
    return met.mapInArrow(run, schema)


def _add_up(df: DataFrame, keys: list[str], sums: list[str], width: int) -> DataFrame:
    """Partial sums of vectors to one row a key, first in the tasks that hold them."""
    schema = StructType([*_fields(df, keys), *(StructField(c, BinaryType()) for c in sums)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = VectorSums(arrow, len(keys), width)
        step = max(1, PART_BYTES // (8 * width * len(sums)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.add(_keys(part, keys), [_matrix(part.column(c), "<f8", width) for c in sums])
            if len(held.place) >= held.most:
                yield held.batch()
        if held.place:
            yield held.batch()

    def whole(part: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(part.combine_chunks().to_batches())), arrow)

    partial = df.select(*keys, *sums).mapInArrow(run, schema)
    return (partial.groupBy(*keys) if keys else partial.groupBy(F.lit(0).alias("all"))).applyInArrow(whole, schema)


def with_weights(df: DataFrame, vectors: DataFrame, strata: list[str], group: str) -> DataFrame:
    """Each row with its group's vector; a row whose group is not drawn from is an error."""
    joined = df.alias("x").join(vectors.alias("y").hint("merge"), same_scope([*strata, group], "x", "y"), "left")
    missing = F.raise_error(F.lit("a scored group is not in the pool")).cast("binary")
    return joined.select("x.*", F.coalesce("y.weights", missing).alias("weights"))


def vector_totals(df: DataFrame, by: list[str], sums: list[str], vectors: DataFrame, strata: list[str], group: str, replicates: int) -> DataFrame:
    """(by, a vector of each sum) over all rows; rows are summed to their group first."""
    cells = df.groupBy(*dict.fromkeys([*by, *strata, group])).agg(*(F.sum(c).cast("double").alias(c) for c in sums))
    return _add_up(weighted_sums(cells, vectors, strata, group, by, sums, replicates + 1), by, sums, replicates + 1)


def drawn_totals(df: DataFrame, by: list[str], sums: list[str], pool: DataFrame, strata: list[str], group: str, replicates: int, seed: int = 17) -> DataFrame:
    """What ``vector_totals`` gives, without a vector a group: rows are summed to their group, and a block of groups meets
    its multiplicities, which travel in packed tiles. A task holds a block's sums and one tile at a time."""
    cells = df.groupBy(*dict.fromkeys([*by, *strata, group])).agg(*(F.sum(c).cast("double").alias(c) for c in sums))
    numbers, sizes = _numbers(pool, strata, group, seed)
    # The more groups a stratum has, the fewer replicates one job draws.
    step = F.greatest(F.lit(1), F.least(F.lit(TILE_REPLICATES), F.floor(F.lit(PART_BYTES) / (2 * F.col("size"))))).cast("int")
    jobs = sizes.where("size > 1").withColumn("reps", step).select(*strata, "size", "key", "reps", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.col("reps"))).alias("rep"))
    own = list(dict.fromkeys([*by, *strata]))
    missing = F.raise_error(F.lit("a scored group is not in the pool")).cast("long")
    joined = cells.alias("x").join(numbers.alias("y").hint("merge"), same_scope([*strata, group], "x", "y"), "left")
    located = joined.select(*(f"x.{c}" for c in (*own, *sums)), F.coalesce("y.k", missing).alias("k")).withColumn("block", F.floor(F.col("k") / SUM_BLOCK))
    fields = [StructField("block", LongType()), StructField("rep", IntegerType()), StructField("reps", IntegerType()), StructField("groups", IntegerType()), StructField("kind", StringType()), StructField("tile", BinaryType())]
    tile = StructType([*_fields(pool, strata), *fields])
    total = StructType([*_fields(cells, by), *(StructField(c, BinaryType()) for c in sums)])
    tile_arrow, total_arrow = to_arrow_schema(tile), to_arrow_schema(total)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for job in batch.to_pylist():
                reps = range(job["rep"], min(job["rep"] + job["reps"], replicates))
                drawn = _drawn(job["key"], reps, job["size"])
                for block, at in enumerate(range(0, job["size"], SUM_BLOCK)):
                    part = drawn[:, at : at + SUM_BLOCK]
                    kind = "u1" if part.max() < 256 else "<u2"
                    packed = codec.compress(part.astype(kind).tobytes(), asbytes=True)
                    values = [[job[c]] for c in strata] + [[block], [job["rep"]], [len(reps)], [part.shape[1]], [kind], [packed]]
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, tile_arrow, strict=True)], schema=tile_arrow)

    def meet(part: pa.Table, tiles: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd", 1)
        found: dict[tuple, int] = {}
        which = np.array([found.setdefault(k, len(found)) for k in _keys(part, by)], np.int64)
        k, n = part.column("k").to_numpy() % SUM_BLOCK, len(found)
        if not n:
            return total_arrow.empty_table()
        values = np.stack([part.column(c).to_numpy() for c in sums], 1)
        out = np.zeros((len(sums), n, replicates + 1))
        used, place = np.unique(k, return_inverse=True)
        dense = np.zeros((len(used), len(sums), n))
        np.add.at(dense, (place, slice(None), which), values)
        out[:, :, 0] = dense.sum(0)
        for rep, reps, groups, kind, packed in zip(*(tiles.column(c).to_pylist() for c in ("rep", "reps", "groups", "kind", "tile")), strict=True):
            raw = codec.decompress(packed, reps * groups * np.dtype(kind).itemsize, asbytes=True)
            drawn = np.frombuffer(raw, kind).reshape(reps, groups)[:, used].astype(float)
            out[:, :, 1 + rep : 1 + rep + reps] += (drawn @ dense.reshape(len(used), -1)).T.reshape(len(sums), n, reps)
        keys = list(zip(*found, strict=True)) if by else []
        columns = [pa.array(list(c), total_arrow.field(j).type) for j, c in enumerate(keys)]
        return pa.table([*columns, *(pa.array([v.tobytes() for v in x], pa.binary()) for x in out)], schema=total_arrow)

    tiles = jobs.repartition(spread, *strata, "rep").mapInArrow(draw, tile)
    met = located.groupBy(*strata, "block").cogroup(tiles.groupBy(*strata, "block")).applyInArrow(meet, total)
    return _add_up(met, by, sums, replicates + 1)


# Scans in order of score.


def harmonic(k: np.ndarray) -> np.ndarray:
    """H(k) of whole numbers: a table up to 64, the Euler-Maclaurin series (error under 1e-16) beyond."""
    table = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 65))])
    x = np.maximum(k, 64.0)
    series = np.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return np.where(k <= 64, table[np.clip(k, 0, 64).astype(np.int64)], series)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def _defined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full_like(a, np.nan), where=b > 0)


class Ranking:
    """Best scores first: what each block of equal scores adds to the pair count of AUROC, to AP and to AURC, in every replicate."""

    descending = True
    adds = ("u", "p", "r", *(f"k{j}" for j in range(len(COVERAGES))))

    @staticmethod
    def scan(n, bad, n_before, bad_before, total, total_bad, _missing) -> list[np.ndarray]:
        good_before = n_before - bad_before
        under, bad_under = total - n_before - n, total_bad - bad_before - bad
        share = _share(bad, n)
        span = harmonic(n_before + n) - harmonic(n_before)
        out = [bad * (good_before + (n - bad) / 2), _share(bad * (bad_under + bad), under + n), (bad_before - n_before * share) * span + bad]
        for c in COVERAGES:
            kept = np.ceil(total * c - 1e-9)
            here = (n_before < kept) & (kept <= n_before + n)
            out.append(np.where(here, _share(bad_before + (kept - n_before) * share, kept), 0.0))
        return [x.sum(0) for x in out]

    @staticmethod
    def finish(sums: dict[str, np.ndarray], total, total_bad, _missing, _missing_bad) -> list[tuple]:
        good = total - total_bad
        aurc = _defined(sums["r"], total)
        ideal = _defined(total_bad - good * (harmonic(total) - harmonic(good)), total)
        risks = [np.where(total > 0, sums[f"k{j}"], np.nan) for j in range(len(COVERAGES))]
        return [((), [_defined(sums["u"], total_bad * good), np.where(good > 0, _defined(sums["p"], total_bad), np.nan), aurc, aurc - ideal, *risks])]


class Budgets:
    """Missing scores, then worst first: expected reviews at each budget, ties picked by one share."""

    descending = False
    adds = tuple(f"{c}{j}" for j in range(len(BUDGETS)) for c in ("w", "b"))

    @staticmethod
    def scan(n, bad, n_before, _bad_before, total, _total_bad, missing) -> list[np.ndarray]:
        out = []
        for budget in BUDGETS:
            quota = np.maximum(0.0, budget * total - missing)
            picked = _share(np.clip(quota - n_before, 0, n), n)
            out += [(picked * n).sum(0), (picked * bad).sum(0)]
        return out

    @staticmethod
    def finish(sums: dict[str, np.ndarray], total, total_bad, missing, missing_bad) -> list[tuple]:
        rows = []
        for j, budget in enumerate(BUDGETS):
            reviewed, hit = missing + sums[f"w{j}"], missing_bad + sums[f"b{j}"]
            unneeded = np.maximum(0.0, reviewed - hit)
            left = np.maximum(0.0, total_bad - hit)
            rows.append(((budget,), [_defined(hit, total_bad), _defined(left, np.maximum(0.0, total - reviewed)), _defined(unneeded, reviewed), _defined(unneeded, total - total_bad), reviewed]))
        return rows


def _prefixes(by: list[str], parts: DataFrame, width: int, descending: bool) -> DataFrame:
    """Parts (by, part, n, bad) with the sums of the parts before each, of the scope, and of its rows without a score (part -1)."""
    names = ["n0", "bad0", "total", "total_bad", "missing", "missing_bad"]
    schema = StructType([*_fields(parts, [*by, "part"]), *(StructField(c, BinaryType()) for c in names)])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "descending" if descending else "ascending")])
        part = np.array(table.column("part").to_pylist())
        sums = [_matrix(table.column(c), "<f8", width) for c in ("n", "bad")]
        scored = (part >= 0)[:, None]
        before = [np.cumsum(x * scored, axis=0) - x * scored for x in sums]
        totals = [x.sum(0) for x in sums] + [(x * ~scored).sum(0) for x in sums]
        vectors = [[v.tobytes() for v in x] for x in before] + [[v.tobytes()] * len(part) for v in totals]
        return pa.table([*(table.column(c) for c in (*by, "part")), *(pa.array(v, pa.binary()) for v in vectors)], schema=arrow)

    return (parts.groupBy(*by) if by else parts.groupBy(F.lit(0).alias("all"))).applyInArrow(run, schema)


def _scan(cells: DataFrame, by: list[str], vectors: DataFrame, strata: list[str], group: str, replicates: int, kernel, extra: list[StructField], metrics: tuple[str, ...]) -> DataFrame:
    """Cells (by, strata, group, score, n, bad) through a kernel to (by, extra, one array a metric: sample and replicates)."""
    width = replicates + 1
    cells = written(cells, "cells")
    # A task gives no more blocks than its cells, nor than there are different scores; each holds two vectors.
    spread = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(cells.count(), spread * cells.select(*by, "score").distinct().count())
    most = max(1, min(4096, -(-blocks * width * 16 // PART_BYTES)))
    if most > 1:
        edges = [k / most for k in range(1, most)]
        cuts = written(cells.groupBy(*by).agg(F.percentile_approx(F.col("score").cast("double"), edges, 10_000).alias("cuts")), "cuts")
        placed = cells.alias("x").join(cuts.alias("y"), same_scope(by, "x", "y")).select("x.*", F.size(F.filter("cuts", lambda c: c < F.col("score"))).alias("part"))
    else:
        placed = cells.withColumn("part", F.lit(0))
    placed = placed.withColumn("part", F.when(F.col("score").isNull(), -1).otherwise(F.col("part")))
    blocks = written(weighted_sums(placed, vectors, strata, group, [*by, "part", "score"], ["n", "bad"], width), "blocks")
    bases = _prefixes(by, _add_up(blocks, [*by, "part"], ["n", "bad"], width), width, kernel.descending)
    names = [*kernel.adds, "total", "total_bad", "missing", "missing_bad"]
    added = StructType([*_fields(blocks, by), *(StructField(c, BinaryType()) for c in names)])
    added_arrow = to_arrow_schema(added)

    def scan(part: pa.Table, base: pa.Table) -> pa.Table:
        n0, bad0, total, total_bad, missing, missing_bad = (_matrix(base.column(c), "<f8", width)[0] for c in ("n0", "bad0", "total", "total_bad", "missing", "missing_bad"))
        if base.column("part")[0].as_py() < 0:
            out = [np.zeros(width)] * len(kernel.adds)
        else:
            score, at = np.unique(part.column("score").to_numpy(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(len(score)))
            sums = [np.add.reduceat(_matrix(part.column(c), "<f8", width)[order], first, axis=0) for c in ("n", "bad")]
            n, bad = (x[::-1] for x in sums) if kernel.descending else sums
            out = kernel.scan(n, bad, n0 + np.cumsum(n, axis=0) - n, bad0 + np.cumsum(bad, axis=0) - bad, total, total_bad, missing)
        keys = [base.column(c).slice(0, 1) for c in by]
        return pa.table([*keys, *(pa.array([x.tobytes()], pa.binary()) for x in (*out, total, total_bad, missing, missing_bad))], schema=added_arrow)

    fields = [*_fields(blocks, by), *extra]
    result = StructType(fields + [StructField(c, _ARRAY) for c in metrics])
    result_arrow = to_arrow_schema(result)

    def finish(table: pa.Table) -> pa.Table:
        sums = {c: _matrix(table.column(c), "<f8", width).sum(0) for c in kernel.adds}
        totals = [_matrix(table.column(c), "<f8", width)[0] for c in names[len(kernel.adds) :]]
        rows = kernel.finish(sums, *totals)
        keys = [[table.column(c)[0].as_py()] * len(rows) for c in by] + [list(x) for x in zip(*(r[0] for r in rows), strict=True)]
        values = [[np.where(np.isnan(r[1][k]), None, r[1][k]).tolist() for r in rows] for k in range(len(metrics))]
        return pa.table([pa.array(v, f.type) for v, f in zip(keys + values, result_arrow, strict=True)], schema=result_arrow)

    keyed = [*by, "part"]
    contributions = blocks.groupBy(*keyed).cogroup(bases.groupBy(*keyed)).applyInArrow(scan, added)
    return (contributions.groupBy(*by) if by else contributions.groupBy(F.lit(0).alias("all"))).applyInArrow(finish, result)


def _cells(df: DataFrame, by: list[str], strata: list[str], group: str, truth: Column, score: str) -> DataFrame:
    bad = F.count_if(truth).cast("double").alias("bad")
    return df.groupBy(*dict.fromkeys([*by, *strata, group]), F.col(score).cast("double").alias("score")).agg(F.count("*").cast("double").alias("n"), bad)


def ranking_bootstrap(df: DataFrame, pool: DataFrame, by: list[str], strata: list[str], group: str, truth: str, score: str, replicates: int = 1000, seed: int = 17, vectors: DataFrame | None = None) -> DataFrame:
    """(by, arrays of RANKING and REGRESSION metrics): entry 0 is the sample, the others the replicates; undefined is null.

    Rows without truth or score are left out, as in ``tie_blocks``; a scope with no row left gives none. ``vectors``: of
    ``draw_vectors``, to share draws between calls.
    """
    rows = only_finite(df, truth, score).where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    regression = _regression(rows, by, vectors, pool, strata, group, truth, score, replicates, seed)
    vectors = draw_vectors(pool, strata, group, replicates, seed) if vectors is None else vectors
    ranked = _scan(_cells(rows, by, strata, group, F.col(truth) < CUT, score), by, vectors, strata, group, replicates, Ranking, [], RANKING)
    return ranked.alias("x").join(regression.alias("y"), same_scope(by, "x", "y")).select("x.*", *(f"y.{c}" for c in REGRESSION))


def _regression(rows: DataFrame, by: list[str], vectors: DataFrame | None, pool: DataFrame, strata: list[str], group: str, truth: str, score: str, replicates: int, seed: int) -> DataFrame:
    e = F.col(truth) - F.col(score)
    rows, sums = rows.withColumns({"n": F.lit(1), "a": F.abs(e), "q": e * e}), ["n", "a", "q"]
    errors = drawn_totals(rows, by, sums, pool, strata, group, replicates, seed) if vectors is None else vector_totals(rows, by, sums, vectors, strata, group, replicates)
    schema = StructType([*_fields(errors, by), *(StructField(c, _ARRAY) for c in REGRESSION)])
    arrow, width = to_arrow_schema(schema), replicates + 1

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, q = (_matrix(batch.column(c), "<f8", width) for c in sums)
            out = [_defined(a, n), np.sqrt(_defined(q, n))]
            yield pa.record_batch([*(batch.column(c) for c in by), *(pa.array([np.where(np.isnan(v), None, v).tolist() for v in x], pa.list_(pa.float64())) for x in out)], schema=arrow)

    return errors.mapInArrow(divide, schema)


def regression_bootstrap(df: DataFrame, pool: DataFrame, by: list[str], strata: list[str], group: str, truth: str, score: str, replicates: int = 1000, seed: int = 17) -> DataFrame:
    """(by, arrays of REGRESSION metrics) alone: rows are summed to their group, and no vector is made a group."""
    rows = only_finite(df, truth, score).where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    return _regression(rows, by, None, pool, strata, group, truth, score, replicates, seed)


def evaluation_groups(df: DataFrame, dataset: str, source: str, group: str, grouped: list[str], name: str = "case") -> DataFrame:
    """``df`` with the unit that is drawn: the group in datasets that have families of sources, else the source itself."""
    return df.withColumn(name, F.when(F.col(dataset).isin(grouped), F.concat(F.lit("group:"), F.col(group).cast("string"))).otherwise(F.concat(F.lit("source:"), F.col(source).cast("string"))))


def by_methods(df: DataFrame, methods: dict[str, str], keep: list[str]) -> DataFrame:
    """One row a method: (keep, method, score, common); ``common`` says that every method has a score there."""
    common = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in methods.values()])
    named = F.create_map(*(x for m, c in methods.items() for x in (F.lit(m), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))))
    return df.select(*keep, common.alias("common"), F.explode(named).alias("method", "score"))


def report_units(claims: DataFrame, report: list[str], truth: str, methods: dict[str, str]) -> DataFrame:
    """Claims to reports: any low truth, each method's least score; one missing score makes the report's missing."""
    scores = [F.when(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) == 0, F.min(c)).alias(c) for c in methods.values()]
    return claims.groupBy(*report).agg(F.bool_or(F.col(truth) < CUT).alias("low"), *scores)


def workload_bootstrap(claims: DataFrame, reports: DataFrame, strata: list[str], group: str, report: list[str], truth: str, methods: dict[str, str], replicates: int = 1000, seed: int = 17) -> DataFrame:
    """(level, policy, method, budget, arrays of WORKLOAD metrics): review workload over claims and over reports.

    ``reports``: every report that was asked for, with strata and group, also those without an eligible claim; its
    groups are the pool, drawn within strata. ``report``: the columns that name a report, strata and group among them.
    Policies: ``common_valid`` keeps units that every method has scored, ``full_failure_first`` keeps all and reviews
    those without a score first, even beyond the budget. The share of all reports is defined for the level of reports.
    """
    vectors = draw_vectors(reports, strata, group, replicates, seed)
    keys = [*strata, group]
    clean = only_finite(claims, truth)
    units = by_methods(clean.withColumn("low", F.col(truth) < CUT), methods, [*keys, "low"]).withColumn("level", F.lit("claim"))
    units = units.unionByName(by_methods(report_units(clean, report, truth, methods), methods, [*keys, "low"]).withColumn("level", F.lit("report")))
    policies = F.when(F.col("common"), F.array(F.lit("common_valid"), F.lit("full_failure_first"))).otherwise(F.array(F.lit("full_failure_first")))
    rows = only_finite(units.withColumn("policy", F.explode(policies)), "score")
    by = ["level", "policy", "method"]
    budget = [StructField("budget", DoubleType())]
    found = _scan(_cells(rows, by, strata, group, F.col("low"), "score"), by, vectors, strata, group, replicates, Budgets, budget, (*WORKLOAD[:4], "reviewed"))
    asked = vector_totals(reports.withColumns({"level": F.lit("report"), "asked": F.lit(1)}), ["level"], ["asked"], vectors, strata, group, replicates)
    width = replicates + 1

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("level"), pa.array([v.tolist() for v in _matrix(batch.column("asked"), "<f8", width)], pa.list_(pa.float64()))], ["level", "asked"])

    none = F.expr("CAST(array() AS array<double>)")  # for claims: as many undefined entries as there are reviews
    share = F.zip_with("reviewed", F.coalesce("asked", none), lambda a, b: F.when(b > 0, a / b))
    joined = found.join(asked.mapInArrow(opened, "level string, asked array<double>"), "level", "left")
    return joined.select(*by, "budget", *WORKLOAD[:4], share.alias(WORKLOAD[4]))


# What comes out of the vectors.


def long_form(result: DataFrame, by: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """(by, rep, metrics): rep -1 is the sample."""
    zipped = F.posexplode(F.arrays_zip(*metrics)).alias("rep", "x")
    return result.select(*by, zipped).select(*by, (F.col("rep") - 1).alias("rep"), *(F.col(f"x.{c}").alias(c) for c in metrics))


def paired(result: DataFrame, by: list[str], method: str, selected: str, metrics: tuple[str, ...]) -> DataFrame:
    """Selected minus each other method, replicate by replicate; one undefined side makes the difference undefined."""
    others = [c for c in by if c != method]
    mine = result.where(F.col(method) == selected).alias("s")
    joined = result.where(F.col(method) != selected).alias("o").join(mine, same_scope(others, "o", "s"))
    return joined.select(*(f"o.{c}" for c in by), *(F.zip_with(f"s.{c}", f"o.{c}", lambda a, b: a - b).alias(c) for c in metrics))


def vector_intervals(result: DataFrame, by: list[str], metrics: tuple[str, ...], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, metric, point, low, high, n_valid, n_undefined): the sample, and exact percentiles over defined replicates."""
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in metrics))).alias("m")
    opened = result.select(*by, named).select(*by, "m.metric", F.element_at("m.v", 1).alias("point"), F.explode(F.slice("m.v", 2, F.size("m.v"))).alias("v"))
    return opened.groupBy(*by, "metric").agg(
        F.first("point").alias("point"), F.percentile("v", F.lit(low)).alias("low"), F.percentile("v", F.lit(high)).alias("high"), F.count("v").alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_undefined")
    )
