"""Near duplicates by banded fingerprints and exact hashes, kept greedily in order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

#: Hamming distance that nine bands of 256 bits find for certain: of nine bands, eight differing bits leave one equal.
RADIUS = 8
#: Widest mean difference of two thumbnails that still are one picture.
THUMBNAIL = 12.0
#: Codes of one band that meet in one task; a larger band is cut into blocks.
BLOCK = 4_000
#: Memberships (some 50 bytes and their names) of a range of nodes that a greedy scan takes in one task.
LOCAL_ROWS = 250_000
#: Memberships of a group beyond which it is not brought to one task.
HOT_GROUP = 100_000


def lanes(code: Column) -> Column:
    """64 hex digits as four 64-bit lanes."""
    return F.array(*(F.conv(F.substring(code, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(4)))


#: First bit and width of the nine bands, from the left: eight of 28 bits and one of 32.
BANDS = [(28 * k, 28) for k in range(8)] + [(224, 32)]


def _pieces(start: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(lane, right shift, width) of the parts of a band that lie in each lane."""
    while width:
        lane, at = divmod(start, 64)
        take = min(width, 64 - at)
        yield lane, 64 - at - take, take
        start, width = start + take, width - take


def bands(lanes_: Column) -> Column:
    """The nine bands of a code as numbers, from its lanes."""

    def band(start: int, width: int) -> Column:
        out = F.lit(0).cast("long")
        for lane, right, take in _pieces(start, width):
            out = F.shiftleft(out, take).bitwiseOR(F.shiftrightunsigned(lanes_[lane], right).bitwiseAND(F.lit((1 << take) - 1)))
        return out

    return F.array(*(band(*x) for x in BANDS))


def _first_shared(a: Column, b: Column) -> Column:
    """The first band in which two codes are equal, from their lanes."""
    out = F.when(F.lit(False), F.lit(0))
    for k, x in enumerate(BANDS):
        equal = reduce(Column.__and__, (F.shiftrightunsigned(a[lane].bitwiseXOR(b[lane]), right).bitwiseAND(F.lit((1 << take) - 1)) == 0 for lane, right, take in _pieces(*x)))
        out = out.when(equal, F.lit(k))
    return out


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two codes, from their lanes."""
    return reduce(Column.__add__, (F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(4)))


def near_pairs(df: DataFrame, key: str, code: str, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance), a < b, for different codes within ``radius``; equal codes are one class and do not pair.

    The self-join runs on distinct codes (exact copies collapse first), so a hot code costs one row; a pair found in
    several bands counts in the first band it shares. Rows carry the key, the lanes and one band. A band value of many
    codes (blank pictures) is cut into blocks, and every two blocks meet in a task of their own. A null code or key
    pairs with nothing.
    """
    classes = df.where(F.col(code).isNotNull() & F.col(key).isNotNull()).groupBy(code).agg(F.min(key).alias("k")).select("k", lanes(F.col(code)).alias("l"))
    opened = classes.select("k", "l", F.posexplode(bands(F.col("l"))).alias("p", "band"))
    sizes = opened.groupBy("p", "band").agg((1 + F.expr(f"(count(*) - 1) DIV {BLOCK}")).alias("blocks")).where("blocks > 1")
    apart = (F.col("a") < F.col("b")) & (hamming(F.col("x"), F.col("y")) <= radius) & (_first_shared(F.col("x"), F.col("y")) == F.col("p"))
    # Both sides of a band that needs no blocks are one shuffle, which Spark reuses as they differ in names alone.
    cold = opened.join(F.broadcast(sizes), ["p", "band"], "left_anti")
    side = lambda k, x: cold.select("p", "band", F.col("k").alias(k), F.col("l").alias(x))
    # Nine rows a code are not seen in the estimated size, so Spark would send all of them through the driver.
    pairs = side("a", "x").join(side("b", "y").hint("merge"), ["p", "band"]).where(apart).select("a", "b", "x", "y")
    hot = opened.join(F.broadcast(sizes), ["p", "band"], "left_semi").join(F.broadcast(sizes), ["p", "band"], "left")
    cut = hot.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))
    others = F.explode(F.expr("sequence(0L, blocks - 1)"))
    a = cut.select("p", "band", F.col("block").alias("i"), others.alias("j"), F.col("k").alias("a"), F.col("l").alias("x"))
    b = cut.select("p", "band", others.alias("i"), F.col("block").alias("j"), F.col("k").alias("b"), F.col("l").alias("y"))
    pairs = pairs.unionByName(a.join(b.hint("merge"), ["p", "band", "i", "j"]).where(apart).select("a", "b", "x", "y"))
    return pairs.select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


def thumbnail_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two thumbnails given as binary of equal length."""
    bytes_of = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.conv(F.hex(F.substring(x, i, F.lit(1))), 16, 10).cast("int"))
    apart = F.zip_with(bytes_of(a), bytes_of(b), lambda x, y: F.abs(x - y))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x) / F.length(a)


def memberships(df: DataFrame, key: str, exact: list[str], code: str, thumbnail: str, radius: int = RADIUS, most: float = THUMBNAIL) -> DataFrame:
    """(group, node): rows of one group match each other. Equal values of an exact hash are one group however many rows
    hold them; a near pair (codes within ``radius`` and thumbnails within ``most``) is a group of two."""
    hashes = [df.where(F.col(h).isNotNull()).select(F.concat(F.lit(f"{h}:"), F.col(h).cast("string")).alias("group"), F.col(key).alias("node")) for h in exact]
    # Rows of one code and thumbnail match each other and pair alike, so pairs are sought between those classes.
    kinds = df.where(F.col(code).isNotNull()).groupBy(code, thumbnail).agg(F.min(key).alias("kind"))
    alike = df.join(kinds, [code, thumbnail]).select("kind", F.col(key).alias("node"))
    hashes.append(alike.select(F.concat(F.lit("kind:"), F.col("kind").cast("string")).alias("group"), "node"))
    codes = kinds.select(code, thumbnail, "kind")
    near = near_pairs(codes, "kind", code, radius).select("a", "b")
    by_code = codes.groupBy(code).agg(F.min("kind").alias("first"))
    named = codes.join(by_code, code).select("first", "kind", F.col(thumbnail).alias("picture"))
    twins = by_code.select(F.col("first").alias("a"), F.col("first").alias("b"))
    side = lambda c: named.select(F.col("first").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("picture").alias(f"picture_{c}"))
    found = near.unionByName(twins).join(side("a"), "a").join(side("b"), "b").where("a < b OR kind_a < kind_b").where(thumbnail_difference(F.col("picture_a"), F.col("picture_b")) <= most)
    pairs = found.select(F.concat_ws(":", F.lit("near"), F.col("kind_a").cast("string"), F.col("kind_b").cast("string")).alias("group"), F.explode(F.array("kind_a", "kind_b")).alias("kind"))
    # All rows of the two classes match each other, so they are one group.
    return reduce(DataFrame.unionByName, hashes).unionByName(pairs.join(alike, "kind").select("group", "node")).distinct()


def pair_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(group, node) of matching pairs."""
    return pairs.select(F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string")).alias("group"), F.explode(F.array(a, b)).alias("node"))


def greedy_keep(members: DataFrame, nodes: DataFrame, seeds: DataFrame | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node, kept) by the sequential rule: in the order of ``node`` keep a row unless an earlier kept row matches it.

    ``members``: (group, node), rows of one group match each other. ``seeds``: (node), kept before all others, whether in
    ``nodes`` or not; of the result only those of ``nodes`` are part. In each round memberships meet once by group, which
    gives the least kept and the least open node of each, and once by ranges of nodes of some ``local_rows`` memberships.
    A range is scanned in order and decides every row all of whose earlier matches are decided or lie in its range, so
    chains of close rows end in few rounds; each round is written, and decided rows leave the table. The first open row
    is decided in each round, with its range, so rounds end with no row open. Groups of over ``HOT_GROUP`` rows are
    summed up and broadcast instead, so a group of any size costs its rows. A null node is no row.
    """
    spark = nodes.sparkSession

    def saved(df: DataFrame) -> DataFrame:
        return written(df, "greedy")

    rows = nodes.select("node").where("node IS NOT NULL").distinct().withColumn("seed", F.lit(False))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("node").distinct().withColumn("seed", F.lit(True))).groupBy("node").agg(F.max("seed").alias("seed"))
    kept = F.when(F.col("seed"), F.lit(True))
    # Rows of a node lie together from here on: what is told twice goes, and the join shuffles nothing more.
    placed = members.where("group IS NOT NULL").select("group", "node").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").distinct()
    live = saved(placed.join(rows, "node").select("group", "node", F.when(F.col("seed"), F.lit(-(2**63))).otherwise(F.col("node")).alias("rank"), kept.alias("kept")))
    least = [F.min(F.when(F.col("kept"), F.col("rank"))), F.min(F.when(F.col("kept").isNull(), F.col("rank")))]
    hot = saved(live.groupBy("group").count().where(F.col("count") > HOT_GROUP).select("group"))
    any_hot = not hot.isEmpty()
    decided = []
    while live.where("kept IS NULL").limit(1).count():
        cold, joined = live, None
        if any_hot:
            large = live.join(F.broadcast(hot), "group", "left_semi")
            joined = large.join(F.broadcast(large.groupBy("group").agg(least[0].alias("first_kept"), least[1].alias("first_open"))), "group")
            cold = live.join(F.broadcast(hot), "group", "left_anti")
        group = Window.partitionBy("group")
        stated = cold.select("*", least[0].over(group).alias("first_kept"), least[1].over(group).alias("first_open"))
        stated = stated.unionByName(joined) if any_hot else stated
        # Groups with no open row have nothing more to say.
        ranges = -(-live.count() // max(1, local_rows))
        placed = stated.where("first_open IS NOT NULL").select(*_SCANNED).repartitionByRange(ranges, "node")
        now = saved(placed.mapInArrow(_scan, "group string, node long, rank long, kept boolean, fate boolean, lead boolean"))
        decided.append(now.where("lead").select("node", F.col("fate").alias("kept")))
        live = now.where("coalesce(fate, true)").select("group", "node", "rank", F.coalesce("kept", "fate").alias("kept"))
    found = reduce(DataFrame.unionByName, decided) if decided else spark.createDataFrame([], "node long, kept boolean")
    # Rows that match nothing, and seeds, are kept.
    return nodes.select("node").where("node IS NOT NULL").distinct().join(found, "node", "left").select("node", F.coalesce("kept", F.lit(True)).alias("kept"))


_SCANNED = ("group", "node", "rank", "kept", "first_kept", "first_open")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one-by-one rule over a range of nodes: the same memberships, with the fate of the rows that can be decided
    and, in one membership of each such row, ``lead``. A row waits if it may be hit by an open one: of its range, or of
    an earlier range, which is where the first open row of its group then is."""
    held = list(batches)
    if not held:
        return
    part = pa.Table.from_batches(held)
    group, node, rank, kept, first_kept, first_open = (part.column(c).to_pylist() for c in _SCANNED)
    own: dict[int, list[int]] = {}
    for i, (n, k) in enumerate(zip(node, kept, strict=True)):
        if k is None:
            own.setdefault(n, []).append(i)
    order = sorted(own)
    start = order[0] if order else 0
    taken: set[str] = set()
    open_: set[str] = set()
    fate: list[bool | None] = [None] * len(node)
    lead = [False] * len(node)
    for n in order:
        at = own[n]
        if any(group[i] in taken or (first_kept[i] is not None and first_kept[i] < n) for i in at):
            fate_n = False
        elif any(first_open[i] < start or group[i] in open_ for i in at):
            open_.update(group[i] for i in at)
            continue
        else:
            fate_n = True
            taken.update(group[i] for i in at)
        lead[at[0]] = True
        for i in at:
            fate[i] = fate_n
    yield from part.select(["group", "node", "rank", "kept"]).append_column("fate", pa.array(fate, pa.bool_())).append_column("lead", pa.array(lead, pa.bool_())).to_batches()
