"""Contour files: round trips, each fault of the grammar with its byte, and three ways to read them."""

import hashlib

import pytest

from rankweave.sources import pfs

RIGHT, LEFT = [(100.0, 100.0), (400.0, 120.5), (380.0, 900.0), (90.25, 880.0)], [(600.0, 100.0), (900.0, 100.0), (900.0, 900.0), (600.0, 900.0)]
GOOD = pfs.written_form(RIGHT, LEFT, ("heart", "right lung"))


def points(side):
    return [(p["x"], p["y"]) for p in side]


def test_round_trip_and_what_is_left_out():
    row = pfs.parse(GOOD.encode())
    assert row["fault"] is None and points(row["right_lung"]) == RIGHT and points(row["left_lung"]) == LEFT
    assert row["excluded"] == ["heart fixed", "right lung fixed"] and row["sha256"] == hashlib.sha256(GOOD.encode()).hexdigest()
    crlf = b"\xef\xbb\xbf" + GOOD.replace("\n", "\r\n").replace("},", "}").encode()
    other = pfs.parse(crlf)
    assert points(other["right_lung"]) == RIGHT and other["sha256"] != row["sha256"]
    twice = pfs.parse(pfs.written_form([RIGHT[0], RIGHT[0], *RIGHT[1:], RIGHT[0], RIGHT[0]], LEFT).encode())
    assert points(twice["right_lung"]) == RIGHT and twice["right_removed"] == [1, 5, 6] and twice["left_removed"] == []


@pytest.mark.parametrize(
    ("old", "new", "kind", "where"),
    [
        ("{\n[Label=left lung]", "{\n{\n[Label=left lung]", "block inside a block", "{\n[Label=left lung]"),
        ("; contours\n", "}\n", "closing without a block", "}\n"), ("; contours\n", "[Label=x]\n", "line outside a block", "[Label=x]"), ("; contours\n", "what\n", "line outside a block", "what"),
        ("[Label=left lung]", "[Label=spleen]", "unknown label", "{\n[Label=spleen]"), ("[Label=left lung]\n", "", "unknown label", "{\n[LineMode=ClosedContour]\n{ 600"),
        ("[Label=left lung]", "[Label=right lung]", "label twice", "{\n[Label=right lung]\n[LineMode=ClosedContour]\n{ 600"),
        ("{ 900.0, 100.0 },", "{ 900.0 100.0 },", "malformed line", "{ 900.0 100.0"), ("{ 900.0, 100.0 },", "{ 900.0, nan },", "malformed line", "{ 900.0, nan"), ("{ 900.0, 100.0 },", "[Late=1]", "attribute twice or after points", "[Late=1]"),
        ("[Label=left lung]", "[Label=left lung]\n[Label=left lung]", "attribute twice or after points", "[Label=left lung]\n[LineMode"),
        ("[LineMode=ClosedContour]\n{ 600", "[LineMode=Open]\n{ 600", "left lung is no closed contour", "{\n[Label=left lung]"), ("left lung]", "left lung fixed]", "no left lung", None),
        ("{ 900.0, 100.0 },", "{ 1900.0, 100.0 },", "left lung: 3 to 2048 different points inside the image are needed", "{\n[Label=left lung]"), ("{ 900.0, 900.0 },\n{ 600.0, 900.0 },", "{ 600.0, 900.0 },\n{ 900.0, 900.0 },", "left lung: no area", "{\n[Label=left lung]"), ("{ 900.0, 900.0 },\n{ 600.0, 900.0 },", "{ 600.0, 900.0 },\n{ 850.0, 800.0 },", "left lung: edges cross, touch or turn back", "{\n[Label=left lung]"),
    ],
)
def test_each_fault_and_its_byte(old, new, kind, where):
    text = pfs.written_form(RIGHT, LEFT)
    assert text.count(old) >= 1
    bad = text.replace(old, new, 1)
    row = pfs.parse(bad.encode())
    assert row["fault"] == kind and row["right_lung"] is None
    assert row["fault_at"] == (len(bad) if where is None else bad.rindex(where) if kind == "label twice" else bad.index(where))


def test_bytes_that_are_no_text_and_files_without_an_end():
    raw = pfs.written_form(RIGHT, LEFT).encode()
    assert pfs.parse(raw[: raw.rindex(b"},")])["fault"] == "block without an end"
    at = raw.index(b"[Label=left")
    assert (pfs.parse(raw[:at] + b"\xff\n" + raw[at:])["fault"], pfs.parse(raw[:at] + b"\xff\n" + raw[at:])["fault_at"]) == ("no UTF-8", at)
    assert pfs.parse(b"")["fault"] == pfs.parse(b";" * (pfs.MOST_BYTES + 1))["fault"] == "empty or too large"


def test_files_through_spark_and_the_data_source(spark, tmp_path):
    pfs.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pfs").write_text(GOOD)
    (tmp_path / "in" / "deep" / "b.pfs").write_text(pfs.written_form(LEFT, RIGHT))
    (tmp_path / "in" / "notes.txt").write_text("no contour")
    place = str(tmp_path / "in")
    one = pfs.contours(spark, place)
    two = spark.read.format("pfs").load(place)
    assert two.rdd.getNumPartitions() == 2 and one.columns == two.columns
    assert sorted(one.collect()) == sorted(two.collect()) and {r.name for r in one.collect()} == {"a.pfs", "b.pfs"}
    (tmp_path / "in" / "c.pfs").write_text("{\n")
    for read in (lambda: pfs.contours(spark, place), lambda: spark.read.format("pfs").load(place)):
        with pytest.raises(Exception, match="c.pfs.*block without an end at byte 0"):
            read().collect()
    kept = spark.read.format("pfs").option("mode", "PERMISSIVE").load(place)
    assert [(r.name, r.fault) for r in kept.where("fault IS NOT NULL").collect()] == [("c.pfs", "block without an end")]
    (tmp_path / "none").mkdir()
    assert spark.read.format("pfs").load(str(tmp_path / "none")).count() == 0


def test_contents_as_a_column_and_masks(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (2, None, "y"), (3, "{", "z")], "k int, content string, fault_at string")
    rows = pfs.parsed(df, ["k"], "content")
    assert {(r.k, r.fault) for r in rows.collect()} == {(1, None), (2, "missing"), (3, "block without an end")}
    masks = {r.k: r for r in pfs.rasterized(rows, ["k"], 512).collect()}
    assert masks[2].right_mask is None and masks[1].left_area == 150 * 400 and (masks[1].height, len(masks[1].left_mask)) == (512, 512 * 512 // 8)
    with pytest.raises(Exception, match="lungs overlap"):
        pfs.rasterized(pfs.parsed(spark.createDataFrame([(1, pfs.written_form(LEFT, LEFT))], "k int, content string"), ["k"], "content"), ["k"], 64).collect()
