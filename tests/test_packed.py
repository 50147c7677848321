"""Order of rows in their files, and identity of packed rows."""

import hashlib
import json

from rankweave.operators import packed


def test_storage_order_gaps_overlaps_and_swaps(spark, tmp_path):
    def table(name, *files):
        for k, positions in enumerate(files):
            spark.createDataFrame([(p, f"r{p}") for p in positions], "position long, x string").coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"f={k}"))
        return spark.read.parquet(str(tmp_path / name))

    faults = lambda df: sorted((r.position, r.fault) for r in packed.storage_faults(df, "position").collect())
    assert faults(table("sound", range(0, 50), range(50, 70), range(70, 71))) == []
    swapped = [*range(50, 60), 61, 60, *range(62, 70)]
    assert faults(table("swapped", range(0, 50), swapped)) == [(60, "out of place"), (61, "out of place")]
    assert faults(table("gap", range(0, 50), range(52, 70))) == [(52, "gap")]
    assert faults(table("overlap", range(0, 50), range(49, 70))) == [(49, "overlap")]
    assert faults(table("late", range(3, 50))) == [(3, "gap")]
    first_moved = [9, *range(1, 9), 0, *range(10, 40)]
    assert faults(table("ends", first_moved)) == [(0, "out of place"), (9, "out of place")]


def test_identity_of_packed_rows(spark):
    def sha(*parts):
        return hashlib.sha256(json.dumps(list(parts), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def rows(k, name, image=None, dataset="d"):
        out = []
        for v in range(13):
            for j, f in enumerate(packed.FINDINGS):
                out.append([39 * k + 3 * v + j, v, f, sha("i", dataset, name, v), sha("q", dataset, name, v, f), dataset, name, image or f"img-{name}", f"g-{name}", "fit"])
        return out

    schema = "position long, variant_index long, finding string, input_id string, row_id string, dataset string, source_id string, source_image_sha256 string, split_group_id string, split string"

    def faults(data):
        return sorted((r.position, r.fault) for r in packed.identity_faults(spark.createDataFrame([tuple(r) for r in data], schema), "fit", "i", "q").collect())

    good = rows(0, "a") + rows(1, "é\"b") + rows(2, "a", "img-other", "e")
    assert faults(good) == []
    swapped = [list(r) for r in good]
    swapped[4][0], swapped[5][0] = 5, 4
    assert faults(swapped) == [(4, "finding"), (4, "row_id"), (5, "finding"), (5, "row_id")]
    other = [list(r) for r in good]
    other[40][8], other[41][9], other[0][3] = "g-x", "dev", None
    assert faults(other) == [(0, "input_id"), (39, "source differs"), (41, "split")]
    assert faults(good[:-1]) == [(78, "rows")]
    assert faults(rows(0, "a") + rows(1, "a")) == [(0, "image twice"), (0, "source twice"), (39, "image twice"), (39, "source twice")]
