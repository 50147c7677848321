"""Resumable runs, locks, plug-ins and canonical digests."""

import hashlib
import json
import math
import os
import sys
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankweave.functions import canonical
from rankweave.operators import runs
from rankweave.operators.contracts import ContractError
from rankweave.sources import locks
from rankweave.staging import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


@pytest.fixture
def log(spark):
    return runs.AttemptLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")


def planned(spark, n=23, size=4):
    return runs.plan_batches(spark.createDataFrame([(k, f"s{k}") for k in range(n)], "k long, name string"), ["k", "name"], ["k"], size, "p1")


def good(rows):
    return [{f: {"score": r["k"] / 100} for f in runs.FINDINGS} for r in rows]


class Asked(runs.Scorer):
    """Notes each call beside the log; ``dies`` and ``raises`` name keys."""

    def __init__(self, notes, dies=(), raises=(), odd=None, prepare_fails=False):
        self.notes, self.dies, self.raises, self.odd, self.prepare_fails = notes, dies, raises, odd or {}, prepare_fails

    def note(self, what):
        with open(f"{self.notes}/{uuid.uuid4().hex}", "w") as f:
            f.write(what)

    def prepare(self):
        self.note("prepare")
        if self.prepare_fails:
            raise OSError("no model")

    def infer(self, rows):
        keys = [r["k"] for r in rows]
        self.note("infer " + ",".join(map(str, keys)))
        if set(keys) & set(self.dies):
            os._exit(3)
        if set(keys) & set(self.raises):
            raise RuntimeError("batch")
        return [self.odd.get(r["k"], x) for r, x in zip(rows, good(rows), strict=True)]

    def close(self):
        self.note("close")


def notes_of(path):
    return [open(f"{path}/{x}").read() for x in os.listdir(path)]


def final(plan, log):
    return {(r.k, r.finding): (r.status, r.score, r.failure_reason, r.attempted) for r in runs.outcomes(plan, log).collect()}


def test_a_run_and_a_second_that_has_nothing_to_do(spark, log, tmp_path):
    plan = planned(spark)
    assert runs.run(plan, log, lambda: Asked(tmp_path), shards=3) >= 1
    assert final(plan, log) == {(k, f): ("success", k / 100, None, True) for k in range(23) for f in runs.FINDINGS}
    said = notes_of(tmp_path)
    assert sorted(x for x in said if x.startswith("infer")) == sorted("infer " + ",".join(str(k) for k in range(a, min(a + 4, 23))) for a in range(0, 23, 4))
    assert said.count("prepare") == said.count("close") > 0
    assert runs.run(plan, log, lambda: Asked(tmp_path), shards=3) == 0 and len(notes_of(tmp_path)) == len(said)


def test_answers_that_break_the_contract_fail_alone(spark, log, tmp_path):
    plan, score = planned(spark), lambda x: {f: {"score": x} for f in runs.FINDINGS}
    odd = {0: score(math.nan), 1: score(True), 2: score("x"), 3: {"pneumothorax": {"score": 0.5}}, 5: {**score(0.5), "more": {"score": 1}}, 6: {f: {"score": 0.5, "name": "mine"} for f in runs.FINDINGS}, 7: ValueError("x"), 9: score(1.5), 10: score(1)}
    runs.run(plan, log, lambda: Asked(tmp_path, odd=odd, raises=[13]), bounds=(0.0, 1.0))
    got = final(plan, log)
    for k in range(23):
        want = "failed" if (k in odd and k != 10) or 12 <= k <= 15 else "success"
        reason = None if want == "success" else "inference: RuntimeError" if 12 <= k <= 15 else "scoring: ValueError" if k == 7 else "scoring: ContractError"
        assert {got[k, f][0] for f in runs.FINDINGS} == {want} and {got[k, f][2] for f in runs.FINDINGS} == {reason}, k
    assert got[10, "pneumothorax"][1] == 1.0 and len(got) == 23 * 3


def test_a_partial_batch_is_asked_whole_and_appends_what_it_lacks(spark, log, tmp_path):
    plan = planned(spark)
    runs.run(plan, log, lambda: Asked(tmp_path, odd={5: ValueError("once")}))
    before = log.records().count()
    second = tmp_path / "second"
    second.mkdir()
    assert runs.run(plan, log, lambda: Asked(second)) == 0  # errors are kept unless they are retried
    runs.run(plan, log, lambda: Asked(second), retry_errors=True)
    assert [x for x in notes_of(second) if x.startswith("infer")] == ["infer 4,5,6,7"]
    assert log.records().count() == before + 1 and final(plan, log)[5, "consolidation"] == ("success", 0.05, None, True)
    assert log.latest().where("attempt = 2").count() == 1


def test_a_worker_that_dies_leaves_every_input_once(spark, log, tmp_path):
    plan = planned(spark)
    with pytest.raises(Exception, match="(?i)crash|exited|worker"):
        runs.run(plan, log, lambda: Asked(tmp_path, dies=[9]), shards=4)
    done = log.latest().count()
    assert done < 23 and not os.path.exists(log.folder.removeprefix("file://") + ".lock")
    assert {v for k, v in final(plan, log).items() if k[0] == 9} == {("failed", None, "not_attempted", False)}
    runs.run(plan, log, lambda: Asked(tmp_path), shards=4)
    assert log.records().count() == 23 and {v[0] for v in final(plan, log).values()} == {"success"}


def test_a_scorer_that_cannot_be_prepared_stops(spark, log, tmp_path):
    plan = planned(spark)
    runs.run(plan, log, lambda: Asked(tmp_path, prepare_fails=True), shards=1)
    said = notes_of(tmp_path)
    assert set(said) == {"prepare"} and 0 < log.records().where("stage = 'preparation'").count() <= 4 * len(said)
    runs.run(plan, log, lambda: Asked(tmp_path), retry_errors=True)
    assert {v[0] for v in final(plan, log).values()} == {"success"}


def test_logs_plans_and_writers_do_not_mix(spark, log, tmp_path):
    plan = planned(spark)
    runs.run(plan, log, lambda: Asked(tmp_path))
    other = planned(spark, size=5)  # other batches, other keys
    with pytest.raises(ContractError, match="another plan"):
        runs.run(other, log, lambda: Asked(tmp_path))
    with locks.exclusive_writer(spark, log.folder), pytest.raises(ContractError, match="another writer"):
        runs.run(plan, log, lambda: Asked(tmp_path))
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "k long, name string")
    with pytest.raises(ContractError, match="more than once"):
        runs.plan_batches(twice, ["k"], ["k"], 4, "p")
    people = spark.createDataFrame([("p", "fit"), ("p", "dev"), ("q", "test")], "subject string, part string")
    with pytest.raises(ContractError, match="cross"):
        runs.refuse_sealed(people, "subject", "part")
    with pytest.raises(ContractError, match="sealed"):
        runs.refuse_sealed(people.where("subject = 'q'"), "subject", "part")
    assert runs.refuse_sealed(people.where("subject = 'q'"), "subject", "part", allow=True).count() == 1
    assert runs.registry(spark).count() == 15


def test_sealed_places_are_refused_before_a_byte_is_read(spark, tmp_path):
    for bad in ("/data/test/x", "file:///data/labels_external_abc/x", "hdfs://host/export_calibration", "/a/TEST/b"):
        with pytest.raises(ContractError):
            locks.allowed_path(bad)
    assert locks.allowed_path("/data/contest/latest/x") == "/data/contest/latest/x"
    place = tmp_path / "fit"
    spark.range(3).write.parquet(str(place / "a"))
    spark.range(3).write.parquet(str(tmp_path / "test" / "a"))
    assert locks.reads_allowed(spark.read.parquet(str(place / "a")), r"test|calibration").count() == 3
    with pytest.raises(ContractError):
        locks.reads_allowed(spark.read.parquet(str(tmp_path / "test" / "a")).where("id > 1"), r"test|calibration")


def test_canonical_json_is_the_plain_writers(spark):
    values = [
        {"b": "é\"\\/\n\x1f\x0b \\u001F", "a": [1, None, 3], "m": {"z": True, "é": None, "A": False}, "s": {"y": None, "x": "𝄞"}},
        {"b": None, "a": None, "m": None, "s": None}, {"b": "", "a": [], "m": {}, "s": {"y": -5, "x": ""}},
    ]
    kind = "b string, a array<int>, m map<string,boolean>, s struct<y:bigint,x:string>"
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v struct<{kind.replace(' ', ':', 1).replace(', a ', ',a:').replace(', m ', ',m:').replace(', s ', ',s:')}>")
    dump = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    assert [r.j for r in df.select("k", canonical.canonical_json(df, "v").alias("j")).orderBy("k").collect()] == [dump(v) for v in values]
    floats = [{"x": 1e22, "y": [0.1, 1e-7, 5.0, -0.0, 2e23]}, {"x": None, "y": None}]
    fdf = spark.createDataFrame(list(enumerate(floats)), "k int, v struct<y:array<double>,x:double>")
    assert [r.j for r in fdf.select("k", canonical.canonical_json(fdf, "v").alias("j")).orderBy("k").collect()] == [dump(v) for v in floats]
    bad = spark.createDataFrame([(math.inf,)], "v double")
    with pytest.raises(Exception, match="Out of range|not JSON compliant"):
        bad.select(canonical.canonical_json(bad, "v")).collect()


def test_signatures_leave_themselves_out(spark):
    df = spark.createDataFrame([({"b": 1, "a": "x"},), (None,)], "doc struct<b:int,a:string>")
    signed = canonical.signed(df, "doc")
    assert signed.first().doc.artifact_sha256 == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()
    assert canonical.signature_faults(signed.where("doc IS NOT NULL"), "doc").count() == 0
    changed = signed.where("doc IS NOT NULL").withColumn("doc", F.col("doc").withField("b", F.lit(2)))
    assert canonical.signature_faults(changed, "doc").count() == 1
    maps = spark.createDataFrame([({"batching": "x", "k": "v"},)], "m map<string,string>")
    assert maps.select(canonical.without(maps, "m", "batching").alias("m")).first().m == {"k": "v"}


def test_array_digests(spark):
    header = lambda kind, shape, dtype: hashlib.sha256(json.dumps({"dtype": dtype, "kind": kind, "schema": "anatomy-array-sha256-v1", "shape": shape}, separators=(",", ":")).encode()).hexdigest()
    mask = np.array([[0, 1, 1], [1, 0, 0]])
    want = hashlib.sha256(header("mask", [2, 3], "|u1").encode() + b"\n" + bytes([0, 1, 1, 1, 0, 0])).hexdigest()
    assert canonical.array_digest(mask, "mask") == canonical.array_digest(np.asfortranarray(mask.astype(bool)), "mask") == want
    df = spark.createDataFrame([([0.0, 1.0, 1.0, 1.0, 0.0, 0.0], [2, 3]), (None, [2, 3])], "v array<double>, s array<int>")
    got = [r.d for r in df.select(canonical.array_hash(F.col("v"), F.col("s"), "mask").alias("d")).collect()]
    assert got == [want, None]
    assert canonical.array_digest(np.array([0.1], np.float32), "probabilities") != canonical.array_digest(np.array([0.1]), "probabilities")
    for bad, kind in ((np.array([2]), "mask"), (np.array([1.5]), "probabilities"), (np.array([np.nan]), "probabilities"), (mask, "other")):
        with pytest.raises(ValueError):
            canonical.array_digest(bad, kind)


def test_a_run_moves_no_more_than_it_needs(spark, log, tmp_path, monkeypatch):
    """Digests are not sorted with the rows, what is open is written as places, and last records without what names them."""
    from rankweave.operators import align

    kept = {}
    for module in (align, runs):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: kept.setdefault(name, df.columns) and f(df, name))
    plan = planned(spark)
    runs.run(plan, log, lambda: Asked(tmp_path, odd={7: ValueError("x")}), shards=2)
    assert "input_hash" not in kept["numbered"] and kept["open"] == ["batch", "lacking"]
    moved = [x for x in runs.outcomes(plan, log)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert moved and not any("batch_id" in x or "input_hash" in x or "results" in x for x in moved)
    assert runs.run(plan, log, lambda: Asked(tmp_path), shards=2, retry_errors=True) == 1
    found = final(plan, log)
    assert len(found) == 69 and all(x == ("success", k / 100, None, True) for (k, _), x in found.items())
    log.append(spark.createDataFrame([("no digest", "b", "h", 1, "success", "scoring", None, None)], runs._RECORD))
    with pytest.raises(ContractError):
        runs.run(plan, log, lambda: Asked(tmp_path))
