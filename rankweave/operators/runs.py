"""Resumable runs of scorers in batches, over an append-only log of attempts.

A plan binds each input to its batch: an input's key is a digest of its identity, of the scorer's protocol, of all
members of its batch and of its place there. A batch with one member still to do is computed whole, with the members it
always had, and only what was lacking is appended. Batches are dealt to shards; each shard is one write, which counts
once it is committed, so a run that dies loses the shard it was in and nothing else, and the next run does what is left.

A scorer lives in a worker: it is prepared once, asked batch by batch, and closed. What it raises becomes failed
attempts of that batch's members; what it returns must be one result for each member and, in each, exactly the findings
with a finite number. If it cannot be prepared, the batch it was prepared for fails and that worker asks no more; the
rest stays open.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.canonical import canonical_hash
from ..functions.ids import json_list, json_string
from ..sources.locks import exclusive_writer
from ..staging import written
from .align import latest, numbered
from .contracts import ContractError, assert_empty

#: The findings that a scorer answers.
FINDINGS = ("pleural_effusion", "pneumothorax", "consolidation")
#: The methods that are compared, by group.
METHODS = {
    "regression": ("hgb", "xgboost", "catboost", "ridge", "tabm", "biomedclip", "chexzero", "dinov2"),
    "visual_ranking": ("chexpert", "autoqc", "biovil_t"),
    "report_ranking": ("maira_logprob", "sentence_logprob", "token_entropy", "scuq_radgraph"),
}
#: Least and largest score of methods that have such bounds.
BOUNDS = {"chexpert": (0.0, 1.0), "autoqc": (-math.inf, 0.0)}
_RESULTS = "array<struct<finding:string,score:double>>"
_RECORD = f"key string, batch_id string, input_hash string, attempt int, status string, stage string, error_type string, results {_RESULTS}"


class Scorer:
    """What a plug-in implements; ``infer`` gets the rows of one batch as dicts and answers {finding: {"score": x}} for each."""

    def prepare(self) -> None:
        """Load what the scorer needs, once a worker."""

    def infer(self, rows: list[dict]) -> Sequence[dict | Exception]:
        raise NotImplementedError

    def close(self) -> None:
        """Give it back."""


def registry(spark: SparkSession) -> DataFrame:
    """(method, group, low, high): the dimension of methods, with the bounds of their scores."""
    rows = [(m, g, *BOUNDS.get(m, (None, None))) for g, methods in METHODS.items() for m in methods]
    return spark.createDataFrame(rows, "method string, group string, low double, high double")


def _digest(x: Column) -> Column:
    """Bytes as lower-case hex."""
    return F.lower(F.hex(x))


def plan_batches(inputs: DataFrame, identity: list[str], order: list[str], size: int, protocol: str) -> DataFrame:
    """(batch, batch_id, members): one row a batch of ``size`` inputs in order; members are (key, input_hash, row).

    Inputs with one identity are an error: they would be one input twice. What is sorted are the rows alone; digests come
    after it and are shuffled as bytes.
    """
    assert_empty(inputs.groupBy(*identity).count().where("count > 1"), "inputs planned more than once")
    placed = numbered(inputs.select(F.struct(*inputs.columns).alias("row"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order))), [f"__o{k}" for k in range(len(order))])
    named = placed.select("position", "row", F.struct(*(F.col("row")[c].alias(c) for c in identity)).alias("__identity"))
    hashed = named.select("position", F.unhex(canonical_hash(named, "__identity")).alias("input_hash"), "row")
    # A batch holds ``size`` members, so what is gathered is bounded.
    batches = hashed.groupBy(F.floor(F.col("position") / size).cast("long").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("position", "input_hash", "row"))).alias("m"))
    batches = batches.withColumn("m", F.transform("m", lambda x: F.struct(_digest(x["input_hash"]).alias("input_hash"), x["row"].alias("row"))))
    batch_id = F.sha2(json_list(json_string(F.lit(protocol)), *[F.array_join(F.transform("m", lambda x: x["input_hash"]), ",")]), 256)
    key = lambda x, k: F.sha2(F.concat_ws(":", x["input_hash"], F.col("batch_id"), k.cast("string")), 256)
    member = lambda x, k: F.struct(key(x, k).alias("key"), x["input_hash"].alias("input_hash"), x["row"].alias("row"))
    return written(batches.withColumn("batch_id", batch_id).select("batch", "batch_id", F.transform("m", member).alias("members")), "plan")


def crossing(inputs: DataFrame, subject: str, partition: str) -> DataFrame:
    """Subjects that lie in more than one partition."""
    return inputs.groupBy(subject).agg(F.count_distinct(partition).alias("n")).where("n > 1").select(subject)


def refuse_sealed(inputs: DataFrame, subject: str, partition: str, sealed: str = "test", allow: bool = False) -> DataFrame:
    """The inputs, unless a subject crosses partitions or, without ``allow``, one is sealed."""
    assert_empty(crossing(inputs, subject, partition), "subjects that cross partitions")
    if not allow:
        assert_empty(inputs.where(F.col(partition) == sealed), f"inputs of the sealed partition {sealed}")
    return inputs


class AttemptLog:
    """Attempts in committed shards under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _store(self, *names: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def shards(self) -> list[str]:
        """Shards whose write was committed; others are of a run that died."""
        path, store = self._store()
        if not store.exists(path):
            return []
        names = sorted(x.getPath().getName() for x in store.listStatus(path) if x.isDirectory())
        return [f"{self.folder}/{x}" for x in names if store.exists(self._store(x, "_SUCCESS")[0])]

    def records(self) -> DataFrame:
        found = self.shards()
        return self.spark.read.schema(_RECORD).parquet(*found) if found else self.spark.createDataFrame([], _RECORD)

    def latest(self) -> DataFrame:
        return latest(self.records(), ["key"], ["attempt"])

    def append(self, records: DataFrame) -> None:
        records.write.option("compression", "zstd").parquet(f"{self.folder}/shard-{uuid.uuid4().hex}")


def _members(plan: DataFrame) -> DataFrame:
    return plan.select("batch", "batch_id", F.explode("members").alias("m")).select("batch", "batch_id", "m.key", "m.input_hash")


def batch_states(plan: DataFrame, attempts: DataFrame) -> DataFrame:
    """(batch, n_members, n_done, n_failed, n_open, state): planned (no member tried), done, error (all tried, some failed last), partial.

    ``attempts``: the last attempt of each key, with its status.
    """
    joined = _members(plan).join(attempts.select("key", "status"), "key", "left")
    counts = joined.groupBy("batch").agg(F.count("*").alias("n_members"), F.count_if(F.col("status") == "success").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    left = F.col("n_members") - F.col("n_done") - F.col("n_failed")
    state = F.when(F.col("n_done") == F.col("n_members"), "done").when(left == F.col("n_members"), "planned").when(left == 0, "error").otherwise("partial")
    return counts.select("batch", "n_members", "n_done", "n_failed", left.alias("n_open"), state.alias("state"))


def open_batches(plan: DataFrame, attempts: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Batches with a member to do, whole, and in ``lacking`` the (key, attempt) of the members to append.

    A member is to do if it was never tried, or failed last and errors are retried.
    """
    last = attempts.select("key", "status", "attempt")
    todo = (F.col("status").isNull()) | ((F.col("status") == "failed") & F.lit(retry_errors))
    lacking = _members(plan).join(last, "key", "left").where(todo).groupBy("batch").agg(F.collect_list(F.struct("key", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"))).alias("lacking"))
    return plan.join(lacking, "batch")


def _lacking(plan: DataFrame, records: DataFrame, retry_errors: bool) -> DataFrame:
    """(batch, lacking): the (place, attempt) of the members to append; a row without a batch stands for keys that the
    plan does not have. Keys meet as bytes, and nothing else of the plan is moved."""
    members = plan.select("batch", F.posexplode("members.key").alias("place", "key")).select("batch", "place", F.unhex("key").alias("key"))
    last = latest(records.select(F.unhex("key").alias("key"), "attempt", "status"), ["key"], ["attempt"])
    todo = F.col("batch").isNull() | F.col("status").isNull() | ((F.col("status") == "failed") & F.lit(retry_errors))
    member = F.when(F.col("batch").isNotNull(), F.struct("place", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")))
    return members.join(last, "key", "full_outer").where(todo).groupBy("batch").agg(F.collect_list(member).alias("lacking"))


def _whole(plan: DataFrame, lacking: DataFrame, tasks: int) -> DataFrame:
    """(batch_id, members, lacking as (key, attempt)) of the batches in ``lacking``, dealt over ``tasks`` by the one shuffle
    in which they meet, with digests as bytes."""
    packed = plan.select("batch", F.unhex("batch_id").alias("id"), F.transform("members", lambda x: F.struct(F.unhex(x["key"]).alias("key"), F.unhex(x["input_hash"]).alias("input_hash"), x["row"].alias("row"))).alias("m"))
    joined = packed.repartition(tasks, "batch").join(lacking.repartition(tasks, "batch"), "batch")
    members = F.transform("m", lambda x: F.struct(_digest(x["key"]).alias("key"), _digest(x["input_hash"]).alias("input_hash"), x["row"].alias("row")))
    named = F.transform("lacking", lambda x: F.struct(_digest(F.col("m")[x["place"]]["key"]).alias("key"), x["attempt"].alias("attempt")))
    return joined.select(_digest(F.col("id")).alias("batch_id"), members.alias("members"), named.alias("lacking"))


def checked_result(value, row: dict, findings: Sequence[str], bounds: tuple[float, float] | None) -> list[dict]:
    """A scorer's answer for one input as rows, or an error that says what is wrong with it."""
    if isinstance(value, Exception):
        raise value
    if not isinstance(value, dict) or set(value) != set(findings):
        raise ContractError("exactly the findings are asked for")
    out = []
    for finding in findings:
        item = value[finding]
        x = item.get("score") if isinstance(item, dict) else None
        if type(x) not in (int, float) or not math.isfinite(x):
            raise ContractError("a score is a finite number and no boolean")
        if set(item) & (set(row) | {"finding", "method", "status", "failure_reason", "attempted"}):
            raise ContractError("a scorer may not overwrite what identifies an input")
        if bounds and not bounds[0] <= x <= bounds[1]:
            raise ContractError("the score is out of the method's range")
        out.append({"finding": finding, "score": float(x)})
    return out


def _worker(factory: Callable[[], Scorer], findings: Sequence[str], bounds: tuple[float, float] | None, schema: StructType):
    arrow = to_arrow_schema(schema)

    def attempt(engine: Scorer, rows: list[dict]) -> list[tuple]:
        """(status, stage, error type, results) of each row."""
        try:
            found = engine.infer(rows)
            if len(found) != len(rows):
                raise ContractError("a batch has one answer for each member")
        except Exception as error:
            return [("failed", "inference", type(error).__name__, None)] * len(rows)
        out = []
        for value, row in zip(found, rows, strict=True):
            try:
                out.append(("success", "scoring", None, checked_result(value, row, findings, bounds)))
            except Exception as error:
                out.append(("failed", "scoring", type(error).__name__, None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, stopped = None, False
        try:
            for batch in batches:
                for x in batch.to_pylist() if not stopped else []:
                    rows = [m["row"] for m in x["members"]]
                    answers = None
                    if engine is None and not stopped:
                        made = factory()
                        try:
                            made.prepare()
                            engine = made
                        except Exception as error:
                            stopped, answers = True, [("failed", "preparation", type(error).__name__, None)] * len(rows)
                    elif stopped:
                        continue
                    answers = answers or attempt(engine, rows)
                    lacking = {y["key"]: y["attempt"] for y in x["lacking"]}
                    records = [(m["key"], x["batch_id"], m["input_hash"], lacking[m["key"]], *a) for m, a in zip(x["members"], answers, strict=True) if m["key"] in lacking]
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*records, strict=True), arrow, strict=True)], schema=arrow)
        finally:
            if engine is not None:
                engine.close()

    return run


def run(plan: DataFrame, log: AttemptLog, factory: Callable[[], Scorer], *, shards: int = 8, retry_errors: bool = False, findings: Sequence[str] = FINDINGS, bounds: tuple[float, float] | None = None) -> int:
    """Do what is open in ``plan``, shard by shard; the number of shards written comes back.

    One run at a time holds the log. A log with keys that the plan does not have belongs to another plan and is refused.
    """
    spark = log.spark
    schema = spark.createDataFrame([], _RECORD).schema
    with exclusive_writer(spark, log.folder):
        todo = written(_lacking(plan, log.records(), retry_errors), "open")
        assert_empty(todo.where("batch IS NULL"), "attempts of another plan in this log")
        shard_of = F.pmod(F.xxhash64("batch"), F.lit(shards))
        numbers = sorted(r.shard for r in todo.select(shard_of.alias("shard")).distinct().collect())
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        for shard in numbers:
            rows = _whole(plan.where(shard_of == shard), todo.where(shard_of == shard), tasks)
            log.append(rows.mapInArrow(_worker(factory, findings, bounds, schema), schema))
    return len(numbers)


def outcomes(plan: DataFrame, log: AttemptLog, findings: Sequence[str] = FINDINGS) -> DataFrame:
    """Every planned input and finding once: (row columns, finding, status, score, failure_reason, attempted)."""
    planned = plan.select(F.explode("members").alias("m")).select(F.unhex("m.key").alias("key"), "m.row")
    # What is shuffled of a record is its key as bytes, its state and one number a finding.
    found = F.map_from_entries(F.coalesce("results", F.expr(f"CAST(array() AS {_RESULTS})")))
    records = log.records().withColumn("found", found).select(F.unhex("key").alias("key"), "attempt", "status", "stage", "error_type", F.array(*(F.try_element_at("found", F.lit(x)) for x in findings)).alias("scores"))
    done = latest(records, ["key"], ["attempt"])
    joined = planned.join(done, "key", "left").select("*", F.posexplode(F.array(*map(F.lit, findings))).alias("place", "finding"))
    reason = F.when(F.col("status").isNull(), "not_attempted").when(F.col("status") == "failed", F.concat_ws(": ", "stage", "error_type"))
    return joined.select("row.*", "finding", F.coalesce("status", F.lit("failed")).alias("status"), F.col("scores")[F.col("place")].alias("score"), reason.alias("failure_reason"), F.col("status").isNotNull().alias("attempted"))
