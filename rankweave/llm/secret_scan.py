"""Secret scans over an incremental ledger of blobs.

Every historical version of every path is addressed by the SHA-256 of its content. A scan looks up which pairs of blob
and rule version the ledger holds already, reads the text of one row for each blob that lacks some, applies just the
lacking rules, appends to the ledger, and joins all findings of the current rules back to every path and version. So
copies are scanned once, a second run over grown history scans what is new, and a rule with a new version is applied
alone.

The ledger is a folder of batches of Parquet files, in the shared store. A batch counts once its write is committed
(``_SUCCESS``), so a run that dies leaves nothing that a later run would believe, and writers at one time do not disturb
each other (a blob scanned by both is read once). Executors may be lost at any time: the manifest and the blobs to scan
are written before they are used twice.

Defined results: a null text is empty content, a blob like any other. Repeated rows come back as often as they came,
null paths included. Other columns are ignored. An empty table gives an empty result and an empty batch. Texts are
scanned whole, at any length; offsets are code points, the end exclusive. Spans of different kinds may overlap.

Texts never move by a key: blobs to scan are named by a 64-bit row key, broadcast behind a check of their number, else
joined by a shuffle. What comes back is joined by blob, with the rows of a hot blob dealt over several tasks.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .shared import checked_broadcast, discard, shared_folder, table, trimmed, written
from .tokens import text_chunks

#: Blobs to scan (a row key and a mask of rules, 16 bytes) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows of one blob from which on they are dealt over several tasks when findings come back.
HOT_ROWS = 5_000
#: A run of so many characters without white space or punctuation may be a key.
LONG_RUN = 32


@dataclass(frozen=True)
class Rule:
    """``needles``: lower-case byte strings one of which a text with a match holds; ``long_run``: or else a long run."""

    name: str
    version: str
    pattern: re.Pattern
    needles: tuple[bytes, ...] = ()
    long_run: bool = False
    keep: Callable[[re.Match], bool] = lambda m: True

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches; those that ``keep`` refuses are dropped, without another try."""
        return [m.span() for m in self.pattern.finditer(text) if self.keep(m)]


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _random_looking(m: re.Match) -> bool:
    """Upper and lower case and digits, mixed as in drawn characters, not as in names or paths."""
    x = m[0]
    return any(c.islower() for c in x) and any(c.isupper() for c in x) and sum(c.isdigit() for c in x) >= len(x) / 10 and entropy(x) >= 4.0


def _is_value(m: re.Match) -> bool:
    """Not what the base rule finds already, and not an ordinary word or a place holder."""
    value = m["quoted"] or m["plain"]
    if m["common"] and not m["quoted"]:
        return False
    if m["common"] and re.fullmatch(r"[A-Za-z0-9+/_.=-]{8,}", value):
        return False
    return not re.fullmatch(r"[$<{%*].*|[Xx.*-]+|\w+\(.*", value) and (bool(m["quoted"]) or any(c.isdigit() for c in value))


def _rule(name: str, pattern: str, needles: Sequence[bytes] = (), flags: int = 0, **more) -> Rule:
    return Rule(name, "1", re.compile(pattern, re.ASCII | flags), tuple(needles), **more)


#: The base kinds, then what this scanner adds.
BASE_RULES = (
    _rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", [b"password", b"passwd", b"secret", b"token", b"key"], re.I, keep=lambda m: len(m[2]) >= 8),
    _rule("access", r"AKIA[A-Z0-9]+", [b"akia"], keep=lambda m: len(m[0]) >= 16),
    _rule("hex", r"[0-9a-f]{32,}", long_run=True),  # a maximal run is the leftmost match of [0-9a-f]+
)
ADDED_RULES = (
    _rule("private_key", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY(?: BLOCK)?-----(?:(?:[A-Za-z0-9+/=:,.()\s]|-(?!-))*+-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY(?: BLOCK)?-----)?", [b"-----begin"]),
    _rule("forge", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,})", [b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat_", b"glpat-"]),
    _rule("chat", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", [b"xox"]),
    _rule("cloud", r"\bAIza[A-Za-z0-9_-]{35}|\bASIA[A-Z0-9]{16}\b", [b"aiza", b"asia"]),
    _rule("payment", r"\b[spr]k_(?:live|test)_[A-Za-z0-9]{10,}", [b"k_live_", b"k_test_"]),
    _rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?", [b"eyj"]),
    _rule("login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]+:[^\s/:@\"'<>]{3,}@(?=[A-Za-z0-9])", [b"://"], re.I),
    _rule("bearer", r"\bbearer\x20+[A-Za-z0-9._~+/-]{20,}=*", [b"bearer"], re.I),
    _rule(
        "keyed", r"(?:(?P<common>password|passwd|secret|token|api_?key)|(?<![a-z])(?:pwd|pass_?phrase|pass_?code|credentials?|(?:api-|(?:access|private|auth|account|signing|encryption|master)[_-]?)key))"
        r"[\"']?\x20*[:=]\x20*(?:\"(?P<quoted>[^\"\n]{6,})\"|(?P<plain>[^\s\"',;]{8,}))", [b"pass", b"pwd", b"secret", b"token", b"key", b"credential"], re.I, keep=_is_value,
    ),
    _rule("random", r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_-]{32,}={0,2}(?![A-Za-z0-9+_=-])", long_run=True, keep=_random_looking),
)
RULES = (*BASE_RULES, *ADDED_RULES)
_FOUND = "array<struct<rule:string,start:bigint,end:bigint>>"
_BATCH = f"blob binary, scanned array<string>, found {_FOUND}"


class Ledger:
    """What has been scanned and found, by blob and rule version, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def fresh(cls, spark: SparkSession) -> Ledger:
        return cls(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")

    def batches(self) -> list[str]:
        """Committed batches; a folder without the mark is of a run that died or still writes."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        found = [x.getPath() for x in store.listStatus(path) if x.isDirectory()]
        return sorted(x.toString() for x in found if store.exists(context._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def rows(self) -> DataFrame:
        paths = self.batches()
        return self.spark.read.schema(_BATCH).parquet(*paths) if paths else self.spark.createDataFrame([], _BATCH)

    def seen(self, rules: Sequence[Rule]) -> DataFrame:
        """(blob, mask): bit k is set where rule k, in its version, has been applied to the blob."""
        mask = F.lit(0).cast("long")
        for k, rule in enumerate(rules):
            mask = mask.bitwiseOR(F.when(F.array_contains("scanned", rule.id), 1 << k).otherwise(0).cast("long"))
        return self.rows().groupBy("blob").agg(F.bit_or(mask).alias("mask"))

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """(blob, found): of the blobs in which these rule versions found something, all spans, each once."""
        ids = [r.id for r in rules]
        here = self.rows().withColumn("found", F.filter("found", lambda x: x["rule"].isin(ids))).where(F.size("found") > 0)
        return here.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))

    def append(self, scanned: DataFrame) -> str:
        path = f"{self.folder}/batch-{uuid.uuid4().hex}"
        scanned.write.parquet(path)
        return path


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def suspects(column: pa.Array, rules: Sequence[Rule]) -> Iterator[str | None]:
    """Each text if its bytes may hold a match of some rule, else nothing; most texts are never decoded."""
    needles, runs = sorted({n for r in rules for n in r.needles}), any(r.long_run for r in rules)
    always = any(not r.needles and not r.long_run for r in rules)
    solid = np.zeros(256, bool)
    solid[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_=-"]] = True
    for row, end, data, offsets in text_chunks(column):
        some = np.full(end - row, always)
        whole = data.tobytes()
        lowered = whole.lower()
        for needle in needles:
            at = lowered.find(needle)
            while at >= 0:
                d = int(offsets.searchsorted(at, "right")) - 1
                some[d] = True
                at = lowered.find(needle, int(offsets[d + 1]))
        if runs:
            gaps = np.flatnonzero(~solid[data])
            edges = np.concatenate([[-1], gaps, [len(data)]])
            for k in np.flatnonzero(np.diff(edges) > LONG_RUN):
                first, last = offsets.searchsorted(edges[k] + 1, "right") - 1, offsets.searchsorted(edges[k + 1] - 1, "right") - 1
                some[first : last + 1] = True
        for k in range(end - row):
            yield whole[offsets[k] : offsets[k + 1]].decode("utf-8", "replace") if some[k] else None


def _scanner(rules: tuple[Rule, ...]):
    found_type = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanned, found = [], []
            for text, needed in zip(suspects(batch.column(1), rules), batch.column(2).to_pylist(), strict=True):
                own = [r for k, r in enumerate(rules) if needed >> k & 1]
                scanned.append([r.id for r in own])
                found.append([{"rule": r.id, "start": s, "end": e} for r in own for s, e in r.spans(text)] if text else [])
            yield pa.record_batch([batch.column(0), pa.array(scanned, pa.list_(pa.string())), pa.array(found, found_type)], ["blob", "scanned", "found"])

    return run


def scan_new_blobs(versions: DataFrame, ledger: Ledger, keys: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions``; the (written) manifest (keys, blob) of all of them comes back."""
    if len(rules) > 62:
        raise ValueError("rules are numbered by the bits of a long")
    addressed = versions.select(*keys, F.col(text).alias("__text"), _blob(text).alias("blob"))
    row_key = F.xxhash64(*keys, "blob").alias("__key")
    manifest = written(addressed.select(*keys, "blob"), "manifest")
    needed = F.coalesce(F.col("mask"), F.lit(0)).bitwiseXOR(F.lit((1 << len(rules)) - 1))
    # The row with the smallest key stands for its blob; a key that two rows share costs a second look at one, no more.
    blobs = manifest.select("blob", row_key).groupBy("blob").agg(F.min("__key").alias("__key"))
    lacking = written(blobs.join(ledger.seen(rules), "blob", "left").select("__key", needed.alias("needed")).where("needed <> 0").groupBy("__key").agg(F.bit_or("needed").alias("needed")), "lacking")
    texts = addressed.select("blob", F.col("__text").alias("text"), row_key).join(checked_broadcast(lacking, BROADCAST_ROWS), "__key").select("blob", "text", "needed")
    ledger.append(texts.mapInArrow(trimmed(_scanner(tuple(rules))), _BATCH))
    discard(lacking)
    return manifest


def scan_history(versions: DataFrame, ledger: Ledger, keys: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(keys, blob, found) for every row of ``versions``; ``found`` is null where no rule of these found anything.

    ``found`` is sorted by start, then by the rules' order. The ledger keeps spans by rule, so this is all it takes to
    read old findings again; no text is read for a blob that the ledger knows.
    """
    manifest = scan_new_blobs(versions, ledger, keys, text, rules)
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.id), F.lit(k))))
    names = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(k), F.lit(r.name))))
    by_place = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), order[x["rule"]].alias("k"), x["end"].alias("end"))))
    found = ledger.findings(rules).select("blob", F.transform(by_place, lambda x: F.struct(names[x["k"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
    sizes = manifest.groupBy("blob").agg(F.count("*").alias("__rows"))
    return salted_join(manifest, written(found.join(sizes, "blob"), "findings"), ["blob"], "__rows", HOT_ROWS)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, by doc_id."""
    spans = F.coalesce("found", F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint>>)"))
    base = F.filter(spans, lambda x: x["kind"].isin([r.name for r in BASE_RULES]))
    of_kind = lambda name: F.size(F.filter(spans, lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *(of_kind(r.name) for r in BASE_RULES), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_added"))


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as the versions of a history that no ledger knows yet: each is the only version of its path."""
    return secret_digest(scan_history(table(spark, sf_dir, "documents"), Ledger.fresh(spark), ["doc_id"]))
