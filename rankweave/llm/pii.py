"""Personal data: high-recall generators propose overlapping spans, boosted trees score them, thresholds select.

Base kinds (email, ip, card, phone) are fixed patterns and always stay. Further generators propose spans (written-out
addresses, local phone numbers, social security numbers, account numbers, keys and passwords, long digit groups); each
becomes a vector of format and context features, scored by gradient boosted trees. The trees are trained here on
examples made by rule (the corpus has no span labels): many formats are personal data in one context and not in another
(dates, years, part numbers, digit groups that fail as cards), some are so in a share of cases alone. On examples that
the trees have not seen, scores are calibrated by kind (isotonic regression), and each kind's threshold is the lowest
calibrated score from which on the share of personal data is ``PRECISION``. Of overlapping proposals over their threshold
the most telling kind stays, then the longest span; only a secret may hold base spans.

Null texts are empty and have no spans. Texts without a digit, ``@`` or keyword cannot hold a span and are not decoded.
Repeated rows are handled one by one; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed
from .tokens import text_chunks

PRECISION = 0.97
ROUNDS, DEPTH, RATE = 60, 3, 0.25
BASE = ("email", "ip", "card", "phone")
#: A local part before each @; the domain is matched from there, so long runs of letters cost nothing.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Generators beside the base kinds.
GENERATORS = {
    "email": re.compile(r"\b[A-Za-z0-9._+-]{1,64} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[] ?dot ?[)\]]|\.) ?[A-Za-z]{2,24}){1,3}\b", re.I),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "secret": re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|(?:pass(?:word|wd)|token|secret|api[_-]?key)\"? ?[=:] ?\"?[^\s\"',;]{6,})", re.I),
    "number": re.compile(r"(?<![0-9.-])[0-9][0-9 -]{5,40}[0-9](?![0-9.-])"),
}
KINDS = (*BASE, *(k for k in GENERATORS if k not in BASE))
#: Words before a span that speak for or against it.
CUES = (
    re.compile(r"\b(?:call|tel|phone|mobile|fax|cell|whatsapp)\b", re.I), re.compile(r"\b(?:e-?mail|contact|write|reach)\b", re.I),
    re.compile(r"\b(?:ssn|social security)\b", re.I), re.compile(r"\b(?:iban|account|konto|cuenta|compte)\b", re.I),
    re.compile(r"\b(?:key|password|passwd|token|secret|credential)", re.I), re.compile(r"\b(?:born|birth|dob|passport|patient|licence|license no)\b", re.I), re.compile(r"\b(?:19|20)[0-9]{2}\b"), re.compile(r"\b(?:order|invoice|version|isbn|page|item|ref|model|part|build|chapter)\b", re.I),
)
#: Byte strings without any of which a text holds no proposal.
NEEDED = (b"@", b"at)", b"at]", b"at )", b"at ]", b"pass", b"token", b"secret", b"key", b"akia", b"gh")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed; code points."""
    out = []
    floor = 0
    at = text.find("@")
    while at >= 0:
        if (local := LOCAL.search(text, max(floor, _run_start(text, at)), at)) and (m := DOMAIN.match(text, at)):
            out.append((local.start(), m.end(), "email"))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, at: int) -> int:
    while at and text[at - 1] in _LOCAL_CHARS:
        at -= 1
    return at


def proposals(text: str) -> list[tuple[int, int, str]]:
    """All spans of all generators; they may overlap."""
    return [(m.start(), m.end(), kind) for kind, pattern in GENERATORS.items() for m in pattern.finditer(text)]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    x = text[start:end]
    digits = "".join(c for c in x if "0" <= c <= "9")
    before, after = text[max(0, start - 32) : start], text[end : end + 1]
    value = re.split("[=:]", x, maxsplit=1)[-1].strip(' "') if kind == "secret" else x
    letters = {c: value.count(c) / len(value) for c in set(value)} if value else {}
    groups = [len(g) for g in re.findall("[0-9]+", x)] or [0]
    return [
        *(float(kind == k) for k in GENERATORS), len(x), len(digits), len(digits) / len(x), sum(c in " -.()" for c in x), float(luhn(digits)) if digits else 0.0,
        len(set(digits)), -sum(p * np.log2(p) for p in letters.values()), len(value), float(any(c.isdigit() for c in value) and any(c.isalpha() for c in value)),
        len(groups), groups[0], groups[-1], max(groups), float(_calendar(x)), float(sum(1900 <= int(g) <= 2099 for g in re.findall("[0-9]{4}", x)) / len(groups)),
        float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "$€£#"), *(float(bool(cue.search(before) or (k == 4 and cue.search(x)))) for k, cue in enumerate(CUES)),
    ]


def _calendar(x: str) -> bool:
    """Whether the whole span is a date or a time stamp."""
    m = re.fullmatch(r"([0-9]{4}|[0-9]{1,2})[- .]([0-9]{1,2})[- .]([0-9]{4}|[0-9]{1,2})(?:[ -][0-9 -]*)?", x)
    return bool(m) and {len(m[1]), len(m[3])} & {4} != set() and 1 <= int(m[2]) <= 31


class BoostedTrees:
    """Logistic gradient boosting of small regression trees on quantile cuts."""

    def __init__(self):
        self.bias, self.trees = 0.0, []

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        leaf = -g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        if depth and len(rows) >= 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for k in range(x.shape[1]):
                for cut in self.cuts[k]:
                    low = x[rows, k] <= cut
                    gl, hl = g[rows][low].sum(), h[rows][low].sum()
                    gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                    gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - whole
                    if gain > best[0] and 5 <= low.sum() <= len(rows) - 5:
                        best = (gain, k, cut)
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.1, 0.9, 9))) for k in range(x.shape[1])]
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += RATE * self._value(tree, x)
        return self

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        k, cut, low, high = tree
        return np.where(x[:, k] <= cut, self._value(low, x), self._value(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + RATE * sum(self._value(t, x) for t in self.trees))))


def _examples(rng: np.random.Generator, n: int) -> Iterator[tuple[str, int]]:
    """(text with one value between bars, whether it is personal data), made by rule."""
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    code = lambda k: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), k))
    secret = lambda k: "".join(rng.choice(list("abcdef0123456789"), k))
    strong = lambda: "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%+"), rng.integers(9, 24)))
    year = lambda: str(rng.integers(1900, 2035))
    day = lambda: f"{rng.integers(1, 13):02d}"
    named = lambda *x: str(rng.choice(list(x)))
    key = lambda: named("password", "passwd", "secret", "token", "api_key", "API-Key")
    eq = lambda: named("=", ": ", " = ", ":")
    three = lambda: f"{digits(3)}{named('-', ' ', '.')}{digits(3)}{named('-', ' ', '.')}{digits(4)}"
    # (how often it is personal data, words before it and the value)
    kinds = (
        (1.0, lambda: (named("call", "phone", "tel", "mobile", "fax", word()), f"({digits(3)}) {digits(3)}-{digits(4)}")), (0.97, lambda: (named("call", "mobile", "phone", "tel", "whatsapp"), three())),
        (0.9, lambda: (word(), f"{digits(3)}-{digits(3)}-{digits(4)}")), (0.3, lambda: (word(), f"{digits(3)} {digits(3)} {digits(4)}")), (0.05, lambda: (named("version", "build", "ref", "part", "model", "order"), three())),
        (1.0, lambda: (named("ssn", "social security"), f"{digits(3)}-{digits(2)}-{digits(4)}")), (0.8, lambda: (word(), f"{digits(3)}-{digits(2)}-{digits(4)}")), (0.1, lambda: (named("order", "model", "part", "invoice"), f"{digits(3)}-{digits(2)}-{digits(4)}")),
        (0.98, lambda: (named("mail", "contact", "write", word()), f"{word()} (at) {word()} (dot) {named('com', 'org', 'de')}")), (0.98, lambda: (word(), f"{word()}.{word()} [at] {word()} [dot] {named('com', 'net')}")), (0.5, lambda: (word(), f"{word()} (at) {word()}.{word()}")),
        (1.0, lambda: (named("iban", "account", "konto"), f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}")), (0.9, lambda: (word(), f"GB{digits(2)}{code(4)}{digits(14)}")), (0.02, lambda: (named("model", "part", "build"), f"AB{digits(2)} {code(4)} {code(4)}")),
        (1.0, lambda: (word(), f"AKIA{code(16)}")), (1.0, lambda: (word(), f"{key()}{eq()}{secret(18)}")), (1.0, lambda: (word(), f'{key()}{eq()}"{secret(40)}"')), (0.99, lambda: (word(), f"{key()}{eq()}{strong()}")),
        (0.95, lambda: (word(), f"{key()}{eq()}{word()}{digits(int(rng.integers(1, 4)))}{word()}")), (0.95, lambda: (word(), f"{key()}{eq()}{word()}{word()}{digits(int(rng.integers(2, 5)))}")),
        (0.03, lambda: (word(), f"{key()}{eq()}{word()}{word()}")), (0.03, lambda: (word(), f"{key()}{eq()}{word()}-{word()}")),
        (0.97, lambda: (named("account", "konto", "cuenta", "passport", "patient"), digits(int(rng.integers(8, 13))))), (0.9, lambda: (named("born", "dob", "birth"), f"{year()}-{day()}-{day()}")),
        (0.0, lambda: (named("order", "invoice", "item", "ref"), digits(int(rng.integers(7, 15))))), (0.0, lambda: (named("isbn", "part", word()), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}")), (0.02, lambda: (word(), digits(int(rng.integers(7, 20))))),
        (0.0, lambda: (word(), digits(16))), (0.0, lambda: (word(), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}")), (0.0, lambda: (word(), f"{digits(4)}-{digits(4)}")), (0.0, lambda: (word(), f"{year()}-{day()}-{day()}")), (0.0, lambda: (word(), f"{day()}-{day()}-{year()}")),
        (0.0, lambda: (word(), " ".join(year() for _ in range(int(rng.integers(2, 6)))))), (0.0, lambda: (word(), f"{year()}-{year()}")), (0.0, lambda: (named("page", "chapter", "item", word()), " ".join(digits(int(rng.integers(1, 4))) for _ in range(int(rng.integers(4, 9)))))),
    )
    for _ in range(n):
        share, make = kinds[rng.integers(len(kinds))]
        cue, value = make()
        yield f"{word()} {word()} {cue} |{value}| {word()} {word()}", int(rng.random() < share)


def _table(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and kind of the proposals on made-up examples."""
    rows, ys, kinds = [], [], []
    for text, y in _examples(np.random.default_rng(seed), n):
        a, rest = text.split("|", 1)
        value, b = rest.rsplit("|", 1)
        whole, start, end = a + value + b, len(a), len(a) + len(value)
        base = base_spans(whole)
        for s, e, kind in proposals(whole):
            if all(e <= p or s >= q for p, q, _ in base) and (s <= start and e >= end or (start <= s and e <= end and e - s > 0.7 * len(value))):
                rows.append(features(whole, s, e, kind))
                ys.append(float(y))
                kinds.append(kind)
    return np.array(rows), np.array(ys), np.array(kinds)


class Calibration:
    """A rising step function from scores to shares, by pooling adjacent violators."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        pools: list[list[float]] = []  # [hits, rows, least score]
        order = np.argsort(score, kind="stable")
        for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
            pools.append([t, 1.0, s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                hits, rows, _ = pools.pop()
                pools[-1][0] += hits
                pools[-1][1] += rows
        self.starts, self.shares = np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])
        rows, hits = np.array([p[1] for p in pools]), np.array([p[0] for p in pools])
        above = np.cumsum(hits[::-1])[::-1] / np.cumsum(rows[::-1])[::-1]
        good = np.flatnonzero((above >= PRECISION) & (self.shares >= 0.5))
        #: The least calibrated score, likelier personal than not, from which on the share is PRECISION; else above one.
        self.threshold = float(self.shares[good[0]]) if len(good) else 2.0

    def __call__(self, score: float) -> float:
        k = int(np.searchsorted(self.starts, score, "right")) - 1
        return float(self.shares[max(k, 0)])


@lru_cache(1)
def trained() -> tuple[BoostedTrees, dict[str, Calibration]]:
    """The trees and each kind's calibration, trained once on the driver (fixed seed) and sent with the tasks."""
    x, y, _ = _table(1, 4000)
    trees = BoostedTrees().fit(x, y)
    x, y, kinds = _table(2, 8000)
    score = trees.score(x)
    return trees, {kind: Calibration(score[kinds == kind], y[kinds == kind]) for kind in GENERATORS}


#: Kinds from the most telling format to the least.
TELLING = ("secret", "account", "email", "ssn", "phone", "number")


class _Cover:
    """Disjoint spans in order, for quick looks whether a span is free."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        k = bisect_right(self.ends, s)
        return k == len(self.starts) or self.starts[k] >= e

    def add(self, s: int, e: int) -> None:
        k = bisect_right(self.ends, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def find_spans(text: str, model: tuple | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind. A secret may hold base spans; other added spans touch none."""
    base = base_spans(text)
    fixed = _Cover([(s, e) for s, e, _ in base])
    found = [x for x in proposals(text) if x[2] == "secret" or fixed.free(x[0], x[1])]
    if not found:
        return base, base
    trees, calibrations = model or trained()
    scores = trees.score(np.array([features(text, *x) for x in found])).tolist()
    over = [x for x, score in zip(found, scores, strict=True) if calibrations[x[2]](score) >= calibrations[x[2]].threshold]
    chosen, taken = [], _Cover([])
    for s, e, kind in sorted(over, key=lambda x: (TELLING.index(x[2]), x[0] - x[1], x[0])):
        if taken.free(s, e):
            taken.add(s, e)
            chosen.append((s, e, kind))
    return base, sorted([*base, *chosen], key=lambda x: (x[0], KINDS.index(x[2])))


def _suspects(column: pa.Array) -> Iterator[tuple[int, str | None]]:
    """(row, text), the text only where the bytes may hold a span."""
    for row, end, data, offsets in text_chunks(column):
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57) | (data == 64))])
        some = digit[offsets[1:]] > digit[offsets[:-1]]
        whole = data.tobytes()
        lowered = whole.lower()
        for needed in NEEDED[1:]:
            at = lowered.find(needed)
            while at >= 0:
                d = int(offsets.searchsorted(at, "right")) - 1
                some[d] = True
                at = lowered.find(needed, int(offsets[d + 1]))
        for k in range(end - row):
            yield row + k, whole[offsets[k] : offsets[k + 1]].decode("utf-8", "replace") if some[k] else None


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def redact(text: str, model: tuple | None = None) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    _, spans = find_spans(text, model)
    out, at = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of ``docs`` (doc_id, text)."""
    model = trained()
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for _, text in _suspects(batch.column(1)):
                base, spans = find_spans(text, model) if text else ([], [])
                counts = [sum(x[2] == k for x in base) for k in BASE]
                rows.append([*counts, hashlib.sha256(_joined(base).encode()).hexdigest() if base else empty, _joined(spans), len(spans) - len(base)])
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars`` (if there) counted anew; null texts stay null."""
    schema = docs.schema
    k, model = schema.fieldNames().index("text"), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(k)
            new = old.to_pylist()
            for row, text in _suspects(old):
                if text:
                    new[row] = redact(text, model)
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, old.type))

    out = docs.mapInArrow(trimmed(run), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out


def op3_pii(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return pii_spans(table(spark, sf_dir, "documents"))
