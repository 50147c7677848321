"""Fill-in-the-middle against a plain version that lists every unit."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.llm import fill_in_middle as fim

UNIT = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "chars": r"(?s)."}


def brute(text, doc_id, unit="lines", seed="7", apply=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    n = len(units)
    plain = (n, "plain", None, None, text)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return plain
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if h[2] % 100 >= apply:
        return plain
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\réß€𝄞<PSM>", max_size=60), st.integers(-(2**63), 2**63 - 1), st.sampled_from(fim.UNITS))
def test_transform_is_the_plain_one_and_restores(text, doc_id, unit):
    rule = fim.Rule(unit=unit)
    x = fim.transform(text.encode(), doc_id, rule)
    n, form, p, m, out = brute(text, doc_id, unit)
    assert (x.n, x.form, x.output.decode()) == (n, form, out)
    assert fim.restore(x.output, x.form, rule).decode() == text
    if x.pieces:
        assert (len(x.pieces[0].decode()), len(x.pieces[1].decode())) == (p, m)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a \né€𝄞", max_size=40), st.sampled_from(fim.UNITS))
def test_every_cut(text, unit):
    runs = fim.encode_runs(np.frombuffer(text.encode(), np.uint8), unit)
    units = re.findall(UNIT[unit], text)
    assert runs.n == len(units)
    assert [runs.place(k) for k in range(runs.n + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]
    assert len(runs.step) <= len(text)


def test_documents_with_hard_rows(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no end"), (6, "a\nb"), (7, "has <M> inside\n"), (None, "a\nb\n"), (None, None), (8, "é\n€𝄞\r\nx\n" * 50), (8, "é\n€𝄞\r\nx\n" * 50)]
    rows += [(100 + k, "".join(rng.choice("ab é\n\n") for _ in range(rng.randint(0, 200)))) for k in range(80)] + [(999, "line of text\n" * 200_000)]
    docs = spark.createDataFrame([(t, i, "x", 1.5) for i, t in rows], "text string, doc_id long, form string, n double")
    for rule in (fim.Rule(), fim.Rule("s", "words", 40, 100), fim.Rule("s", "chars", 70, 0)):
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256, r.output) for r in fim.fim_documents(docs, rule, with_output=True).collect()), key=repr)
        want = []
        for i, t in rows:
            n, form, p, m, out = brute(t, i, rule.unit, rule.seed, rule.apply_percent, rule.spm_percent)
            want.append((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), out))
        assert got == sorted(want, key=repr)
    assert fim.fim_documents(docs.limit(0)).count() == 0


def test_sentinels_must_be_told_apart(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in ((b"<P>", b"<P>", b"<M>"), (b"", b"<S>", b"<M>"), (b"aba", b"<S>", b"<M>"), (b"<P><S>", b"<S>", b"<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.fim_documents(docs, fim.Rule(prefix=marks[0], suffix=marks[1], middle=marks[2]))
    with pytest.raises(ValueError, match="unit"):
        fim.fim_documents(docs, fim.Rule(unit="bits"))
