"""Token alignment against whole texts encoded at once and token ends compared by sets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.llm import token_alignment as ta

A_PATH, B_PATH = ta.vocabularies()


@pytest.fixture(scope="module")
def coders():
    return ta.ByteLevel(A_PATH), ta.Pieces(B_PATH)


def whole(text, coders):
    """(A ids, B ids) of the whole text in one call, none if their bytes differ from space + text."""
    a, b = coders
    if not text:
        return [], []
    x, y = a.encode([" " + text])[0], b.model.encode(text)
    want = (" " + text).encode()
    same = b"".join(a.bytes[i] for i in x) == want and b"".join(b.bytes[i] for i in y) == want
    return (x, y) if same else ([], [])


def groups_of(x, y, coders):
    ends = [np.cumsum([v.bytes[i].__len__() for i in ids]).tolist() for v, ids in zip(coders, (x, y), strict=True)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, low = [], 0
    for cut in cuts:
        out.append(tuple([i for i, e in zip(ids, side, strict=True) if low < e <= cut] for ids, side in zip((x, y), ends, strict=True)))
        low = cut
    return out


def brute(texts, coders, rule):
    rows, linked, totals = [], [], Counter()
    for t in texts:
        x, y = whole(t, coders)
        g = groups_of(x, y, coders)
        own = [(p[-1], q[-1]) for p, q in g] if rule == "ends" else [(i, j) for p, q in g for i in p for j in q]
        totals.update(own)
        linked.append(own)
        rows.append([len(x), len(y), len(g), len(own), hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g).encode()).hexdigest() if x else ""])
    best = defaultdict(int)
    for (_, j), n in totals.items():
        best[j] = max(best[j], n)
    return [(r[0], r[1], r[2], r[3], sum(totals[p] == best[p[1]] for p in own), sum(totals[p] for p in own), r[4]) for r, own in zip(rows, linked, strict=True)], totals, best


def texts():
    rng = random.Random(5)
    parts = ["the", "and", " ", "  ", "   ", "\n", "\t", "\xa0", "　", " ", "\x85", "\x1c", "é", "ß", "naïve", "日本語", "𝄞", "👩‍👧", "ﬁ", "é", "1234567", "don't", "'s", "...", "–", "“x”", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\r\n", "-", "_", "A", "Zz", "\x00", "\x7f", "Ġ", "x"]
    out = [None, "", " ", "  ", "a", "a ", " a", "a  b ", "▁", "x▁y", "<|endoftext|>", "x" * 3000, "日本" * 800, " " * 300, "\n" * 200]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)] + [" ".join(rng.choice(["alpha", "beta", "gamma", "Straße", "über"]) for _ in range(400)) for _ in range(20)]


@pytest.mark.parametrize(("rule", "fold"), [("ends", 1 << 30), ("ends", 3000), ("groups", 3000)])
def test_documents_and_corpus_counts(spark, coders, monkeypatch, rule, fold):
    monkeypatch.setattr(ta, "FOLD", fold)
    rows = list(enumerate(texts()))
    rows += [(None, "the end"), (None, None), (20, rows[20][1]), (20, rows[20][1])]
    docs = spark.createDataFrame([(i, t, 9, "p", "f") for i, t in rows], "doc_id long, text string, fold int, pairs string, n_a string").repartition(3)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in ta.align_documents(docs, A_PATH, B_PATH, rule=rule).collect()), key=repr)
    want, totals, best = brute([t for _, t in rows], coders, rule)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=repr)
    if fold == 3000:
        table = {(r.a_id, r.b_id): (r.total, r.best) for r in ta.linked_ids(docs, A_PATH, B_PATH, rule=rule).collect()}
        assert table == {p: (n, n == best[p[1]]) for p, n in totals.items()}
    assert ta.align_documents(docs.limit(0), A_PATH, B_PATH, rule=rule).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="ab \n\t\x85\xa0 　é€▁'s1.", max_size=60))
def test_segments_give_the_ids_of_the_whole(coders, text):
    if not text:
        return
    a, b = coders
    parts = [x.decode() for x in ta.segments((" " + text).encode())]
    assert "".join(parts) == " " + text and all(x.startswith(" ") for x in parts)
    assert [i for x in a.encode(parts) for i in x] == a.encode([" " + text])[0]
    assert [i for x in b.encode(parts) for i in x] == b.model.encode(text)
    raw = [x.encode() for x in parts]
    for v in (a, b):
        flat, counts, ok = v.encode_segments(raw + raw)
        each = v.encode(parts)
        assert flat.tolist() == [i for x in each + each for i in x] and counts.tolist() == [len(x) for x in each] * 2
        assert ok.tolist() == [b"".join(v.bytes[i] for i in x) == y for x, y in zip(each, raw, strict=True)] * 2


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.randoms(use_true_random=False))
def test_rank_and_select(n, rng):
    ends = np.array(sorted({rng.randint(1, n) for _ in range(rng.randint(0, n))} | {n}))
    bits = ta.bitset(ends, n)
    assert ta.select(bits).tolist() == ends.tolist()
    at = np.arange(n + 1)
    assert ta.rank(bits, ta.ranks(bits), at).tolist() == [int((ends <= k).sum()) for k in at]


def test_cache_is_bounded(spark, coders, monkeypatch):
    known = ta.Aligner(A_PATH, B_PATH, "ends")
    monkeypatch.setattr(ta, "CACHE", 10)
    for k in range(5):
        fold = ta._Fold(known)
        fold.add(k, " ".join(f"w{k}x{j}" for j in range(8)).encode())
        assert fold.row(k).num_rows == 1
        known.trim()
        assert len(known.index) <= 10


def test_unsafe_vocabularies_are_refused(monkeypatch):
    class Odd(ta.Pieces):
        def __init__(self, path):
            super().__init__(path)
            self.bytes[300] = b"of the"

    monkeypatch.setattr(ta, "Pieces", Odd)
    with pytest.raises(ValueError, match="space after its start"):
        ta.Aligner(A_PATH, B_PATH, "ends")
