"""A large group of near copies costs the exhaustive step few pairs, and loses no link."""

import numpy as np

from rankweave.llm import jaccard_join


def _texts(copies: int) -> list[str]:
    """Copies of one text with one word changed (they all link) or two (these link with the first kind alone)."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    out = []
    for i in range(copies):
        words = list(base)
        for at in rng.choice(len(base), 1 if i % 4 == 0 else 2, replace=False):
            words[at] = f"x{i}y{at}"
        out.append(" ".join(words))
    return out


def _plain(texts: list[str]) -> list[int]:
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    least = list(range(len(sets)))
    for _ in range(4):
        for i, x in enumerate(sets):
            for j in range(i):
                if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    return least


def test_near_copies_are_joined_before_all_pairs_are_made(spark, monkeypatch):
    texts, made, across = _texts(240), [], jaccard_join.across
    monkeypatch.setattr(jaccard_join, "across", lambda *x: made.append(across(*x).count()) or across(*x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components_rows(docs)}
    assert [found[k] for k in range(len(texts))] == _plain(texts)
    assert made[0] <= 4 * len(texts)


def jaccard_components_rows(docs):
    return jaccard_join.jaccard_components(docs).collect()
