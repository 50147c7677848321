"""Each stage of the corpus pipeline on its own against a plain version, on rows with odd ids, texts and columns."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from rankweave.llm import packing, pii, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double"
ITEM = "one two three four five six seven eight nine ten eleven twelve"


def rows():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(90)
    out = [(k, text(rng.randint(5, 60))) for k in range(40)] + [(100 + k, base) for k in range(4)] + [(110, base + " tail"), (111, base.upper())]
    out += [(200, f"{text(30)} {ITEM} {text(30)}"), (201, ITEM), (202, "mail jane.doe@example.org now"), (203, None), (204, ""), (205, "<|endoftext|> one")]
    out += [*((300 + k, f"you idiot {text(3)} moron idiot {text(2)} scum") for k in range(12)), (None, "no name"), (None, None), (40, base), (41, "first"), (41, "second"), (5, None), (400, text(40_000))]
    return [(i, t, "en", f"s{k % 3}", len(t or ""), "x", 0.5) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(300 + k, 1, 0) for k in range(10)] + [(k, 0, 1) for k in range(30)], "doc_id long, toxic int, quality int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return spark.createDataFrame(rows(), SCHEMA).repartition(3), place


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_order_of_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_toxicity_drops_what_it_rejects(spark, given):
    docs, place = given
    rejected = {r.doc_id for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{place}/labels.parquet")).where("predicted = 1").collect()}
    out = pipeline.toxicity(spark, docs, place)
    assert out.columns == docs.columns and plain(out) == Counter(r for r in rows() if r[0] not in rejected) and rejected >= {310, 311}


def test_near_duplicates_keep_one_of_each_group(spark, given):
    docs, place = given
    texts = defaultdict(list)
    for r in rows():
        if r[0] is not None:
            texts[r[0]].append(r)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(r[1])) for i, own in texts.items() for r in own]
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    out = pipeline.near_duplicates(spark, docs, place)
    # Of several rows with one id, the smallest text; a null one is smaller than any.
    want = Counter(min(own, key=lambda r: (r[1] is not None, r[1] or "")) for i, own in texts.items() if root(i) == i)
    assert out.columns == docs.columns and plain(out) == want


def test_decontamination_drops_documents_with_an_item(spark, given):
    docs, place = given
    item = shingles(ITEM)
    out = pipeline.decontamination(spark, docs, place)
    hit = {r[0] for r in rows() if 100 * len(item & shingles(r[1])) >= 75 * len(item)}
    assert out.columns == docs.columns and plain(out) == Counter(r for r in rows() if r[0] is not None and r[0] not in hit) and hit == {200, 201}


def test_personal_data_is_redacted(spark, given):
    docs, place = given
    model = pii.trained()
    out = pipeline.personal_data(spark, docs, place)
    new = [r[1] and pii.redact(r[1], model) for r in rows()]
    assert out.columns == docs.columns
    assert plain(out) == Counter((r[0], t, r[2], r[3], None if t is None else len(t), *r[5:]) for r, t in zip(rows(), new, strict=True))
    assert "mail [EMAIL] now" in new


def test_packing_holds_every_id_once(spark, given):
    from tokenizers import Tokenizer

    docs, place = given
    tokenizer = Tokenizer.from_file(packing.word_vocabulary())
    want = Counter()
    for r in rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) if len(ids) <= 64 else None] += 1
    got, sequences = Counter(), defaultdict(list)
    for r in pipeline.packing(spark, docs, place).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.start == 0:
            got[r.doc_id, r.doc_tokens, r.ids_crc32 if r.doc_tokens <= 64 and r.length == r.doc_tokens else None] += 1
    assert {k[:2]: n for k, n in got.items()}.keys() == {k[:2]: n for k, n in want.items()}.keys() and sum(got.values()) == sum(want.values())
    assert all(k in want for k in got if k[2] is not None)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == packing.LIMIT or at & (at - 1) == 0


def test_stages_of_an_empty_table(spark, given):
    docs, place = given
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs.limit(0), place)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
