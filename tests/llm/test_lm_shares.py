"""What is sent to the parts of the hash space is shuffled share by share, and scores do not depend on the shares."""

from pyspark.sql import functions as F

from rankweave.llm import lm_scoring


def test_parts_answer_share_by_share(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{k * i % 37}" for i in range(k % 60))) for k in range(120)], "doc_id long, text string")
    held, answered = [], lm_scoring._answered

    def noted(sent):
        held.append({(r["order"], r["part"]) for r in sent.select("order", "part").distinct().collect()})
        return answered(sent)

    monkeypatch.setattr(lm_scoring, "_answered", noted)
    monkeypatch.setattr(lm_scoring, "FOLD", 500)
    scores = lambda: {r["doc_id"]: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in lm_scoring.lm_scores(docs, F.col("doc_id") % 7 != 2).collect()}
    three = scores()
    for order in (1, 2):
        of = [x for x in held if any(o == order for o, _ in x)]
        assert max(map(len, of)) < 0.6 * len(set().union(*of)) and sum(map(len, of)) == len(set().union(*of))
    monkeypatch.setattr(lm_scoring, "SHARES", 1)
    assert scores() == three and len(three) == 120
