import math
import random

from corelode.llm import lm_score


def key(rows):
    return sorted((repr(r["doc_id"]), r["n_tokens"], *(None if v is None else round(v, 9) for v in (r["loss_target"], r["loss_background"], r["score"]))) for r in rows)


def test_fewer_spans_than_chunks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(300)] + [(None, "w1 w2 w3"), (None, None), (7, "w1 w2 w3"), *[(8, "w5 w5 w6")] * 40, (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(" ".join(rng.choices(words[:50], k=40)),) for _ in range(60)], "text string")
    models = lm_score.learn(target, docs)
    want = key(lm_score.score_documents(docs, models).collect())
    assert len(want) == len(rows) and sum(r[0] == "8" for r in want) == 41
    monkeypatch.setattr(lm_score, "SQUARE", 1)
    assert lm_score.spans_of(40) == 7
    assert key(lm_score.score_documents(docs, models, chunk_bytes=1500).collect()) == want


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(1_700_000))
    assert len(long) > 9_000_000
    docs = spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, lm_score.learn(docs.where("doc_id = 2").select("text"), docs)).collect()}
    assert got[1]["n_tokens"] == 1_700_000 and math.isfinite(got[1]["score"]) and got[2]["score"] < got[1]["score"]


def test_rows_sent_grow_less_than_the_square():
    assert lm_score.spans_of(1) == 1 and lm_score.spans_of(900) == 900
    for n in (10_000, 1_000_000):
        assert 100 * n * lm_score.spans_of(100 * n) < 1100 * n * lm_score.spans_of(n)
