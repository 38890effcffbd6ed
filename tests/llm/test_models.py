"""Learned operators, the codec and the pipeline."""

import math
import os
import random
from collections import Counter

import brute
import pytest

from corelode.llm import language_id, lm_score, sentencepiece_codec, toxicity
from corelode.llm.queries import TOKENIZER

SYLLABLES = {"aa": "ka lo mi ta ru pe".split(), "bb": "schen ung ver ich keit".split(), "cc": "eau oux ment é tion".split()}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES))), lang) for i in range(300)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", None), (1003, "🙂 🙂", None), (None, rows[0][1], rows[0][2]), (1004, sentence(rng, "aa", 40) + " " + sentence(rng, "bb", 30), None), (1005, sentence(rng, "cc", 20_000), None), rows[3]]
    return spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, score string")


def test_languages(talk):
    model = language_id.learn(talk)
    rows = {r["doc_id"]: r for r in language_id.identify(talk, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in talk.collect()}
    held = [d for d, r in rows.items() if d is not None and d < 300 and r["held_out"]]
    assert {d for d in rows if d is not None and rows[d]["held_out"]} == {d for d in rows if d is not None and brute.crc(str(d)) % 4 == 2}
    assert len(held) > 40 and all(rows[d]["lang_pred"] == truth[d] for d in held)
    assert all(rows[d]["lang_pred"] == "und" and rows[d]["score"] == 0 for d in (1000, 1001, 1002, 1003))
    mixed = rows[1004]
    assert mixed["languages"] == ["aa", "bb"] and abs(mixed["shares"][0] - 4 / 7) < 0.1 and abs(sum(mixed["shares"]) - 1) < 1e-3
    assert rows[1005]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1.000001 for r in rows.values())
    kept = language_id.drop_unidentified(talk, model)
    assert kept.columns == talk.columns and kept.count() == talk.count() - 4


def test_language_inputs_are_texts_only(spark, talk):
    model = language_id.learn(talk)
    other = talk.selectExpr("doc_id + 7 as doc_id", "text", "'zz' as lang")
    a = sorted((r["text"] or "", r["lang_pred"]) for r in talk.join(language_id.identify(talk, model), "doc_id").collect() if r["doc_id"] is not None)
    b = sorted((r["text"] or "", r["lang_pred"]) for r in other.join(language_id.identify(other, model), "doc_id").collect())
    assert {x for x in a} == {x for x in b if x in set(a)}


def test_text_in_all_languages(spark):
    rng = random.Random(15)
    parts = {**SYLLABLES, "dd": "zyx wq jj vv".split(), "ee": "ooh ihi uhu".split()}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang := list(parts)[i % 5], 40), lang) for i in range(200)]
    rows += [(1000, " ".join(say(x, 60) for x in parts), None), (1001, " ".join([say("aa", 600), say("bb", 8)]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn(docs)).where("doc_id >= 1000").collect()}
    assert set(got[1000]["languages"]) == set(parts) and all(abs(x - 0.2) < 0.05 for x in got[1000]["shares"])
    assert got[1001]["languages"] == ["aa", "bb"] and abs(got[1001]["shares"][1] - 8 / 608) < 0.005


def test_letters_that_are_no_language_are_rejected(spark, talk):
    rng = random.Random(21)
    junk = [" ".join("".join(rng.choice("qwxzjvfbgdyh0") for _ in range(rng.randrange(3, 9))) for _ in range(60)) for _ in range(20)]
    rows = [(i, t, None, "q") for i, t in enumerate(junk, 2000)] + [(3000, sentence(rng, "aa", 5) + " xq zj", None, "q"), (3001, " ".join(sentence(rng, x, 9) for x in SYLLABLES), None, "q")]
    docs = talk.unionByName(spark.createDataFrame(rows, talk.schema))
    kept = {r["doc_id"] for r in language_id.drop_unidentified(docs, language_id.learn(docs)).collect()}
    assert not kept & set(range(2000, 2020)) and {3000, 3001, *range(300)} <= kept


def test_mixture_equals_plain_em():
    """Set by set, document by document, word by word."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(9)
    many = np.array([1, 2, 7, 30, 55])
    ll = rng.normal(-20, 4, (int(many.sum()), 3)).astype(np.float32)
    ll[-30:, 0] += 12
    ll[-55:-30, 2] += 12
    got, at = language_id.mixture(ll, many), 0

    def em(rows, share, rounds=10):
        for _ in range(rounds):
            part = [[s * math.exp(float(x)) for s, x in zip(share, r, strict=True)] for r in rows]
            total = [sum(p) for p in part]
            share = [sum(p[k] / t for p, t in zip(part, total, strict=True)) / len(rows) for k in range(3)]
        return share, sum(map(math.log, total))

    for n, chosen in zip(many.tolist(), got, strict=True):
        rows, at = (ll[at : at + n] - ll[at : at + n].max(axis=1, keepdims=True)).tolist(), at + n
        share, _ = em(rows, [1 / 3] * 3)
        order = sorted(range(3), key=lambda k: -share[k])
        alone = [sum(r[k] for r in rows) for k in range(3)]
        best = (max(alone), [float(k == alone.index(max(alone))) for k in range(3)])
        for k in itertools.takewhile(lambda k: sum(s * n >= 0.5 for s in share) >= k, (2, 3)):
            start = [share[i] if i in order[:k] else 0.0 for i in range(3)]
            fitted, value = em(rows, [s / sum(start) for s in start])
            value -= language_id.PENALTY * (k - 1) * math.log(max(n, 2)) / 2
            best = max(best, (value, fitted), key=lambda x: x[0])
        assert chosen == pytest.approx(best[1], abs=1e-3)


def test_no_languages(spark, talk):
    none = talk.limit(0)
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(talk, language_id.learn(none)).collect()} == {"und"}


@pytest.fixture(scope="module")
def rude(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words, bad = sentence(rng, "aa", rng.randrange(20, 200)).split(), i % 6 == 0
        for _ in range(rng.randrange(1, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "rotten"]))
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, int(bad)))
    rows += [(700, None), (701, ""), (None, "nasty vile rotten nasty"), (702, "word " * 30_000)]
    labels += [(6, 0), (None, 1), (9999, 1)]
    return spark.createDataFrame([(*r, "u") for r in rows], "doc_id long, text string, y string"), spark.createDataFrame([(a, 1, b) for a, b in labels], "doc_id long, quality int, toxic int")


def test_toxicity(rude):
    docs, labels = rude
    model = toxicity.train(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = range(450, 600)
    assert sum(rows[i]["toxic"] == (i % 6 == 0) for i in held) >= 147
    assert rows[None]["toxic"] and all(not rows[i]["toxic"] and rows[i]["severity"] == 0 for i in (700, 701)) and not rows[702]["toxic"]
    assert all(0 <= r["severity"] <= 2 and r["severity"] >= r["p_toxic"] - 1e-12 for r in rows.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in rows.values())


def test_toxicity_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    rows, cols, values = np.arange(300), rng.integers(0, 3, 300), np.ones(300)
    grades = np.clip(cols + rng.integers(-1, 2, 300), 0, 2)
    weights, cuts = toxicity.fit(rows, cols, values, grades, 3)
    assert weights[0] < weights[1] < weights[2] and cuts[0] < cuts[1]


def test_toxicity_fit_is_the_least_of_a_plain_loss():
    """The loss is written out from its definition; no step from the fitted point lowers it."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, width = 240, 4
    x = rng.random((n, width)) * (rng.random((n, width)) < 0.7)
    grades = np.clip((x @ [3.0, -2.0, 1.0, 0.0] + rng.normal(0, 1, n)).round().astype(int), 0, 2)
    rows, cols = np.nonzero(x)
    weights, cuts = toxicity.fit(rows, cols, x[rows, cols], grades, width, ridge=0.0, steps=3000, rate=0.02)

    def loss(w, c):
        total = 0.0
        for i in range(n):
            below = [0.0, *(1 / (1 + math.exp(-(t - float(x[i] @ w)))) for t in c), 1.0]
            total -= math.log(below[grades[i] + 1] - below[grades[i]])
        return total / n

    best = loss(weights, cuts)
    for k in range(width + 2):
        for step in (-0.02, 0.02):
            w, c = weights.copy(), cuts.copy()
            (w if k < width else c)[k if k < width else k - width] += step
            assert loss(w, c) > best
    model = toxicity.OrdinalModel({b"bad": 0, b" 6 rotten": 1}, np.array([2.0, 1.5]), np.array([0.5, 1.0]))
    text = b"a Bad rottenest day, bad!"
    z = 2.0 * min(1, 10 * math.sqrt(2 / 5)) + 1.5 * min(1, 10 * math.sqrt(1 / 5))
    assert model.above(text) == pytest.approx([1 - 1 / (1 + math.exp(-(t - z))) for t in (0.5, 1.0)])


def test_toxicity_counts_a_repeated_id_once(spark, rude):
    docs, labels = rude
    more = docs.unionByName(docs.where("doc_id = 0").selectExpr("*", "explode(sequence(1, 400)) as k").drop("k"))
    a, b = toxicity.train(docs, labels), toxicity.train(more, labels)
    assert a.index == b.index and list(a.thresholds) == pytest.approx(list(b.thresholds)) and list(a.weights) == pytest.approx(list(b.weights))


def test_toxicity_without_labels(rude):
    docs, labels = rude
    model = toxicity.train(docs, labels.limit(0))
    assert {r["severity"] for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def lm_brute(target, background, text, words=10_000):
    cut = lambda t: brute.WORDS.findall((t or "").translate(brute.LOWER))
    out = []
    known = set(w for t in [*target, *background] for w in cut(t))
    for corpus in (target, background):
        uni, ctx, two = Counter(), Counter(), Counter()
        for t in corpus:
            w = cut(t)
            for a, b in zip(["<s>", *w], w, strict=False):
                uni[b] += 1
                ctx[a] += 1
                two[a, b] += 1
        w, size = cut(text), len(known) + 2
        loss = [-math.log((two[a, b] + 8 * (uni[b] + 1) / (sum(uni.values()) + size)) / (ctx[a] + 8)) for a, b in zip(["<s>", *w], w, strict=False)]
        out.append(sum(loss) / len(loss) if loss else None)
    return out


def test_lm_scores(spark):
    rng = random.Random(4)
    target = [sentence(rng, "aa", 12) for _ in range(20)] + [None, "", "X x, x"]
    background = [sentence(rng, rng.choice(["aa", "bb"]), 15) for _ in range(40)] + [None, "", "!!"]
    t = spark.createDataFrame([(x, 1) for x in target], "text string, n_tokens int")
    b = spark.createDataFrame([(i, x, "k") for i, x in enumerate(background)], "doc_id long, text string, score string")
    models = lm_score.learn(t, b)
    for r in lm_score.score_documents(b, models).collect():
        wanted = lm_brute(target, background, background[r["doc_id"]])
        if wanted[0] is None:
            assert r["n_tokens"] == 0 and r["score"] is None
        else:
            assert r["loss_target"] == pytest.approx(wanted[0], rel=1e-4) and r["loss_background"] == pytest.approx(wanted[1], rel=1e-4) and r["score"] == pytest.approx(wanted[0] - wanted[1], rel=1e-3, abs=1e-4)
    assert lm_score.score_documents(b.limit(0), models).count() == 0
    empty = lm_score.learn(t.limit(0), b.limit(0))
    assert all(r["score"] is None or abs(r["score"]) < 1e-6 for r in lm_score.score_documents(b, empty).collect())


def test_lm_models_keep_all_words_and_bigrams(spark):
    rng = random.Random(14)
    target = [" ".join(f"w{rng.randrange(40_000)}" for _ in range(400)) for _ in range(60)]
    background = [" ".join(f"w{rng.randrange(40_000)}" for _ in range(400)) for _ in range(120)]
    t, b = (spark.createDataFrame(list(enumerate(x)), "doc_id long, text string") for x in (target, background))
    models = lm_score.learn(t, b)
    other = spark.createDataFrame([(0, background[0]), (1, target[0]), (2, "new words w1 w1 w2")], "doc_id long, text string")
    for docs, texts, few in ((b, background, range(0, 120, 40)), (other, [r["text"] for r in other.collect()], range(3))):
        got = {r["doc_id"]: r for r in lm_score.score_documents(docs, models, chunk_bytes=50_000).collect()}
        assert len(got) == len(texts)
        for i in few:
            wanted = lm_brute(target, background, texts[i])
            assert got[i]["loss_target"] == pytest.approx(wanted[0], rel=1e-9) and got[i]["loss_background"] == pytest.approx(wanted[1], rel=1e-9)


TEXTS = ["", " ", "  two  blanks ", "Hello world", "tab\tand\nline\r\n", "é 漢字 🙂 x", "a" * 50, "$$$$$ &&&&& ### ***", "The the THE", "日本語テキスト", "Ünïcode naïve café", "x" * 3 + " " * 20 + "y", "word " * 5000, None]


@pytest.fixture(scope="module")
def model_bytes():
    if not os.path.exists(TOKENIZER):
        pytest.skip("no vocabulary file here")
    with open(TOKENIZER, "rb") as f:
        return f.read()


@pytest.mark.parametrize("kind", [sentencepiece_codec.BPE, sentencepiece_codec.UNIGRAM])
def test_codec_equals_library(model_bytes, kind):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model_bytes)
    proto.trainer_spec.model_type = kind
    for p in proto.pieces:
        if kind == sentencepiece_codec.UNIGRAM:
            p.score = max(p.score, -40_000)
    data = proto.SerializeToString()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(sentencepiece_codec.Pieces(data))
    rng = random.Random(6)
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choice("abcdefgh  eé.,\n") for _ in range(80)) for _ in range(200)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t) and codec.pieces.decode(ids.tolist()) == t


def test_search_equals_merges(model_bytes):
    """Whole words by the search over ends against plain merging, pair by pair; the table of pairs is small, so its slots are fought for."""
    import numpy as np

    plain = sentencepiece_codec.Pieces(model_bytes)
    rng, words = random.Random(31), []
    names = [n for n in plain.names if n.strip("▁").isalpha()]
    for _ in range(4000):
        words.append("".join(rng.choice(names).replace("▁", "")[: rng.randrange(1, 9)] for _ in range(rng.randrange(1, 6)))[:24] or "x")

    def merged(word):
        parts = list(word)
        while True:
            scored = [(-plain.scores[i], k) for k in range(len(parts) - 1) if (i := plain.known.get(parts[k] + parts[k + 1])) is not None]
            if not scored:
                return parts
            k = min(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    old, sentencepiece_codec._PAIR_BITS = sentencepiece_codec._PAIR_BITS, 8
    try:
        for size in sorted({len(w) for w in words}):
            group = [w for w in words if len(w) == size]
            points = np.frombuffer("".join(group).encode("utf-32-le"), dtype="<u4").reshape(len(group), size)
            live = plain.paths(points, plain._prefixes(points))
            for w, row in zip(group, live, strict=True):
                at = [*np.flatnonzero(row).tolist(), size]
                assert [w[a:b] for a, b in zip(at, at[1:], strict=False)] == merged(w)
    finally:
        sentencepiece_codec._PAIR_BITS = old


@pytest.mark.parametrize("kind", [sentencepiece_codec.BPE, sentencepiece_codec.UNIGRAM])
def test_unbroken_texts_take_linear_time(model_bytes, kind):
    import time

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model_bytes)
    proto.trainer_spec.model_type = kind
    data = proto.SerializeToString()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(sentencepiece_codec.Pieces(data))
    rng = random.Random(16)
    make = lambda n: "".join(rng.choice("ABCDabcdefghijklmnop0123+/") for _ in range(n))
    for text in (make(257), make(3000) + " " + make(2000), "a" * 4000, "é漢" + "日本語" * 500, make(300) + "🙂" + make(300), "ab" * 9000):
        got = codec.encode([text])[0].tolist()
        assert codec.pieces.decode(got) == text
        if kind == sentencepiece_codec.BPE or len(text) < 6000:
            assert got == library.encode(text)
    began = time.time()
    text = make(1_000_000)
    assert codec.pieces.decode(codec.encode([text])[0].tolist()) == text and time.time() - began < 60 and not any(len(w) > sentencepiece_codec.LONG for w in codec.kept)


def test_codec_frames(spark, model_bytes):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, "a b", "k"), (3, "Hello world", "k")], "doc_id long, text string, ids string")
    out = sentencepiece_codec.encode_texts(docs, TOKENIZER)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["round_trip"] for r in rows if r["ids"] is not None) and sum(r["ids"] is None for r in rows) == 1
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_ids(out, TOKENIZER).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    assert sentencepiece_codec.encode_texts(docs.limit(0), TOKENIZER).count() == 0


def test_pipeline(spark, tmp_path, model_bytes):
    import corpus_pipeline

    rng = random.Random(8)
    item = "this passage is part of a test that no training text should ever hold whole"
    rows = [[i, sentence(rng, lang := rng.choice(list(SYLLABLES)), 80), lang, f"src{i % 3}"] for i in range(120)]
    labels = []
    for i in range(0, 120, 4):
        words = rows[i][1].split()
        for _ in range(6):
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "rotten"]))
        rows[i][1] = " ".join(words)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(100)]
    rows.append([200, rows[1][1], "aa", "s"])
    rows.append([201, rows[2][1].replace(rows[2][1].split()[40], "changed", 1), "aa", "s"])
    rows[3][1] += " " + item
    rows += [[202, item, "aa", "s"], [203, None, None, None], [204, "1 2 3", None, "s"], [205, "", "aa", "s"]]
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(120) if i % 4}
    assert set(out) == clean and all(r["round_trip"] for r in out.values())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before
    assert item not in {r["doc_id"]: r["text"] for r in docs.collect()}[3]
    assert len(corpus_pipeline.STAGES) == 5
