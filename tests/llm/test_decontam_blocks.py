import random

from corelode.llm import decontam


def nested(seed, n=60):
    """Items of few words, and texts in which items are planted inside items, whole or torn, so that cuts bring windows together."""
    rng = random.Random(seed)
    items = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(3, 14))] for _ in range(12)]

    def planted(depth):
        item = rng.choice(items)
        if depth == 0 or rng.random() < 0.3:
            return item
        at = rng.randint(1, len(item))
        return item[:at] + planted(depth - 1) + item[at:]

    texts = []
    for _ in range(n):
        words = [f"c{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = planted(rng.randint(0, 4))
        texts.append(" ".join(words) + rng.choice(["", ".", "\n"]))
    return [(f"i{k}", " ".join(w)) for k, w in enumerate(items)], list(enumerate(texts))


def test_any_block_size_removes_the_same(spark):
    items, texts = nested(1)
    docs = spark.createDataFrame([*texts, (None, texts[0][1]), (900, None), (901, "")], "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(decontam.remove_leaks(docs, tests, window=5).collect(), key=repr)
    assert len(want) < docs.count() and any(t not in [x for _, x in texts] for _, t in want if t)
    for words, parts in ((5, 1), (5, 4), (40, 2)):
        left = decontam.remove_leaks(docs, tests.repartition(parts), window=5, block_words=words)
        assert sorted(left.collect(), key=repr) == want
        assert decontam.find_leaks(left, tests, window=5).where("n_hit > 0").count() == 0


def test_an_item_planted_in_another_goes_whatever_the_block(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    text = " ".join(f"clean{i}" for i in range(40)) + " " + " ".join(a.split()[:6] + b.split() + a.split()[6:])
    docs, tests = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("a", a), ("b", b)], "item_id string, text string")
    for words in (5, 250_000):
        (left,) = decontam.remove_leaks(docs, tests, block_words=words).collect()
        assert left["text"].split() == [f"clean{i}" for i in range(40)]
