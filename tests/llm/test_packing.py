import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corelode.llm import packing as pk

PATH = "/opt/tokenizers/byte_bpe_50k.json"


def best_fit_decreasing(sizes, room):
    """Plain, one document at a time."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(left) if f >= s]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= s
        else:
            left.append(room - s)
    return len(left)


def histogram(sizes, room):
    return np.bincount(sizes, minlength=room + 1)


SPREADS = {
    "even": lambda r: r.randint(1, 64), "large": lambda r: r.randint(20, 40), "small": lambda r: r.randint(1, 9), "one": lambda r: 21, "few": lambda r: r.choice([13, 19, 32, 33, 45]),
    "hot": lambda r: 30 if r.random() < 0.4 else r.randint(1, 64), "full": lambda r: r.choice([64, 64, 1]),
}


@pytest.mark.parametrize("kind", SPREADS)
@pytest.mark.parametrize("n", [1, 7, 300, 3000])
def test_plans_hold_all_documents_in_few_sequences(kind, n):
    rng = random.Random(n)
    sizes = [SPREADS[kind](rng) for _ in range(n)]
    counts = histogram(sizes, 64)
    plan = pk.plan(counts, 64)
    held = np.zeros(65, dtype=int)
    for a in plan:
        assert a.many > 0 and a.free == 64 - sum(s * k for s, k in a.content) >= 0
        for s, k in a.content:
            held[s] += k * a.many
    assert (held == counts).all()
    many = sum(a.many for a in plan)
    assert -(-sum(sizes) // 64) <= many <= best_fit_decreasing(sizes, 64)


def test_configurations_beat_best_fit():
    """Three sizes that fill a sequence exactly: best fit pairs the larger two kinds with themselves."""
    sizes = [30, 21, 13] * 60 + [31, 33] * 10
    assert sum(a.many for a in pk.plan(histogram(sizes, 64), 64)) == 70
    for chosen, many in pk.configurations([30, 21, 13], [60, 60, 60], 64):
        assert many > 0 and chosen @ np.array([30, 21, 13]) <= 64


def test_work_follows_the_sizes_not_the_documents():
    rng = random.Random(3)
    counts = histogram([rng.randint(1, 1024) for _ in range(4000)], 1024) * 10**9
    plan = pk.plan(counts)
    assert len(plan) < 20_000 and len(pk.places(plan)["key"]) < 60_000
    assert sum(a.many for a in plan) < 1.02 * (counts * np.arange(1025)).sum() / 1024


def check(rows, got, room, ids_of, end=2):
    """Every row's pieces are whole and in order; every sequence is gapless and no longer than the room."""
    want = sorted(zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in (ids_of(t) + [end] for t in rows))
    by_seq, whole = {}, []
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= room
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r["piece"])
        ids = [i for r in pieces for i in r["ids"]]
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and all(r["length"] == room for r in pieces[1:])
        assert [r["start"] for r in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in pieces)
        whole.append(zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert sorted(whole) == want
    return by_seq


def test_packing_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    words = ["a", "Der", "naïve", "x1", "don't", "  ", "\n", "\t\n", "###", "日本", " ", "᠎", "!\x1c", "　 ", "e.g.", "<|endoftext|>", "🙂"]
    texts = [None, "", " ", "\n\n x", *("".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(120)), "ab " * 3000, "y" * 5000]
    rows = [(i, x, i, "s") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id string").repartition(3)
    packed = pk.pack_documents(df, PATH, room=64, with_ids=True)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = packed.collect()
    by_seq = check(texts, got, 64, lambda x: t.encode(x or "", add_special_tokens=False).ids)
    sizes = [r["length"] for r in got]
    assert len(by_seq) <= best_fit_decreasing(sizes, 64)
    joined = {r["sequence_id"]: r for r in pk.sequences(packed).collect()}
    assert all(len(joined[s]["ids"]) == sum(n for _, n in spans) and len(joined[s]["parts"]) == len(spans) for s, spans in by_seq.items())


def test_units_are_borders_of_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(PATH), pk.Encoder(PATH)
    rng = random.Random(5)
    signs = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", "᠎", "​", " ", "　", "﻿", "a", "B", "7", "'s", "'", ".", "é", "ß", "́", "字"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(4000)]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    e.number = {str(i): i for i in range(pk.MOST_UNITS + 1)}  # a full memory is given up
    assert [x.tolist() for x in e.encode(pa.array(["a b", ""]))] == [t.encode("a b").ids, []]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two")] * 5 + [(3, None)] * 4, "doc_id long, text string")
    got = pk.pack_documents(df, PATH, room=8).collect()
    assert len(got) == 9 and len({(r["sequence_id"], r["offset"]) for r in got}) == 9 and {r["doc_id"] for r in got} == {None, 3}
    assert {r["sequence_id"] for r in got} == {0, 1, 2} and all(r["length"] == 1 for r in got if r["doc_id"])
    assert pk.pack_documents(df.limit(0), PATH).collect() == []


def test_places_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "w " * (i * 7 % 90)) for i in range(400)], "doc_id long, text string")
    seen = [len({r["sequence_id"] for r in pk.pack_documents(df.repartition(n), PATH, room=64).collect()}) for n in (1, 5)]
    assert seen[0] == seen[1]
