import hashlib
import math
import random

import numpy as np
import pytest

from corelode.llm import vector_codes as vc


def plain(rows, entries=256, parts=4, rounds=4, scale=1024):
    """(id, label, code, error) of rows (id, vector, label), and the books' digest, number by number."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // parts
    vectors = [[int(x) * scale if abs(x) >= 2**60 else math.floor(x * scale) for x in r[1]] for r in kept]
    fit = [v for v in vectors if len(v) == width * parts]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in fit[:entries]] for p in range(parts)]
    best = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), i) for i, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            near = [best(v, p)[1] for v in fit]
            new.append([[sum(col) // near.count(i) for col in zip(*(cut(v, p) for v, k in zip(fit, near, strict=True) if k == i), strict=True)] if i in near else c for i, c in enumerate(books[p])])
        books = new
    out = []
    for r, v in zip(kept, vectors, strict=True):
        if len(v) != width * parts:
            out.append((r[0], r[2], None, None))
            continue
        found = [best(v, p) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def key(r):
    return tuple((x is None, "" if x is None else x) for x in r)


def check(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    got = vc.encode_vectors(df, **how)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    want, digest = plain(rows, **{k: v for k, v in how.items() if k in ("entries", "parts", "rounds")})
    got = got.collect()
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    sums = {}
    for _, c, _, e in want:
        if e is not None:
            sums[c] = sums.get(c, 0) + e
    assert all(r["label_error"] == sums.get(r["label"]) for r in got)


@pytest.mark.parametrize("spread,entries", [(0.3, 256), (0.004, 20)])
def test_codes_equal_plain_quantisation(spark, spread, entries):
    """The small spread makes ties and repeated entries the rule."""
    rng = random.Random(5)
    rows = [(i // 2 if i % 7 == 0 else i, [rng.gauss(0, spread) for _ in range(8)], rng.choice([None, 1, 2, 2, 2])) for i in range(400)]
    rows += [rows[5]] * 30 + [(None, [0.1] * 8, None), (900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [0.1] * 7 + [float("nan")], 1), (903, [0.1] * 7 + [float("-inf")], 1)]
    check(spark, rows, entries=entries)


def test_salted_labels_and_other_lengths(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)], i % 40 if i % 3 else None) for i in range(200)] + [(500, [0.5] * 3, 7), (501, [], None)]
    check(spark, rows, entries=16, most_labels=5)


def test_large_components_are_exact(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 3e3 for _ in range(4)], 1) for i in range(12)] + [(i, [rng.random() * 9e4 for _ in range(4)], 2) for i in range(12, 40)]
    check(spark, rows, kind="double", entries=8)
    x = vc.whole(np.array([[2.0**70, -(2.0**70)]]))
    c = vc.Codebook(np.array([[2**80, -(2**80) + 1], [2**80, -(2**80) + 1]], dtype=object))
    assert c.nearest(x) == (0, 1)


def test_empty_and_odd_tables(spark):
    check(spark, [])
    check(spark, [(1, None, 2)])
    check(spark, [(3, [0.1, 0.2, 0.3, 0.4], None)])
    with pytest.raises(ValueError):
        vc.encode_vectors(spark.createDataFrame([(1, [0.1] * 6, 1)], "vec_id long, embedding array<float>, label int"))
    clash = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0], "x", 5, 6)], "key string, v array<double>, label string, code int, error int")
    assert vc.encode_vectors(clash, "key", "v").select("key", "code", "error").collect() == [("a", "00000000", 0)]


def test_pruning_equals_a_full_search():
    rng = np.random.default_rng(8)
    for width, spread in ((16, 100), (2, 3), (1, 2)):
        x = np.floor(rng.normal(size=(2000, width)) * spread)
        x[:50] *= 9
        c = x[rng.integers(0, len(x), 150)]
        far = ((x[:, None] - c) ** 2).sum(axis=2)
        index, best = vc.Codebook(c).nearest(x)
        assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()
