"""Vector codes: product quantisation in whole numbers, nearest entries found by annular norm pruning.

A component x becomes floor(scale * x). Vectors are cut into equal consecutive parts, each with a codebook of its own, which begins as that
part of the vectors with the smallest ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower
index) and puts the floored mean of its parts in an entry's place; entries that nothing is assigned to stay.

Pruning: an entry at distance d from a point has a norm within d of the point's. Entries are sorted by norm; points, sorted likewise, are
taken in blocks. A block first meets the entries around its own norms. Then the interval that the best distance so far allows each point is
found by binary search, both ends included, and the entries in it that weren't met are evaluated, nearest norms first, until no interval
reaches beyond what was met. Distances are exact: in doubles where they stay below 2**53, else in Python's whole numbers.

A round is one scan without an exchange of vectors: each task gives one row of counts and sums for each entry it used. Nothing is kept
between rounds but the codebooks (`entries` x components numbers, the only thing that is broadcast), so a lost executor costs its tasks only.

Defined results: rows whose vector is null, or holds null, NaN or infinite components, are dropped; rows with one id are taken each, among
the first entries in the order of id (null last), then vector; with fewer rows than `entries` the codebooks are as short; a vector of another
length than that of the first row keeps its row with null code and error, and doesn't count; a length that isn't a multiple of `parts` is an
error; an error sum beyond a long is an arithmetic error; null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import durable

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Points that are pruned together, and entries that they meet at a time.
BLOCK, STEP = 256, 32
#: Labels up to which their sums are broadcast; more meet by a salted join.
MOST_LABELS, SALTS = 100_000, 64


def _small(most: float, width: int) -> bool:
    """Whether squared distances of vectors with components up to `most` are exact in doubles."""
    return most < 2.0**26 and most * most * 4 * width < 2.0**53


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): doubles if their squared distances are exact, else Python's whole numbers."""
    if not values.size or _small(min(np.abs(values).max(), 2.0**60) * scale + 1, values.shape[-1]):
        return np.floor(values * scale)
    each = [math.floor(x * scale) if abs(x) < 2.0**60 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(each, dtype=object).reshape(values.shape)


def _exact(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python's whole numbers."""
    return values if values.dtype == object else values.astype(np.int64).astype(object)


class Codebook:
    """One part's entries, in the order of their norms."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        norms = np.sqrt(squares.astype(float))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.squares, self.entries = norms[self.order], squares[self.order], entries[self.order]

    def _met(self, x: np.ndarray, xs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the best of the entries at [lo, hi) for each row of x."""
        far = xs[:, None] - 2 * (x @ self.entries[lo:hi].T) + self.squares[lo:hi]
        least = far.min(axis=1)
        return np.where(far == least[:, None], self.order[lo:hi], len(self.order)).min(axis=1), least

    def _block(self, x: np.ndarray, xs: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.norms)
        lo, hi = np.searchsorted(self.norms, norms[0]), np.searchsorted(self.norms, norms[-1], "right")
        lo, hi = max(0, lo - STEP // 2), min(size, hi + STEP // 2)
        index, best = self._met(x, xs, lo, hi)

        def meet(who: np.ndarray, a: int, b: int) -> None:
            i, d = self._met(x[who], xs[who], a, b)
            better = (d < best[who]) | ((d == best[who]) & (i < index[who]))
            index[who[better]], best[who[better]] = i[better], d[better]

        while True:
            reach = np.sqrt(best.astype(float))
            slack = 1e-9 * (1 + norms + reach)
            first = np.searchsorted(self.norms, norms - reach - slack)
            last = np.searchsorted(self.norms, norms + reach + slack, "right")
            below, above = np.flatnonzero(first < lo), np.flatnonzero(last > hi)
            if below.size:
                a = max(lo - STEP, int(first[below].min()))
                meet(below, a, lo)
                lo = a
            if above.size:
                b = min(hi + STEP, int(last[above].max()))
                meet(above, hi, b)
                hi = b
            if not below.size and not above.size:
                return index, best

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lower of equally near ones, and its squared distance, for each row of x."""
        if x.dtype != self.entries.dtype:
            x, self.entries, self.squares = _exact(x), _exact(self.entries), _exact(self.squares)
        xs = (x * x).sum(axis=1)
        norms = np.sqrt(xs.astype(float))
        order = np.argsort(norms, kind="stable")
        index, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
        for k in range(0, len(x), BLOCK):
            at = order[k : k + BLOCK]
            index[at], best[at] = self._block(x[at], xs[at], norms[at])
        return index, best


def _rows(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _cut(vectors: np.ndarray, books: list[Codebook]) -> list[np.ndarray]:
    return np.split(whole(vectors), len(books), axis=1)


def _summed(shared, dim: int):
    """(part, entry, n, sums) of all of a task's vectors."""

    def run(batches):
        books = [Codebook(e) for e in shared.value]
        size, width = len(shared.value[0]), dim // len(books)
        n, sums = np.zeros((len(books), size), dtype=np.int64), np.zeros((len(books), size, width), dtype=np.int64)
        for batch in batches:
            for p, x in enumerate(_cut(_rows(batch.column(0), dim), books)):
                at, _ = books[p].nearest(x)
                if x.dtype == object:
                    sums = _exact(sums)
                n[p] += np.bincount(at, minlength=size)
                np.add.at(sums[p], at, x.astype(sums.dtype) if sums.dtype != object else _exact(x))
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry], pa.int64()), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())),
            ], names=["part", "entry", "n", "sums"])

    return run


def _coded(shared, dim: int):
    def run(batches):
        books = [Codebook(e) for e in shared.value]
        for batch in batches:
            good = np.array(batch.column("vector").value_lengths().to_numpy() == dim)
            codes, far = np.zeros((int(good.sum()), len(books)), dtype=np.int64), [0] * int(good.sum())
            if good.any():
                for p, x in enumerate(_cut(_rows(batch.column("vector").filter(pa.array(good)), dim), books)):
                    codes[:, p], d = books[p].nearest(x)
                    far = [a + int(b) for a, b in zip(far, d.tolist(), strict=True)]
            if far and max(far) >= 2**63:
                raise ArithmeticError("an error is beyond a long")
            found = zip(codes.tolist(), far, strict=True)
            each = [next(found) if g else (None, None) for g in good]
            code = pa.array([None if c is None else "".join(f"{x:02x}" for x in c) for c, _ in each], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array([e for _, e in each], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def train(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Each part's final entries, and the length of the vectors. kept: (vec_id, vector)."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    dim = len(first[0]["vector"]) if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    fit = kept.where(F.size("vector") == dim)
    start = fit.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    values = whole(np.array([r["vector"] for r in start], dtype=float).reshape(len(start), dim))
    books = np.split(values, parts, axis=1)
    if not dim:
        return books, dim
    sums = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dim // parts)]
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)
        found = fit.select("vector").mapInArrow(_summed(shared, dim), "part int, entry int, n long, sums array<long>")
        books = [_exact(b) for b in books]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each entry
            books[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(dim // parts)]
        books = [b.astype(float) if _small(float(abs(b).max()), dim) else b for b in books]
        shared.unpersist()
    return books, dim


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """coded plus label_error, the sum of `error` over equal labels."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("__label"))
    if sums.limit(most_labels + 1).count() <= most_labels:
        out = coded.join(F.broadcast(sums), same, "left")
    else:
        salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        each = sums.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(each, same & (F.col("__salt") == F.col("__s")), "left").drop("__salt", "__s")
    return out.drop("__label")


def encode_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, most_labels: int = MOST_LABELS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256): a code holds two hex digits a part."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is two hex digits: from 1 to 256 entries")
    d = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = d.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    books, dim = train(kept, entries, parts, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    shared = rows.sparkSession.sparkContext.broadcast(books)
    coded = durable(kept.mapInArrow(_coded(shared, dim), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    out = with_label_error(coded, most_labels).withColumn("codebooks_sha256", F.lit(books_sha256(books)))
    return out.select(F.col("vec_id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", "codebooks_sha256")
