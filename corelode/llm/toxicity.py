r"""Toxicity by cumulative-link ordinal regression.

A document's grade y in 0..K-1 has P(y <= k) = sigmoid(threshold_k - w.x): one weight vector for all ordered thresholds. x holds
min(1, 10 sqrt(count / words)) of the vocabulary's features: words (lower-cased A-Z, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``) and their first
6 and 8 bytes. The vocabulary is the `features` most associated with grades over zero among the training rows.

Training takes at most `most_rows` labelled texts, the first in the order of a hash of their ids, and of each id the text with the least
hash, so that a repeated id counts once. Features in fewer than `least_documents` of them, or associated by less than `least_z`
standard errors, are noise and take no part. Labels say toxic or not; among
toxic rows those whose share of vocabulary words is at least the median get grade 2, the others grade 1. Scoring reads every
whole text; what is broadcast is the sample's labels (bounded by `most_rows`) and the model (bounded by `features`).

Output: p_toxic = P(y >= 1), severity = sum of P(y >= k), grade (the most probable) and toxic = p_toxic >= threshold.

Defined results: texts that are null or have no words score 0; null ids are scored and never match a label; of labels that
disagree the largest counts; repeated rows are scored alike; without labelled rows of both kinds all scores are 0; an empty
table gives an empty result; other columns are ignored by score_toxicity() and kept by drop_toxic().
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import ALNUM, durable

MOST_ROWS = 20_000
FEATURES = 4096
LEAST_DOCUMENTS = 3
LEAST_Z = 3.0
THRESHOLD = 0.3
PREFIXES = (6, 8)
_FLUSH = 200_000


def counts_of(text: bytes | None) -> tuple[Counter, int]:
    """Features with counts, and the number of words. A prefix carries its length in front, so it equals no word."""
    words = Counter((text or b"").translate(ALNUM).split())
    found = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                found[b" %d " % k + w[:k]] += n
    return found, sum(words.values())


@dataclass
class OrdinalModel:
    """Weights by feature, and ascending thresholds; no thresholds: it knows nothing."""

    index: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, text: bytes | None) -> tuple[list[int], list[float], int]:
        """Indices, values and the number of words; words are looked up once each."""
        words = Counter((text or b"").translate(ALNUM).split())
        n, found = sum(words.values()), Counter()
        get = self.index.get
        for w, c in words.items():
            if (i := get(w)) is not None:
                found[i] += c
            for k in PREFIXES:
                if len(w) > k and (i := get(b" %d " % k + w[:k])) is not None:
                    found[i] += c
        return [*found], [min(1.0, 10 * (c / n) ** 0.5) for c in found.values()], n

    def above(self, text: bytes | None) -> np.ndarray:
        """P(y >= k) for k = 1, 2, ..."""
        i, x, n = self.features(text)
        if not n or not len(self.thresholds):
            return np.zeros(max(1, len(self.thresholds)))
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[i] @ np.array(x), -50, 50)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, ridge: float = 3e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the mean cumulative-link loss. Thresholds are a first value plus
    exponentials, so they stay in order."""
    k, n = int(grades.max()), len(grades)
    theta = np.zeros(width + k)
    share = np.clip([(grades <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta[width] = start[0]
    theta[width + 1 :] = np.log(np.maximum(np.diff(start), 1e-2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(n)
    for t in range(1, steps + 1):
        gaps = np.exp(theta[width + 1 :])
        cuts = np.concatenate(([theta[width]], theta[width] + np.cumsum(gaps)))
        s = np.bincount(rows, values * theta[cols], minlength=n)
        c = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -30, 30)))
        full = np.concatenate((np.zeros((n, 1)), c, np.ones((n, 1))), axis=1)
        slope = np.concatenate((np.zeros((n, 1)), c * (1 - c), np.zeros((n, 1))), axis=1)
        p = np.maximum(full[at, grades + 1] - full[at, grades], 1e-9)
        up, low = slope[at, grades + 1] / p, slope[at, grades] / p
        g = np.zeros_like(theta)
        g[:width] = np.bincount(cols, values * ((up - low) / n)[rows], minlength=width) + ridge * theta[:width] / width**0.5
        cut_g = np.array([-(up[grades == j].sum() - low[grades == j + 1].sum()) / n for j in range(k)])
        g[width] = cut_g.sum()
        g[width + 1 :] = np.cumsum(cut_g[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(theta[width + 1 :])
    return theta[:width], np.concatenate(([theta[width]], theta[width] + np.cumsum(gaps)))


def _document_counts(batches):
    """(feature, toxic documents, other documents), summed up to `_FLUSH` features at a time."""
    found: dict[bytes, list[int]] = {}

    def out():
        f = list(found)
        batch = pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array([found[x][1] for x in f], pa.int64()), pa.array([found[x][0] for x in f], pa.int64())], names=["feature", "toxic", "other"])
        found.clear()
        return batch

    for b in batches:
        for t, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
            for x in counts_of(t.as_py())[0]:
                found.setdefault(x, [0, 0])[y] += 1
            if len(found) >= _FLUSH:
                yield out()
    yield out()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, features: int = FEATURES, least_documents: int = LEAST_DOCUMENTS, least_z: float = LEAST_Z) -> OrdinalModel:
    few = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    # Of very many labels only about twice what is needed gets sorted.
    part = 2.0 * most_rows / max(1, few.count())
    if part < 1:
        few = few.where(F.xxhash64("id") < F.lit(int(-(1 << 63) + part * (1 << 64))))
    few = few.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    text = F.col(text_col).cast("binary").alias("text")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), text).join(F.broadcast(few), "id")  # at most most_rows rows of an id and a bit
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    rows = durable(rows.select("text", "y"))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return OrdinalModel()
    seen = rows.mapInArrow(_document_counts, "feature binary, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    a, b, na, nb = F.col("toxic") + 0.5, F.col("other") + 0.5, float(total[1] + 1), float(total[0] + 1)
    far = F.abs(F.log(a / na) - F.log(b / nb)) / F.sqrt(1 / a + 1 / b)
    top = seen.where(F.col("toxic") + F.col("other") >= least_documents).withColumn("far", far).where(F.col("far") >= least_z).orderBy(F.desc("far"), "feature").limit(features).collect()
    if not top:
        return OrdinalModel()
    model = OrdinalModel({bytes(r["feature"]): i for i, r in enumerate(top)})
    strong = {i for i, r in enumerate(top) if r["toxic"] * total[0] > 4 * r["other"] * total[1] and not bytes(r["feature"]).startswith(b" ")}

    def sparse(batches):
        for batch in batches:
            found = [model.features(t.as_py()) for t in batch.column("text")]
            share = [sum(x * x for i, x in zip(f[0], f[1], strict=True) if i in strong) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), pa.array(share, pa.float64())], names=["y", "i", "x", "share"])

    got = rows.mapInArrow(sparse, "y int, i array<int>, x array<float>, share double").toArrow().to_pydict()
    order = sorted(range(len(got["y"])), key=lambda k: (got["y"][k], got["share"][k], got["i"][k], got["x"][k]))
    y, share = np.array([got["y"][k] for k in order]), np.array([got["share"][k] for k in order])
    middle = np.median(share[y == 1])
    grades = np.where(y == 1, 1 + (share >= middle), 0)
    if not (grades == 1).any():
        grades = np.minimum(grades, 1)
    sizes = [len(got["i"][k]) for k in order]
    cols = np.array([i for k in order for i in got["i"][k]], dtype=np.int64)
    values = np.array([x for k in order for x in got["x"][k]])
    model.weights, model.thresholds = fit(np.repeat(np.arange(len(order)), sizes), cols, values, grades, len(top))
    return model


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = [shared.value.above(t.as_py()) for t in b.column("text")]
            grade = [int((x >= 0.5).sum()) for x in p]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([float(x[0]) for x in p], pa.float64()), pa.array([float(x.sum()) for x in p], pa.float64()), pa.array(grade, pa.int32()), pa.array([bool(x[0] >= threshold) for x in p], pa.bool_())], names=["doc_id", "p_toxic", "severity", "grade", "toxic"])

    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return few.mapInArrow(run, f"doc_id {kind}, p_toxic double, severity double, grade int, toxic boolean").withColumnRenamed("doc_id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the toxic rows, all columns as they were."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            keep = [not t.is_valid or bool(shared.value.above(t.as_buffer().to_pybytes())[0] < threshold) for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return inner.mapInArrow(run, inner.schema).toDF(*names)
