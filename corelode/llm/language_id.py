"""Language identification as inference of a mixture.

Each language has a smoothed distribution over hashed byte trigrams around letters (A-Z lower-cased, other ASCII taken as blanks),
counted over all training texts. A word's likelihood under a language is that of its trigrams. For each document,
expectation-maximisation finds the proportions of languages among its words; then sets of the 1, 2, ... largest, up to all
learned languages, are fitted alone, and the set with the best likelihood less `penalty` * log(words) / 2 for each further language counts.
The prediction is its largest part, the score that part's share.

Evidence for a document is its log-likelihood a trigram under its mixture, over that of cells drawn evenly. Where it isn't positive, no
learned language explains the text better than chance; drop_unidentified() rejects such texts.

Documents of a slice go through the iterations together as one matrix (words x languages), cut so that memory is bounded.

Defined results: null texts, empty ones and those without a letter get ``und`` and score 0; so does every text if nothing
could be learned; null ids aren't learned from; repeated rows count each; an empty table gives an empty result; other
columns are ignored by identify() and kept by drop_unidentified().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import slices

CELLS = 1 << 16
UNKNOWN = "und"
SMOOTHING = 0.5
PENALTY = 8.0
ROUNDS = 10
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())
_CELLS_AT_ONCE = 1 << 20


def grams(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams around each letter of a line that begins and ends with a blank, and for each whether its letter
    begins a word."""
    a = np.frombuffer(line, dtype=np.uint8).astype(np.uint32)
    h = ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    letter = a[1:-1] != 32
    return h[letter], (a[:-2] == 32)[letter]


def has_letter(text: bytes) -> bool:
    if text.lower() != text.upper():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class LanguageModel:
    names: list[str]
    #: Log-probabilities, cells x languages.
    table: np.ndarray

    def words(self, line: bytes) -> np.ndarray:
        """Log-likelihoods, words x languages."""
        cell, first = grams(line)
        starts = np.flatnonzero(first)
        step, out = max(1, _CELLS_AT_ONCE // max(1, len(self.names))), []
        k = 0
        while k < len(starts):
            stop = max(k + 1, int(np.searchsorted(starts, starts[k] + step)))
            end = starts[stop] if stop < len(starts) else len(cell)
            out.append(np.add.reduceat(self.table[cell[starts[k] : end]], starts[k:stop] - starts[k], axis=0))
            k = stop
        return np.concatenate(out) if out else np.zeros((0, len(self.names)), dtype=np.float32)

    def infer(self, texts: list[bytes | None], judged: bool = False) -> list[tuple[list[str], list[float], float]]:
        """Languages and shares of each text, the largest first, and with `judged` the evidence (else 0); none where there is no letter."""
        out: list[tuple[list[str], list[float], float]] = [([], [], 0.0)] * len(texts)
        good = [i for i, t in enumerate(texts) if t and self.names and has_letter(t)]
        lines = [t.translate(_LETTERS) for t in (texts[i] for i in good)]
        many = [len(x.split()) for x in lines]
        good, many, lines = ([x for x, n in zip(xs, many, strict=True) if n] for xs in (good, many, lines))
        if not good:
            return out
        ll = self.words(b" " + b" ".join(lines) + b" ")
        many = np.array(many)
        top = ll.max(axis=1, keepdims=True)
        like = _likelihood(ll, top)
        shares = mixture(ll, many, like=like)
        found = evidence(like, top, many, shares, np.array([len(x) - x.count(b" ") for x in lines])).tolist() if judged else [0.0] * len(good)
        for i, p, e in zip(good, shares, found, strict=True):
            order = [int(k) for k in np.argsort(-p, kind="stable") if p[k] > 0]
            out[i] = ([self.names[k] for k in order], [min(1.0, float(p[k])) for k in order], e)
        return out


def _em(like: np.ndarray, starts: np.ndarray, many: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after `rounds` rounds from `share`, and the log-likelihood of each document before the last one."""
    for _ in range(rounds):
        part = np.repeat(share, many, axis=0)
        part *= like
        total = part.sum(axis=1)
        part /= total[:, None]
        share = np.add.reduceat(part, starts, axis=0) / many[:, None].astype(np.float32)
    return share, np.add.reduceat(np.log(total.astype(np.float64)), starts)


def _likelihood(ll: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Relative to the best language of each word."""
    return np.maximum(np.exp(ll - top), np.float32(1e-30))


def mixture(ll: np.ndarray, many: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS, like: np.ndarray | None = None) -> np.ndarray:
    """Shares, documents x languages, of the chosen set. many: words of each document, all positive."""
    like = _likelihood(ll, ll.max(axis=1, keepdims=True)) if like is None else like
    starts = np.concatenate(([0], np.cumsum(many)[:-1]))
    langs = ll.shape[1]
    share, _ = _em(like, starts, many, np.full((len(many), langs), 1 / langs, dtype=np.float32), rounds)
    alone = np.add.reduceat(np.log(like).astype(np.float64), starts, axis=0)
    best = np.zeros_like(share)
    best[np.arange(len(many)), alone.argmax(axis=1)] = 1
    value = alone.max(axis=1)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    for k in range(2, langs + 1):
        # Only documents where a k-th language has a part at all, half a word or more, can gain.
        some = np.flatnonzero((share * many[:, None] >= 0.5).sum(axis=1) >= k)
        if not some.size:
            break
        rows = np.repeat(np.isin(np.arange(len(many)), some), many)
        n, begin = share[some] * (rank[some] < k), np.concatenate(([0], np.cumsum(many[some])[:-1]))
        fitted, total = _em(like[rows], begin, many[some], n / n.sum(axis=1, keepdims=True), rounds)
        total -= penalty * (k - 1) * np.log(np.maximum(many[some], 2)) / 2
        better = total > value[some]
        value[some[better]], best[some[better]] = total[better], fitted[better]
    return best


def evidence(like: np.ndarray, top: np.ndarray, many: np.ndarray, shares: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """Of each document: the mean over its trigrams of log P under its mixture less that of even cells."""
    word = top[:, 0] + np.log(np.maximum((like * np.repeat(shares, many, axis=0)).sum(axis=1), 1e-30))
    starts = np.concatenate(([0], np.cumsum(many)[:-1]))
    return np.add.reduceat(word.astype(np.float64), starts) / trigrams + np.log(CELLS)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """From rows with an id, a text and a language that aren't held out. What reaches the driver is a count for each
    language and cell."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole):
                for name in b.column("lang").unique().to_pylist():
                    texts = [t for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True) if t and x == name]
                    cell, _ = grams(b" " + b" ".join(t.translate(_LETTERS) for t in texts) + b"  ")
                    found.setdefault(name, np.zeros(CELLS, dtype=np.int64))
                    found[name] += np.bincount(cell, minlength=CELLS)
        for name, n in found.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n[cells])], names=["lang", "cell", "n"])

    seen = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    name, cell, n = seen["lang"].to_numpy(), seen["cell"].to_numpy(), seen["n"].to_numpy()
    names = sorted(set(name.tolist()))
    counts = np.zeros((CELLS, len(names)))
    for k, x in enumerate(names):
        counts[cell[name == x], k] = n[name == x]
    return LanguageModel(names, np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * CELLS)).astype(np.float32))


def _most(model: LanguageModel) -> int:
    """Bytes of text whose words x languages matrices take some tens of MB."""
    return max(1 << 16, (4 << 20) // max(4, len(model.names)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, languages, shares)."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in slices(whole, most=_most(shared.value)):
                found = shared.value.infer(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), b.column("held_out"), pa.array([x[0][0] if x[0] else UNKNOWN for x in found], pa.string()), pa.array([x[1][0] if x[1] else 0.0 for x in found], pa.float64()),
                    pa.array([x[0] for x in found], pa.list_(pa.string())), pa.array([x[1] for x in found], pa.list_(pa.float64())),
                ], names=["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    few = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return few.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>").withColumnRenamed("doc_id", id_col)


def drop_unidentified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_evidence: float = 0.0) -> DataFrame:
    """docs without the rows that have no language or not more than `least_evidence` for theirs; all columns as they were."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(text_col)}"

    def run(batches):
        for whole in batches:
            for b in slices(whole, at, _most(shared.value)):
                found = shared.value.infer([t if t is None else t.encode() for t in b.column(at).to_pylist()], judged=True)
                yield b.filter(pa.array([bool(x[1]) and x[2] > least_evidence for x in found], pa.bool_()))

    return inner.mapInArrow(run, inner.schema).toDF(*names)
