r"""LM scoring by cross-entropy difference: two matched bigram models, one of a target corpus and one of the background.

Tokens are words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, A-Z lower-cased). Both models share the vocabulary of all words of both corpora,
one more standing for all unknown ones; all words and all bigrams count, over all rows. In either model

    P(w | v) = (c(v, w) + K * P(w)) / (c(v) + K),  P(w) = (c(w) + 1) / (N + words + 2),

with c = 0 for what the corpus doesn't hold. A document's score is the mean over its tokens of -log P_target + log P_background: the
lower, the closer to the target. The first token follows the text's start, which is a context of its own.

Nothing is broadcast and no table is bounded. Documents are dealt into chunks of about `chunk_bytes` of text, keys (64-bit hashes, which tell
words and bigrams apart) into ranges, as many for up to about a thousand chunks. A chunk sends its different keys and their counts, one packed row a range; the rows of
all chunks and of the models' corpora meet by range and are summed by key, and the sums go back to the chunk, but for those that equal its
own counts. Where the scored documents are the background, the same rows count for it. A key has at most one entry for each chunk, however
frequent it is.

Defined results: null texts and those without words have no tokens and null scores; repeated rows count each; an empty
target or background gives the uniform model; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import ALNUM, pair, slices

BACKOFF = 8.0
CHUNK_BYTES = 8 << 20
SQUARE = 32
_FLUSH = 1_000_000
_BATCH = 100_000
_START = 0x9E3779B97F4A7C15
_TARGET, _BACKGROUND = -1, -2


def _numbers(texts: list[bytes | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts in a row, new ones being added, and words of each text."""
    words = [(t or b"").translate(ALNUM).split() for t in texts]
    many = np.array([len(w) for w in words], dtype=np.int64)
    return np.fromiter((number.setdefault(x, len(number)) for ws in words for x in ws), dtype=np.int64, count=int(many.sum())), many


def _hashes(number: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in number), dtype=np.uint64, count=len(number))


def _two(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of bigrams."""
    x = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys:
    """The words, contexts and bigrams of texts: sorted keys, n as words or bigrams and x as contexts, and the places of each token's
    word, context and bigram in them."""

    def __init__(self, texts: list[bytes | None]):
        number: dict[bytes, int] = {}
        w, self.many = _numbers(texts, number)
        words = np.append(_hashes(number), np.uint64(_START))
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[(np.cumsum(self.many) - self.many)[self.many > 0]] = len(number)
        pairs, at, n = np.unique(before * len(words) + w, return_inverse=True, return_counts=True)
        keys = np.concatenate([words, _two(words[pairs // len(words)], words[pairs % len(words)])])
        order = np.argsort(keys)
        place = np.empty_like(order)
        place[order] = np.arange(len(keys))
        self.keys, self.n = keys[order], np.concatenate([np.bincount(w, minlength=len(words)), n])[order]
        self.x = np.concatenate([np.bincount(before, minlength=len(words)), np.zeros(len(pairs), dtype=np.int64)])[order]
        self.word, self.context, self.pair = place[w], place[before], place[len(words) + at]


def _packed(a: np.ndarray) -> bytes:
    """Byte planes of whole numbers, which compress where they are small."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


_SENT = "span int, chunk long, first long, key binary, n binary, x binary"
_SUMS = ("tn", "bn", "tx", "bx")


def _count(side: int, spans: int, most: int):
    """Rows of _SENT: of each chunk if the batches, sorted by it, have one, or of about `most` bytes of a corpus at once."""

    def sent(chunk: int, texts: list):
        k = Keys(texts)
        edges = np.searchsorted(((k.keys >> np.uint64(32)) * np.uint64(spans)) >> np.uint64(32), np.arange(spans + 1))
        for lo in range(0, spans, 64):
            some = [(p, a, b) for p, (a, b) in enumerate(zip(edges[lo : lo + 64].tolist(), edges[lo + 1 : lo + 65].tolist(), strict=False), lo) if b > a]
            if some:
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _, _ in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([a for _, a, _ in some], pa.int64()),
                    pa.array([_packed(np.diff(k.keys[a:b], prepend=np.uint64(0))) for _, a, b in some], pa.binary()), *(pa.array([_packed(v[a:b]) for _, a, b in some], pa.binary()) for v in (k.n, k.x)),
                ], names=["span", "chunk", "first", "key", "n", "x"])

    def run(batches):
        now, held, size = side, [], 0
        for batch in batches:
            of = batch.column("chunk").to_pylist() if side >= 0 else [side] * batch.num_rows
            for c, t in zip(of, batch.column("text"), strict=True):
                if held and (c != now or (side < 0 and size >= most)):
                    yield from sent(now, held)
                    held, size = [], 0
                now, t = c, t.as_py() or b""
                held.append(t)
                size += len(t)
        if held:
            yield from sent(now, held)

    return run


def _sum(same: bool):
    """Reads rows of _SENT sorted by span, gives (chunk, at, sums): for places in a chunk's keys what both corpora hold."""

    def sums(held: list[tuple]):
        key = np.concatenate([np.cumsum(_unpacked(r[3]), dtype=np.uint64) for r in held])
        n, x = (np.concatenate([_unpacked(r[k]) for r in held]).astype(np.int64) for k in (4, 5))
        many = [len(r[3]) // 8 for r in held]
        chunk = np.repeat(np.array([r[1] for r in held]), many)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        group = np.empty(len(key), dtype=np.int64)
        group[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(key)]))
        target, background = chunk == _TARGET, chunk != _TARGET if same else chunk == _BACKGROUND
        total = {s + c: np.add.reduceat(np.where(who, v, 0)[order], start) for s, who in (("t", target), ("b", background)) for c, v in (("n", n), ("x", x))}
        out, lo = [], 0
        for r, k in zip(held, many, strict=True):
            g, hi = group[lo : lo + k], lo + k
            if r[1] >= 0:
                got = [total[c][g] for c in _SUMS]
                at = np.flatnonzero((got[0] > 0) | (got[2] > 0) | (got[1] != n[lo:hi]) | (got[3] != x[lo:hi]))
                if at.size:
                    out.append((r[1], _packed(np.diff(at + r[2], prepend=0)), *(_packed(v[at]) for v in got)))
            lo = hi
        for k in range(0, len(out), 64):
            cols = list(zip(*out[k : k + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["chunk", "at", *_SUMS])

    def run(batches):
        now, held = None, []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("span", "chunk", "first", "key", "n", "x")), strict=True):
                if held and r[0] != now:
                    yield from sums(held)
                    held = []
                now = r[0]
                held.append(r)
        if held:
            yield from sums(held)

    return run


def _count_words(batches):
    """(word, n) of each task's part, a bounded number of words at once."""
    number: dict[bytes, int] = {}
    n = np.zeros(0, dtype=np.int64)

    def out():
        key = _hashes(number).view(np.int64)
        for k in range(0, len(key), _BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + _BATCH]), pa.array(n[k : k + _BATCH])], names=["word", "n"])

    for whole in batches:
        for b in slices(whole):
            w, _ = _numbers(b.column("text").to_pylist(), number)
            more = np.bincount(w, minlength=len(number))
            more[: len(n)] += n
            n = more
            if len(number) >= _FLUSH:
                yield from out()
                number.clear()
                n = np.zeros(0, dtype=np.int64)
    yield from out()


@dataclass
class MatchedModels:
    """Two corpora, their tokens, and how many different words they have together."""

    target: DataFrame
    background: DataFrame
    text_col: str
    tokens: tuple[int, int]
    words: int
    backoff: float = BACKOFF

    def losses(self, word: np.ndarray, context: np.ndarray, two: np.ndarray) -> np.ndarray:
        """-log P of each token, tokens x 2, from the counts of words, contexts and bigrams, tokens x 2 each."""
        p = (word + 1) / (np.array(self.tokens) + self.words + 2)
        return -np.log((two + self.backoff * p) / (context + self.backoff))


def learn(target: DataFrame, background: DataFrame, text_col: str = "text", backoff: float = BACKOFF) -> MatchedModels:
    t, b = (d.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_count_words, "word long, n long") for d in (target, background))
    zero = F.lit(0).cast("long")
    seen = t.select("word", F.col("n").alias("t"), zero.alias("b")).union(b.select("word", zero.alias("t"), F.col("n").alias("b"))).groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    r = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), zero).alias("t"), F.coalesce(F.sum("b"), zero).alias("b")).collect()[0]
    return MatchedModels(target, background, text_col, (r["t"], r["b"]), r["n"], backoff)


def spans_of(chunks: int) -> int:
    """Ranges of keys: as many as chunks up to SQUARE ** 2 of them, then with the square root, so that rows sent grow with the power 1.5 and a range with 0.5."""
    return min(chunks, SQUARE * math.isqrt(chunks) + SQUARE)


def score_documents(docs: DataFrame, models: MatchedModels, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_tokens, loss_target, loss_background, score)."""
    kind, same = docs.schema[id_col].dataType.simpleString(), docs is models.background and text_col == models.text_col
    few = pair(docs, id_col, text_col)
    size = few.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0][0]
    chunks = int(size // chunk_bytes) + 1
    spans = spans_of(chunks)
    few = few.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long").alias("chunk"), "doc_id", "text")
    parts = max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = few.repartition(parts, "chunk").sortWithinPartitions("chunk")
    sent = dealt.mapInArrow(_count(0, spans, chunk_bytes), _SENT)
    for side, corpus in ((_TARGET, models.target), *(() if same else ((_BACKGROUND, models.background),))):
        sent = sent.union(corpus.select(F.col(models.text_col).cast("binary").alias("text")).mapInArrow(_count(side, spans, chunk_bytes), _SENT))
    sums = sent.repartition(max(spans, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "span").sortWithinPartitions("span").mapInArrow(_sum(same), "chunk long, at binary, tn binary, bn binary, tx binary, bx binary")
    few_models = MatchedModels(None, None, models.text_col, models.tokens, models.words, models.backoff)

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        k = Keys(texts.column("text").to_pylist())
        counts = np.zeros((len(k.keys), 4))
        counts[:, 1], counts[:, 3] = k.n, k.x
        for at, *sums in zip(*(found.column(c) for c in ("at", *_SUMS)), strict=True):
            at = np.cumsum(_unpacked(at.as_py()).astype(np.int64))
            for j, v in enumerate(sums):
                counts[at, j] = _unpacked(v.as_py())
        mean, some = np.full((len(k.many), 2), np.nan), k.many > 0
        if some.any():
            loss = few_models.losses(counts[k.word, :2], counts[k.context, 2:], counts[k.pair, :2])
            mean[some] = np.add.reduceat(loss, (np.cumsum(k.many) - k.many)[some], axis=0) / k.many[some][:, None]
        return pa.table([texts.column("doc_id"), pa.array(k.many), *(pa.array(v, pa.float64(), mask=~some) for v in (mean[:, 0], mean[:, 1], mean[:, 0] - mean[:, 1]))], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return dealt.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double").withColumnRenamed("doc_id", id_col)
