r"""SimHash near-duplicates with bit-sliced comparison.

A text's words (``[^\x20\x09-\x0D]+``, A-Z lower-cased) form shingles of `size` words, repeats included; fewer words form one.
A fingerprint bit is set if it is in over half of the shingles' XXH64 (seed 42); a text without words has fingerprint 0.
Fingerprints within `radius` bits are linked, documents of one fingerprint or of linked ones form a component.

Equal fingerprints are grouped first, so copies cost one row. To find links, the 64 bits are cut into radius + 2 blocks: two
fingerprints within the radius agree in two blocks at least, so each is filed under every pair of its blocks, and files are
compared. Within a file the bits are stored as planes (lane = fingerprint) and many distances are counted at once by
carry-save adders; blocks of lanes are abandoned once all of them exceed the radius. Only the links that join a file's
lanes to their local least one go on, so a file of n gives under n links.

Files over `split_rows` rows are filed again by further blocks of their remaining bits, of which one must agree. What is crowded even
then (a dense group) is dealt into chunks of `split_rows`, each pair of chunks to a task of its own.

Defined results: null text counts as no words; null ids are kept and get their component's least id (null if it has none);
repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corelode.llm.common import durable, pair, slices
from corelode.llm.components import least_member

SEED = 42
SIZE = 3
RADIUS = 3
SPLIT_ROWS = 20_000
_CHUNK = 1 << 16
_SHORT = 48


def shingle_hashes(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """XXH64 of each shingle in order; none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], dtype="<u8")
    line, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w) + 1
        ends.append(at - 1)
    starts = [0, *(e + 1 for e in ends[:-size])]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], dtype="<u8")


def majority(h: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes, the lowest first; 0 of no hashes."""
    total, n = np.zeros(64, dtype=np.int64), len(h)
    for k in range(0, n, _CHUNK):
        total += np.unpackbits(h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * total > n, bitorder="little").tobytes()


def fingerprint(text: bytes | None, size: int = SIZE) -> int:
    return int.from_bytes(majority(shingle_hashes(text, size)), "little")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits for each hash; k = 0 leaves them."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                found = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], dtype=np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return pair(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long").withColumnRenamed("doc_id", id_col)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row j holds bit j of every fingerprint (a row of one or more words), 64 lanes a word."""
    padded = np.zeros((-(-len(prints) // 64) * 64, prints.shape[1]), dtype="<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


class Counter:
    """Carry-save counters, per lane and query, that begin so far below their limit that the carry out of the last bit tells
    the lanes over the radius; those die."""

    def __init__(self, alive: np.ndarray, radius: int):
        many = (radius + 1).bit_length()
        begin = (1 << many) - 1 - radius
        self.alive = alive
        self.bits = [np.full_like(alive, ~np.uint64(0) if begin >> k & 1 else np.uint64(0)) for k in range(many)]

    def add(self, differ: np.ndarray) -> None:
        carry = differ & self.alive
        for b in self.bits:
            over = b & carry
            b ^= carry
            carry = over
        self.alive &= ~carry


def within(planes: np.ndarray, other, alive: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """For each query the lanes of `alive` (queries x words) at most `radius` bits away; other(j, words) is what plane j is held
    against. Blocks of lanes none of which is left for any query are abandoned every `step` planes."""
    at, counter = np.arange(alive.shape[1]), Counter(alive.copy(), radius)
    for j in range(len(planes)):
        counter.add(planes[j, at] ^ other(j, at))
        if j % step == step - 1:
            left = counter.alive.any(axis=0)
            if not left.any():
                return np.zeros_like(alive)
            if 2 * left.sum() < len(at):
                at = at[left]
                counter.alive, counter.bits = counter.alive[:, left], [b[:, left] for b in counter.bits]
    out = np.zeros_like(alive)
    out[:, at] = counter.alive
    return out


def short_links(prints: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in one run within the radius: for each offset d all pairs (i, i + d) are compared at once."""
    found = []
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[start, len(run)])
    per_row, at = np.repeat(size, size), np.arange(len(prints))
    for d in range(1, int(size.max())):
        at = at[per_row[at] > d]  # whole runs stay or go, so offsets hold
        same = run[at[:-d]] == run[at[d:]]
        p, q = planes_of(prints[at[:-d]]), planes_of(prints[at[d:]])
        alive = np.zeros(p.shape[1] * 64, dtype=np.uint8)
        alive[: len(same)] = same
        met = lanes_of(within(p, lambda j, k, q=q: q[j, k], np.packbits(alive, bitorder="little").view("<u8")[None, :], radius)[0])
        found.append((at[:-d][met], at[d:][met]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def run_labels(prints: np.ndarray, radius: int, many: int = 32) -> np.ndarray:
    """For each position of a run the least one that links within the radius reach. `many` queries at once stand against the lanes
    that weren't queries yet and aren't in the query's own component: a dense group costs little once its lanes are joined."""
    n, planes = len(prints), planes_of(prints)
    label, done = np.arange(n), np.zeros(n, dtype=bool)
    while True:
        rest = np.flatnonzero(~done)
        if not rest.size or (label[rest] == label[rest[0]]).all():
            return label
        queries = rest[np.argsort(label[rest], kind="stable")[:many]]
        done[queries[label[queries] == label[queries[0]]]] = True  # lanes of one component don't ask each other
        open_ = ~done[None, :] & (label[None, :] != label[queries][:, None])
        alive = np.packbits(np.pad(open_, ((0, 0), (0, -n % 64))), axis=1, bitorder="little").view("<u8")
        done[queries] = True
        bits = np.unpackbits(np.ascontiguousarray(prints[queries]).view(np.uint8), axis=1, bitorder="little")
        fill = np.where(bits.T[:, :, None] == 1, ~np.uint64(0), np.uint64(0))
        near = within(planes, lambda j, k, fill=fill: fill[j], alive, radius)
        row, lane = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
        if row.size:
            label = least_labels(n, label[queries[row]], label[lane])[label]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the least one that links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


def file_links(prints: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger position's fingerprint, least fingerprint of its local component) over sorted runs."""
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[start, len(run)])
    per_row = np.repeat(size, size)
    out = []
    some = np.flatnonzero((per_row > 1) & (per_row <= _SHORT))
    if some.size:
        a, b = short_links(prints[some], run[some], radius)
        label = least_labels(len(some), a, b)
        moved = np.flatnonzero(label != np.arange(len(some)))
        out.append((prints[some[moved]], prints[some[label[moved]]]))
    for s, n in zip(start[size > _SHORT].tolist(), size[size > _SHORT].tolist(), strict=True):
        label = run_labels(prints[s : s + n], radius)
        moved = np.flatnonzero(label != np.arange(n))
        out.append((prints[s + moved], prints[s + label[moved]]))
    if not out:
        return prints[:0], prints[:0]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _words_of(column) -> np.ndarray:
    """Fingerprints of a long or binary column, as rows of words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype("<u8").reshape(-1, 1)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u8").reshape(len(column), -1)


def _as_column(prints: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_integer(kind):
        return pa.array(prints[:, 0].astype(np.int64))
    return pa.array([x.tobytes() for x in prints], pa.binary())


def _compare(radius: int, most: int = 1 << 19):
    """Reads rows sorted by file; runs may span batches."""

    def links(t, k, f, kind):
        run = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        a, b = file_links(f, run, radius)
        return pa.RecordBatch.from_arrays([_as_column(a, kind), _as_column(b, kind)], names=["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], []]
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("fp").type
            cols = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k")), _words_of(batch.column("fp"))]
            for h, c in zip(held, cols, strict=True):
                h.append(c)
            rows += len(cols[0])
            if rows >= most:
                t, k, f = (np.concatenate(h) for h in held)
                same = (t == t[-1]) & (k == k[-1])
                cut = len(t) - int(same[::-1].argmin()) if not same.all() else 0
                if cut:
                    yield links(t[:cut], k[:cut], f[:cut], kind)
                held, rows = [[t[cut:]], [k[cut:]], [f[cut:]]], len(t) - cut
        if rows:
            yield links(*(np.concatenate(h) for h in held), kind)

    return run


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of `parts` blocks."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _dealt(rows: DataFrame) -> DataFrame:
    """Files sorted, over as many tasks as the session asks for: they are small in bytes but not in work, so they aren't to be coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "k").sortWithinPartitions("t", "k", "fp")


def _in_chunks(rows: DataFrame, split_rows: int) -> DataFrame:
    """rows (fp, t, k) in which each file over `split_rows` rows is cut into chunks by a hash of fp, and each pair of chunks is a file."""
    crowded = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > split_rows)
    crowded = crowded.select("t", "k", F.ceil(F.col("n") / split_rows).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    other = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    rows = rows.join(crowded, ["t", "k"], "left").select("fp", "t", "k", own.alias("own"), F.explode(other).alias("other"))
    return rows.select("fp", "t", F.when(F.col("own").isNull(), F.col("k")).otherwise(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other"))).alias("k"))


def linked(prints: DataFrame, radius: int = RADIUS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(a, b): links that join the distinct fingerprints of (fp) as all pairs within the radius would."""
    fp, blocks = F.col("fp"), _cuts(64, radius + 2)
    files = []
    for t, ((low1, w1), (low2, w2)) in enumerate(combinations(blocks, 2)):
        files.append(F.struct(F.lit(t).alias("t"), F.shiftleft(_bits(fp, low1, w1), w2).bitwiseOR(_bits(fp, low2, w2)).alias("k")))
    rows = prints.select("fp", F.explode(F.array(*files)).alias("f")).select("fp", "f.t", "f.k")
    if radius + 2 > 2:
        # A crowded file is filed again: of its other bits, cut into radius + 1 parts, one part must agree.
        crowded = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > split_rows).select("t", "k", F.lit(True).alias("crowded"))
        rows = rows.join(crowded, ["t", "k"], "left")
        again = []
        for t, pair_of in enumerate(combinations(blocks, 2)):
            rest = [b for b in range(64) if not any(low <= b < low + w for low, w in pair_of)]
            for p, (low, w) in enumerate(_cuts(len(rest), radius + 1)):
                mask = sum(1 << b for b in rest[low : low + w])
                signed = mask - (1 << 64) if mask >> 63 else mask
                again.append(F.when(F.col("t") == t, F.struct(F.lit(1000 * (t + 1) + p).alias("t"), F.xxhash64("k", fp.bitwiseAND(F.lit(signed))).alias("k"))))
        finer = F.filter(F.array(*again), lambda x: x.isNotNull())
        rows = rows.select("fp", F.explode(F.when(F.col("crowded"), finer).otherwise(F.array(F.struct(F.col("t"), F.col("k"))))).alias("f")).select("fp", "f.t", "f.k")
        rows = _in_chunks(rows, split_rows)
    return _dealt(rows).mapInArrow(_compare(radius), "a long, b long")


def grouped(prints: DataFrame, id_col: str, radius: int = RADIUS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(fp, component_id) for each fingerprint of (id, fp)."""
    least = durable(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    root = least_member(linked(least, radius, split_rows)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    of = least.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return of.join(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, radius: int = RADIUS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) for each row."""
    prints = durable(fingerprints(df, id_col, text_col, size))
    return prints.join(grouped(prints, id_col, radius, split_rows), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies: five-word shingles, similarity 0.8 or more -------------------------------------------------------------

WIDTH = 4
SIMILARITY = 0.8
#: Of 256 bits, for candidates only. Shingle sets of Jaccard similarity s (cosine c = 2s / (1 + s)) differ in arccos(c) / pi of all bits
#: on average: 39 at 0.8, with a deviation of 5.7; 68 at 0.5.
WIDE_RADIUS = 72
COPY_SIZE = 5
ANCHORS = 8
#: Members of a candidate component that one task compares with as many others at once.
BLOCK_ROWS = 4096
SALTS = 64


def shingle_set(text: bytes | None, size: int = COPY_SIZE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _wide_prints(size: int, many: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole):
                sets = [shingle_set(t, size) for t in b.column("text").to_pylist()]
                keys = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets]
                wide = [b"".join(majority(mixed(h, k)) for k in range(WIDTH)) for h in sets]
                least = [h[:many].astype(np.int64).tolist() if len(h) else [0] for h in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(keys, pa.binary()), pa.array(wide, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "h", "key", "fp", "anchors"])

    return run


def similar_links(sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(member, another one with Jaccard similarity of at least `least`): links that join the sets as all such pairs would.
    Each set in turn is held against all that nothing has reached yet; those it reaches come next."""
    size = np.array([len(s) for s in sets])
    flat, number = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(flat), dtype=bool)
    start = np.cumsum(size) - size
    rest, reached, found = np.arange(len(sets)), [], []
    tokens, own, begin = number, size, start  # of the rest
    while rest.size:
        if reached:
            q = reached.pop()
        else:
            q, gone = rest[0], len(tokens) if len(rest) == 1 else begin[1]
            rest, tokens, own = rest[1:], tokens[gone:], own[1:]
            begin = np.cumsum(own) - own
        if not rest.size:
            break
        mine = number[start[q] : start[q] + size[q]]
        marked[mine] = True
        both = np.add.reduceat(marked[tokens].astype(np.int64), begin)
        marked[mine] = False
        near = both >= least * (size[q] + own - both) - 1e-9
        if near.any():
            found += [(i, q) for i in rest[near].tolist()]
            reached += rest[near].tolist()
            tokens, rest, own = tokens[np.repeat(~near, own)], rest[~near], own[~near]
            begin = np.cumsum(own) - own
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _verify(size: int, least: float):
    """Reads (root, i, j, key, text) sorted by (root, i, j); such files may span batches."""

    def links(keys: dict):
        names = list(keys)
        a, b = similar_links([keys[k] for k in names], least) if len(names) > 1 else ((), ())
        return pa.RecordBatch.from_arrays([pa.array([names[x] for x in a], pa.binary()), pa.array([names[x] for x in b], pa.binary())], names=["a", "b"])

    def run(batches):
        now, held = None, {}
        for whole in batches:
            for b in slices(whole):
                for root, i, j, key, text in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "key", "text")), strict=True):
                    if (root, i, j) != now:
                        if len(held) > 1:
                            yield links(held)
                        now, held = (root, i, j), {}
                    if key not in held and len(found := shingle_set(text, size)):
                        held[key] = found
        if len(held) > 1:
            yield links(held)

    return run


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = COPY_SIZE, radius: int = WIDE_RADIUS, many: int = ANCHORS, split_rows: int = SPLIT_ROWS, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row, that of the least id, of each group of near copies; all columns as they were. Texts are linked if the Jaccard
    similarity of their sets of shingles is `similarity` or more; links join groups; texts without words are one group.

    Texts of equal sets (by a digest of 128 bits) are one row. Candidates: fingerprints of the sets have 256 bits here and are filed
    under the `many` least shingle hashes: two sets with similarity s share none in about (1 - s) ** many of all cases (3 in a million at 0.8).
    Files are compared bit-sliced as above. Verdict: all members of a component of candidates are held against each other by their
    whole sets. Crowded files and large components are dealt out in blocks, each pair of blocks to a file of its own. Of each group the least (id, text hash) stays; of rows with one id and
    text the least by the other columns, in their order."""
    kind, names = docs.schema[id_col].dataType.simpleString(), docs.columns
    keyed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    i, t = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    keyed = keyed.withColumn("h", F.xxhash64(t))
    prints = keyed.select(i.alias("doc_id"), "h", t.cast("binary").alias("text")).mapInArrow(_wide_prints(size, many), f"doc_id {kind}, h long, key binary, fp binary, anchors array<long>")
    groups = durable(prints.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("best"), F.min("fp").alias("fp"), F.min("anchors").alias("anchors")))
    rows = groups.select("fp", F.lit(-1).alias("t"), F.explode("anchors").alias("k"))
    rows = _in_chunks(rows, split_rows)
    links = _dealt(rows).mapInArrow(_compare(radius), "a binary, b binary")
    root = least_member(links).select(F.col("a").alias("fp"), F.col("b").alias("root"))

    near = groups.select("key", "best", "fp").join(root, "fp", "left").select("key", "best", F.coalesce("root", "fp").alias("root"))
    # A component may hold very many: its members meet their number under one of several salts, so not in one task.
    blocks = near.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    blocks = blocks.select("root", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    near = near.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(SALTS)).cast("int")).join(blocks, ["root", "salt"]).select("root", "key", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("own"), "blocks", F.col("best.doc_id").alias("__id"), F.col("best.h").alias("__h"))
    near = near.join(keyed.select(i.alias("id"), "h", t.cast("binary").alias("text")), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
    near = near.select("root", "key", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    near = near.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "text")
    near = near.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    same = least_member(near.mapInArrow(_verify(size, similarity), "a binary, b binary")).select(F.col("a").alias("key"), F.col("b").alias("root"))

    best = groups.select("key", "best").join(same, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
    best = best.select(F.col("best.doc_id").alias("__id"), F.col("best.h").alias("__h"))
    kept = keyed.join(best, i.eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "inner")
    # Of rows with one id and text the least by the other columns, so that each run keeps the same.
    rest = [F.col(f"c{k}") for k, f in enumerate(docs.schema.fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = F.row_number().over(W.partitionBy("__id", "__h").orderBy(*rest))
    return kept.withColumn("__n", first).where("__n = 1").select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)))
