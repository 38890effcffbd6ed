"""Best-fit packing of tokenised documents into sequences of bounded length, by linear grouping.

A document is its token ids and an end id. Only longer ones than a sequence are cut: into pieces as long as a sequence, but for the first, which
is what is left. What has to be packed is then one size for each document, so the plan needs the number of documents of each size only, at most
`room` numbers, whatever the table's size:

1. sizes above `room // share` are large. In descending order they are dealt into groups of equal cardinality, and each counts as its group's largest (no more
   sizes than groups are groups as they are);
2. configurations of these few sizes are chosen by the cutting-stock linear programme: columns come from a knapsack over `room`, the
   fractional solution is rounded down, then up where the demand allows it;
3. the documents themselves take the places of their groups, from the largest on, which frees the room that rounding up took;
4. the large ones that rounding left, then the small ones, in descending order, go where they fit best.

Alike sequences are one entry of the plan with a multiplicity, and steps 3 and 4 work on entries. A few numbers of groups and shares are tried; the plan
with the fewest sequences counts.

Where a document goes follows from its place among those of its size: tasks number their own documents by size while they tokenise, and
(task, size) counts, summed over tasks, turn these into places among all. So no text and no ids are sorted or sent, and a size that a third of the
documents share is split like any other. The plan (tens of thousands of entries at most) is the only thing that is broadcast.

Defined results: null and empty texts are the end id alone; repeated rows and null ids are packed each; an empty table gives an empty
result; a text of any length is whole, in pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corelode.llm.common import durable, pair, slices

ROOM, END = 1024, 2
GROUPS, SHARES = (32, 96), (2, 3, 8)
#: Different units that a worker remembers, units that are encoded in a row, and bytes of text that are split at once.
MOST_UNITS, _TOGETHER, _SLICE = 2_000_000, 20_000, 8 << 20
_PLAIN = re.compile(r"[ \t\n\r][^ \t\n\r]")
#: Texts with any other blank, or what some take for one, are cut before a plain blank after something that surely isn't one.
_RARE = re.compile("[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_SAFE = re.compile("(?<=[^\\s\u180e\u200b\ufeff])(?=[ \t\n\r])")
_PLACES = 40


@dataclass
class Alike:
    """`many` sequences with the same content: (size, how often) in order; `free` is left."""

    free: int
    many: int
    content: tuple[tuple[int, int], ...] = ()

    def with_(self, size: int, times: int, many: int) -> Alike:
        same = self.content and self.content[-1][0] == size
        last = (size, times + self.content[-1][1]) if same else (size, times)
        return Alike(self.free - size * times, many, (*(self.content[:-1] if same else self.content), last))


def _knapsack(sizes: list[int], worth: np.ndarray, most: list[int], room: int) -> tuple[float, np.ndarray]:
    """The worthiest configuration: how often each size stands in it."""
    best, taken = np.zeros(room + 1), np.zeros((len(sizes), room + 1), dtype=np.int64)
    for g, size in enumerate(sizes):
        before = best
        if worth[g] > 1e-12:
            best = before.copy()
            for k in range(1, min(room // size, most[g]) + 1):
                more = before[: room + 1 - k * size] + k * worth[g]
                better = more > best[k * size :] + 1e-12
                best[k * size :][better] = more[better]
                taken[g, k * size :][better] = k
    at, chosen = int(best.argmax()), np.zeros(len(sizes), dtype=np.int64)
    value = float(best[at])
    for g in reversed(range(len(sizes))):
        chosen[g] = taken[g, at]
        at -= sizes[g] * int(chosen[g])
    return value, chosen


def configurations(sizes: list[int], demand: list[int], room: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the sizes and how often each is used, in whole numbers that demand no more than there is, from the linear programme's optimum."""
    n, need = len(sizes), np.array(demand, dtype=float)
    basis = np.diag([float(min(room // s, d)) for s, d in zip(sizes, demand, strict=True)])
    for _ in range(30 * n):
        worth = np.linalg.solve(basis.T, np.ones(n))
        value, column = _knapsack(sizes, worth, demand, room)
        if value <= 1 + 1e-7:
            break
        used, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    solved = np.linalg.solve(basis, need)
    used = np.maximum(np.floor(solved + 1e-6), 0).astype(np.int64)
    left = np.array(demand) - basis.astype(np.int64) @ used
    for j in np.argsort(used - solved, kind="stable"):  # once more where the demand still has it
        if (basis[:, j] <= left).all():
            used[j] += 1
            left -= basis[:, j].astype(np.int64)
    return [(basis[:, j].astype(np.int64), int(u)) for j, u in enumerate(used) if u > 0]


def _take(group: list[list[int]], many: int) -> list[tuple[int, int]]:
    """(size, how many) of the next documents of a group; fewer if it ends."""
    out = []
    while many and group:
        size, there = group[0]
        k = min(there, many)
        out.append((size, k))
        many -= k
        group[0][1] -= k
        if not group[0][1]:
            group.pop(0)
    return out


def _filled(columns: list[list[tuple[int, int]]], many: int, room: int) -> Iterator[Alike]:
    """Sequences whose places are taken from the columns, alike ones together. A column that ends early leaves its place free."""
    columns = [[list(x) for x in c] for c in columns]
    while many:
        k = min([many, *(c[0][1] for c in columns if c)])
        now = Alike(room, k)
        for size in sorted((c[0][0] for c in columns if c), reverse=True):
            now = now.with_(size, 1, k)
        yield now
        many -= k
        for c in columns:
            if c:
                c[0][1] -= k
                if not c[0][1]:
                    c.pop(0)


class Shelf:
    """Open sequences by what is free in them."""

    def __init__(self, room: int):
        self.room, self.by_free = room, [[] for _ in range(room + 1)]

    def put(self, a: Alike) -> None:
        if a.many:
            self.by_free[a.free].append(a)

    def best_fit(self, size: int, many: int) -> None:
        """Each of `many` documents goes into the sequence with the least room that holds it, else into a new one."""
        free = size
        while many:
            while free <= self.room and not self.by_free[free]:
                free += 1
            new = free > self.room
            a = Alike(self.room, -(-many // (self.room // size))) if new else self.by_free[free].pop()
            each = a.free // size
            whole, rest = min(a.many, many // each), 0
            if whole < a.many:
                rest = many - whole * each
            self.put(a.with_(size, each, whole))
            if rest:
                self.put(a.with_(size, rest, 1))
            if not new:
                self.put(Alike(a.free, a.many - whole - bool(rest), a.content))
            many -= whole * each + rest

    def __iter__(self) -> Iterator[Alike]:
        return (a for each in self.by_free for a in each)


def grouped(counts: np.ndarray, room: int, groups: int, share: int) -> list[Alike]:
    """A plan for counts[size] documents of each size."""
    large = [[s, int(counts[s])] for s in range(room, room // share, -1) if counts[s]]
    each = -(-sum(n for _, n in large) // groups) if large else 0
    dealt: list[list[list[int]]] = [[list(x)] for x in large] if len(large) <= groups else []
    left = [] if dealt else [list(x) for x in large]
    while left:
        group = [list(x) for x in _take(left, each)]
        if dealt and dealt[-1][0][0] == group[0][0]:
            dealt[-1] += group
        else:
            dealt.append(group)
    shelf = Shelf(room)
    if dealt:
        sizes, demand = [g[0][0] for g in dealt], [sum(n for _, n in g) for g in dealt]
        for column, many in configurations(sizes, demand, room):
            places = [_take(dealt[g], many) for g in np.repeat(np.arange(len(sizes)), column).tolist()]
            for a in _filled(places, many, room):
                shelf.put(a)
    for size, n in sorted((x for g in dealt for x in g), reverse=True):
        shelf.best_fit(size, n)
    for size in range(room // share, 0, -1):
        if counts[size]:
            shelf.best_fit(size, int(counts[size]))
    return [a for a in shelf if a.content]


def plan(counts: np.ndarray, room: int = ROOM, groups: tuple[int, ...] = GROUPS, shares: tuple[int, ...] = SHARES) -> list[Alike]:
    """The plan with the fewest sequences of those tried, for counts[size] documents of each size from 1 to `room`."""
    few, best = np.array(counts), None
    few[room] = 0
    least = -(-int((np.arange(room + 1) * few).sum()) // room)
    for share in shares:
        for g in groups:
            got = grouped(few, room, g, share)
            if best is None or sum(a.many for a in got) < sum(a.many for a in best):
                best = got
            if sum(a.many for a in best) == least:
                break
    return [Alike(0, int(counts[room]), ((room, 1),)), *best] if counts[room] else best


def places(alike: list[Alike], room: int = ROOM) -> dict[str, np.ndarray]:
    """The plan as a table by (size, place among the documents of that size): times in a sequence, first sequence, offset."""
    seen, rows, first = np.zeros(room + 1, dtype=np.int64), [], 0
    for a in alike:
        at = 0
        for size, times in a.content:
            rows.append(((size << _PLACES) + int(seen[size]), times, first, at))
            seen[size] += a.many * times
            at += size * times
        first += a.many
    rows.sort()
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(("key", "times", "first", "offset"))}


class Encoder:
    """Ids of texts by the tokenizer, which gets each different unit once. A unit is a run of blanks and what follows up to the next: no token of the
    byte-level pre-tokenizer has a blank after anything else, so a text's ids are those of its units in a row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread's work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        first = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        #: Ids of tokens that begin with a blank, in the byte-level spelling.
        self.blank = np.array([t[:1] in ("\u0120", "\u010a", "\u0109", "\u010d") for t in first])
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, units: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def _learn(self, fresh: list[str]) -> None:
        """Units of one blank and a word are encoded in a row: each has one token that begins with a blank, its first."""
        odd = [u for u in fresh if not _PLAIN.match(u)]
        plain = [u for u in fresh if _PLAIN.match(u)] if odd else fresh
        for k in range(0, len(plain), _TOGETHER):
            some = plain[k : k + _TOGETHER]
            row = "".join(some)
            ids = self._encoded([row])[0]
            start = np.flatnonzero(self.blank[ids])
            if len(start) == len(some) and not _RARE.search(row):
                self._remember(some, ids, np.diff(np.append(start, len(ids))))
            else:
                odd += some
        if odd:
            got = self._encoded(odd)
            self._remember(odd, np.concatenate(got), np.array([len(x) for x in got], dtype=np.int64))

    def _split(self, texts: pa.Array) -> pa.Array:
        """A mark before each first blank of a run; where no two blanks meet, that is each blank."""
        if pc.any(pc.match_substring_regex(texts, "[ \\n\\t\\r][ \\n\\t\\r]|[\\t\\r]")).as_py():
            marked = pc.replace_substring_regex(texts, "([^ \\t\\n\\r])([ \\t\\n\\r])", "\\1\x00\\2")
        else:
            marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
        return pc.split_pattern(marked, "\x00")

    def _joined(self, units: pa.Array) -> list[np.ndarray]:
        """The ids of lists of units."""
        at = units.flatten().dictionary_encode()
        different = at.dictionary.to_pylist()
        known = list(map(self.number.get, different))
        fresh = [u for u, n in zip(different, known, strict=True) if n is None]
        self._learn(fresh)
        learnt = map(self.number.__getitem__, fresh)
        n = np.array([next(learnt) if n is None else n for n in known], dtype=np.int64)[at.indices.to_numpy()]
        size, start = self.size[n], (np.cumsum(self.size) - self.size)[n]
        edges = np.r_[0, np.cumsum(size)]
        flat = self.ids[np.repeat(start - edges[:-1], size) + np.arange(edges[-1])]
        return np.split(flat, edges[np.cumsum(units.value_lengths().to_numpy(), dtype=np.int64)][:-1]) if len(units) else []

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (strings without nulls)."""
        if len(self.number) > MOST_UNITS or len(self.ids) > 8 * MOST_UNITS:
            self._clear()
        rare = pc.match_substring_regex(texts, _RARE.pattern)
        usual = iter(self._joined(self._split(texts.filter(pc.invert(rare)))))
        others = iter(self._joined(pa.array([_SAFE.split(t) for t in texts.filter(rare).to_pylist()], pa.list_(pa.string()))))
        return [next(others if r else usual) for r in rare.to_pylist()]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """A worker's own, so that what it has learnt serves its next task."""
    return Encoder(path)


def _strings(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, b"")
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _pieces(path: str, room: int, end: int, with_ids: bool):
    """(doc_id, piece, start, length, ids_crc32, task, place) of each document's pieces; `place` counts a task's pieces of one length."""

    def run(batches):
        encoder, seen, task = _encoder(path), np.zeros(room + 1, dtype=np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for b in slices(whole, most=_SLICE):
                rows, tokens = [], []
                ids = encoder.encode(_strings(b.column("text")))
                for i, x in enumerate(ids):
                    x = np.append(x, np.uint32(end)).astype("<u4")
                    first = (len(x) - 1) % room + 1
                    for k, stop in enumerate(range(first, len(x) + 1, room)):
                        start = max(0, stop - room) if k else 0
                        rows.append((i, k, start, stop - start, zlib.crc32(x[start:stop].tobytes()), int(seen[stop - start])))
                        seen[stop - start] += 1
                        if with_ids:
                            tokens.append(x[start:stop].astype(np.int32))
                cols = list(zip(*rows, strict=True))
                more = [pa.array(tokens, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array([task] * len(rows), pa.int32()), pa.array(cols[5], pa.int64()), *more,
                ], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", *["ids"] * with_ids])

    return run


def _put(shared):
    """Turns `place` among all pieces of that length into sequence_id and offset."""

    def run(batches):
        p = shared.value
        for b in batches:
            length, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place"))
            at = np.searchsorted(p["key"], (length << _PLACES) + place, "right") - 1
            nth = place - (p["key"][at] & ((1 << _PLACES) - 1))
            sequence, offset = p["first"][at] + nth // p["times"][at], p["offset"][at] + nth % p["times"][at] * length
            keep = [n for n in b.schema.names if n != "place"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), and `ids` if asked for: a row for each piece. Sequences are numbered from 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    made = pair(docs, id_col, text_col).mapInArrow(_pieces(tokenizer_path, room, end, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long{ids}")
    made = durable(made)
    per = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = per.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = np.zeros(room + 1, dtype=np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length, `room` at most
        counts[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, room), room))
    rows = made.join(before, ["length", "task"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    rows = rows.select(*names, (F.col("before") + F.col("place")).alias("place"))
    put = rows.mapInArrow(_put(shared), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long")
    return put.withColumnRenamed("doc_id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, parts) of pieces packed with their ids: the tokens in order, and (id, piece, offset, length) of what they are made of. A
    group is one sequence, so its size is bounded."""
    part = F.struct("offset", F.col(id_col).alias("id"), "piece", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("parts"))
