r"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Texts become lower-case words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z). The automaton holds every run of
consecutive item words; a document's words are streamed through it, which gives at each word the length of the longest
run that ends there. Runs of `window` words or more, and whole items that are shorter, are hits.

Before the walk, words become numbers (unknown: none) and pairs of neighbours are looked up in a bitmap of item pairs. A hit
of two words or more lies in a stretch of known pairs, and no run crosses an unknown pair, so only stretches that are
long enough are walked, from the root: the result is the same.

The items go to the workers in blocks of at most `block_words` words, one pass over the documents for each block, so what is
broadcast is bounded; hits of earlier blocks travel along with the row.

Defined results: null and empty texts have no words and no hits; null, empty and repeated items are no windows, or count
by id; an item whose id is null counts for hits and has no name; null or repeated doc_ids are kept, each row is judged alone; an
empty table on either side is fine; extra columns are ignored by find_leaks() and kept by remove_leaks().
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corelode.llm.common import ALNUM, durable, pair, slices

WINDOW = 10
BLOCK_WORDS = 250_000
PAIR_BITS = 22
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Of word numbers. State 0 is the root; `length` is that of a state's longest run, `link` its longest proper suffix
    of another state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[str | None, list[int]]] = []
        self.shortest = window

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def add(self, name: str | None, text: bytes | None) -> int:
        words = [self.numbers.setdefault(w, len(self.numbers)) for w in (text or b"").translate(ALNUM).split()]
        if words:
            self.items.append((name, words))
            self.shortest = min(self.shortest, len(words))
            last = 0
            for w in words:
                last = self._extend(last, w)
        return len(words)

    def finish(self) -> None:
        """Which items hold the window that ends in a state, which whole short items end in it, and the pair bitmap."""
        size = len(self.length)
        #: The state of the last `window` words of a run.
        self.top = list(range(size))
        for s in sorted(range(1, size), key=self.length.__getitem__):
            if self.length[self.link[s]] >= self.window:
                self.top[s] = self.top[self.link[s]]
        self.holds: dict[int, set[str | None]] = {}
        whole: dict[int, set[tuple[int, str | None]]] = {}
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        for name, words in self.items:
            s = 0
            for w in words:
                s = self.next[s][w]
                if self.length[s] >= self.window:
                    self.holds.setdefault(self.top[s], set()).add(name)
            if len(words) < self.window:
                whole.setdefault(s, set()).add((len(words), name))
            if len(words) > 1:
                n = np.array(words, dtype=np.int64)
                self.pairs[self.cell(n[:-1], n[1:])] = True
        #: Of a state and all its suffixes.
        self.whole: dict[int, list[tuple[int, str | None]]] = {}
        for s in sorted(range(1, size), key=self.length.__getitem__):
            if found := sorted([*whole.get(s, ()), *self.whole.get(self.link[s], ())], key=str):
                self.whole[s] = found
        del self.items

    @staticmethod
    def cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 2654435761 + b * 40503) >> 3) & ((1 << PAIR_BITS) - 1)

    def walk(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest run that ends there)."""
        s, n = 0, 0
        for i, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s = self.next[s][w]
                n += 1
            yield i, s, n

    def stretches(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """[start, end) of what has to be walked."""
        if self.shortest < 2:
            good, more = numbers >= 0, 0
        else:
            a, b = numbers[:-1], numbers[1:]
            good, more = (a >= 0) & (b >= 0), 1
            good[good] = self.pairs[self.cell(a[good], b[good])]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start + more >= self.shortest:
                yield start, end + more

    def hits(self, numbers: np.ndarray) -> tuple[list[list[int]], set[str | None]]:
        """Merged spans [start, end) of hit words and the items with occurring windows. -1 separates."""
        spans: list[list[int]] = []
        names: set[str | None] = set()
        for start, end in self.stretches(numbers):
            for i, s, n in self.walk(numbers[start:end].tolist()):
                reach = 0
                if n >= self.window:
                    reach = n
                    names |= self.holds[self.top[s]]
                for k, name in self.whole.get(s, ()):
                    if k <= n:
                        reach = max(reach, k)
                        names.add(name)
                if reach:
                    add_span(spans, start + i + 1 - reach, start + i + 1)
        return spans, names


def add_span(spans: list[list[int]], start: int, end: int) -> None:
    """Appends a span whose end isn't before the last one's, joining those that meet."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def merged(*lists: Iterable[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(x for xs in lists for x in xs):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of the items, in blocks that hold an item more at most than `block_words` words; rows stream to the driver."""
    held, words = SuffixAutomaton(window), 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).dropDuplicates()
    for r in rows.toLocalIterator():
        words += held.add(r["i"], r["t"])
        if words >= block_words:
            held.finish()
            yield held
            held, words = SuffixAutomaton(window), 0
    held.finish()
    yield held


def _pass(shared, drop: tuple[str, ...] = (), after=None):
    """Adds a block's hits to n_words, spans and items; `after` then works on each batch, in the same worker."""

    def run(batches):
        a: SuffixAutomaton = shared.value
        get = a.numbers.get
        for whole in batches:
            for b in slices(whole):
                words = [(t or b"").translate(ALNUM).split() for t in b.column("text").to_pylist()]
                many = [len(w) for w in words]
                numbers = np.full(sum(many) + len(many), -1, dtype=np.int64)
                at, starts = 0, []
                for w in words:
                    starts.append(at)
                    numbers[at : at + len(w)] = [get(x, -1) for x in w]
                    at += len(w) + 1
                # Stretches are found in all of the slice at once; few documents have any.
                touched = sorted({int(np.searchsorted(starts, s, "right")) - 1 for s, _ in a.stretches(numbers)})
                spans, names = b.column("spans").to_pylist(), b.column("items").to_pylist()
                for d in touched:
                    new, found = a.hits(numbers[starts[d] : starts[d] + many[d]])
                    old = [list(x) for x in zip(spans[d][::2], spans[d][1::2], strict=True)]
                    spans[d] = [x for s in merged(old, new) for x in s]
                    names[d] = sorted({*names[d], *(x for x in found if x is not None)})
                kept = [c for c in b.schema.names if c not in ("spans", "items", "n_words", *drop)]
                out = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(many, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=[*kept, "n_words", "spans", "items"])
                yield after(out, a) if after else out

    return run


def _swept(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, block_words: int, drop: tuple[str, ...], after=None, schema=None) -> tuple[DataFrame, int]:
    """rows (with a binary `text`) plus n_words, spans and items, by a pass for each block of items, and the number of blocks; the last pass ends with
    `drop` and with what `after` gives for that number."""
    sc = rows.sparkSession.sparkContext
    rows = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    ready, many = None, 0
    for a in blocks(items, item_id, item_text, window, block_words):
        if ready is not None:
            rows = rows.mapInArrow(_pass(ready), rows.schema)
        ready, many = sc.broadcast(a), many + 1
    return rows.mapInArrow(_pass(ready, drop, after(many) if after else None), schema or T.StructType([f for f in rows.schema if f.name not in drop])), many


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, spans, items): spans are [start, end, start, end, ...] in words, items the names in order."""
    found, _ = _swept(pair(docs, id_col, text_col), items, item_id, item_text, window, block_words, ("text",))
    spans = F.col("spans")
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items")


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*out, text[last:]])


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, count_col: str | None = "n_chars") -> DataFrame:
    """docs without the spans of benchmark words; where those are over `max_coverage` of the words, the document goes. All
    columns stay; `count_col`, if there, follows the new text. What is left of a cut is scanned again for all items, since words that a cut brings
    together may form a window, until nothing is found: at once where one block holds the items, else in rounds over the rows that were cut,
    which are kept in the shared checkpoint folder. The result is the same for any size of block."""
    names = docs.columns
    k, n = f"c{names.index(text_col)}", f"c{names.index(count_col)}" if count_col in names else None
    own = [f"c{i}" for i in range(len(names))]

    def cleaner(many: int):
        def clean(b, a):
            cols = {c: b.column(c) for c in own}
            spans = b.column("spans").to_pylist()
            hit = b.column("hit").to_pylist()
            words = [w if was is None else was for w, was in zip(b.column("n_words").to_pylist(), b.column("words").to_pylist(), strict=True)]
            again = [bool(s) and many > 1 for s in spans]
            if any(spans):
                texts, size = b.column(k).to_pylist(), b.column(n).to_pylist() if n else None
                for i, s in enumerate(spans):
                    if s:
                        rest, s = texts[i].encode(), list(s)
                        while s:
                            rest = cut(rest, s)
                            hit[i] += sum(s[1::2]) - sum(s[::2])
                            if many > 1:
                                break
                            found, _ = a.hits(np.array([a.numbers.get(w, -1) for w in rest.translate(ALNUM).split()], dtype=np.int64))
                            s = [x for span in found for x in span]
                        texts[i] = rest.decode()
                        if n:
                            size[i] = len(texts[i])
                cols[k] = pa.array(texts, pa.string())
                if n:
                    cols[n] = pa.array(size, b.schema.field(n).type)
            return pa.RecordBatch.from_arrays([*cols.values(), pa.array(hit, pa.int64()), pa.array(words, pa.int64()), pa.array(again, pa.bool_())], names=[*own, "hit", "words", "again"])

        return clean

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    todo = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), zero.alias("hit"), none.alias("words"))
    schema = T.StructType([*todo.schema.fields[: len(own)], T.StructField("hit", T.LongType()), T.StructField("words", T.LongType()), T.StructField("again", T.BooleanType())])
    done = None
    while True:
        swept, many = _swept(todo.withColumn("text", F.col(k).cast("binary")), items, item_id, item_text, window, block_words, ("text",), cleaner, schema)
        ready = swept.where("not again")
        done = ready if done is None else done.union(ready)
        if many == 1:
            break
        todo = durable(swept.where("again")).drop("again")
        if todo.isEmpty():
            break
    return done.where((F.col("hit") == 0) | (F.col("hit") <= F.col("words") * max_coverage)).select(*own).toDF(*names)
