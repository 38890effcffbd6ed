"""SentencePiece encoding and decoding in numpy, for models of either kind.

A text gets a leading blank, blanks become U+2581, and it is cut into words: a run of U+2581 with what follows, and further
wherever a character that is in no longer piece stands. No piece spans such a cut, so words are encoded alone, each different one
once, and equal-length words advance together:

* Unigram models: batched Viterbi. For each end and each piece length, hashes of the substrings (from prefix hashes) probe
  the sorted hashes of the pieces; vectorised maxima of score + best score before store backpointers.
* BPE models: their piece scores are merge ranks, which no sum over a path reproduces. But merging gives each prefix of a word one last
  piece, and a piece can follow another only if merging the two texts together gives back the two. So the same search runs over
  ends, lengths and probes, a path's score being whether all its neighbours may stand together; one path has it at each end, the
  maximum finds it, and its ids are those of the merges. Which pairs may stand together follows from undoing the merges of both,
  and is kept in a table of fixed size.

Words of more than `LONG` characters (unbroken scripts, base64) are encoded one by one in near-linear time instead: the same search with a
dictionary of pieces, or merges from a heap; they are not kept.

Characters that no piece has become their UTF-8 bytes' pieces if the model has these, else unknown.

Defined results: a null text gives null ids and decodes to null; an empty text gives no ids; ids may be null or repeated; an
empty table gives an empty result; other columns are ignored. Decoding drops control pieces and the leading blank.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import slices

BLANK = "▁"
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that are kept with their ids; the whole store is emptied at this size.
_KEPT = 250_000
_CELLS = 1 << 21
_PAIR_BITS = 21
_KEY_BITS = 20
#: Characters from which a word is encoded alone; rounds of merges over a word of n characters cost n * n.
LONG = 256
MODEL_BYTES = 64 << 20


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints for varints, bytes for the rest."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class Pieces:
    """A model file's pieces, with sorted hashes for lookups."""

    def __init__(self, data: bytes, kind: int | None = None):
        self.names: list[str] = []
        scores, types, self.kind = [], [], UNIGRAM
        self.dummy, self.unk = True, 0
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.names.append(f.get(1, b"").decode())
                scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                types.append(f.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only identity normalisation that keeps blanks is supported")
                self.dummy = bool(spec.get(3, 1))
        self.kind = kind or self.kind
        self.types = np.array(types)
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if types[i] == BYTE}
        self.unk = types.index(UNKNOWN)
        usable = [i for i, t in enumerate(types) if t in (NORMAL, USER_DEFINED)]
        special = {BYTE: lambda n: bytes([int(n[3:5], 16)]), CONTROL: lambda n: b"", UNKNOWN: lambda n: b" \xe2\x81\x87 "}
        self.raw = [special.get(t, str.encode)(n) for n, t in zip(self.names, types, strict=True)]
        self.longest = max((len(self.names[i]) for i in usable), default=1)
        self.powers = np.ones(self.longest + 1, dtype=np.uint64)
        for k in range(self.longest):
            self.powers[k + 1 :] *= _BASE
        keys = np.array([self._hash(self.names[i]) for i in usable], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        #: Whether any key has these highest bits: most substrings are no piece, and this tells it without a search.
        self.some = np.zeros(1 << _KEY_BITS, dtype=bool)
        self.some[self.keys >> np.uint64(64 - _KEY_BITS)] = True
        self.ids = np.array(usable, dtype=np.int64)[order]
        self.scores = np.array(scores, dtype=np.float32)
        self.key_scores = self.scores[self.ids]
        self.lengths = np.array([len(self.names[i]) for i in usable], dtype=np.int64)[order]
        self.points = np.zeros((len(usable), self.longest), dtype=np.uint32)
        for row, i in enumerate(self.ids):
            self.points[row, : len(self.names[i])] = [ord(c) for c in self.names[i]]
        joined = {c for i in usable if len(self.names[i]) > 1 for c in self.names[i]}
        if any(BLANK in self.names[i].lstrip(BLANK) for i in usable):
            raise ValueError("a piece has a blank behind another character")
        inner = "".join(re.escape(c) for c in sorted(joined - {BLANK}))
        self.cut = re.compile(f"{BLANK}*[{inner}]+|{BLANK}+|[^{BLANK}]" if inner else f"{BLANK}+|[^{BLANK}]")
        self.least = float(self.scores[usable].min()) if usable else 0.0
        self.ranked = len(np.unique(self.key_scores)) == len(self.key_scores)  # else ranks don't tell which merge comes first
        self.known = {self.names[i]: i for i in usable}
        self.alone = np.zeros(0, dtype=bool)
        self.pair_keys, self.pair_ok = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def _hash(self, s: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in s:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the sorted keys, and whether there."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def _prefixes(self, points: np.ndarray) -> np.ndarray:
        h = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
        for k in range(points.shape[1]):
            h[:, k + 1] = h[:, k] * _BASE + (points[:, k].astype(np.uint64) + np.uint64(1))
        return h

    def _same(self, at: np.ndarray, points: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether substrings really are the pieces that have their hashes."""
        ok = self.lengths[at] == n
        for k in range(int(n.max(initial=0))):
            more = np.flatnonzero(ok & (n > k))
            ok[more] = self.points[at[more], k] == points[row[more], start[more] + k]
        return ok

    def viterbi(self, points: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For words of one length: where the pieces of the best path begin. Of equal paths the longer last piece wins."""
        words, size = points.shape
        best = np.full((words, size + 1), -np.inf, dtype=np.float32)
        best[:, 0] = 0
        back = np.zeros((words, size + 1), dtype=np.int64)
        for end in range(1, size + 1):
            for n in range(min(self.longest, end), 0, -1):
                start = end - n
                at, hit = self.find(h[:, end] - h[:, start] * self.powers[n])
                hit &= self.lengths[at] == n
                value = best[:, start] + np.where(hit, self.key_scores[at], -np.inf if n > 1 else np.float32(self.least - 10))
                better = value > best[:, end]
                best[better, end], back[better, end] = value[better], n
        return self._starts(back)

    @staticmethod
    def _starts(back: np.ndarray) -> np.ndarray:
        """Where pieces begin, from the length of the last piece before each end."""
        words, size = back.shape[0], back.shape[1] - 1
        live, end = np.zeros((words, size), dtype=bool), np.full(words, size)
        rows = np.arange(words)
        while rows.size:
            end[rows] -= back[rows, end[rows]]
            live[rows, end[rows]] = True
            rows = rows[end[rows] > 0]
        return live

    # Symbols are places in the sorted keys, or, for characters that are no piece, the number of keys plus their code point.

    def _prepare(self) -> None:
        """Of each piece: whether merging its text gives it, its rank (-1 for a character), and the symbols that its last merge joined; and an
        empty table of pairs."""
        many = len(self.ids)
        self.alone, self.left, self.right = np.zeros(many, dtype=bool), np.arange(many), np.arange(many)
        self.rank = np.empty(many, dtype=np.int64)
        self.rank[np.argsort(-self.key_scores, kind="stable")] = np.arange(many)
        self.rank[self.lengths == 1] = -1
        for size in np.unique(self.lengths).tolist():
            of = np.flatnonzero(self.lengths == size)
            points = np.ascontiguousarray(self.points[of, :size])
            h = self._prefixes(points)
            live, cut = self._merge(points, h)
            self.alone[of] = live.sum(axis=1) == 1
            if size > 1:
                row, cut = np.arange(len(of)), np.clip(cut, 1, size - 1)
                self.left[of] = self._symbols(points, h, row, np.zeros(len(of), dtype=np.int64), cut)
                self.right[of] = self._symbols(points, h, row, cut, np.full(len(of), size))
        self.pair_keys, self.pair_ok = np.full(1 << _PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << _PAIR_BITS, dtype=bool)

    def _symbols(self, points: np.ndarray, h: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        at, hit = self.find(h[row, end] - h[row, start] * self.powers[n])
        return np.where(hit & (self.lengths[at] == n), at, len(self.keys) + points[row, start].astype(np.int64))

    def _of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, hash and length of symbols."""
        many = len(self.keys)
        piece, k = s < many, np.minimum(s, many - 1)
        return np.where(piece, self.rank[k], -1), np.where(piece, self.keys[k], (s - many + 1).astype(np.uint64)), np.where(piece, self.lengths[k], 1)

    def _stay(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging gives x and y back from the two texts together. Their merges are undone, the latest first; at no time may the
        symbols that meet at the border be a piece that would have been merged before."""
        out, which = np.zeros(len(x), dtype=bool), np.arange(len(x))
        limit = np.full(len(x), len(self.keys) + 1, dtype=np.int64)
        while which.size:
            (rx, hx, nx), (ry, hy, ny) = self._of(x), self._of(y)
            n = nx + ny
            fits = n <= self.longest
            at, hit = self.find(hx * self.powers[np.where(fits, ny, 0)] + hy)
            stay = ~(hit & fits & (self.lengths[at] == n) & (self.rank[at] < limit))
            out[which[stay & (rx < 0) & (ry < 0)]] = True
            go = np.flatnonzero(stay & ((rx >= 0) | (ry >= 0)))
            which, x, y, rx, ry = which[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit = np.where(first, rx, ry + 1)
            x, y = x.copy(), y.copy()
            x[first], y[~first] = self.right[x[first]], self.left[y[~first]]
        return out

    def _together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stay(), remembered."""
        many = len(self.keys) + 0x110000
        key = a * many + b
        at = (key.astype(np.uint64) * _BASE >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        ok, new = self.pair_ok[at], np.flatnonzero(self.pair_keys[at] != key)
        if new.size:
            ok[new] = self._stay(a[new], b[new])
            # Of several keys for one slot a single one is written, with its own verdict.
            _, one = np.unique(at[new], return_index=True)
            self.pair_keys[at[new[one]]], self.pair_ok[at[new[one]]] = key[new[one]], ok[new[one]]
        return ok

    def paths(self, points: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For words of one length: where the pieces of the one path begin all of whose neighbours may stand together."""
        if not len(self.alone):
            self._prepare()
        if not self.ranked:
            return self.merge(points, h)
        words, size = points.shape
        row, last = np.arange(words), np.zeros((words, size + 1), dtype=np.int64)
        back = np.zeros((words, size + 1), dtype=np.int64)
        for end in range(1, size + 1):
            n = np.arange(min(self.longest, end), 0, -1)
            start = end - n
            hashes = h[:, end, None] - h[:, start] * self.powers[n]
            r, c = np.nonzero(self.some[hashes >> np.uint64(64 - _KEY_BITS)])
            at, hit = self.find(hashes[r, c])
            hit &= self.alone[at]
            hit &= self.lengths[at] == n[c]
            r, c, at = r[hit], c[hit], at[hit]
            lone = np.ones(words, dtype=bool)
            lone[r[n[c] == 1]] = False  # what is left is a character that is no piece
            lone = np.flatnonzero(lone)
            r, c = np.concatenate((r, lone)), np.concatenate((c, np.full(len(lone), len(n) - 1)))
            at = np.concatenate((at, len(self.keys) + points[lone, end - 1].astype(np.int64)))
            good = start[c] == 0
            inner = np.flatnonzero(~good)
            good[inner] = self._together(last[r[inner], start[c[inner]]], at[inner])
            length = np.zeros(words, dtype=np.int64)
            np.maximum.at(length, r[good], n[c[good]])
            if not length.all():
                return self.merge(points, h)
            best = good & (n[c] == length[r])
            last[r[best], end], back[:, end] = at[best], length
        return self._starts(back)

    def merge(self, points: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For words of one length: where pieces begin after rounds of best-ranked merges."""
        return self._merge(points, h)[0]

    def _merge(self, points: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Also where the last merge of each word joined two symbols."""
        words, size = points.shape
        cut = np.zeros(words, dtype=np.int64)
        last = np.tile(np.arange(1, size + 1), (words, 1))  # end of the symbol that starts here
        before = np.tile(np.arange(-1, size - 1), (words, 1))  # start of the symbol before
        after = np.full((words, size), -np.inf, dtype=np.float32)  # score of joining the symbol here with the next
        live = np.ones((words, size), dtype=bool)

        def rate(row, start):
            mid = last[row, start]
            end = last[row, np.minimum(mid, size - 1)]
            n = end - start
            can = (mid < size) & (n <= self.longest)
            n = np.where(can, n, 0)
            at, hit = self.find(h[row, end] - h[row, start] * self.powers[n])
            after[row, start] = np.where(hit & can & (self.lengths[at] == n), self.key_scores[at], -np.inf)

        if size > 1:
            rate(np.repeat(np.arange(words), size - 1), np.tile(np.arange(size - 1), words))
        active = np.arange(words)
        while active.size:
            part = after[active]
            pick = part.argmax(axis=1)
            good = part[np.arange(len(active)), pick] > -np.inf
            active, pick = active[good], pick[good]
            mid = last[active, pick]
            cut[active] = mid
            end = last[active, mid]
            last[active, pick] = end
            live[active, mid] = False
            after[active, mid] = -np.inf
            inside = end < size
            before[active[inside], end[inside]] = pick[inside]
            prior = before[active, pick]
            has = prior >= 0
            rate(np.concatenate((active, active[has])), np.concatenate((pick, prior[has])))
        return live, cut

    def merge_one(self, word: str) -> list[int]:
        """Ends of the pieces of a long word after best-ranked merges (the leftmost of equals), taken from a heap."""
        size, known, scores = len(word), self.known, self.scores.tolist()
        end = list(range(1, size + 1))  # of the symbol that starts here; 0: none does
        before = list(range(-1, size - 1))

        def pair(start: int):
            mid = end[start]
            if mid < size and (i := known.get(word[start : end[mid]])) is not None:
                return -scores[i], start, mid, end[mid]
            return None

        heap = [x for k in range(size) if (x := pair(k))]
        heapify(heap)
        while heap:
            _, start, mid, stop = heappop(heap)
            if end[start] != mid or end[mid] != stop:
                continue
            end[start], end[mid] = stop, 0
            if stop < size:
                before[stop] = start
                if x := pair(start):
                    heappush(heap, x)
            if before[start] >= 0 and (x := pair(before[start])):
                heappush(heap, x)
        return [e for e in end if e]

    def viterbi_one(self, word: str) -> list[int]:
        """Ends of the pieces of the best path of a long word."""
        size, known, scores, longest = len(word), self.known, self.scores, self.longest
        odd = np.float32(self.least - 10)
        best, back = [np.float32(0)] * (size + 1), [0] * (size + 1)
        for e in range(1, size + 1):
            top = None
            for n in range(min(longest, e), 0, -1):
                i = known.get(word[e - n : e])
                if i is None and n > 1:
                    continue
                value = best[e - n] + (odd if i is None else scores[i])
                if top is None or value > top:
                    top, back[e] = value, n
            best[e] = top
        out, e = [], size
        while e:
            out.append(e)
            e -= back[e]
        return out[::-1]

    def encode_one(self, word: str) -> bytes:
        start, ids = 0, []
        for e in self.merge_one(word) if self.kind == BPE else self.viterbi_one(word):
            piece, start = word[start:e], e
            i = self.known.get(piece)
            ids += self._bytes(piece) if i is None else [i]
        return np.array(ids, dtype="<i4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (32 bits each) of different words, taken together by length."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.encode_one(w)
            else:
                by.setdefault(len(w), []).append(i)
        by.pop(0, None)
        for size, group in by.items():
            step = max(1, _CELLS // (size * self.longest))
            for k in range(0, len(group), step):
                some = group[k : k + step]
                points = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), dtype="<u4").reshape(len(some), size)
                h = self._prefixes(points)
                live = (self.paths if self.kind == BPE else self.viterbi)(points, h)
                row, start = np.nonzero(live)
                end = np.r_[start[1:], 0]
                end[end == 0] = size
                n = end - start
                at, hit = self.find(h[row, end] - h[row, start] * self.powers[np.minimum(n, self.longest)])
                hit &= self._same(at, points, row, start, n)
                ids, first = self.ids[at].astype("<i4"), np.searchsorted(row, np.arange(len(some) + 1)) * 4
                raw = ids.tobytes()
                first = first.tolist()
                for j, i in enumerate(some):
                    out[i] = raw[first[j] : first[j + 1]]
                for j in np.unique(row[~hit]).tolist():
                    parts = range(first[j] // 4, first[j + 1] // 4)
                    one = [[int(ids[x])] if hit[x] else self._bytes(words[some[j]][start[x] : end[x]]) for x in parts]
                    out[some[j]] = np.array([y for x in one for y in x], dtype="<i4").tobytes()
        return out

    def _bytes(self, piece: str) -> list[int]:
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unk]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((BLANK if self.dummy else "") + text.replace(" ", BLANK))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


class Codec:
    """Encodes texts, keeping the ids of words that come again."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.kept = pieces, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.pieces.words(t) for t in texts]
        if len(self.kept) > _KEPT:
            self.kept.clear()
        kept = self.kept
        new = list(set().union(*(ws for ws in cut if ws)).difference(kept))
        kept.update(zip(new, self.pieces.encode_words(new), strict=True))
        out = [None if ws is None else np.frombuffer(b"".join(map(kept.__getitem__, ws)), dtype="<i4") for ws in cut]
        for w in new:
            if len(w) > LONG:
                del kept[w]
        return out


_CODECS: dict[str, Codec] = {}


def _codec(shared, kind: int | None) -> Codec:
    data = shared.value
    key = hashlib.sha256(data).hexdigest() + str(kind)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Pieces(data, kind))
    return _CODECS[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError("the model file is over 64 MB")
    return data


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", kind: int | None = None) -> DataFrame:
    """(id, n_ids, ids, ids_sha256, round_trip): the digest is of the ids in 4 bytes each, the lowest first; round_trip tells whether decoding gives
    the text back. The model file is read on the driver and broadcast (its size is checked: 64 MB at most)."""
    shared, of = docs.sparkSession.sparkContext.broadcast(_model(model_path)), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(shared, kind)
        for whole in batches:
            for b in slices(whole):
                texts = [t if t is None else t.decode() for t in b.column("text").to_pylist()]
                ids = codec.encode(texts)
                back = [None if x is None else codec.pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                    pa.array([None if x is None else hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array(back, pa.bool_()),
                ], names=["doc_id", "n_ids", "ids", "ids_sha256", "round_trip"])

    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return few.mapInArrow(run, f"doc_id {of}, n_ids long, ids array<int>, ids_sha256 string, round_trip boolean").withColumnRenamed("doc_id", id_col)


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids."""
    shared, of = rows.sparkSession.sparkContext.broadcast(_model(model_path)), rows.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = _codec(shared, None).pieces
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else pieces.decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {of}, text string").withColumnRenamed("doc_id", id_col)
