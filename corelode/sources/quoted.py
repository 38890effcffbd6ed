"""CSV files with quoted line breaks, read in parallel.

Whether a line begins inside quotes depends on all quotes before it, so such a file is usually one task. Here each split first tells its own parity of
quotes and how many records would begin in it for either state at its start; a row a split goes to the driver, where running parities give each split its
state and the number of its first record. Then each split puts its records together on its own. Only what crosses the border of two splits,
two pieces a split at most, is joined by an exchange.

Files count in the order of their names, records in the order of their places; the first record of each file is its header; blank lines between records are none;
a quote that is never closed takes all that follows, to the end of its file. Where lines end in CR and LF, line breaks inside quotes become LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SPLIT = "file string, block long, odd boolean, outside long, inside long, crlf boolean"
_RECORD = "file string, block long, no long, kind int, text string"
WHOLE, HEAD, TAIL = 0, 1, 2


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): the bytes of each line, in the splits of the scan."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(split, lines): of each batch what belongs to one split; a task reads one split after the other."""
    for b in batches:
        block, file = b.column("block").to_numpy(), b.column("file").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            if end > start:
                yield (b.column("file")[start].as_py(), int(block[start])), b.column("line").slice(start, end - start)


def _state(some: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Whether each line begins inside quotes, whether it holds anything, and the state after the last."""
    quotes = pc.count_substring(some, '"').to_numpy() % 2 == 1
    after = np.logical_xor.accumulate(np.concatenate(([odd], quotes)))
    blank = _blank(some)
    return after[:-1], blank, bool(after[-1])


def _blank(some: pa.Array) -> np.ndarray:
    short = pc.less(pc.binary_length(some), 256).to_numpy(zero_copy_only=False)
    return np.array([bool(s) and not x.strip() for s, x in zip(short, some.to_pylist(), strict=True)], dtype=bool)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of _SPLIT for each split."""
    found: dict[tuple[str, int], list] = {}
    for split, some in _segments(batches):
        mine = found.setdefault(split, [False, 0, 0, some[0].as_py().endswith(b"\r")])
        within, blank, mine[0] = _state(some, mine[0])
        mine[1] += int((~within & ~blank).sum())
        mine[2] += int((within & ~blank).sum())
    if found:
        cols = [[*split, *mine] for split, mine in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cols, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["file", "block", "odd", "outside", "inside", "crlf"])


def _starts(splits: list) -> dict[tuple[str, int], tuple[bool, int, bool, bool]]:
    """Of each split, whether it begins inside quotes, the number of the first record that begins in it, whether that is its file's header, which
    has no number, and whether the file's lines end in CR and LF, as its first one does."""
    out, before, inside, file = {}, 0, False, None
    for r in sorted(splits, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            inside, file, header, crlf = False, r["file"], True, r["crlf"]
        out[(r["file"], r["block"])] = (inside, before, header, crlf)
        if begun := r["inside" if inside else "outside"]:
            before += begun - header
            header = False
        inside ^= r["odd"]
    return out


def _records(shared, decode):
    """Rows of _RECORD: whole records, and of those that cross a border what this split holds of them. Headers have a null number."""

    def run(batches):
        starts, now, out = shared.value, None, []
        no, header, crlf, inside, held, kind = 0, False, False, False, [], WHOLE

        def put(k: int) -> None:
            nonlocal no, header
            text = decode(b"\n".join(held))
            if k == HEAD:
                out.append((*now, None, k, text))
                return
            out.append((*now, None if header else no, k, text))
            no, header = no + (not header), False

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "block", "no", "kind", "text"])

        for split, some in _segments(batches):
            if split != now:
                if held:
                    put(HEAD if kind == HEAD else TAIL)
                now, held = split, []
                inside, no, header, crlf = starts[split]
                kind = HEAD if inside else WHOLE
            within, blank, last = _state(some, inside)
            ends = np.append(within[1:], last)
            for line, begun_inside, ends_inside, empty in zip(some.to_pylist(), within.tolist(), ends.tolist(), blank.tolist(), strict=True):
                if not begun_inside and empty:
                    continue
                held.append(line.removesuffix(b"\r") if crlf else line)
                if not ends_inside:
                    put(kind)
                    held, kind = [], WHOLE
            inside = last
            if len(out) > 10_000:
                yield flush()
        if held:
            put(HEAD if kind == HEAD else TAIL)
        if out:
            yield flush()

    return run


def records(spark: SparkSession, path: str, decode) -> DataFrame:
    """(_row, text): each record but the headers, and its number from 0. decode turns a record's bytes into text."""
    rows = lines(spark, path)
    starts = _starts(rows.mapInArrow(_told, _SPLIT).collect())  # a row for each split
    found = rows.mapInArrow(_records(spark.sparkContext.broadcast(starts), decode), _RECORD)
    whole = found.where(F.col("kind") == WHOLE).select("no", "text")
    # A crossing record is the tail of one split and the heads of those that follow, up to the next tail.
    chain = F.sum((F.col("kind") == TAIL).cast("int")).over(W.partitionBy("file").orderBy("block", "kind"))
    parts = found.where(F.col("kind") != WHOLE).withColumn("chain", chain).groupBy("file", "chain").agg(F.max("no").alias("no"), F.sort_array(F.collect_list(F.struct("block", F.col("kind") != TAIL, "text"))).alias("p"))
    joined = parts.select("no", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.union(joined).where("no is not null").select(F.col("no").alias("_row"), "text")
