"""Helpers shared by the training-data operators.

Word rules work on UTF-8 bytes: one ``bytes.translate`` lower-cases A-Z and turns every separator into a
blank, so ``split()`` yields the words. Bytes from 0x80 up belong to words, hence whole code points do too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of at most so many bytes are handed to a vectorised kernel at once; a longer text goes alone.
SLICE_BYTES = 1 << 20


def _table(is_word) -> bytes:
    low = bytes(range(256)).lower()
    return bytes(low[b] if is_word(low[b]) else 0x20 for b in range(256))


#: Words of letters and digits: everything but [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words between blanks: everything but [\x20\x09-\x0D].
BLANK = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, one in the warehouse, which on a cluster mustn't be a local folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not sc.master.startswith("local") and (place.startswith("file:") or "://" not in place):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return place + "/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Deletes the files of durable(), once nothing reads df any more."""
    plan, sc = df._jdf.queryExecution().logical(), df.sparkSession.sparkContext
    if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def pair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the UTF-8 bytes of the text, under fixed names: other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about `most` bytes of the binary column, so that memory doesn't follow the batch size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
