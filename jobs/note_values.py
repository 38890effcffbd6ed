"""Numbers in free text (drilling notes, certificates, reports): every word with a digit is read as a grade, and each that isn't one is accounted for.

A stream over the files of the text table. A run takes the files that are new since the last one, and ends; the checkpoint tells which were taken, the
sink's own log which output counts, so a run that was broken off goes on where it was, and one without new files adds nothing. Writes

    <output>/values   Parquet, partitioned by the text's language: (id, place, word, unit, value, ppm, state)
    <output>/summary  CSV: words by language and state, over all that was taken so far

Output and checkpoint belong together: delete both or none.

    python -m jobs.note_values --input DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.functions import units
from corelode.functions.numbers import ParseRules, parse_grade
from jobs.common import arguments, log, read_config, session

CONFIG = Path(__file__).with_suffix(".yaml")
KEPT = "spark.sql.streaming.numRecentProgressUpdates"
BLANKS = r"[\x20\x09-\x0D]+"
#: Brackets, quotes and marks around a word.
AROUND = r"^[(\[{\"']+|[)\]}\"',;:.!?]+$"


def mentions(texts: DataFrame, cfg: dict) -> DataFrame:
    """(id, place, word, unit, value, ppm, state, part): a row for each word with a digit; `place` counts them from 0 in their text."""
    src = cfg["source"]
    words = F.filter(F.split(F.col(src["text"]), BLANKS), lambda w: w.rlike("[0-9]"))
    rows = texts.select(F.col(src["id"]), F.col(src["part"]), F.posexplode(words).alias("place", "word"))
    rows = rows.withColumn("word", F.regexp_replace("word", AROUND, ""))
    suffixes = sorted(cfg["units"].items(), key=lambda u: (-len(u[0]), u[0]))  # the longest that fits counts
    ends = [F.when(F.lower("word").endswith(suffix.lower()), F.struct(F.lit(name).alias("name"), F.lit(len(suffix)).alias("size"))) for suffix, name in suffixes]
    rows = rows.withColumn("__u", F.coalesce(*ends))
    number = F.expr("substr(word, 1, length(word) - coalesce(__u.size, 0))")
    rules = ParseRules(tuple(str(v) for v in cfg["null_values"]), cfg["negative_is_below_detection"])
    rows = rows.withColumn("__p", parse_grade(number, rules))
    ppm = F.coalesce(*(F.when(F.col("__u.name") == u, units.grade_to_ppm(F.col("__p.value"), u)) for u in dict.fromkeys(cfg["units"].values())))
    return rows.select(src["id"], F.col("place").cast("bigint").alias("place"), "word", F.col("__u.name").alias("unit"), "__p.value", ppm.alias("ppm"), "__p.state", src["part"])


def read_values(spark: SparkSession, output_path: str, cfg: dict) -> DataFrame:
    """What the job has written so far; the schema is told, so that no language is taken for a number."""
    src = cfg["source"]
    fields = dict(f.strip().split(" ", 1) for f in src["schema"].split(","))
    schema = f"{src['id']} {fields[src['id']]}, place bigint, word string, unit string, value double, ppm double, state string, {src['part']} {fields[src['part']]}"
    try:
        return spark.read.schema(schema).parquet(f"{output_path}/values")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # there were no files yet


def run(spark: SparkSession, input_path: str, output_path: str, checkpoint_path: str, cfg: dict) -> dict[str, int]:
    """Takes what is new; returns the texts that this run has read, and the words that all runs have written."""
    src = cfg["source"]
    stream = spark.readStream.format(src["format"]).schema(src["schema"]).option("maxFilesPerTrigger", int(cfg["max_files"])).load(f"{input_path.rstrip('/')}/{src['path']}")
    kept = spark.conf.get(KEPT)
    spark.conf.set(KEPT, str(1 << 20))  # so that no batch's progress is forgotten before it is counted
    try:
        query = (
            mentions(stream, cfg).writeStream.format("parquet").partitionBy(src["part"])
            .option("checkpointLocation", checkpoint_path).option("path", f"{output_path}/values").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        texts = sum(p.numInputRows for p in query.recentProgress)
    finally:
        spark.conf.set(KEPT, kept)
    counts = read_values(spark, output_path, cfg).groupBy(src["part"], "state").agg(F.count("*").alias("words"))
    counts.coalesce(1).sortWithinPartitions(src["part"], "state").write.mode("overwrite").option("header", True).csv(f"{output_path}/summary")
    told = spark.read.option("header", True).schema("part string, state string, words bigint").csv(f"{output_path}/summary")
    figures = {"texts": texts, "words": told.agg(F.coalesce(F.sum("words"), F.lit(0))).collect()[0][0]}
    log.info("read %(texts)d new texts; %(words)d words are written in all", figures)
    return figures


def main(argv: list[str] | None = None) -> None:
    a = arguments(__doc__, CONFIG, "checkpoint", argv=argv)
    spark = session("note_values")
    try:
        run(spark, a.input, a.output, a.checkpoint, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
