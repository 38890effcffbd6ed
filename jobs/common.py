"""What the jobs share: configuration, sources declared as SQL expressions, logging, the command line's session."""

from __future__ import annotations

import argparse
import contextlib
import logging
from collections.abc import Iterator
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def read_config(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def source(spark: SparkSession, input_path: str, declared: dict) -> DataFrame:
    """A table as its configuration declares it: `derive` adds columns one after the other, `columns` names what is kept; all are SQL expressions."""
    reader = spark.read.format(declared.get("format", "parquet")).options(**declared.get("options", {}))
    rows = reader.load(f"{input_path.rstrip('/')}/{declared['path']}")
    for step in declared.get("derive", []):
        for name, expression in step.items():
            rows = rows.withColumn(name, F.expr(expression))
    return rows.select(*(F.expr(str(e)).alias(name) for name, e in declared["columns"].items()))


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows, and how many of them the next action that reads them has seen: no job of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextlib.contextmanager
def dealt_to(spark: SparkSession, tasks: int | None) -> Iterator[None]:
    """Meanwhile shuffles go to `tasks`, where there are any; then to as many partitions as before."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        if tasks:
            spark.conf.set(name, str(tasks))
        yield
    finally:
        spark.conf.set(name, before)


def arguments(text: str | None, config: Path, *more: str, argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=text)
    for name in ("input", "output", *more):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(config))
    return parser.parse_args(argv)


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
