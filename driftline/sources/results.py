"""Result tables: resuming, and keeping contaminated runs apart."""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate

#: What a fallback run leaves in a backend column.
MARK = "mock-after-"


def pending(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items that have no result row yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def resume(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results written so far, typed; none if there are none."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.csv(path, schema=schema, header=True) if system.exists(files) else spark.createDataFrame([], schema)


#: A row of a run's log: what was appended, and what ended the run if something did.
LOG = "at timestamp, status string, ids array<string>, failed_id string, error string"


class RunTable:
    """A run's rows and its log, as two tables that grow by one file an append, which is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _read(self, name: str, schema: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        system = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if system.exists(place) else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema)

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def append(self, rows: list[tuple], status: str, failed_id: str | None = None, error: str | None = None) -> None:
        """Rows whose first column is the id; they come before the log that tells of them."""
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/rows")
        entry = (datetime.now(), status, [r[0] for r in rows], failed_id, error)
        self.spark.createDataFrame([entry], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")


def contaminated(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: how many rows name a fallback backend in any of the columns (all strings by default), of how many."""
    names = columns if columns is not None else [c for c, t in rows.dtypes if t == "string"]
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).contains(MARK), F.lit(False)) for c in names], F.lit(False))
    return rows.agg(F.count_if(hit).alias("contaminated"), F.count("*").alias("n")).withColumn("fraction", F.when(F.col("n") > 0, F.col("contaminated") / F.col("n")).otherwise(0.0))


def write(rows: DataFrame, path: str, allow_contaminated: bool = False) -> str:
    """Writes rows as CSV with a header; to a path of its own if any is contaminated and that isn't allowed."""
    dirty = not allow_contaminated and contaminated(rows).first()["contaminated"] > 0
    to = f"{path}_contaminated" if dirty else path
    rows.write.mode("overwrite").csv(to, header=True)
    return to


def write_json(summary: dict, path: str) -> None:
    """A summary, which may be nested, as a JSON file."""
    Path(path).write_text(json.dumps(summary, indent=1, sort_keys=True, default=str))


def summary(rows: DataFrame) -> dict:
    """What a run comes to: accuracy of each arm overall and by operator, expected failures, contamination, and silent failures seen."""
    one = lambda frame: {k: v for k, v in frame.first().asDict().items()}
    by = lambda frame, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in frame.collect()}  # noqa: E731  a row an operator
    return {
        "overall": one(evaluate.pooled(rows)),
        "operators": by(evaluate.per_operator(rows), "perturbation"),
        "expected_failures": by(evaluate.expected_failures(rows), "perturbation"),
        "contamination": one(contaminated(rows, [c for c in rows.columns if c.endswith("backend")])),
        "silent_failures": one(evaluate.silent_detection(rows)),
    }


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; beyond so many rows an error, as nobody would read them."""
    held = rows.take(most + 1)
    if len(held) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = [list(rows.columns), ["-"] * len(rows.columns), *([("" if v is None else str(v).replace("|", "\\|")) for v in r] for r in held)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
