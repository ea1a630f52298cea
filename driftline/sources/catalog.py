"""Catalogs: what tables and columns there are, as DataFrames of table_name, column_name, data_type, ordinal."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of the test data.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SCHEMA = "table_name string, column_name string, data_type string, ordinal int"


def read_tables(spark: SparkSession, root: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names}


def register(frames: dict[str, DataFrame], prefix: str = "") -> None:
    """Exposes frames as temporary views, so that SQL text can run on them."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(prefix + name)


def describe(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """The catalog of named frames. Reads no data."""
    rows = [(t, f.name, f.dataType.simpleString(), i) for t in sorted(frames) for i, f in enumerate(frames[t].schema)]
    return spark.createDataFrame(rows, SCHEMA)


def introspect(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The catalog of the session's tables and views, or of those named."""
    found = sorted(names if names is not None else (t.name for t in spark.catalog.listTables()))
    return describe(spark, {n: spark.table(n) for n in found})


def from_columns(spark: SparkSession, tables: dict[str, list[tuple[str, str]]]) -> DataFrame:
    return spark.createDataFrame([(t, c, k, i) for t, columns in tables.items() for i, (c, k) in enumerate(columns)], SCHEMA)


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """n tables of four columns each, for timing."""
    columns = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t"), F.lit(i).alias("i")) for i, (c, t) in enumerate([("id", "INTEGER"), ("c1", "TEXT"), ("c2", "INTEGER"), ("c3", "REAL")])])
    rows = spark.range(n).select(F.concat(F.lit("table_"), F.col("id").cast("string")).alias("table_name"), F.explode(columns).alias("x"))
    return rows.select("table_name", F.col("x.c").alias("column_name"), F.col("x.t").alias("data_type"), F.col("x.i").alias("ordinal"))


def load_queries(path: str | Path) -> list[dict]:
    """Query items of a JSON file: a list, or an object that holds one under queries."""
    held = json.loads(Path(path).read_text())
    items = held.get("queries") if isinstance(held, dict) else held
    if not isinstance(items, list):
        raise ValueError(f"{path} holds no list of queries")
    return items


def load_configs(root: str | Path) -> list[dict]:
    """config.json of every folder under root, by folder name, with paths resolved against their folder."""
    out = []
    for path in sorted(Path(root).glob("*/config.json")):
        config = json.loads(path.read_text())
        for key in ("pre_db", "post_db", "queries"):
            if key in config:
                config[key] = str(path.parent / config[key])
        out.append(config | {"id": path.parent.name})
    return out


def check_items(items: list[dict]) -> list[str]:
    """What is wrong with query items: missing keys, golds that an expected failure must not have, missing reasons."""
    wrong = []
    for k, item in enumerate(items):
        name = item.get("id", f"item {k}")
        wrong += [f"{name}: no {key}" for key in ("id", "question", "gold_pre", "gold_post", "perturbation", "touches") if key not in item]
        if item.get("expected_failure"):
            if item.get("gold_post") is not None:
                wrong.append(f"{name}: an expected failure has a later query")
            if not item.get("failure_reason"):
                wrong.append(f"{name}: an expected failure has no reason")
        elif not item.get("gold_post"):
            wrong.append(f"{name}: no later query")
    return wrong
