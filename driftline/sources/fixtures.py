"""Fixtures of a change: the tables after it, written beside a manifest, and checks of query corpora over them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import evolve
from ..plans.workload import Tables, runs
from . import catalog


def build(tables: Tables, specs: list[dict], root: str | Path, name: str) -> dict:
    """Writes the tables before and after a change as Parquet and config.json with what was done; gives the configuration."""
    after, made = evolve.apply(tables, specs, hashed=True)
    folder = Path(root, name)
    for side, frames in (("pre", tables), ("post", after)):
        for table, frame in frames.items():
            frame.write.mode("overwrite").parquet(str(folder / side / f"{table}.parquet"))
    config = {"pre_db": "pre", "post_db": "post", "engine_version": made.engine_version, "content_hash": made.content_hash, "specs": made.specs, "events": made.events}
    (folder / "config.json").write_text(json.dumps(config, indent=1))
    return config


def tables_of(spark: SparkSession, folder: str | Path) -> Tables:
    """The tables that build() wrote on one side of a change."""
    return {p.stem: spark.read.parquet(str(p)) for p in sorted(Path(folder).glob("*.parquet"))}


def check(spark: SparkSession, config: dict) -> list[str]:
    """What is wrong with a written fixture: a hash that isn't of its form, or that the tables no longer have."""
    wrong = []
    digest = config.get("content_hash", "")
    if len(digest) != 16 or set(digest) - set("0123456789abcdef"):
        wrong.append(f"{digest!r} is no hash of 16 digits")
    elif evolve.content_hash(tables_of(spark, config["post_db"]), config["specs"]) != digest:
        wrong.append("the tables aren't those that were written")
    return wrong


def check_corpus(spark: SparkSession, items: list[dict], pre: Tables, post: Tables) -> list[str]:
    """What is wrong with query items: their keys, queries that fail, and queries without rows."""
    wrong = catalog.check_items(items)
    for item in items:
        for key, tables in (("gold_pre", pre), ("gold_post", post)):
            sql = item.get(key)
            if not sql:
                continue
            got = runs(spark, sql, tables)
            if got.error is not None:
                wrong.append(f"{item.get('id')}: {key} fails: {got.error.splitlines()[0]}")
            elif not got.n:
                wrong.append(f"{item.get('id')}: {key} has no rows")
    return wrong
