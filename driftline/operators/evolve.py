"""Schema evolution as DataFrame transforms over a set of named tables.

A set of tables is a dict of name to DataFrame. Every transform is lazy and gives a new dict; nothing is copied.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def rename_table(tables: Tables, old: str, new: str) -> Tables:
    if old not in tables or new in tables:
        raise ValueError(f"can't rename {old} to {new}")
    return {new if n == old else n: t for n, t in tables.items()}


def rename_columns(tables: Tables, table: str, names: dict[str, str]) -> Tables:
    own = {c.lower(): c for c in tables[table].columns}
    missing = [c for c in names if c.lower() not in own]
    if missing:
        raise ValueError(f"{table} has no {missing}")
    return tables | {table: tables[table].withColumnsRenamed({own[a.lower()]: b for a, b in names.items()})}


def rename_by_position(tables: Tables, table: str, names: list[str]) -> Tables:
    """New names for all columns, in their order."""
    if len(names) != len(tables[table].columns):
        raise ValueError(f"{table} has {len(tables[table].columns)} columns, not {len(names)}")
    return tables | {table: tables[table].toDF(*names)}


def split_table(tables: Tables, table: str, key: str, parts: dict[str, list[str]]) -> Tables:
    """Each part gets the key and its columns; rows stay as they are, repeats included."""
    own = {c.lower(): c for c in tables[table].columns}
    missing = [c for cs in parts.values() for c in [key, *cs] if c.lower() not in own]
    if missing:
        raise ValueError(f"{table} has no {missing}")
    out = {n: t for n, t in tables.items() if n != table}
    for name, columns in parts.items():
        picked = dict.fromkeys(own[c.lower()] for c in [key, *columns])
        out[name] = tables[table].select(*picked)
    return out


def merge_tables(tables: Tables, first: str, second: str, key: str | tuple[str, str], target: str, suffix: bool = False) -> Tables:
    """The inner join on key; rows without a partner are lost. A column of both is taken from the first, or, with suffix,
    kept as name_table as well."""
    left_key, right_key = key if isinstance(key, tuple) else (key, key)
    a, b = tables[first].alias("a"), tables[second].alias("b")
    held = {c.lower() for c in tables[first].columns}
    picked = [F.col(f"a.`{c}`") for c in tables[first].columns]
    for c in tables[second].columns:
        if c.lower() not in held:
            picked.append(F.col(f"b.`{c}`"))
        elif suffix and c.lower() != right_key.lower():
            picked.append(F.col(f"b.`{c}`").alias(f"{c}_{second}"))
    joined = a.join(b, F.col(f"a.`{left_key}`") == F.col(f"b.`{right_key}`")).select(*picked)
    return {n: t for n, t in tables.items() if n not in (first, second)} | {target: joined}


def merge_columns(tables: Tables, table: str, sources: list[str], target: str, expression: str | None = None) -> Tables:
    """The sources go, and target is appended: an SQL expression of them (null if any operand of || is), or their texts
    joined by one blank, null as an empty text."""
    own = {c.lower() for c in tables[table].columns}
    missing = [c for c in sources if c.lower() not in own]
    if missing:
        raise ValueError(f"{table} has no {missing}")
    if expression is None:
        texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sources]
        value = F.concat(*[x for t in texts for x in (F.lit(" "), t)][1:])
    else:
        value = F.expr(expression)
    return tables | {table: tables[table].withColumn(target, value).drop(*sources)}


def merge_key(first: DataFrame, second: DataFrame, join_on: tuple[str, str] | None = None, keys: tuple[list[str], list[str]] | None = None) -> tuple[str, str]:
    """What two tables are joined on: the columns that a query joins them on, else a declared key of both, else their only
    common column."""
    if join_on:
        return join_on
    a, b = ({c.lower(): c for c in f.columns} for f in (first, second))
    if keys and len(keys[0]) == len(keys[1]) == 1 and keys[0][0].lower() == keys[1][0].lower():
        return keys[0][0], keys[1][0]
    common = sorted(set(a) & set(b))
    if len(common) != 1:
        raise ValueError(f"no single column to join on among {common}")
    return a[common[0]], b[common[0]]


def merged_columns(pre: list[str], post: list[str]) -> tuple[str, list[str]]:
    """The new column and those it took in, in their old order, from a table's columns before and after."""
    old, now = {c.lower() for c in pre}, {c.lower() for c in post}
    gone, new = [c for c in pre if c.lower() not in now], [c for c in post if c.lower() not in old]
    if len(new) != 1 or len(gone) < 2:
        raise ValueError("the columns don't show one merge")
    return new[0], gone


@dataclass
class Manifest:
    """What was done: specifications, the events a perfect classifier finds, and a hash of the resulting rows."""

    specs: list[dict]
    events: list[dict] = field(default_factory=list)
    content_hash: str = ""
    engine_version: str = "1"


def apply(tables: Tables, specs: list[dict], hashed: bool = False) -> tuple[Tables, Manifest]:
    """Applies specifications in their order."""
    made = Manifest(list(specs))
    for s in specs:
        op = s["op"]
        if op == "TABLE_RENAME":
            tables = rename_table(tables, s["from"], s["to"])
            event = {"from": s["from"], "to": s["to"]}
        elif op == "COLUMN_RENAME":
            tables = rename_columns(tables, s["table"], {s["from"]: s["to"]})
            event = {"table": s["table"], "from": s["from"], "to": s["to"]}
        elif op == "TABLE_SPLIT":
            tables = split_table(tables, s["source"], s["key"], s["partition"])
            event = {"source": s["source"], "targets": sorted(s["partition"]), "key": s["key"]}
        elif op == "TABLE_MERGE":
            tables = merge_tables(tables, *s["sources"][:2], s["key"], s["target"])
            event = {"sources": sorted(s["sources"][:2]), "target": s["target"], "key": s["key"]}
        elif op == "COLUMN_MERGE":
            tables = merge_columns(tables, s["table"], s["sources"], s["target"], s.get("expression"))
            event = {"table": s["table"], "sources": sorted(s["sources"]), "target": s["target"]}
        else:
            raise ValueError(f"no such operator: {op}")
        made.events.append({"op": op} | event)
    if hashed:
        made.content_hash = content_hash(tables, specs)
    return tables, made


def content_hash(tables: Tables, specs: list[dict]) -> str:
    """16 digits that follow from all rows, in any order, and the specifications: an exact sum of row hashes for each table."""
    parts = []
    for name in sorted(tables):
        row = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(20,0)")
        got = tables[name].agg(F.count("*").alias("n"), F.sum(row).alias("s")).first()
        parts.append(f"{name}:{got.n}:{got.s}")
    return hashlib.sha256(("\n".join(parts) + json.dumps(specs, sort_keys=True)).encode()).hexdigest()[:16]


def first_per_group(frame: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps at most k rows of a group in each task before the shuffle."""
    place = Window.partitionBy(*group).orderBy(*order)
    return frame.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")


def stratified(items: DataFrame, per_group: int = 4, whole: str = "COLUMN_MERGE") -> DataFrame:
    """Benchmark items: the first of each operator and database by index, and all of the operator named by whole."""
    own = first_per_group(items.where(F.col("op") != whole), ["op", "db_id"], ["train_idx"], per_group)
    return own.unionByName(items.where(F.col("op") == whole)).orderBy("op", "db_id", "train_idx")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
