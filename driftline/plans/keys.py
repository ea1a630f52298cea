"""What keys of split and merged tables hold: whether views over them may leave out a join or a DISTINCT."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Facts:
    """Tables whose key is unique and never null, and pairs of tables of which the second has every key of the first."""

    unique: set[str] = field(default_factory=set)
    included: set[tuple[str, str]] = field(default_factory=set)

    def matched_once(self, table: str, other: str) -> bool:
        """Whether joining the other table on the key leaves every row of the first exactly once."""
        return other in self.unique and (table, other) in self.included


def key_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """For each key how often each table has it, in a column of the table's name. Rows of all tables meet in one shuffle, after they are counted
    where they lie, so a key of many rows is one row of each task."""
    tagged = [frame.select(F.col(key).alias("k"), F.lit(name).alias("t")) for name, frame in tables.items()]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy("k").agg(*[F.count_if(F.col("t") == name).alias(name) for name in tables])


def facts(tables: dict[str, DataFrame], events: list[dict]) -> Facts:
    """What a split's targets, and a merge's target, hold of their key: one aggregate of one row an event.

    A null key joins nothing, so a table that has one isn't unique, and its keys are in no other table. Tables without rows are unique,
    and their keys are in all others.
    """
    out = Facts()
    for e in events:
        if e["op"] not in ("TABLE_SPLIT", "TABLE_MERGE") or not e.get("key"):
            continue
        held = {t: tables[t] for t in (e["targets"] if e["op"] == "TABLE_SPLIT" else [e["target"]])}
        names = list(held)
        once = [F.coalesce(F.bool_and(F.when(F.col("k").isNull(), F.col(t) == 0).otherwise(F.col(t) <= 1)), F.lit(True)) for t in names]
        pairs = [(a, b) for a in names for b in names if a != b]
        inside = [F.coalesce(F.bool_and((F.col(a) == 0) | F.col("k").isNotNull() & (F.col(b) > 0)), F.lit(True)) for a, b in pairs]
        row = key_counts(held, e["key"]).agg(F.array(*once), F.array(*inside) if pairs else F.lit(None)).first()
        out.unique |= {t for t, yes in zip(names, row[0], strict=True) if yes}
        out.included |= {p for p, yes in zip(pairs, row[1] or [], strict=True) if yes}
    return out
