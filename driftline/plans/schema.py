"""Schema fingerprints, and the classified difference between two schemas.

A fingerprint is one ordered aggregate over a catalog DataFrame. A difference is metadata of a few thousand rows at
most, so one is worked out on the driver, with one index lookup per table where pairwise comparison would take time with
the square of the number of tables; many are worked out side by side with difference_of_pairs.

Ties are always broken by name, so that results don't depend on hash order.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "op string, `from` string, `to` string, table string, `column` string, source string, sources array<string>, target string, targets array<string>, key string"
FIELDS = ("op", "from", "to", "table", "column", "source", "sources", "target", "targets", "key")


def canonical(catalog: DataFrame, *keys: str) -> DataFrame:
    """The canonical string of each schema of a catalog; keys name the columns that tell schemas apart, if there are several.
    Names and types count without case, in sorted order."""
    column = F.concat(F.lower("column_name"), F.lit("|"), F.lower("data_type"))
    tables = catalog.groupBy(*keys, "table_name").agg(F.array_sort(F.collect_list(F.struct(F.lower("column_name").alias("n"), column.alias("c")))).alias("x"))
    text = F.concat(F.lower("table_name"), F.lit(":"), F.array_join(F.col("x.c"), "||"))
    tables = tables.select(*keys, F.struct(F.lower("table_name").alias("n"), text.alias("t")).alias("x"))
    return tables.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("x"))["t"], "$$").alias("canonical"))


def fingerprint(catalog: DataFrame, *keys: str) -> DataFrame:
    return canonical(catalog, *keys).withColumn("fingerprint", F.sha2("canonical", 256))


def prompt_block(catalog: DataFrame) -> DataFrame:
    """One row a table: its name and a line that lists its columns in their own order."""
    column = F.concat_ws(" ", "column_name", "data_type")
    held = catalog.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", column.alias("c")))).alias("x"))
    return held.select("table_name", F.concat(F.lit("TABLE "), F.col("table_name"), F.lit(" ( "), F.array_join(F.col("x.c"), ", "), F.lit(" )")).alias("line"))


def prompt_text(catalog: DataFrame) -> str:
    return "\n".join(r.line for r in prompt_block(catalog).orderBy(F.lower("table_name")).collect())


@dataclass(frozen=True)
class Table:
    """A table's columns by lower-case name: the name as written, and its type."""

    name: str
    columns: dict[str, tuple[str, str]]

    @cached_property
    def text(self) -> str:
        """The columns as the canonical string of a schema has them; what a catalog says, so it is made once."""
        return "||".join(f"{c}|{kind}" for c, (_, kind) in sorted(self.columns.items()))

    def types(self) -> tuple[str, ...]:
        return tuple(sorted(t for _, t in self.columns.values()))

    def shape(self) -> frozenset[tuple[str, str]]:
        return frozenset((n, t) for n, (_, t) in self.columns.items())

    def written(self, name: str) -> str:
        return self.columns[name][0]


def tables_of(rows: Iterable[tuple[str, str, str, int]]) -> dict[str, Table]:
    held: dict[str, dict[str, tuple[str, str]]] = defaultdict(dict)
    for table, column, kind, _ in sorted(rows, key=lambda r: (r[0], r[3])):
        held[table][column.lower()] = (column, kind.lower())
    out = {t: Table(t, c) for t, c in held.items()}
    for t in out.values():
        t.text  # noqa: B018  with the catalog at hand
    return out


def _collect(catalog: DataFrame) -> dict[str, Table]:
    return tables_of(tuple(r) for r in catalog.select("table_name", "column_name", "data_type", "ordinal").collect())


def difference(pre: DataFrame | dict[str, Table], post: DataFrame | dict[str, Table], strict_merge: bool = False) -> list[dict]:
    """Events that lead from one schema to the other, in order of decreasing certainty: tables renamed as they are, tables
    renamed with columns, splits, merges, tables gone or new, then column events of tables in both.

    With strict_merge, several columns of a table gone and one new is a merge even if one of them has the new one's type;
    otherwise such a pair is a rename first.
    """
    pre, post = (x if isinstance(x, dict) else _collect(x) for x in (pre, post))
    gone, new = sorted(set(pre) - set(post)), sorted(set(post) - set(pre))
    out: list[dict] = []
    for step in (_renamed, _renamed_with_columns, _split, _merged):
        events, gone, new = step(pre, post, gone, new)
        out += events
    out += [{"op": "TABLE_REMOVE", "table": t} for t in gone] + [{"op": "TABLE_ADD", "table": t} for t in new]
    changed = [n for n in set(pre) & set(post) if pre[n].columns != post[n].columns]
    for name in sorted(changed):
        out += _columns(pre[name], post[name], name, strict_merge)
    return out


def _renamed(pre, post, gone, new):
    """A table that is gone and the only new one with its columns and types."""
    by_shape = defaultdict(list)
    for t in new:
        by_shape[post[t].shape()].append(t)
    out, kept = [], []
    for t in gone:
        same = by_shape[pre[t].shape()]
        if len(same) == 1:
            out.append({"op": "TABLE_RENAME", "from": t, "to": same.pop()})
        else:
            kept.append(t)
    taken = {e["to"] for e in out}
    return out, kept, [t for t in new if t not in taken]


def _renamed_with_columns(pre, post, gone, new):
    """A table that is gone and the first new one with as many columns of the same types."""
    by_types = defaultdict(list)
    for t in reversed(new):
        by_types[post[t].types()].append(t)
    out, kept, taken = [], [], set()
    for t in gone:
        if same := by_types[pre[t].types()]:
            to = same.pop()
            taken.add(to)
            out += [{"op": "TABLE_RENAME", "from": t, "to": to}, *_columns(pre[t], post[to], to, False, merges=False)]
        else:
            kept.append(t)
    return out, kept, [t for t in new if t not in taken]


class Containment:
    """Which of many sets of columns lie within one. Sets are filed under their rarest column, so only those whose rarest column is among
    the given ones are looked at; tables with the same columns are one set."""

    def __init__(self, tables: Iterable[tuple[str, Table]]):
        self.names: dict[frozenset[str], dict[str, None]] = {}
        for name, table in tables:
            self.names.setdefault(frozenset(table.columns), {})[name] = None
        frequency = Counter(c for columns in self.names for c in columns)
        self.filed: dict[str, list[frozenset[str]]] = defaultdict(list)
        for columns in self.names:
            if columns:
                self.filed[min(columns, key=lambda c: (frequency[c], c))].append(columns)

    def within(self, columns: Iterable[str], strictly: bool = False) -> list[str]:
        """Names, sorted, of the tables whose columns are all among these; strictly if they are fewer."""
        given = frozenset(columns)
        found = (s for c in given for s in self.filed.get(c, ()) if s <= given and not (strictly and s == given))
        return sorted(n for s in found for n in self.names[s])

    def take(self, name: str, table: Table) -> None:
        self.names[frozenset(table.columns)].pop(name)


def _split(pre, post, gone, new):
    """A table that is gone whose columns several new ones divide, all sharing a key."""
    out, kept, index, taken = [], [], Containment((a, post[a]) for a in new), set()
    for t in gone:
        names = set(pre[t].columns)
        parts = index.within(names, strictly=True)
        shared = set.intersection(names, *(set(post[a].columns) for a in parts))
        if len(parts) >= 2 and shared and names <= set().union(*(post[a].columns for a in parts)):
            out.append({"op": "TABLE_SPLIT", "source": t, "targets": parts, "key": pre[t].written(min(shared))})
            for a in parts:
                index.take(a, post[a])
            taken.update(parts)
        else:
            kept.append(t)
    return out, kept, [a for a in new if a not in taken]


def _merged(pre, post, gone, new):
    """A new table whose columns are those of several that are gone, all sharing a key."""
    out, kept, index, taken = [], [], Containment((r, pre[r]) for r in gone), set()
    for t in new:
        names = set(post[t].columns)
        parts = index.within(names)
        shared = set.intersection(names, *(set(pre[r].columns) for r in parts))
        if len(parts) >= 2 and shared and names <= set().union(*(pre[r].columns for r in parts)):
            out.append({"op": "TABLE_MERGE", "sources": parts, "target": t, "key": pre[parts[0]].written(min(shared))})
            for r in parts:
                index.take(r, pre[r])
            taken.update(parts)
        else:
            kept.append(t)
    return out, [r for r in gone if r not in taken], kept


def containment(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """The same for catalogs of any size: outer_table and inner_table for each table of inner whose columns are all among those of a table of
    outer, without case. Each inner table is joined by its rarest column alone, and what that finds is compared as sets."""
    columns = lambda df: df.select("table_name", F.lower("column_name").alias("c")).distinct()
    a, b = columns(outer), columns(inner)
    rarest = b.join(b.groupBy("c").agg(F.count("*").alias("n")), "c").groupBy("table_name").agg(F.min(F.struct("n", "c"))["c"].alias("c"), F.collect_list("c").alias("needs"))
    sets = a.groupBy("table_name").agg(F.collect_list("c").alias("has"))
    pairs = rarest.select(F.col("table_name").alias("inner_table"), "c", "needs").join(a.select(F.col("table_name").alias("outer_table"), "c"), "c")
    held = pairs.join(sets.withColumnRenamed("table_name", "outer_table"), "outer_table")
    return held.where(F.size(F.array_except("needs", "has")) == 0).select("outer_table", "inner_table")


def _columns(pre: Table, post: Table, name: str, strict_merge: bool, merges: bool = True) -> Iterator[dict]:
    gone, new = sorted(set(pre.columns) - set(post.columns)), sorted(set(post.columns) - set(pre.columns))
    if not (strict_merge and len(gone) >= 2 and len(new) == 1):
        by_type = defaultdict(list)
        for c in new:
            by_type[post.columns[c][1]].append(c)
        for c in list(gone):
            same = by_type[pre.columns[c][1]]
            if len(same) == 1:
                to = same.pop()
                yield {"op": "COLUMN_RENAME", "table": name, "from": pre.written(c), "to": post.written(to)}
                gone.remove(c)
                new.remove(to)
    if merges and len(gone) >= 2 and len(new) == 1:
        yield {"op": "COLUMN_MERGE", "table": name, "sources": sorted(map(pre.written, gone)), "target": post.written(new[0])}
        return
    yield from ({"op": "COLUMN_REMOVE", "table": name, "column": pre.written(c)} for c in gone)
    yield from ({"op": "COLUMN_ADD", "table": name, "column": post.written(c)} for c in new)


def events_frame(spark, events: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(e.get(f) for f in FIELDS) for e in events], EVENTS)


def events_text(events: list[dict]) -> str:
    return "\n".join(json.dumps(e) for e in events)


def hashed(tables: dict[str, Table]) -> str:
    """The fingerprint of a schema that is at hand, as fingerprint() makes it from a catalog."""
    named = sorted([(name.lower(), t.text) for name, t in tables.items()])
    return hashlib.sha256("$$".join([f"{n}:{columns}" for n, columns in named]).encode()).hexdigest()


def first_renamed(tables: dict[str, Table], to: str = "renamed") -> dict[str, Table]:
    """A schema whose first table, by name, has another: the least change that can be timed on schemas of any size."""
    first = min(tables, default=None)
    return {to if t == first else t: x for t, x in tables.items()}


def difference_of_pairs(catalogs: DataFrame, key: str = "pair") -> DataFrame:
    """Events of many schema pairs: catalogs holds key, side ("pre" or "post") and a catalog's columns. A pair's catalog is
    metadata of one schema, which is what a task holds at a time."""

    def run(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        side = {s: tables_of(x[["table_name", "column_name", "data_type", "ordinal"]].itertuples(index=False)) for s, x in rows.groupby("side")}
        events = difference(side.get("pre", {}), side.get("post", {}))
        return pd.DataFrame([(names[0], i, json.dumps(e, sort_keys=True)) for i, e in enumerate(events)], columns=[key, "place", "event"])

    kind = catalogs.schema[key].dataType.simpleString()
    return catalogs.groupBy(key).applyInPandas(run, f"{key} {kind}, place int, event string")


SNAPSHOT = "name string, version bigint, at timestamp, fingerprint string, tables string"


class Snapshots:
    """Schemas seen under each name, as a table that grows by one file a change. A file is there whole or not at all, and the last version
    counts, so looks from other processes see the last one that was put, and never half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(SNAPSHOT).parquet(self.path) if system.exists(place) else self.spark.createDataFrame([], SNAPSHOT)

    def last(self, name: str) -> tuple[int, str, dict[str, Table]] | None:
        """Version, fingerprint and tables of the last snapshot; of two writers' with one version the later one."""
        row = self._rows().where(F.col("name") == name).orderBy(F.desc("version"), F.desc("at"), "fingerprint").first()
        return None if row is None else (row.version, row.fingerprint, tables_of(tuple(r) for r in json.loads(row.tables)))

    def put(self, name: str, version: int, fingerprint: str, tables: dict[str, Table]) -> None:
        rows = [(t, c, kind, i) for t, x in tables.items() for i, (c, kind) in enumerate(x.columns.values())]
        self.spark.createDataFrame([(name, version, datetime.now(), fingerprint, json.dumps(rows))], SNAPSHOT).coalesce(1).write.mode("append").parquet(self.path)

    def history(self, name: str) -> DataFrame:
        return self._rows().where(F.col("name") == name).select("version", "at", "fingerprint").orderBy("version", "at")


class SchemaCache:
    """The last schema seen under each name; the first look at one counts as a change from nothing. With a table of snapshots, looks of
    other sessions count as well."""

    def __init__(self, kept: Snapshots | None = None) -> None:
        self.seen: dict[str, tuple[int, str, dict[str, Table]]] = {}
        self.kept = kept

    def look(self, name: str, catalog: DataFrame) -> dict:
        print_, tables = fingerprint(catalog).first(), _collect(catalog)
        now = print_["fingerprint"] if print_ else ""
        version, before, old = (self.kept.last(name) if self.kept else self.seen.get(name)) or (0, "", None)
        self.seen[name] = (version + 1, now, tables)
        if self.kept and before != now:
            self.kept.put(name, version + 1, now, tables)
        return {"pre_fingerprint": before, "post_fingerprint": now, "changed": before != now, "events": [] if old is None or before == now else difference(old, tables)}
