import json

import pytest

from driftline.operators import evolve
from driftline.plans import schema
from driftline.sources import catalog

OLD = {"vessel": [("Vessel_ID", "INTEGER"), ("Label", "TEXT"), ("Flag", "TEXT"), ("Built", "INTEGER")], "dock": [("Dock_ID", "INTEGER"), ("Yard_ID", "INTEGER")]}


def tables(d):
    return schema.tables_of((t, c, k, i) for t, cs in d.items() for i, (c, k) in enumerate(cs))


def diff(a, b, **how):
    return schema.difference(tables(a), tables(b), **how)


def test_same_schema_has_no_events():
    assert diff(OLD, OLD) == []


def test_rename_of_a_table_as_it_is():
    assert diff(OLD, {"boat": OLD["vessel"], "dock": OLD["dock"]}) == [{"op": "TABLE_RENAME", "from": "vessel", "to": "boat"}]


def test_two_candidates_are_no_exact_rename():
    new = {"a": OLD["vessel"], "b": OLD["vessel"], "dock": OLD["dock"]}
    events = diff(OLD, new)
    assert events == [{"op": "TABLE_RENAME", "from": "vessel", "to": "a"}, {"op": "TABLE_ADD", "table": "b"}]


def test_rename_of_a_table_with_a_column():
    new = {"boat": [("Vessel_ID", "INTEGER"), ("Label", "TEXT"), ("State", "TEXT"), ("Built", "INTEGER")], "dock": OLD["dock"]}
    assert diff(OLD, new) == [{"op": "TABLE_RENAME", "from": "vessel", "to": "boat"}, {"op": "COLUMN_RENAME", "table": "boat", "from": "Flag", "to": "State"}]


def test_split():
    new = {"info": [("Vessel_ID", "INTEGER"), ("Label", "TEXT")], "more": [("Vessel_ID", "INTEGER"), ("Flag", "TEXT"), ("Built", "INTEGER")], "dock": OLD["dock"]}
    assert diff(OLD, new) == [{"op": "TABLE_SPLIT", "source": "vessel", "targets": ["info", "more"], "key": "Vessel_ID"}]


def test_merge():
    old = {"dock": [("Dock_ID", "INTEGER"), ("Depth", "TEXT")], "cast": [("Dock_ID", "INTEGER"), ("Vessel_ID", "INTEGER")]}
    new = {"show": [("Dock_ID", "INTEGER"), ("Depth", "TEXT"), ("Vessel_ID", "INTEGER")]}
    assert diff(old, new) == [{"op": "TABLE_MERGE", "sources": ["cast", "dock"], "target": "show", "key": "Dock_ID"}]


def test_columns_of_a_table_in_both():
    new = {"vessel": [("Vessel_ID", "INTEGER"), ("Full", "TEXT"), ("Fee", "REAL")], "dock": OLD["dock"]}
    assert diff(OLD, new) == [
        {"op": "COLUMN_RENAME", "table": "vessel", "from": "Flag", "to": "Full"},
        {"op": "COLUMN_MERGE", "table": "vessel", "sources": ["Built", "Label"], "target": "Fee"},
    ]


def test_strict_merge_comes_before_renames():
    new = {"vessel": [("Vessel_ID", "INTEGER"), ("Label_Flag", "TEXT"), ("Built", "INTEGER")], "dock": OLD["dock"]}
    assert [e["op"] for e in diff(OLD, new)] == ["COLUMN_RENAME", "COLUMN_REMOVE"]
    assert diff(OLD, new, strict_merge=True) == [{"op": "COLUMN_MERGE", "table": "vessel", "sources": ["Flag", "Label"], "target": "Label_Flag"}]


def test_a_changed_type_alone_is_no_event_but_changes_the_fingerprint(spark):
    new = {"vessel": [("Vessel_ID", "INTEGER"), ("Label", "TEXT"), ("Flag", "TEXT"), ("Built", "REAL")], "dock": OLD["dock"]}
    assert diff(OLD, new) == []
    prints = [schema.fingerprint(catalog.from_columns(spark, d)).first().fingerprint for d in (OLD, new)]
    assert prints[0] != prints[1]


def test_fingerprint_ignores_case_and_order(spark):
    shuffled = {"DOCK": OLD["dock"][::-1], "Vessel": OLD["vessel"][::-1]}
    prints = {schema.fingerprint(catalog.from_columns(spark, d)).first().fingerprint for d in (OLD, shuffled)}
    assert len(prints) == 1


SPECS = [
    [{"op": "TABLE_RENAME", "from": "customer", "to": "client"}],
    [{"op": "COLUMN_RENAME", "table": "customer", "from": "c_acctbal", "to": "balance"}],
    [{"op": "TABLE_SPLIT", "source": "orders", "key": "o_orderkey", "partition": {"a": ["o_custkey", "o_orderstatus", "o_orderdate"], "b": ["o_totalprice", "o_orderpriority"]}}],
    [{"op": "TABLE_MERGE", "sources": ["supplier", "partsupp"], "key": "s_suppkey", "target": "source"}],
    [{"op": "COLUMN_MERGE", "table": "customer", "sources": ["c_name", "c_mktsegment"], "target": "label", "expression": "c_name || ' - ' || c_mktsegment"}],
]


@pytest.mark.parametrize("specs", SPECS, ids=lambda s: s[0]["op"])
def test_classified_events_are_what_was_applied(spark, specs):
    held = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("customer", "orders", "supplier")}
    held["partsupp"] = spark.createDataFrame([(1, 5)], "s_suppkey bigint, ps_qty int")
    after, made = evolve.apply(held, specs)
    events = schema.difference(catalog.describe(spark, held), catalog.describe(spark, after), strict_merge=True)
    assert events == made.events


def test_pairs_side_by_side(spark):
    new = {"boat": OLD["vessel"], "dock": OLD["dock"]}
    from pyspark.sql import functions as F

    side = lambda d, s, p: catalog.from_columns(spark, d).withColumn("side", F.lit(s)).withColumn("pair", F.lit(p))
    both = side(OLD, "pre", 1).unionByName(side(new, "post", 1)).unionByName(side(OLD, "pre", 2)).unionByName(side(OLD, "post", 2))
    got = schema.difference_of_pairs(both).collect()
    assert [(r.pair, json.loads(r.event)["op"]) for r in got] == [(1, "TABLE_RENAME")]


def test_cache_counts_the_first_look_as_a_change(spark):
    cache, first = schema.SchemaCache(), catalog.from_columns(spark, OLD)
    assert cache.look("db", first) | {"post_fingerprint": ""} == {"pre_fingerprint": "", "post_fingerprint": "", "changed": True, "events": []}
    assert not cache.look("db", first)["changed"]
    later = cache.look("db", catalog.from_columns(spark, {"boat": OLD["vessel"], "dock": OLD["dock"]}))
    assert later["changed"] and later["events"][0]["op"] == "TABLE_RENAME"


def test_many_splits_and_merges_are_found_quickly():
    """1,000 gone and 2,000 new tables that all share a column, split and merged, in well under the time of comparing all with all."""
    import time

    whole = {f"w{k}": [("id", "INTEGER"), (f"a{k}", "TEXT"), (f"b{k}", "REAL")] for k in range(1000)}
    parts = {f"p{k}_{c}": [("id", "INTEGER"), (f"{c}{k}", "TEXT" if c == "a" else "REAL")] for k in range(1000) for c in "ab"}
    whole, parts = tables(whole), tables(parts)
    for old, new, op in ((whole, parts, "TABLE_SPLIT"), (parts, whole, "TABLE_MERGE")):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            events = schema.difference(old, new)
            took.append(time.perf_counter() - began)
        assert len(events) == 1000 and {e["op"] for e in events} == {op}
        assert min(took) < 0.1


def test_the_index_finds_what_comparing_all_finds():
    import random

    rng = random.Random(4)
    made = {f"t{k}": [(c, "INTEGER") for c in rng.sample("abcdefgh", rng.randint(1, 5))] for k in range(60)}
    held = tables(made)
    index = schema.Containment(held.items())
    for t in held.values():
        for strictly in (False, True):
            want = sorted(n for n, x in held.items() if set(x.columns) <= set(t.columns) and not (strictly and set(x.columns) == set(t.columns)))
            assert index.within(t.columns, strictly) == want


def test_containment_of_catalogs(spark):
    outer = catalog.from_columns(spark, {"w": [("ID", "int"), ("a", "int"), ("b", "int")], "v": [("id", "int")]})
    inner = catalog.from_columns(spark, {"x": [("id", "int"), ("A", "int")], "y": [("id", "int")], "z": [("id", "int"), ("c", "int")]})
    got = {tuple(r) for r in schema.containment(outer, inner).collect()}
    assert got == {("w", "x"), ("w", "y"), ("v", "y")}
    assert not schema.containment(outer, inner.limit(0)).count()
