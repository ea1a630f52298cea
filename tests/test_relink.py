import pytest

from driftline.plans.mutate import drop_where, label, mutants, shift_limit, stale_merge_filter, swap_aggregate, wrong_column, wrong_join_key
from driftline.plans.keys import facts
from driftline.plans.relink import compatible_views, guidance, relink, rewrite, same_plan, with_old_tables
from driftline.plans.validate import complexity
from driftline.queries import QUERIES

TABLE = {"op": "TABLE_RENAME", "from": "vessel", "to": "boat"}
COLUMN = {"op": "COLUMN_RENAME", "table": "boat", "from": "Label", "to": "sign"}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT Label FROM vessel", "SELECT sign FROM boat"),
        ("SELECT vessel.Label FROM Vessel WHERE vessel.Built > 3", "SELECT boat.sign FROM boat WHERE boat.Built > 3"),
        ("SELECT T1.Label, T2.Label FROM vessel AS T1 JOIN yard AS T2 ON T1.id = T2.id", "SELECT T1.sign, T2.Label FROM boat AS T1 JOIN yard AS T2 ON T1.id = T2.id"),
        ("SELECT Label FROM yard", "SELECT Label FROM yard"),
        ("SELECT 'Label' FROM vessel -- Label", "SELECT 'Label' FROM boat -- Label"),
        ("SELECT x FROM t WHERE id IN (SELECT id FROM vessel s WHERE s.Label = t.Label)", "SELECT x FROM t WHERE id IN (SELECT id FROM boat s WHERE s.sign = t.Label)"),
        ("SELECT count(*) AS Label FROM vessel GROUP BY Label", "SELECT count(*) AS Label FROM boat GROUP BY sign"),
        ("WITH c AS (SELECT Label FROM vessel) SELECT * FROM c", "WITH c AS (SELECT sign FROM boat) SELECT * FROM c"),
        ("SELECT Label FROM vessel UNION ALL SELECT Label FROM yard", "SELECT sign FROM boat UNION ALL SELECT Label FROM yard"),
    ],
)
def test_rewrite(sql, want):
    assert rewrite(sql, [TABLE, COLUMN]) == want


def test_chained_and_swapped_renames_happen_at_once():
    swap = [{"op": "TABLE_RENAME", "from": "a", "to": "b"}, {"op": "TABLE_RENAME", "from": "b", "to": "a"}]
    assert rewrite("SELECT a.x FROM a JOIN b ON a.k = b.k", swap) == "SELECT b.x FROM b JOIN a ON b.k = a.k"


PRE = {"vessel": [("id", "int"), ("Label", "string"), ("age", "int")], "dock": [("id", "int"), ("Label", "string")], "pet": [("id", "int"), ("kind", "string")]}
POST = {"boat": [("id", "int"), ("Call Sign", "string"), ("age", "int")], "dock": PRE["dock"], "pet": PRE["pet"]}
STAGE = {"op": "COLUMN_RENAME", "table": "boat", "from": "Label", "to": "Call Sign"}
FRONT = "WITH vessel AS (SELECT id, `Call Sign` AS Label, age FROM boat)"


@pytest.mark.parametrize(
    ("sql", "method"),
    [
        ("SELECT Label, count(*) FROM vessel s WHERE age > 3 GROUP BY Label HAVING count(*) > 1 ORDER BY Label", "ast"),
        ("WITH vessel AS (SELECT id, Label FROM dock) SELECT Label FROM vessel", "ast"),
        ("SELECT x.Label FROM (SELECT Label FROM vessel) x", "ast"),
        ("SELECT (SELECT MAX(Label) FROM dock) FROM vessel", "ast"),
        ("SELECT id FROM vessel WHERE EXISTS (SELECT 1 FROM pet WHERE kind > Label)", "ast"),
        ("SELECT Label FROM pet LATERAL VIEW explode(array('x')) v AS Label", "ast"),
        ("SELECT id FROM dock WHERE id IN (SELECT s.id FROM vessel s WHERE s.Label = dock.Label)", "ast"),
        ("SELECT t.Label FROM (SELECT * FROM vessel) t", "views"),
        ("SELECT Label FROM (SELECT * FROM vessel)", "views"),
        ("SELECT vessel.age FROM vessel JOIN dock USING (Label)", "views"),
        ("SELECT age FROM vessel NATURAL JOIN dock", "views"),
        ("SELECT count(*) AS Label FROM vessel GROUP BY Label ORDER BY Label", "views"),
        ("WITH vessel AS (SELECT * FROM vessel WHERE age > 3) SELECT Label FROM vessel", "views"),
        ("WITH a AS (SELECT Label, id FROM vessel), b(n) AS (SELECT Label FROM a) SELECT n FROM b", "views"),
        ("SELECT Label FROM vessel UNION ALL SELECT kind FROM pet", "ast"),
        ("SELECT a.Label FROM vessel a, vessel b WHERE a.id = b.age", "ast"),
    ],
)
def test_nested_names_mean_what_they_meant(spark, sql, method):
    """On rows: the old text on the old tables against the new one on the new tables."""
    data = {"vessel": [(1, "a", 5), (2, "b", 2), (3, "b", 9)], "dock": [(1, "b"), (2, "z")], "pet": [(1, "cat"), (2, "dog")]}
    got = relink(spark, sql, [TABLE, STAGE], pre=PRE, post=POST)
    assert got["method"] == method

    def run(text, tables, names):
        own = spark.newSession()
        for name, rows in zip(names, data.values(), strict=True):
            own.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in tables[name])).createOrReplaceTempView(name)
        return sorted(map(tuple, own.sql(text).collect()))

    assert run(sql, PRE, ["vessel", "dock", "pet"]) == run(got["sql"], POST, ["boat", "dock", "pet"])


def test_swapped_tables_are_defined_behind_one_another(spark):
    events = [{"op": "TABLE_RENAME", "from": "a", "to": "b"}, {"op": "TABLE_RENAME", "from": "b", "to": "a"}]
    columns = {"a": [("x", "int")], "b": [("x", "int")]}
    got = relink(spark, "SELECT (SELECT max(x) FROM a), (SELECT max(x) FROM b)", events, pre=columns, post=columns)
    assert got == {"sql": "SELECT (SELECT max(x) FROM b), (SELECT max(x) FROM a)", "method": "ast", "applied": events}
    text = with_old_tables("SELECT a.x, b.x FROM a, b", events, columns | {"a": [("x", "int"), ("y", "int")]}, columns)
    assert text == "WITH a_before AS (SELECT x FROM b), b_before AS (SELECT x FROM a), a AS (SELECT * FROM a_before), b AS (SELECT * FROM b_before) SELECT a.x, b.x FROM a, b"


def test_names_with_a_database(spark):
    got = relink(spark, "SELECT db.vessel.Label FROM db.vessel", [TABLE, STAGE], pre=PRE, post=POST)
    assert got["sql"] == "SELECT db.boat.`Call Sign` FROM db.boat"
    assert with_old_tables("SELECT * FROM db.vessel", [TABLE, STAGE], PRE, POST) is None


def test_a_plan_tells_wrong_texts_from_right_ones(spark):
    events = [TABLE, STAGE]
    assert same_plan(spark, "SELECT Label FROM vessel", "SELECT `Call Sign` FROM boat", events, PRE, POST)
    assert same_plan(spark, "SELECT Label FROM vessel", "SELECT Label FROM dock", events, PRE, POST) is False
    assert same_plan(spark, "SELECT id FROM vessel", "SELECT id FROM pet", events, PRE, POST) is False
    assert same_plan(spark, "SELECT Label FROM vessel", "SELECT Label FROM boat", events, PRE, POST) is False
    assert same_plan(spark, "SELECT nope FROM vessel", "SELECT nope FROM boat", events, PRE, POST) is None


def test_added_columns_do_not_matter_unless_all_are_read(spark):
    wider = POST | {"boat": [*POST["boat"], ("born", "date")]}
    assert relink(spark, "SELECT Label FROM vessel", [TABLE, STAGE], pre=PRE, post=wider)["method"] == "ast"
    got = relink(spark, "SELECT * FROM vessel", [TABLE, STAGE], pre=PRE, post=wider)
    assert got["sql"] == FRONT + " SELECT * FROM vessel"


@pytest.mark.parametrize(("second", "dropped"), [([1, 2, 3], True), ([1, 2, 3, 4], True), ([1, 2], False), ([1, 2, 3, 3], False), ([1, 2, 3, None], False)])
def test_a_part_is_left_out_only_if_keys_allow_it(spark, second, dropped):
    event = {"op": "TABLE_SPLIT", "source": "t", "targets": ["a", "b"], "key": "id"}
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, x int")
    b = spark.createDataFrame([(k, 0) for k in second], "id int, y int")
    found = facts({"a": a, "b": b}, [event])
    view = compatible_views([event], {"t": ["id", "x", "y"]}, {"a": ["id", "x"], "b": ["id", "y"]}, {"x"}, found)["t"]
    assert ("JOIN" not in view) == dropped
    got = spark.sql(view.replace("FROM a", "FROM {a} AS a").replace("JOIN b", "JOIN {b} AS b"), a=a, b=b)
    whole = spark.sql("SELECT a.id, a.x FROM {a} AS a JOIN {b} AS b ON a.id = b.id", a=a, b=b)
    assert sorted(got.collect()) == sorted(whole.collect())


def test_null_keys_of_the_part_in_use_keep_the_join(spark):
    event = {"op": "TABLE_SPLIT", "source": "t", "targets": ["a", "b"], "key": "id"}
    a, b = spark.createDataFrame([(1, 1), (None, 2)], "id int, x int"), spark.createDataFrame([(1, 1)], "id int, y int")
    assert not facts({"a": a, "b": b}, [event]).matched_once("a", "b")
    empty = facts({"a": a.limit(0), "b": b}, [event])
    assert empty.matched_once("a", "b") and empty.unique == {"a", "b"}


@pytest.mark.parametrize(("keys_", "plain"), [([1, 2, 3], True), ([1, 1, 2], False), ([1, None], False)])
def test_merged_parts_are_distinct_unless_the_key_is_unique(spark, keys_, plain):
    event = {"op": "TABLE_MERGE", "sources": ["a", "b"], "target": "m", "key": "id"}
    found = facts({"m": spark.createDataFrame([(k, 1, 2) for k in keys_], "id int, x int, y int")}, [event])
    view = compatible_views([event], {"a": ["id", "x"]}, {"m": ["id", "x", "y"]}, None, found)["a"]
    assert view == f"SELECT {'' if plain else 'DISTINCT '}id, x FROM m"


def test_plans_of_split_tables(spark):
    root = "/root/testdata/sf0.001"
    plan = lambda name: QUERIES[name](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("relink_split_unique") and "Project [o_orderstatus" in plan("relink_split_unique")
    assert "Join Inner" in plan("relink_split_repeated")


def test_methods(spark):
    assert relink(spark, "SELECT 1", [])["method"] == "noop"
    assert relink(spark, "SELEC FROM", [TABLE])["method"] == "parse_error"
    got = relink(spark, "SELECT Label FROM vessel", [TABLE, COLUMN])
    assert got == {"sql": "SELECT sign FROM boat", "method": "ast", "applied": [TABLE, COLUMN]}
    split = {"op": "TABLE_SPLIT", "source": "x", "targets": ["a", "b"], "key": "id"}
    assert relink(spark, "SELECT Label FROM vessel", [TABLE, split])["method"] == "ast"
    calls = []
    got = relink(spark, "SELECT Label FROM vessel", [TABLE, split], "schema", lambda s, e, t: calls.append(s) or "SELECT 2")
    assert got["method"] == "llm" and calls == ["SELECT Label FROM boat"]


def test_guidance_names_the_separator():
    event = {"op": "COLUMN_MERGE", "table": "t", "sources": ["a", "b"], "target": "ab", "expression": "a || ' - ' || b"}
    assert "ab LIKE 'X - %'" in guidance([event]) and "ab LIKE '% - Y'" in guidance([event])
    assert guidance([TABLE]) == ""


def test_views_join_only_what_is_used():
    event = {"op": "TABLE_SPLIT", "source": "t", "targets": ["a", "b"], "key": "id"}
    pre, post = {"t": ["id", "x", "y"]}, {"a": ["id", "x"], "b": ["id", "y"]}
    assert compatible_views([event], pre, post, {"x"})["t"] == "SELECT a.id, a.x FROM a"
    assert "JOIN b ON a.id = b.id" in compatible_views([event], pre, post)["t"]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a FROM t", "easy"),
        ("SELECT count(*) FROM t", "medium"),
        ("SELECT a FROM t JOIN u ON t.k = u.k", "medium"),
        ("SELECT a FROM t, u", "medium"),
        ("SELECT a FROM t JOIN u ON t.k = u.k JOIN v ON u.k = v.k", "hard"),
        ("SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > 1", "hard"),
        ("SELECT a FROM t WHERE a IN (SELECT b FROM u)", "hard"),
    ],
)
def test_complexity(spark, sql, want):
    assert complexity(spark, sql) == want


def test_mutants():
    assert drop_where("SELECT a FROM t WHERE a > 1 ORDER BY a") == [("drop_where", "SELECT a FROM t ORDER BY a")]
    assert swap_aggregate("SELECT min(a), avg(b) FROM t") == [("swap_agg_min", "SELECT MAX(a), avg(b) FROM t"), ("swap_agg_avg", "SELECT min(a), MAX(b) FROM t")]
    assert wrong_column("SELECT t.a FROM t", {"t": ["a", "b"]}) == [("wrong_column", "SELECT t.b FROM t")]
    assert shift_limit("SELECT a FROM t LIMIT 1") == [("limit_minus_one", "SELECT a FROM t LIMIT 0"), ("limit_plus_one", "SELECT a FROM t LIMIT 2")]
    assert shift_limit("SELECT a FROM t;") == [("spurious_limit_one", "SELECT a FROM t LIMIT 1")]
    assert wrong_join_key("SELECT x.a FROM t x JOIN u y ON x.k = y.k", {"u": ["k", "z"]}) == [("wrong_join_key", "SELECT x.a FROM t x JOIN u y ON x.k = y.z")]
    assert len(stale_merge_filter("SELECT ab FROM t", [{"op": "COLUMN_MERGE", "table": "t", "target": "ab"}])) == 1
    assert mutants("SELECT a FROM t", {}) == []


def test_labels_are_verified_on_rows(spark):
    spark.createDataFrame([(1, 5), (2, 6)], "a int, b int").createOrReplaceTempView("t")
    items = [{"id": "q", "question": "list a", "gold_post": "SELECT a FROM t WHERE a > 1"}, {"id": "r", "question": "", "gold_post": "SELECT nope FROM t"}]
    got = label(spark, items, {"t": ["a", "b"]})
    assert [(c["label"], c["mutation"]) for c in got] == [("valid", "none"), ("silent_failure", "drop_where"), ("silent_failure", "wrong_column")]
