"""The evaluation run with generators that know one schema, know both, or learn from errors."""

import json

import pytest

from driftline.functions import stats
from driftline.operators import evaluate, evolve
from driftline.plans import answers, workload
from driftline.plans.mutate import label_counts, label_frame, same_answer
from driftline.sources import catalog, fixtures, results

ITEMS = [
    {"id": "a", "question": "list the name of staff", "gold_pre": "SELECT name FROM employee", "gold_post": "SELECT name FROM staff", "perturbation": "TABLE_RENAME", "touches": ["employee"]},
    {"id": "b", "question": "how many towns are there", "gold_pre": "SELECT COUNT(*) FROM town", "gold_post": "SELECT COUNT(*) FROM town", "perturbation": "NONE", "touches": []},
    {"id": "c", "question": "list what was lost", "gold_pre": "SELECT age FROM employee", "gold_post": None, "perturbation": "TABLE_RENAME", "touches": [], "expected_failure": True, "failure_reason": "gone"},
]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "employee": spark.createDataFrame([(1, "Ann", 30), (2, "Bob", 41)], "id int, name string, age int"),
        "town": spark.createDataFrame([(1, "Rome"), (2, "Oslo")], "town_id int, place string"),
    }


@pytest.fixture(scope="module")
def later(tables):
    return evolve.apply(tables, [{"op": "TABLE_RENAME", "from": "employee", "to": "staff"}])[0]


def rows(frame):
    return {r.id: r for r in frame.collect()}


def stale(prompt):
    return next(i["gold_pre"] for i in ITEMS if f"Question: {i['question']}" in prompt)


def learns(prompt):
    """Knows the old names, but reads an error, or the new schema."""
    sql = stale(prompt)
    return (sql.replace("employee", "staff") if "failed" in prompt or "TABLE staff" in prompt else sql), "mock-after-x" if "failed" in prompt else "x"


def test_arms(spark, tables, later):
    got = rows(workload.evaluate_items(spark, ITEMS, tables, later, stale))
    a = got["a"]
    assert (a.pre_ok, a.baseline_ok, a.refreshed_schema_ok, a.error_feedback_ok, a.mcp_ok) == (1, 0, 0, 0, 1)
    assert (a.error_feedback_retry, a.mcp_method, a.mcp_verdict, a.recovered, a.degraded) == (1, "ast", "valid", 1, 0)
    assert "TABLE_OR_VIEW_NOT_FOUND" in a.error_feedback_error and a.mcp_sql == "SELECT name FROM staff"
    assert got["b"].baseline_ok == got["b"].mcp_ok == 1 and got["b"].error_feedback_retry == 0 and got["b"].recovered == 0
    assert got["c"].mcp_ok is None and got["c"].expected_failure and got["c"].failure_reason == "gone"
    assert got["a"].latency_mcp_s > 0


def test_a_retry_sees_the_old_schema_and_the_error(spark, tables, later):
    prompts = []

    def generate(prompt):
        prompts.append(prompt)
        return learns(prompt)

    got = rows(workload.evaluate_items(spark, ITEMS[:1], tables, later, generate))["a"]
    assert (got.baseline_ok, got.refreshed_schema_ok, got.error_feedback_ok, got.mcp_ok) == (0, 1, 1, 1)
    assert got.error_feedback_backend == "mock-after-x" and got.backend == "x"
    retry = next(p for p in prompts if "failed" in p)
    assert "TABLE employee" in retry and "TABLE staff" not in retry


def test_seeds_and_resuming(spark, tables, later):
    got = workload.evaluate_items(spark, ITEMS, tables, later, stale, seeds=2)
    assert sorted((r.id, r.seed) for r in got.collect()) == [(i, k) for i in "abc" for k in (0, 1)]
    done = got.where("id = 'a'")
    assert set(rows(workload.evaluate_items(spark, ITEMS, tables, later, stale, done=done))) == {"b", "c"}
    assert workload.evaluate_items(spark, [], tables, later, stale).count() == 0


def test_an_empty_answer_is_asked_for_again_with_the_rules(spark):
    pre = {"person": spark.createDataFrame([("Ann", "Lee"), ("Bob", "Ray")], "first string, last string")}
    post = evolve.merge_columns(pre, "person", ["first", "last"], "full", "first || ' ' || last")
    cues = []

    def generate(prompt):
        if "part of a merged column" in prompt:
            cues.append(prompt)
            return "SELECT full FROM person WHERE full LIKE 'Ann%'"
        return "SELECT full FROM person WHERE full = 'Ann'" if "COLUMN_MERGE" in prompt else "SELECT first FROM person WHERE first = 'Ann'"

    item = {"id": "m", "question": "show the full person first Ann", "gold_pre": "SELECT first FROM person WHERE first = 'Ann'", "gold_post": "SELECT full FROM person WHERE full LIKE 'Ann%'", "perturbation": "COLUMN_MERGE"}
    got = rows(workload.evaluate_items(spark, [item], pre, post, generate, strict_merge=True))["m"]
    assert len(cues) == 1 and got.mcp_ok == 1 and got.mcp_verdict == "valid"


def test_exec_match(spark, tables):
    match = lambda a, b: workload.exec_match(spark, a, b, tables)
    assert match("SELECT name FROM employee ORDER BY name DESC", "SELECT name FROM employee")
    assert not match("SELECT name FROM employee LIMIT 1", "SELECT name FROM employee")
    assert not match("SELECT nope FROM employee", "SELECT name FROM employee") and not match("SELECT name FROM employee", None)
    assert not match("SELECT 1 / 0", "SELECT 1 / 0") and not match("", "SELECT 1")
    assert not match("SELECT CAST(1 AS DOUBLE)", "SELECT 1")  # types count
    assert "employee" not in [t.name for t in spark.catalog.listTables()]


def test_summary_and_reports(spark, tables, later, tmp_path):
    run = workload.evaluate_items(spark, ITEMS, tables, later, learns)
    got = results.summary(run)
    assert got["overall"]["n"] == 2 and got["overall"]["mediated_ex"] == 1.0 and got["operators"]["TABLE_RENAME"]["recovered"] == 1
    assert got["contamination"]["contaminated"] >= 1 and got["expected_failures"]["TABLE_RENAME"]["n"] == 1
    results.write_json(got, f"{tmp_path}/summary.json")
    assert json.loads((tmp_path / "summary.json").read_text())["overall"]["n"] == 2
    table = results.markdown(run.select("id", "mcp_ok").orderBy("id"))
    assert table.splitlines() == ["| id | mcp_ok |", "| - | - |", "| a | 1 |", "| b | 1 |", "| c |  |"]
    with pytest.raises(ValueError):
        results.markdown(spark.range(5), 4)
    path = results.write(run, f"{tmp_path}/rows")
    assert path.endswith("_contaminated")
    again = results.resume(spark, path, workload.ROW)
    assert {r.id for r in results.pending(spark.createDataFrame([("a",), ("z",)], "id string"), again).collect()} == {"z"}


def test_silent_failures_and_buckets(spark):
    scored = [("A", 0, 0, 1, 0, 1, "silent_failure"), ("A", 0, 0, 1, 0, 0, "valid"), ("A", 0, 1, 1, 1, 1, "valid"), ("B", 1, 0, 0, 0, 0, "silent_failure")]
    frame = spark.createDataFrame(scored, "perturbation string, expected_failure int, baseline_ok int, refreshed_schema_ok int, error_feedback_ok int, mcp_ok int, mcp_verdict string")
    assert tuple(evaluate.silent_detection(frame).first()) == (1, 1, 0.5)
    got = evaluate.by_bucket(evaluate.scored(frame), "perturbation").first()
    assert (got.n, got.ex_stale, got.ex_mediated, got.rr_mediated, got.rr_error_feedback) == (3, 0.3333, 0.6667, 0.5001, 0.0)


def test_bootstrap_of_recovery(spark):
    import random

    rng = random.Random(4)
    held = [(int(rng.random() < 0.3), int(rng.random() < 0.9), int(rng.random() < 0.7)) for _ in range(60)]
    exact = stats.bootstrap_recovery_exact(held, 300, seed=3)
    rng, found = random.Random(3), []
    for _ in range(300):
        sample = [held[rng.randrange(60)] for _ in range(60)]
        s, f, a = (sum(r[k] for r in sample) / 60 for k in range(3))
        found.append((a - s) / (f - s))
    found.sort()
    assert (exact["lower"], exact["upper"], exact["degenerate"]) == (round(found[7], 4), round(found[292], 4), 0)
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(held)], "id int, s int, f int, a int")
    got = stats.bootstrap_recovery(frame, "id", *(stats.F.col(c) for c in "sfa"), 2000).first()
    assert got.point == exact["point"] and abs(got.lower - exact["lower"]) < 0.1 and abs(got.upper - exact["upper"]) < 0.1
    assert stats.bootstrap_recovery_exact([(1, 1, 1)] * 3, 10) == {"n_boot": 10, "degenerate": 10, "point": None, "lower": None, "upper": None}
    assert stats.bootstrap_recovery_exact([], 10)["degenerate"] == 10


def test_labels_compare_in_order_where_the_query_orders(spark):
    a, b = spark.sql("SELECT * FROM VALUES 1, 2 t(x) ORDER BY x"), spark.sql("SELECT * FROM VALUES 1, 2 t(x) ORDER BY x DESC")
    assert same_answer(a, b, False) and not same_answer(a, b, True) and same_answer(a, a, True)
    assert not same_answer(a, a.limit(1), True) and not same_answer(a, a.select(stats.F.col("x").cast("long")), True)
    cases = [{"id": "q", "question": "", "sql": "", "label": "valid", "mutation": "none", "source_query_id": "q"}] * 2
    assert label_counts(cases) == {"label": {"valid": 2}, "mutation": {"none": 2}} and label_frame(spark, cases).count() == 2


def test_fixtures(spark, tables, later, tmp_path):
    specs = [{"op": "TABLE_RENAME", "from": "employee", "to": "staff"}]
    made = fixtures.build(tables, specs, tmp_path, "renamed")
    (config,) = catalog.load_configs(tmp_path)
    assert config["id"] == "renamed" and config["events"] == made["events"] == [{"op": "TABLE_RENAME", "from": "employee", "to": "staff"}]
    pre, post = (fixtures.tables_of(spark, config[side]) for side in ("pre_db", "post_db"))
    assert sorted(pre) == ["employee", "town"] and sorted(post) == ["staff", "town"] and evaluate.same_rows(post["staff"], tables["employee"])
    assert fixtures.check(spark, config) == [] and fixtures.check(spark, config | {"content_hash": "x"}) and fixtures.check(spark, config | {"content_hash": "0" * 16})
    (tmp_path / "queries.json").write_text(json.dumps({"queries": ITEMS}))
    items = catalog.load_queries(tmp_path / "queries.json")
    assert fixtures.check_corpus(spark, items, tables, later) == []
    wrong = fixtures.check_corpus(spark, [*items, {**ITEMS[0], "id": "d", "gold_post": "SELECT name FROM employee"}, {**ITEMS[0], "id": "e", "gold_pre": "SELECT name FROM employee WHERE id > 9"}, {**ITEMS[2], "id": "f", "failure_reason": ""}, {"id": "g"}], tables, later)
    assert len([w for w in wrong if w.startswith("d: gold_post fails")]) == 1 and "e: gold_pre has no rows" in wrong and "f: an expected failure has no reason" in wrong and "g: no question" in wrong
    with pytest.raises(ValueError):
        (tmp_path / "queries.json").write_text('{"other": 1}')
        catalog.load_queries(tmp_path / "queries.json")


def test_session_catalog(spark, tables):
    with workload.views(spark, tables):
        got = catalog.introspect(spark, ["town"])
        assert [(r.table_name, r.column_name, r.data_type) for r in got.orderBy("ordinal").collect()] == [("town", "town_id", "int"), ("town", "place", "string")]
        assert {"employee", "town"} <= {r.table_name for r in catalog.introspect(spark).collect()}
    assert set(catalog.read_tables(spark, "/root/testdata/sf0.001", ("region", "nation"))) == {"region", "nation"}


def test_rules_on_a_stream(spark, tmp_path):
    from driftline.streaming.score import score_stream

    schema = "question string, paraphrase string, row_count int"
    given = [("how many vessels", "show count vessel", 1), ("list names", "show name vessel", 0), ("zebra", "show age", 3), ("list", "show", None)]
    spark.createDataFrame(given, schema).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = score_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    assert stream.isStreaming
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {r.question: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"how many vessels": "valid", "list names": "silent_failure", "zebra": "silent_failure", "list": "execution_error"}


def test_a_broken_run_is_taken_up(spark, tables, later, tmp_path):
    """The generator fails at the third of four items; what was scored stays, and the second call only asks for the rest."""
    items = [ITEMS[0], ITEMS[1], {**ITEMS[0], "id": "x", "question": "list each name of staff"}, {**ITEMS[1], "id": "y"}]
    path, asked = f"{tmp_path}/run", []

    def generate(prompt, breaks=True):
        question = prompt.split("Question: ")[1].splitlines()[0]
        if breaks and "each name" in question:
            raise ConnectionError("gone away")
        asked.append(question)
        return ITEMS[1]["gold_pre"] if "towns" in question else ITEMS[0]["gold_pre"]

    with pytest.raises(ConnectionError):
        workload.evaluate_items(spark, items, tables, later, generate, path=path, batch=5)
    kept = results.RunTable(spark, path, workload.ROW)
    assert sorted(r.id for r in kept.rows().collect()) == ["a", "b"]
    (entry,) = kept.log().collect()
    assert (entry.status, entry.failed_id, entry.error, entry.ids) == ("failed", "x", "ConnectionError: gone away", ["a", "b"])
    asked.clear()
    steady = lambda prompt: generate(prompt, False)
    got = workload.evaluate_items(spark, items, tables, later, steady, path=path, batch=1)
    assert set(asked) == {"list each name of staff", ITEMS[1]["question"]} and [e.status for e in kept.log().orderBy("at").collect()] == ["failed", "running", "finished"]
    whole = workload.evaluate_items(spark, items, tables, later, steady)
    timed = [c for c in whole.columns if c.startswith("latency") or c == "ast_relink_ms"]
    assert evaluate.same_rows(got.drop(*timed), whole.drop(*timed))
    asked.clear()
    again = workload.evaluate_items(spark, items, tables, later, steady, path=path)
    assert not asked and again.count() == 4


def executions(spark, since=None):
    """The last execution; or, of those since then, how many ran a job, which registering a view doesn't."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    held = spark._jsparkSession.sharedState().statusStore().executionsList()
    seen = [held.apply(k) for k in range(held.size())]
    if since is None:
        return max((e.executionId() for e in seen), default=-1)
    return sum(e.jobs().nonEmpty() for e in seen if e.executionId() > since)


def test_each_text_runs_once(spark, tables):
    held = answers.Answers(spark, tables)
    before = executions(spark)
    assert held.same("SELECT name FROM employee", "SELECT name FROM employee ORDER BY name") and executions(spark, before) == 2
    assert held.same("SELECT name FROM employee", "SELECT name FROM employee") and not held.same("SELECT 1 / 0", "SELECT 1")
    assert executions(spark, before) == 3  # the division fails before it runs
    answers.ahead(spark, [(held, "SELECT 1"), (held, "SELECT 2"), (held, "SELECT 2"), (held, "SELECT nope"), (held, None)])
    assert executions(spark, before) == 4 and held.answer("SELECT nope").error and held.answer(None).error == "there is no query"


def test_an_item_runs_no_query_twice(spark, tables, later):
    change = workload.Change(spark, tables, later, stale)
    before = executions(spark)
    workload.answer_item(change, ITEMS[1])
    assert executions(spark, before) == 2  # the one text, on the old tables and on the new ones


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("VALUES (1, NULL)", "VALUES (NULL, 1)", False),
        ("VALUES (1), (1), (2)", "VALUES (1), (2), (2)", False),
        ("VALUES (1), (2)", "VALUES (2), (1)", True),
        ("VALUES (array(1, NULL))", "VALUES (array(NULL, 1))", False),
        ("VALUES (array(1, NULL))", "VALUES (array(1, NULL))", True),
        ("VALUES (named_struct('a', 1, 'b', CAST(NULL AS INT)))", "VALUES (named_struct('a', CAST(NULL AS INT), 'b', 1))", False),
        ("VALUES (-0.0D), (DOUBLE('NaN'))", "VALUES (DOUBLE('NaN')), (0.0D)", True),
        ("VALUES ('')", "VALUES (CAST(NULL AS STRING))", False),
        ("SELECT 1 WHERE false", "SELECT 2 WHERE false", True),
        ("SELECT 1 WHERE false", "SELECT '2' WHERE false", False),
        ("VALUES ('a', 'bc')", "VALUES ('ab', 'c')", False),
    ],
)
def test_digests_tell_bags_apart(spark, a, b, same):
    held = answers.Answers(spark, {})
    assert held.same(a, b) is same and evaluate.same_rows(spark.sql(a), spark.sql(b)) is same
