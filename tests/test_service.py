import json

import pytest

from driftline.plans.generate import Fallback, repair, stand_in, strip_fences
from driftline.plans.service import Service, ToolContext, answer, prompt, serve, tool_loop
from driftline.sources import catalog
from driftline.streaming.score import score_stream

OLD = {"vessel": [("Vessel_ID", "int"), ("Label", "string"), ("Built", "int")]}


@pytest.fixture
def service(spark):
    frame = spark.createDataFrame([(1, "Joe", 52), (2, "Ann", 41)], "Vessel_ID int, Label string, Built int")
    frame.createOrReplaceTempView("boat")
    return Service(spark, {"db": {"boat": frame}})


def test_schema_resource(service):
    first = json.loads(service.schema("db"))
    assert first["changed"] and first["events"] == [] and first["schema"] == "TABLE boat ( Vessel_ID int, Label string, Built int )"
    assert not json.loads(service.schema("db"))["changed"]
    with pytest.raises(FileNotFoundError):
        service.schema("other")


def test_tools(spark, service):
    context = ToolContext(service, "db", catalog.from_columns(spark, OLD), "how many vessels")
    assert context.call("schema_diff", "{}")["events"] == [{"op": "TABLE_RENAME", "from": "vessel", "to": "boat"}]
    assert context.call("query_relink", {"stale_sql": "SELECT Label FROM vessel"})["sql"] == "SELECT Label FROM boat"
    assert context.call("query_validate", json.dumps({"sql": "SELECT count(*) FROM boat"}))["verdict"] == "valid"
    assert "error" in context.call("query_validate", "{broken") and "error" in context.call("query_relink", {})
    with pytest.raises(KeyError):
        context.call("drop_everything", {})


def test_capped_loop_scores_the_last_query(spark, service):
    context = ToolContext(service, "db", catalog.from_columns(spark, OLD), "names")
    got = tool_loop(context, lambda calls: {"tool": "query_relink", "arguments": {"stale_sql": "SELECT Label FROM vessel"}}, 2)
    assert got["capped"] and got["sql"] == "SELECT Label FROM boat" and len(got["calls"]) == 2
    assert not tool_loop(context, lambda calls: {"sql": "SELECT 1"})["capped"]


def test_answer(spark, service):
    pre, post = catalog.from_columns(spark, OLD), catalog.describe(spark, service.databases["db"])
    got = answer(spark, "how many vessels are there", "SELECT count(*) FROM vessel", pre, post)
    assert (got["sql"], got["verdict"]) == ("SELECT count(*) FROM boat", "valid")
    got = answer(spark, "list the name of vessels", "SELECT Label FROM vessel WHERE Built > 99", pre, post, lambda *a: "SELECT Label FROM boat")
    assert (got["sql"], got["verdict"]) == ("SELECT Label FROM boat", "valid")


def test_generation(spark, service):
    assert strip_fences("<think>x</think>\n```sql\nSELECT 1;\n```") == "SELECT 1"
    fall = Fallback(lambda p: 1 / 0, stand_in, "hosted")
    assert fall(prompt("how many boats", "TABLE boat ( Label string )")) == ("SELECT COUNT(*) FROM boat", "mock-after-hosted")
    with pytest.raises(ZeroDivisionError):
        Fallback(lambda p: 1 / 0, stand_in, "hosted", strict=True)("x")
    assert repair(spark, "SELECT Nam FROM boat") == "SELECT Label FROM boat"
    assert repair(spark, "SELECT Label FROM boat") is None and repair(spark, "SELECT x FROM nowhere") is None


def test_stream_rules_agree_with_the_validator(spark):
    rows = spark.createDataFrame([("how many vessels", "show count vessel", 1), ("list names", "show name vessel", 0), ("zebra", "show age", 3), ("list", "show", None)], "question string, paraphrase string, row_count int")
    assert [r.verdict for r in score_stream(rows).collect()] == ["valid", "silent_failure", "silent_failure", "execution_error"]


def test_two_sessions_share_snapshots(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    make = lambda session, name, columns: {"db": {name: session.createDataFrame([], columns)}}
    first = Service(spark, make(spark, "vessel", "id int, label string"), path)
    seen = json.loads(first.schema("db"))
    assert seen["changed"] and seen["events"] == [] and not json.loads(first.schema("db"))["changed"]
    other = spark.newSession()
    second = Service(other, make(other, "boat", "id int, label string"), path)
    got = json.loads(second.schema("db"))
    assert got["events"] == [{"op": "TABLE_RENAME", "from": "vessel", "to": "boat"}] and got["pre_fingerprint"] == seen["post_fingerprint"]
    back = json.loads(first.schema("db"))  # the other session's look was the last
    assert back["events"] == [{"op": "TABLE_RENAME", "from": "boat", "to": "vessel"}]
    assert [r.version for r in first.cache.kept.history("db").collect()] == [1, 2, 3]
    assert first.cache.kept.last("none") is None


def test_requests_line_by_line(spark, service):
    import io

    asked = [
        {"id": 1, "method": "tools"},
        {"id": 2, "method": "schema", "params": {"database": "db"}},
        {"id": "c", "method": "relink", "params": {"sql": "SELECT Label FROM vessel", "events": [{"op": "TABLE_RENAME", "from": "vessel", "to": "boat"}]}},
        {"id": 4, "method": "validate", "params": {"database": "db", "sql": "SELECT COUNT(*) FROM boat", "question": "how many boats"}},
        {"id": 5, "method": "drop"},
        {"id": 6, "method": "schema", "params": {"database": "none"}},
    ]
    told = io.StringIO()
    serve(service, [*map(json.dumps, asked), "", "{broken", "[]"], told)
    got = [json.loads(x) for x in told.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, "c", 4, 5, 6, None, None]
    assert "query_relink" in got[0]["result"] and got[1]["result"]["changed"] and got[2]["result"]["sql"] == "SELECT Label FROM boat"
    assert got[3]["result"]["verdict"] == "valid" and all("error" in g for g in got[4:])
