"""The engine as a service: a schema resource, two tools, and a dispatcher for tool calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from ..sources import catalog
from .relink import Rewriter, relink
from .schema import SchemaCache, Snapshots, difference, events_text, prompt_text
from .validate import Similarity, validate

#: What each tool takes, for callers that list tools.
TOOLS = {
    "schema_diff": {"description": "The classified difference between the old schema and the current one.", "required": []},
    "query_relink": {"description": "Rewrites a stale query for the current schema.", "required": ["stale_sql"]},
    "query_validate": {"description": "Runs a query and gives a verdict on it.", "required": ["sql"]},
}


class Service:
    """Databases are sets of named DataFrames, under an id each. With a path for snapshots, changes since the last look are those since
    any session's."""

    def __init__(self, spark: SparkSession, databases: dict[str, dict[str, DataFrame]], snapshots: str | None = None):
        self.spark, self.databases, self.cache = spark, databases, SchemaCache(Snapshots(spark, snapshots) if snapshots else None)

    def _tables(self, name: str) -> dict[str, DataFrame]:
        if name not in self.databases:
            raise FileNotFoundError(f"no database {name}")
        return self.databases[name]

    def schema(self, name: str) -> str:
        """The current schema as JSON: its text, and what changed since the last look."""
        described = catalog.describe(self.spark, self._tables(name))
        return json.dumps({"database": name, "schema": prompt_text(described)} | self.cache.look(name, described))

    def relink(self, sql: str, events: list[dict]) -> dict:
        return relink(self.spark, sql, events)

    def validate(self, name: str, sql: str, question: str, similarity: Similarity | None = None) -> dict:
        catalog.register(self._tables(name))
        return validate(self.spark, sql, question, **({"similarity": similarity} if similarity else {})).to_dict()


@dataclass
class ToolContext:
    """What tool calls about one question work on."""

    service: Service
    database: str
    pre: DataFrame
    question: str
    calls: list[dict] = field(default_factory=list)

    def events(self) -> list[dict]:
        return difference(self.pre, catalog.describe(self.service.spark, self.service._tables(self.database)))

    def call(self, tool: str, arguments: str | dict) -> dict:
        """Runs a tool. Arguments that can't be read give an error as the result; an unknown tool raises."""
        if tool not in TOOLS:
            raise KeyError(f"no tool {tool}")
        try:
            args = json.loads(arguments) if isinstance(arguments, str) else dict(arguments)
            missing = [k for k in TOOLS[tool]["required"] if not isinstance(args.get(k), str)]
        except (ValueError, TypeError, AttributeError) as e:
            args, missing = {}, [f"readable arguments ({e})"]
        if missing:
            out = {"error": f"{tool} needs {', '.join(missing)}"}
        elif tool == "schema_diff":
            out = {"events": self.events()}
        elif tool == "query_relink":
            out = self.service.relink(args["stale_sql"], self.events())
        else:
            out = self.service.validate(self.database, args["sql"], args.get("question", self.question))
        self.calls.append({"tool": tool, "args": args, "result": out})
        return out


def serve(service: Service, asked: Iterable[str], told: TextIO) -> None:
    """Answers requests line by line: each is a JSON object with an id of any kind, a method (tools, schema, relink or validate) and its
    params; each answer has that id and a result, or an error's text. A line that can't be read is answered too."""
    methods = {
        "tools": lambda: TOOLS,
        "schema": lambda database: json.loads(service.schema(database)),
        "relink": service.relink,
        "validate": lambda database, sql, question: service.validate(database, sql, question),
    }
    for line in asked:
        if not line.strip():
            continue
        request: dict = {}
        try:
            request = json.loads(line)
            if request["method"] not in methods:
                raise KeyError(f"no method {request['method']}")
            out = {"result": methods[request["method"]](**request.get("params", {}))}
        except Exception as e:  # the loop goes on; whoever asked learns of it
            out = {"error": f"{type(e).__name__}: {e}"}
        told.write(json.dumps({"id": request.get("id") if isinstance(request, dict) else None} | out, default=str) + "\n")
        told.flush()


def tool_loop(context: ToolContext, generate: Callable[[list[dict]], dict], most: int = 8) -> dict:
    """Lets a generator call tools until it answers with sql. When turns run out, the last query that a tool saw counts."""
    for _ in range(most):
        step = generate(context.calls)
        if "sql" in step:
            return {"sql": step["sql"], "calls": context.calls, "capped": False}
        context.call(step["tool"], step.get("arguments", {}))
    seen = [c["result"].get("sql") or c["args"].get("sql") for c in context.calls if c["tool"] != "schema_diff"]
    return {"sql": next((s for s in reversed(seen) if s), None), "calls": context.calls, "capped": True}


def prompt(question: str, schema_text: str, error: str | None = None, events: list[dict] | None = None, stale: str | None = None) -> str:
    """The text that a generator gets."""
    parts = [f"Schema:\n{schema_text}", f"Question: {question}"]
    if events:
        parts.append(f"Schema changes:\n{events_text(events)}")
    if stale:
        parts.append(f"Stale query:\n{stale}")
    if error:
        parts.append(f"The last query failed: {error}")
    return "\n\n".join([*parts, "Answer with one SQL query."])


def answer(spark: SparkSession, question: str, stale: str, pre: DataFrame, post: DataFrame, generate: Rewriter | None = None) -> dict:
    """The mediated arm: rewrite, validate, and where the verdict isn't valid ask the generator once more and keep its
    query if that one is valid."""
    events = difference(pre, post)
    text = prompt_text(post)
    got = relink(spark, stale, events, text, generate)
    verdict = validate(spark, got["sql"], question)
    if verdict.verdict != "valid" and generate is not None:
        again = generate(got["sql"], events, prompt(question, text, verdict.error, events, stale))
        second = validate(spark, again, question)
        if second.verdict == "valid" or verdict.verdict == "execution_error":
            got, verdict = got | {"sql": again, "method": "llm"}, second
    return got | {"verdict": verdict.verdict, "reason": verdict.reason}
