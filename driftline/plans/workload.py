"""The evaluation run: four ways to answer questions over a changed schema, scored against known answers.

An item has an id, a question, gold_pre and gold_post (the right query before and after the change), perturbation, and for those that
can't be answered expected_failure with failure_reason. A generator is any function of a prompt; it may give the text alone, or the text
and the name of what made it. One query at a time is asked for; each text runs once, as one aggregate that says whether it runs, how
many rows it has and what they are in any order, and of an item's queries those that are known run side by side.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources import catalog, results
from .answers import Answer, Answers, Tables, ahead, views  # noqa: F401
from .generate import strip_fences
from .keys import facts
from .relink import guidance, relink
from .schema import difference, events_text, prompt_text
from .service import prompt
from .validate import EXECUTION_ERROR, SILENT_FAILURE, Verdict, weigh

Generate = Callable[[str], "str | tuple[str, str]"]
EMPTY = "empty_result_on_affirmative_question"
#: A row for each item; what isn't scored is null.
ROW = (
    "id string, perturbation string, question string, gold_post string, expected_failure boolean, failure_reason string, "
    "pre_sql string, pre_ok int, baseline_sql string, baseline_ok int, refreshed_schema_sql string, refreshed_schema_ok int, "
    "error_feedback_sql string, error_feedback_ok int, error_feedback_retry int, error_feedback_error string, error_feedback_backend string, "
    "mcp_sql string, mcp_method string, mcp_verdict string, mcp_ok int, recovered int, degraded int, "
    "latency_pre_s double, latency_baseline_s double, latency_refreshed_schema_s double, latency_error_feedback_s double, latency_mcp_s double, "
    "ast_relink_ms double, backend string, seed int"
)
NAMES = [f.split()[0] for f in ROW.split(", ")]


def exec_match(spark: SparkSession, predicted: str | None, gold: str | None, tables: Tables) -> bool:
    """Whether both queries run and have the same rows, in any order."""
    return Answers(spark, tables).same(predicted, gold)


def runs(spark: SparkSession, sql: str | None, tables: Tables) -> Answer:
    """The answer of a query over the tables, from one run."""
    return Answers(spark, tables).answer(sql)


def gate(spark: SparkSession, item: dict, pre: Tables, post: Tables) -> str | None:
    """Why an item can't be scored, or None: its right queries must run, have rows, and the same ones (of merged columns as many)."""
    sides = [("pre", Answers(spark, pre), item["gold_pre"]), ("post", Answers(spark, post), item["gold_post"])]
    ahead(spark, [(held, sql) for _, held, sql in sides])
    got = [held.answer(sql) for _, held, sql in sides]
    for (side, *_), answer in zip(sides, got, strict=True):
        if answer.error is not None:
            return f"execution_error_{side}"
        if not answer.n:
            return f"empty_{side}"
    if (item.get("op") or item["perturbation"]) == "COLUMN_MERGE":
        return None if got[0].n == got[1].n else "row_count_mismatch"
    return None if got[0].same(got[1]) else "result_mismatch"


@dataclass
class Change:
    """What all items of one run share: tables before and after, their schemas as text, and the events between them."""

    spark: SparkSession
    pre: Tables
    post: Tables
    generate: Generate
    strict_merge: bool = False
    similarity: Callable[[str, str], float] | None = None
    events: list[dict] = field(init=False)

    def __post_init__(self) -> None:
        described = [catalog.describe(self.spark, t) for t in (self.pre, self.post)]
        self.events = difference(*described, self.strict_merge)
        self.columns = [{n: f.dtypes for n, f in t.items()} for t in (self.pre, self.post)]
        self.facts = facts(self.post, self.events)
        self.before, self.after = Answers(self.spark, self.pre), Answers(self.spark, self.post)
        self.pre_text, self.post_text = map(prompt_text, described)
        self.rules = guidance(self.events)

    def ask(self, *args, extra: str = "", **kwargs) -> tuple[str, str]:
        got = self.generate(prompt(*args, **kwargs) + (f"\n\n{extra}" if extra else ""))
        text, backend = got if isinstance(got, tuple) else (got, "generator")
        return strip_fences(text or ""), backend

    def judge(self, sql: str, question: str) -> Verdict:
        got = self.after.answer(sql)
        if got.error is not None:
            return Verdict(EXECUTION_ERROR, error=got.error)
        return weigh(sql, question, got.first(), got.n, similarity=self.similarity)


def error_feedback(change: Change, question: str, sql: str) -> tuple[str, int, str, str | None]:
    """One retry with the error's text if the query fails; what is asked with is still the old schema."""
    error = change.after.answer(sql).error
    if error is None:
        return sql, 0, "", None
    again, backend = change.ask(question, change.pre_text, error=error, stale=sql)
    return again, 1, error, backend


def mediated(change: Change, question: str, sql: str) -> tuple[str, str, str, float]:
    """Rewrite, then validate; one new query from the generator where the verdict isn't valid, and one more, with its cause named, where
    nothing was found though something was asked for and there are rules about merged or split tables. Gives the query, how it
    was rewritten, the verdict and the milliseconds of rewriting."""
    began = time.perf_counter()
    got = relink(change.spark, sql, change.events, change.post_text, None, *change.columns, change.facts)
    took = 1e3 * (time.perf_counter() - began)
    now, verdict = got["sql"], change.judge(got["sql"], question)
    if verdict.verdict in (SILENT_FAILURE, EXECUTION_ERROR):
        again, _ = change.ask(question, change.post_text, verdict.error, change.events, now, extra=change.rules)
        if again:
            now, verdict = again, change.judge(again, question)
    if verdict.reason == EMPTY and change.rules:
        cue = "The last query found nothing, but the question asks for something. The value looked for may be part of a merged column."
        again, _ = change.ask(question, change.post_text, None, change.events, now, extra=f"{cue}\n{change.rules}")
        second = change.judge(again, question) if again else None
        if second and second.verdict != EXECUTION_ERROR:
            now, verdict = again, second
    return now, got["method"], verdict.verdict, took


def answer_item(change: Change, item: dict, seed: int = 0) -> dict:
    """All arms of one item, as a row."""
    question, fails = item["question"], bool(item.get("expected_failure", False))
    clock = [time.perf_counter()]

    def lap() -> float:
        clock.append(time.perf_counter())
        return round(clock[-1] - clock[-2], 4)

    def right(sql: str, gold: str | None, held: Answers) -> int | None:
        return None if fails else int(held.same(sql, gold))

    row = {c: item.get(c) for c in ("id", "perturbation", "question", "gold_post")}
    row |= {"expected_failure": fails, "failure_reason": item.get("failure_reason") or "", "seed": seed}
    row["pre_sql"], row["backend"] = change.ask(question, change.pre_text)
    if not fails:
        ahead(change.spark, [(change.before, row["pre_sql"]), (change.before, item["gold_pre"]), (change.after, item["gold_post"])])
    row["pre_ok"], row["latency_pre_s"] = right(row["pre_sql"], item["gold_pre"], change.before), lap()
    stale, backend = change.ask(question, change.pre_text)
    row["baseline_sql"], row["baseline_ok"], row["latency_baseline_s"] = stale, right(stale, item["gold_post"], change.after), lap()
    fresh, _ = change.ask(question, change.post_text)
    row["refreshed_schema_sql"], row["refreshed_schema_ok"], row["latency_refreshed_schema_s"] = fresh, right(fresh, item["gold_post"], change.after), lap()
    again, retry, error, by = error_feedback(change, question, stale)
    row |= {"error_feedback_sql": again, "error_feedback_retry": retry, "error_feedback_error": error, "error_feedback_backend": by or backend}
    row["error_feedback_ok"], row["latency_error_feedback_s"] = right(again, item["gold_post"], change.after), lap()
    row["mcp_sql"], row["mcp_method"], row["mcp_verdict"], took = mediated(change, question, stale)
    row["mcp_ok"], row["latency_mcp_s"], row["ast_relink_ms"] = right(row["mcp_sql"], item["gold_post"], change.after), lap(), round(took, 6)
    row["recovered"] = int(bool(row["mcp_ok"]) and not row["baseline_ok"])
    row["degraded"] = int(bool(row["baseline_ok"]) and not row["mcp_ok"])
    return row


def evaluate_items(
    spark: SparkSession, items: list[dict], pre: Tables, post: Tables, generate: Generate, seeds: int = 1, done: DataFrame | None = None,
    path: str | None = None, batch: int = 8, **how,
) -> DataFrame:
    """A row (ROW) for each item and seed; items whose id is in done are left out. The first seed's rows are those to score.

    With a path the run is durable: rows are appended to a table there, so many items at a time, with a row of the run's log for each
    append; items that the table has are left out; an error is logged and raised after what was scored is written; and the whole
    table is returned. So a run that ended early is taken up by calling it again.
    """
    kept = results.RunTable(spark, path, ROW) if path else None
    known = {r["id"] for frame in (done, kept and kept.rows()) if frame is not None for r in frame.select("id").distinct().toLocalIterator()}
    open_ = [item for item in items if item["id"] not in known]
    change = Change(spark, pre, post, generate, **how) if open_ or not kept else None
    rows: list[tuple] = []
    held: list[tuple] = []
    for k, item in enumerate(open_, 1):
        try:
            own = [answer_item(change, item, seed) for seed in range(max(1, seeds))]
        except Exception as e:
            if kept:
                kept.append(held, "failed", item["id"], f"{type(e).__name__}: {e}")
            raise
        change.before.known.clear()
        change.after.known.clear()
        held += [tuple(r[c] for c in NAMES) for r in own]
        if kept and (k % batch == 0 or k == len(open_)):
            kept.append(held, "finished" if k == len(open_) else "running")
            held = []
        elif not kept:
            rows, held = rows + held, []
    return kept.rows() if kept else spark.createDataFrame(rows, ROW)


def changes_text(change: Change) -> str:
    return events_text(change.events)
