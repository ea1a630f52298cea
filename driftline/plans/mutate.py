"""Queries made wrong on purpose: they run, and should be told from right ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import same_rows
from .sqltext import outline, splice

Mutant = tuple[str, str]


def drop_where(sql: str) -> list[Mutant]:
    """The first WHERE goes."""
    held = outline(sql)
    kept = held.within("WHERE")
    if not kept:
        return []
    word = held.tokens[held.main.clauses["WHERE"][0] - 1]
    return [("drop_where", (sql[: word.start].rstrip() + " " + sql[kept[-1].end :].lstrip()).strip())]


def swap_aggregate(sql: str) -> list[Mutant]:
    """MIN for MAX, MAX for MIN, MAX for AVG, one kind at a time."""
    held, out = outline(sql), []
    for own, other in (("min", "MAX"), ("max", "MIN"), ("avg", "MAX")):
        edits = [(t.start, t.end, other) for t, n in zip(held.tokens, held.tokens[1:], strict=False) if t.kind == "name" and t.text.lower() == own and n.text == "("]
        if edits:
            out.append((f"swap_agg_{own}", splice(sql, edits)))
    return out


def wrong_column(sql: str, columns: dict[str, list[str]]) -> list[Mutant]:
    """The first column shown becomes another of its table."""
    held = outline(sql)
    shown = {id(t) for t in held.within("SELECT")}
    for _, column, _ in held.columns:
        if id(column) not in shown:
            continue
        for table in held.relations:
            own = columns.get(table.word.lower(), [])
            if column.word.lower() in [c.lower() for c in own]:
                for other in own:
                    if other.lower() != column.word.lower():
                        return [("wrong_column", splice(sql, [(column.start, column.end, other)]))]
    return []


def shift_limit(sql: str) -> list[Mutant]:
    """One row less and one more; or only one, where there was no limit."""
    held = outline(sql)
    limit = held.within("LIMIT")
    if not limit:
        return [("spurious_limit_one", sql.rstrip().rstrip(";") + " LIMIT 1")]
    n = limit[0]
    if n.kind != "number" or not n.text.isdigit():
        return []
    return [(name, splice(sql, [(n.start, n.end, str(int(n.text) + d))])) for d, name in ((-1, "limit_minus_one"), (1, "limit_plus_one")) if int(n.text) + d >= 0]


def wrong_join_key(sql: str, columns: dict[str, list[str]]) -> list[Mutant]:
    """The right side of the first equality of a join becomes another column of its table."""
    held = outline(sql)
    place = {id(t): i for i, t in enumerate(held.tokens)}
    for qualifier, column, scope in held.columns:
        i = place[id(column)]
        if qualifier is None or i < 4 or held.tokens[i - 3].text != "=":
            continue
        before = [t.text.upper() for t in held.tokens[max(0, i - 12) : i]]
        if "ON" not in before:
            continue
        for other in columns.get((scope.owner(qualifier.word) or "").lower(), []):
            if other.lower() != column.word.lower():
                return [("wrong_join_key", splice(sql, [(column.start, column.end, other)]))]
    return []


def stale_merge_filter(sql: str, events: list[dict]) -> list[Mutant]:
    """Equality of a merged column with what can only be a part of it."""
    for e in events:
        if e.get("op") == "COLUMN_MERGE" and e["target"].lower() in sql.lower():
            c, t = e["target"], e["table"]
            return [("stale_merge_eq", f"SELECT {c} FROM {t} WHERE {c} = (SELECT SUBSTR({c}, 1, 1) FROM {t} LIMIT 1)")]
    return []


def families(sql: str, columns: dict[str, list[str]], events: list[dict] | None = None, expanded: bool = False) -> list[list[Mutant]]:
    out = [drop_where(sql), swap_aggregate(sql), wrong_column(sql, columns), stale_merge_filter(sql, events or [])]
    return out + [shift_limit(sql), wrong_join_key(sql, columns)] if expanded else out


def mutants(sql: str, columns: dict[str, list[str]], events: list[dict] | None = None, expanded: bool = False) -> list[Mutant]:
    """All families' mutants, one of each family in turn."""
    return [m for turn in zip_longest(*families(sql, columns, events, expanded)) for m in turn if m]


def same_answer(a: DataFrame, b: DataFrame, ordered: bool) -> bool:
    """Whether two results are equal: row by row if the order counts, read side by side up to the first difference; else as bags."""
    if not ordered:
        return same_rows(a, b)
    if [t for _, t in a.dtypes] != [t for _, t in b.dtypes]:
        return False
    return all(x is not None and y is not None and tuple(x) == tuple(y) for x, y in zip_longest(a.toLocalIterator(), b.toLocalIterator()))


def label_counts(cases: list[dict]) -> dict[str, dict[str, int]]:
    """How many cases there are by label and by mutation."""
    return {key: dict(sorted(Counter(c[key] for c in cases).items())) for key in ("label", "mutation")}


def label_frame(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Cases as a table, to be written and scored."""
    names = ("id", "question", "sql", "label", "mutation", "source_query_id")
    return spark.createDataFrame([tuple(c[n] for n in names) for c in cases], ", ".join(f"{n} string" for n in names))


def label(spark: SparkSession, items: list[dict], columns: dict[str, list[str]], most_valid: int = 2, most_silent: int = 4, expanded: bool = False, run: Callable[[str], DataFrame] | None = None) -> list[dict]:
    """Labelled cases: each item's later query as valid, and mutants that run and answer otherwise as silent failures."""
    run = run or spark.sql
    out: list[dict] = []
    counts = {"valid": 0, "silent_failure": 0}
    for item in items:
        if item.get("expected_failure"):
            continue
        try:
            gold = run(item["gold_post"])
            gold.schema
        except Exception:
            continue
        case = {"question": item["question"], "source_query_id": item["id"]}
        if counts["valid"] < most_valid:
            out.append(case | {"id": f"{item['id']}__gold", "sql": item["gold_post"], "label": "valid", "mutation": "none"})
            counts["valid"] += 1
        for name, sql in mutants(item["gold_post"], columns, item.get("events"), expanded):
            if counts["silent_failure"] >= most_silent:
                break
            if " ".join(sql.lower().split()) == " ".join(item["gold_post"].lower().split()):
                continue
            try:
                wrong = not same_answer(run(sql), gold, "ORDER" in outline(item["gold_post"]).main.clauses)
            except Exception:
                continue
            if wrong:
                out.append(case | {"id": f"{item['id']}__{name}", "sql": sql, "label": "silent_failure", "mutation": name})
                counts["silent_failure"] += 1
    return out
