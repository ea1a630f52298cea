"""Three verdicts on a query: it fails, it answers something else in silence, or it is valid."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import AFFIRMATIVE, STOP, SYNONYMS
from .sqltext import outline, parses

EXECUTION_ERROR, SILENT_FAILURE, VALID = "execution_error", "silent_failure", "valid"
TOKEN_THRESHOLD, EMBEDDING_THRESHOLD = 0.10, 0.45
Similarity = Callable[[str, str], float]
#: Rows of a result that a verdict looks at and keeps; of the others only the number counts.
SHOWN = 2


@dataclass
class Verdict:
    verdict: str
    rows: list[Row] | None = None  # the first few
    row_count: int | None = None
    error: str | None = None
    paraphrase: str | None = None
    similarity: float | None = None
    reason: str | None = None

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "rows"}


def execute(spark: SparkSession, sql: str) -> tuple[bool, DataFrame | str]:
    """Runs a query whole, without fetching its rows. Errors of analysis and of execution come back as text."""
    try:
        frame = spark.sql(sql)
        frame.write.format("noop").mode("overwrite").save()
        return True, frame
    except Exception as e:
        return False, str(e)


def token_set(text: str) -> set[str]:
    own = set(re.findall("[a-z]+", text.lower())) - set(STOP)
    return own.union(*(SYNONYMS.get(t, ()) for t in own))


def overlap(a: str, b: str) -> float:
    x, y = token_set(a), token_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def paraphrase(sql: str) -> str:
    """A query in key words: aggregates, names it shows and filters by, clauses and tables."""
    held = outline(sql)
    if held.main is None:
        return ""
    pieces = lambda name: [p.lower() for p in re.split(r"[_\W]+", name) if p]
    out = ["show"] + [cue for call, cue in (("count", "count"), ("avg", "average"), ("min", "min"), ("max", "max")) if call in held.calls]
    for p in held.projections():
        last = p[-1]
        alias = len(p) > 1 and last.kind == "name" and (p[-2].is_("AS") or p[-2].text == ")")
        column = last.kind == "name" and (len(p) == 1 or len(p) == 3 and p[1].text == ".")
        if alias or column:
            out += pieces(last.word)
    if "WHERE" in held.main.clauses:
        out.append("where")
        out += [x for c in held.columns_in("WHERE") for x in pieces(c)]
    out += ["ordered"] * ("ORDER" in held.main.clauses) + ["grouped"] * ("GROUP" in held.main.clauses)
    return " ".join(out + [t.word.lower() for t in held.relations])


def affirmative(question: str) -> bool:
    return re.search(AFFIRMATIVE, question, re.IGNORECASE) is not None


def _count(frame: DataFrame) -> int:
    """How many rows there are, each made whole, so that none can hide an error."""
    n = F.count("*").alias("n")
    seen = F.max(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in _names(frame)])).alias("seen")
    return frame.toDF(*_names(frame)).agg(n, seen).first()["n"]


def _names(frame: DataFrame) -> list[str]:
    return [f"c{i}" for i in range(len(frame.columns))]


def zero_count(rows: list[Row], sql: str) -> bool:
    """Whether the result is a single zero that an aggregate made."""
    return len(rows) == 1 and len(rows[0]) == 1 and rows[0][0] in (0, "0") and any(c in outline(sql).calls for c in ("count", "sum", "avg"))


def validate(spark: SparkSession, sql: str, question: str, threshold: float = TOKEN_THRESHOLD, similarity: Similarity | None = None) -> Verdict:
    """An error first; then too little in common with the question; then nothing where something was asked for."""
    try:
        frame = spark.sql(sql)
        first = frame.take(SHOWN)
        n = len(first) if len(first) < SHOWN else _count(frame)
    except Exception as e:
        return Verdict(EXECUTION_ERROR, error=str(e))
    return weigh(sql, question, first, n, threshold, similarity)


def weigh(sql: str, question: str, first: list[Row], n: int, threshold: float = TOKEN_THRESHOLD, similarity: Similarity | None = None) -> Verdict:
    """The verdict on a query that runs, from its first rows and their number."""
    said = paraphrase(sql)
    near = (similarity or overlap)(said, question)
    out = Verdict(VALID, first, n, None, said, near)
    if near < threshold:
        out.verdict, out.reason = SILENT_FAILURE, "low_semantic_similarity" if similarity else "low_token_overlap"
    elif affirmative(question) and (not first or zero_count(first, sql)):
        out.verdict, out.reason = SILENT_FAILURE, "empty_result_on_affirmative_question"
    return out


def validate_with_embeddings(spark: SparkSession, sql: str, question: str, threshold: float = EMBEDDING_THRESHOLD, similarity: Similarity | None = None) -> Verdict:
    """The same with sentence embeddings, which must be injected; without them a warning, and words count."""
    if similarity is None:
        warnings.warn("no embedding similarity was given; words are compared instead", RuntimeWarning, stacklevel=2)
        return validate(spark, sql, question)
    return validate(spark, sql, question, threshold, similarity)


def complexity(spark: SparkSession, sql: str) -> str:
    """hard with two joins, a subquery or HAVING; medium with a join, an aggregate or a group; else easy."""
    if not parses(spark, sql):
        raise ValueError("the text is no query")
    held = outline(sql)
    if held.joins >= 2 or len(held.scopes) > 1 or any("HAVING" in s.clauses for s in held.scopes):
        return "hard"
    grouped = any("GROUP" in s.clauses for s in held.scopes) or any(c in ("count", "sum", "avg", "min", "max") for c in held.calls)
    return "medium" if held.joins == 1 or grouped else "easy"
