"""Scoring of workloads: equal results, and aggregates over rows of one scored query each.

A scored row has an operator (perturbation), one right-or-not column for each arm (1, 0 or null), verdicts and backends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, recovery, truth, wilson
from ..functions.text import AFFIRMATIVE, GROUPED, LISTED, SCALAR, SEVERAL, cue

#: Arms and their columns.
ARMS = {"stale": "baseline_ok", "refreshed": "refreshed_schema_ok", "error_feedback": "error_feedback_ok", "mediated": "mcp_ok"}
CATEGORIES = ("correct", "execution_error", "silent_failure", "wrong_result", "unknown")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are equal as bags: any order, column names aside, types not, null equal to null."""
    if [t for _, t in a.dtypes] != [t for _, t in b.dtypes]:
        return False
    return row_difference(a, b).isEmpty()


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two results has more often than the other, and how much more often: one aggregate, no join."""
    names = [f"c{i}" for i in range(len(a.columns))]
    both = a.toDF(*names).withColumn("n", F.lit(1)).unionByName(b.toDF(*names).withColumn("n", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("n").alias("surplus")).where("surplus != 0")


def gold_gate(pre: DataFrame, post: DataFrame, op: str) -> str | None:
    """Why two golds don't fit each other, or None: both must have rows, and the same ones; merged columns the same count."""
    if pre.isEmpty():
        return "empty_pre"
    if post.isEmpty():
        return "empty_post"
    if op == "COLUMN_MERGE":
        return None if pre.count() == post.count() else "row_count_mismatch"
    return None if same_rows(pre, post) else "result_mismatch"


def scored(rows: DataFrame) -> DataFrame:
    """Rows that aren't expected to fail."""
    return rows.where(~truth(F.col("expected_failure")))


def expected_failures(rows: DataFrame) -> DataFrame:
    """Of the queries that must fail: how many there are by operator, and how many were flagged."""
    own = rows.where(truth(F.col("expected_failure")))
    return own.groupBy("perturbation").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("mcp_verdict") != "valid", F.lit(True))).alias("flagged"))


def per_operator(rows: DataFrame, digits: int = 4) -> DataFrame:
    """By operator: n, how often each arm is right, how many the mediated arm recovers or spoils, and rates."""
    right = {a: truth(F.col(c)) for a, c in ARMS.items()}
    got = scored(rows).groupBy("perturbation").agg(
        F.count("*").alias("n"),
        *[F.count_if(r).alias(f"{a}_correct") for a, r in right.items()],
        F.count_if(~right["stale"] & right["mediated"]).alias("recovered"),
        F.count_if(right["stale"] & ~right["mediated"]).alias("degraded"),
    )
    return got.select("*", *[F.round(ratio(F.col(f"{a}_correct"), F.col("n")), digits).alias(f"{a}_rate") for a in ARMS])


def pooled(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy of each arm over all scored rows of a group (not the mean of groups' rates), its bounds, and recovery."""
    share = {a: F.sum(truth(F.col(c)).cast("long")) for a, c in ARMS.items()}
    got = scored(rows).groupBy(*by).agg(F.count("*").alias("n"), *[s.alias(f"{a}_k") for a, s in share.items()])
    rate = {a: ratio(F.col(f"{a}_k"), F.col("n")) for a in ARMS}
    low, high = wilson(F.col("mediated_k"), F.col("n"))
    recovered = recovery(rate["stale"], rate["refreshed"], rate["mediated"])
    return got.select(*by, "n", *[F.round(r, 6).alias(f"{a}_ex") for a, r in rate.items()], F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"), F.round(recovered, 6).alias("recovery"))


def silent_detection(rows: DataFrame) -> DataFrame:
    """One row: of scored queries that were wrong unaided, how many the mediated arm flagged as silent failures (tp), how many it called
    valid though they stayed wrong (fn), and the share flagged."""
    wrong = ~truth(F.col("baseline_ok"))
    got = scored(rows).agg(
        F.count_if(wrong & (F.col("mcp_verdict") == "silent_failure")).alias("tp"),
        F.count_if(wrong & (F.col("mcp_verdict") == "valid") & ~truth(F.col("mcp_ok"))).alias("fn"),
    )
    return got.select("*", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("rate"))


def by_bucket(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """For each bucket: n, each arm's accuracy (4 digits) with its bounds, and the recovery of the mediated and the error feedback arm
    from these rounded accuracies."""
    got = rows.groupBy(bucket).agg(F.count("*").alias("n"), *[F.sum(truth(F.col(c)).cast("long")).alias(f"{a}_k") for a, c in ARMS.items()])
    rate = {a: F.round(ratio(F.col(f"{a}_k"), F.col("n")), 4) for a in ARMS}
    bounds = {a: [F.round(c, 6) for c in wilson(F.col(f"{a}_k"), F.col("n"))] for a in ARMS}
    named = [x for a in ARMS for x in (rate[a].alias(f"ex_{a}"), bounds[a][0].alias(f"{a}_lower"), bounds[a][1].alias(f"{a}_upper"))]
    return got.select(bucket, "n", *named, *[F.round(recovery(rate["stale"], rate["refreshed"], rate[a]), 4).alias(f"rr_{a}") for a in ("mediated", "error_feedback")])


def suspicions(question: Column, n_rows: Column, n_columns: Column, zero: Column) -> dict[str, Column]:
    """Rules that flag an answer by its shape: one column for several attributes, nothing (or a counted zero) where something is asked for,
    several rows for one value, one row for a list."""
    return {
        "arity_low": cue(question, SEVERAL) & (n_columns == 1),
        "affirmative_empty": cue(question, AFFIRMATIVE) & ((n_rows == 0) | zero),
        "scalar_multi_rows": cue(question, SCALAR) & ~cue(question, GROUPED) & (n_rows > 1),
        "list_single_row": cue(question, LISTED) & (n_rows == 1),
    }


def category(ok: Column, error: Column, verdict: Column, ran: Column) -> Column:
    """Why a query is wrong, the first that holds."""
    return (
        F.when(truth(ok), "correct")
        .when(error, "execution_error")
        .when(verdict == "silent_failure", "silent_failure")
        .when(ran, "wrong_result")
        .otherwise("unknown")
    )


def category_counts(rows: DataFrame, column: str = "category") -> DataFrame:
    """How many rows have each category; those of none too."""
    every = rows.sparkSession.createDataFrame([(c,) for c in CATEGORIES], f"{column} string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def confusion(rows: DataFrame, predicted: Column, actual: Column, empty: float | None = 0.0) -> DataFrame:
    """One row: counts of a binary prediction, precision, recall and F1; empty stands where nothing is divided."""
    got = rows.agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")
    )
    none = F.lit(empty).cast("double")
    p = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), none)
    r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), none)
    return got.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(ratio(2 * p * r, p + r), none), 6).alias("f1"))


def recall_by(rows: DataFrame, group: str, flagged: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged")).withColumn("recall", F.round(ratio(F.col("flagged"), F.col("n")), 6))


def sweep(rows: DataFrame, score: Column, rule: Column, actual: Column, thresholds: list[float]) -> DataFrame:
    """Confusion at each threshold, where a low score or a rule flags. Each row meets a short list of thresholds."""
    each = rows.select(score.alias("s"), rule.alias("r"), actual.alias("a"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    flag = (F.col("s") < F.col("threshold")) | F.col("r")
    got = each.groupBy("threshold").agg(F.count_if(flag & F.col("a")).alias("tp"), F.count_if(flag & ~F.col("a")).alias("fp"), F.count_if(~flag & F.col("a")).alias("fn"), F.count_if(~flag & ~F.col("a")).alias("tn"))
    return got.select("*", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


def stability(rows: DataFrame, item: str, outcome: Column) -> DataFrame:
    """One row: items seen, and the share whose outcome is the same under every seed."""
    each = rows.groupBy(item).agg(F.min(outcome).eqNullSafe(F.max(outcome)).alias("same"))
    return each.agg(F.count("*").alias("items"), F.count_if("same").alias("stable")).withColumn("share", F.round(ratio(F.col("stable"), F.col("items")), 6))


def by_seed(rows: DataFrame, seed: str, ok: Column) -> DataFrame:
    """One row: mean, least, greatest and range of the seeds' accuracies."""
    each = rows.groupBy(seed).agg(F.avg(truth(ok).cast("double")).alias("ex"))
    return each.agg(*[F.round(f("ex"), 6).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))], F.round(F.max("ex") - F.min("ex"), 6).alias("range"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """Rows of two arms that were scored in both: keys, left and right."""
    left = a.where(F.col(ok).isNotNull()).select(*keys, F.col(ok).alias("left"))
    return left.join(b.where(F.col(ok).isNotNull()).select(*keys, F.col(ok).alias("right")), keys)


def agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("left") == F.col("right")).cast("double")), 6).alias("agreement"))


def long_form(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each row and column: for configurations scored side by side."""
    return rows.unpivot(keys, columns, "config", "ok")


def cost(rows: DataFrame, prices: DataFrame, key: str = "model") -> DataFrame:
    """Price of the tokens by model; prices is a short list of dollars per million tokens in and out."""
    usd = (F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1e6
    return rows.join(prices, key).groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(usd), 4).alias("usd"), F.round(F.avg("tokens_in"), 6).alias("mean_in"), F.round(F.avg("tokens_out"), 6).alias("mean_out"))


def tool_usage(rows: DataFrame, calls: str = "tool_calls_json") -> DataFrame:
    """How many rows call each tool at least once; "none" for rows without calls."""
    parsed = F.from_json(calls, "array<struct<tool: string>>")
    used = F.coalesce(F.array_distinct(F.transform(parsed, lambda c: c["tool"])), F.array().cast("array<string>"))
    each = rows.select(F.explode(F.when(F.size(used) > 0, used).otherwise(F.array(F.lit("none")))).alias("tool"))
    return each.groupBy("tool").agg(F.count("*").alias("rows"))
