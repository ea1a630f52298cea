import math
import random
from statistics import mean, median

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import stats
from driftline.operators import evaluate, evolve, joins
from driftline.sources import results


@pytest.mark.parametrize(
    ("base", "challenger", "want"),
    [([1] * 5, [0] * 5, (0, 5, 3.2, 0.0625)), ([1, 1, 0, 1], [1, 0, 1, 0], (1, 2, 0.0, 1.0)), ([1, 0], [1, 0], (0, 0, None, 1.0)), ([0] * 11 + [1] * 2, [1] * 11 + [0] * 2, (11, 2, 4.923077, 0.022461))],
)
def test_mcnemar(spark, base, challenger, want):
    rows = spark.createDataFrame(list(zip(base, challenger, strict=True)), "a int, b int")
    assert tuple(stats.mcnemar(rows, F.col("a"), F.col("b")).first()) == want


def test_mcnemar_does_not_underflow(spark):
    rows = spark.range(6000).select((F.col("id") % 2).alias("a"), (1 - F.col("id") % 2).alias("b"))
    assert stats.mcnemar(rows, F.col("a"), F.col("b")).first().p_value == 1.0


def test_wilson(spark):
    low, high = stats.wilson(F.lit(5), F.lit(10))
    got = spark.range(1).select(low, high).first()
    assert [round(x, 5) for x in got] == [0.23659, 0.76341]
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (None, None)


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "name string, p_value double")
    assert {r.name: r.adjusted for r in stats.holm(rows).collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.integers(0, 50), min_size=1, max_size=30))
def test_latency_against_lists(spark, values):
    rows = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got, v = stats.latency(rows, "g", "v").first().asDict(), sorted(map(float, values))
    n = len(v)
    low, high = v[: n // 2] or v[:1], v[(n + 1) // 2 :] or v[-1:]
    want = {"g": "g", "n": n, "mean": mean(v), "median": median(v), "q1": median(low), "q3": median(high), "iqr": median(high) - median(low), "p95": v[math.ceil(0.95 * n) - 1], "min": v[0], "max": v[-1]}
    assert all(got[k] == pytest.approx(w, abs=1e-6) if isinstance(w, float) else got[k] == w for k, w in want.items())


def test_latency_of_no_group_and_of_nulls(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "g string, v double")
    assert {r.g: (r.n, r.median) for r in stats.latency(rows, "g", "v").collect()} == {None: (2, 2.0), "b": (1, 2.0)}


def test_a_value_of_any_frequency_is_one_row(spark):
    """One value in 99 of a hundred rows, and a group of it alone."""
    rows = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.when((F.col("id") % 100 < 98) | (F.col("id") % 2 == 0), 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    held = stats.ranked(rows, "g").collect()
    assert len(held) == 1002 and max(r.k for r in held) == 50_000 and all(r.n == 50_000 for r in held)
    got = {r.g: (r.n, r.median, r.q1, r.q3, r.p95, r.min) for r in stats.latency(rows, "g", "v").collect()}
    assert got[0] == (50_000, 7.0, 7.0, 7.0, 7.0, 7.0) and got[1] == (50_000, 7.0, 7.0, 7.0, 7.0, 7.0)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        tasks = stats.ranked(rows, "g").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset(key)
    assert max(r["count"] for r in tasks) < 600  # of 100,000 rows


@pytest.mark.parametrize("n", [0, 1, 500])
def test_holm_over_many_parts(spark, n):
    rng = random.Random(n)
    tests = [(f"t{k:04d}", rng.choice([0.0001, 0.001, rng.random() / 100, rng.random()])) for k in range(n)]
    got = {r.name: r.adjusted for r in stats.holm(spark.createDataFrame(tests, "name string, p_value double")).collect()}
    running, want = 0.0, {}
    for i, (p, name) in enumerate(sorted((p, name) for name, p in tests)):
        running = max(running, (n - i) * p)
        want[name] = round(min(1.0, running), 6)
    assert got == pytest.approx(want)


def test_weights_follow_from_key_and_draw_alone(spark):
    """Against exploding rows by draws, over partitions of any number; null keys and null values too."""
    import hashlib

    held = [(k, float(k * k % 17) if k % 5 else None) for k in range(40)] + [(None, 3.0)]

    def weight(draw, k):
        text = f"3:{draw // 4}" + ("" if k is None else f":{k}")
        u = int(hashlib.md5(text.encode()).hexdigest()[8 * (draw % 4) :][:8], 16) / 2**32
        return sum(u >= sum(0.36787944117144233 / math.factorial(j) for j in range(i + 1)) for i in range(12))

    for parts in (1, 3):
        rows = spark.createDataFrame(held, "k int, v double").repartition(parts)
        got = {r.draw: (r.w, r.v) for r in stats.drawn(rows, "k", {"v": F.col("v")}, 10, 3).collect()}
        assert got == {d: (sum(weight(d, k) for k, _ in held), sum(weight(d, k) * (v or 0) for k, v in held)) for d in range(10)}


def test_digests_are_those_of_the_library():
    import hashlib

    keys = [b"", b":1", b":" + b"x" * 40, b":" + b"y" * 52, b":" + b"z" * 300, ":é漢".encode()]
    prefixes = [f"0:{d}".encode() for d in range(120)]
    got = stats._weights(keys, prefixes)
    units = [[int.from_bytes(hashlib.md5(p + k).digest()[4 * q :][:4], "big") for p in prefixes for q in range(4)] for k in keys]
    assert got.tolist() == [[int((stats._STEPS <= u).sum()) for u in row] for row in units]


def test_recovery_and_truth(spark):
    got = spark.range(1).select(stats.recovery(F.lit(0.2), F.lit(0.7), F.lit(0.6)), stats.recovery(F.lit(0.5), F.lit(0.5), F.lit(0.9)), stats.truth(F.lit("Yes")), stats.truth(F.lit(None))).first()
    assert got[0] == pytest.approx(0.8) and tuple(got)[1:] == (None, True, False)


def test_exact_bootstrap_is_reproducible(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(20)], "g string, v double")
    a, b = (stats.bootstrap_exact(rows, "g", "v", 100).first() for _ in range(2))
    assert a == b and a.lower <= a.estimate <= a.upper


@pytest.mark.parametrize("n", [1, 2, 5, 64, 100])
def test_exact_bootstrap_is_that_of_the_generator(spark, n):
    rng, values = random.Random(0), [i * 1.25 for i in range(n)]
    means = sorted(mean([rng.choice(values) for _ in values]) for _ in range(1000))
    rows = spark.createDataFrame([("a", v) for v in reversed(values)], "g string, v double")
    got = stats.bootstrap_exact(rows, "g", "v").first()
    assert tuple(got) == ("a", n, round(mean(values), 6), round(means[25], 6), round(means[974], 6))


def test_registered_bootstraps_take_whole_tables_and_a_thousand_draws(spark, monkeypatch):
    from driftline import queries

    root, seen = "/root/testdata/sf0.001", []
    own = stats.bootstrap
    monkeypatch.setattr(stats, "bootstrap", lambda *a: seen.append(a[3]) or own(*a))
    exact = queries.QUERIES["stat_bootstrap_exact"](spark, root).agg(F.sum("n")).first()[0]
    assert exact == spark.read.parquet(f"{root}/events.parquet").where("value IS NOT NULL").count()
    assert queries.QUERIES["stat_bootstrap_hash"](spark, root).first().n and seen == [1000]


def test_bag_equality(spark):
    make = lambda rows, kind="a int, b string": spark.createDataFrame(rows, kind)
    assert evaluate.same_rows(make([(1, None), (2, "x")]), make([(2, "x"), (1, None)], "p int, q string"))
    assert not evaluate.same_rows(make([(1, "x")] * 2), make([(1, "x")]))
    assert not evaluate.same_rows(make([(1, "x")]), make([(1.0, "x")], "a double, b string"))
    assert evaluate.same_rows(make([]), make([]))


def test_confusion_of_nothing(spark):
    empty = spark.createDataFrame([], "p boolean, a boolean")
    assert tuple(evaluate.confusion(empty, F.col("p"), F.col("a")).first())[4:] == (0.0, 0.0, 0.0)
    assert tuple(evaluate.confusion(empty, F.col("p"), F.col("a"), None).first())[4:] == (None, None, None)


def test_categories_are_all_there(spark):
    got = evaluate.category_counts(spark.createDataFrame([("correct",), ("correct",)], "category string"))
    assert {r.category: r.n for r in got.collect()} == {"correct": 2, "execution_error": 0, "silent_failure": 0, "wrong_result": 0, "unknown": 0}


def test_sink_keeps_contaminated_rows_apart(spark, tmp_path):
    clean, dirty = (spark.createDataFrame([("q1", b)], "id string, backend string") for b in ("hosted", "mock-after-timeout"))
    assert results.write(clean, f"file://{tmp_path}/out") == f"file://{tmp_path}/out"
    assert results.write(dirty, f"file://{tmp_path}/out").endswith("_contaminated")
    assert results.write(dirty, f"file://{tmp_path}/all", allow_contaminated=True).endswith("all")
    done = results.resume(spark, f"file://{tmp_path}/out", "id string, backend string")
    assert [r.id for r in results.pending(spark.createDataFrame([("q1",), ("q2",)], "id string"), done).collect()] == ["q2"]
    assert results.resume(spark, f"file://{tmp_path}/none", "id string").count() == 0


def test_evolution_guards(spark):
    t = {"a": spark.createDataFrame([(1, "x", None)], "k int, p string, q string"), "b": spark.createDataFrame([(1, "y"), (2, "z")], "k int, p string")}
    with pytest.raises(ValueError):
        evolve.rename_table(t, "a", "b")
    with pytest.raises(ValueError):
        evolve.rename_columns(t, "a", {"nope": "x"})
    with pytest.raises(ValueError):
        evolve.rename_by_position(t, "a", ["x"])
    with pytest.raises(ValueError):
        evolve.split_table(t, "a", "k", {"s": ["nope"]})
    merged = evolve.merge_tables(t, "a", "b", "k", "m", suffix=True)["m"]
    assert merged.columns == ["k", "p", "q", "p_b"] and merged.count() == 1
    assert evolve.merge_columns(t, "a", ["p", "q"], "pq")["a"].first().pq == "x "
    assert evolve.merge_columns(t, "a", ["p", "q"], "pq", "p || q")["a"].first().pq is None
    assert evolve.merge_key(t["a"], t["b"], keys=(["k"], ["k"])) == ("k", "k")
    with pytest.raises(ValueError):
        evolve.merge_key(t["a"], t["b"])
    assert evolve.merged_columns(["k", "p", "q"], ["k", "pq"]) == ("pq", ["p", "q"])
    specs = [{"op": "TABLE_RENAME", "from": "a", "to": "c"}]
    hashes = {evolve.apply(t, specs, hashed=True)[1].content_hash for _ in range(2)}
    assert len(hashes) == 1 and len(hashes.pop()) == 16


@pytest.mark.parametrize(("left", "right"), [([1, 2, None], [2]), ([1, None], [2, None]), ([1, None], []), ([], [1]), ([1, 1, 3], [3, 3])])
def test_not_in_means_what_sql_means(spark, left, right):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in (left, right))
    want = spark.sql("SELECT k FROM {a} WHERE k NOT IN (SELECT k FROM {b})", a=a, b=b)
    assert sorted(map(str, joins.not_in(a, "k", b, "k").collect())) == sorted(map(str, want.collect()))


def test_stratified_sample_takes_all_merges(spark):
    rows = [("TABLE_RENAME", "d", i) for i in range(9)] + [("COLUMN_MERGE", "d", i) for i in range(9)]
    got = evolve.stratified(spark.createDataFrame(rows, "op string, db_id string, train_idx int"))
    assert [tuple(r) for r in got.collect()] == [("COLUMN_MERGE", "d", i) for i in range(9)] + [("TABLE_RENAME", "d", i) for i in range(4)]


def test_digests_hold_only_words_that_differ():
    """Blocks laid out whole take over a hundred bytes a digest, and a pass for each of their words."""
    import hashlib
    import tracemalloc

    keys, prefixes = [b":%d" % (10**6 + 37 * k) for k in range(131)], [f"0:{d}".encode() for d in range(250)]
    tracemalloc.start()
    got = stats._weights(keys, prefixes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    units = np.frombuffer(b"".join([hashlib.md5(p + k).digest() for k in keys for p in prefixes]), ">u4").astype(np.int64)
    want = np.searchsorted(stats._STEPS.astype(np.int64), units, "right")
    assert want.max() > 6 and (got.ravel() == want).all()
    assert most < 100 * len(keys) * len(prefixes)
