"""Exact statistics as columns and windows. One row in is one observation; rounding to 6 digits follows the callers."""

from __future__ import annotations

import hashlib
import itertools
import math
import operator
import random
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth(c: Column) -> Column:
    """Reads 1, true and yes, in any case, as true; all else, null too, as false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "1.0", "true", "yes"), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def recovery(stale: Column, refreshed: Column, arm: Column) -> Column:
    """How much of what the new schema gives back an arm recovers; can exceed 1 or be negative; null if there is nothing."""
    return ratio(arm - stale, refreshed - stale)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval for k of n, within 0 and 1; null for no observations."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m) / (1 + z * z / m)
    return F.when(m.isNotNull(), F.greatest(F.lit(0.0), centre - margin)), F.when(m.isNotNull(), F.least(F.lit(1.0), centre + margin))


def binomial_tail(n: Column, k: Column) -> Column:
    """Probability of at most k heads in n fair throws, summed in logarithms so that no n underflows."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), k.cast("int")))
    first = -n * F.log(F.lit(2.0))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i)
        return F.when(i > k, s).otherwise(F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum")))

    return F.aggregate(steps, start, add)["sum"]


def mcnemar(rows: DataFrame, base: Column, challenger: Column) -> DataFrame:
    """One row: b (only the challenger is right), c (only the base), the corrected statistic, and the exact two-sided p."""
    x, y = truth(base), truth(challenger)
    counted = rows.agg(F.count_if(~x & y).alias("b"), F.count_if(x & ~y).alias("c"))
    n, b, c = F.col("b") + F.col("c"), F.col("b"), F.col("c")
    statistic = F.when(n > 0, F.round(F.pow(F.abs(b - c) - 1, 2) / n, 6))
    p = F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * binomial_tail(n, F.least(b, c))), 6))
    return counted.select("b", "c", statistic.alias("statistic"), p.alias("p_value"))


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by range of the order, written with the number of their part, as that must not change between uses."""
    context = rows.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="driftline-"))
    return rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).checkpoint()


def _of_parts(rows: DataFrame, value: Column, before: Callable[[float, float], float]) -> DataFrame:
    """A row a part: what value comes to over all parts before it, in part and until, null for the first. Parts are as many as tasks."""
    held = sorted((r["part"], r["x"]) for r in rows.groupBy("part").agg(value.alias("x")).collect())
    upto = itertools.accumulate((x for _, x in held), before)
    schema = f"part int, until {rows.groupBy('part').agg(value.alias('x')).schema['x'].dataType.simpleString()}"
    return F.broadcast(rows.sparkSession.createDataFrame([(p, u) for (p, _), u in zip(held, [None, *upto], strict=False)], schema))


def holm(rows: DataFrame, name: str = "name", p: str = "p_value") -> DataFrame:
    """Holm's step-down adjustment; ties by name. Tests are dealt by range of p; a part's places follow from how many tests stand before
    it, and its running maximum from the maxima before it, so a family of any size is no task's alone."""
    placed = _in_order(rows.select(F.col(name).alias("name"), F.col(p).alias("p")), "p", "name")
    own = Window.partitionBy("part").orderBy("p", "name")
    m = placed.count()
    place = F.row_number().over(own) + F.coalesce("until", F.lit(0))
    stepped = placed.join(_of_parts(placed, F.count("*"), operator.add), "part", "left").withColumn("step", (m - place + 1) * F.col("p")).drop("until")
    running = F.max("step").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = stepped.withColumn("running", running).join(_of_parts(stepped, F.max("step"), max), "part", "left")
    return met.select(F.col("name").alias(name), F.col("p").alias(p), F.round(F.least(F.lit(1.0), F.greatest("running", "until")), 6).alias("adjusted"))


def ranked(rows: DataFrame, group: str) -> DataFrame:
    """For rows of group and v, each value once: k, how often its group has it; upto, the rank (from 1) of its last occurrence there; and n, the
    group's size. Values are counted before they are sorted, so one of any frequency is one row; the rest is sorted by range over all
    partitions and ranked from counts of the partitions before, so no task holds a group."""
    counted = rows.select(F.col(group).alias("of"), "v").groupBy("of", "v").agg(F.count("*").alias("k"))
    placed = _in_order(counted, "of", "v")
    sums = placed.groupBy("of", "part").agg(F.sum("k").alias("k"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("of")
    offsets = sums.select(F.col("of").alias("to"), F.col("part").alias("at"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.sum("k").over(whole).alias("n"))
    own = F.sum("k").over(Window.partitionBy("part", "of").orderBy("v"))
    met = placed.withColumn("own", own).join(offsets, F.col("of").eqNullSafe(F.col("to")) & (F.col("part") == F.col("at")))
    return met.select(F.col("of").alias(group), "v", "k", "n", (F.col("own") + F.col("before")).alias("upto"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For each group: n, mean, median, quartiles as medians of the lower and upper half (the middle left out), iqr,
    95th percentile by nearest rank, min and max; 6 digits. Values are ranked within groups, never gathered."""
    v = F.col(value).cast("double")
    placed = ranked(rows.where(v.isNotNull()).select(group, v.alias("v")), group)
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    at = lambda rank: F.max(F.when((rank > F.col("upto") - F.col("k")) & (rank <= F.col("upto")), F.col("v")))

    def middle(first: Column, size: Column) -> Column:
        """Mean of the one or two middle ranks of size ranks from first on."""
        return (at(first + F.floor((size - 1) / 2)) + at(first + F.floor(size / 2))) / 2

    least, most = F.min("v"), F.max("v")
    got = placed.groupBy(group).agg(
        F.sum("k").alias("n"),
        (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"),
        middle(F.lit(1), n).alias("median"),
        F.when(F.max(half) > 0, middle(F.lit(1), half)).otherwise(least).alias("q1"),
        F.when(F.max(half) > 0, middle(n - half + 1, half)).otherwise(most).alias("q3"),
        at(F.ceil(95 * n / 100)).alias("p95"),
        least.alias("min"),
        most.alias("max"),
    )
    digits = lambda c: F.round(c, 6)
    return got.select(
        group, "n", *[digits(F.col(c)).alias(c) for c in ("mean", "median", "q1", "q3")], digits(F.col("q3") - F.col("q1")).alias("iqr"), *[digits(F.col(c)).alias(c) for c in ("p95", "min", "max")]
    )


#: Draws that one digest decides, its quarters of 32 bits, and digests made at once: a processor's own cache holds their words.
QUARTERS, BLOCK = 4, 1 << 15
#: A quarter from here on, from there on and so on counts once more: distribution of a Poisson variable of mean 1, up to 12.
_STEPS = np.array([math.ceil(sum(0.36787944117144233 / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)], np.uint64)


#: MD5 as RFC 1321 defines it: its additive constants, rotations by round and step, and first state.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: A message of more bytes takes more than one block.
_LONGEST = 55


def _digests(words: list[np.ndarray | None]) -> tuple[np.ndarray, ...]:
    """MD5 of messages of one padded block each, as four numbers; all messages at once, step by step. Words that all messages have as zero
    are None and take no step's time."""
    shape = next(w.shape for w in words if w is not None)
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _STATE)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:  # (b and c) or (not b and d), and so on
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif turn == 1:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif turn == 2:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        if word is not None:
            np.add(f, word, f)
        np.add(f, np.uint32(_SINES[i]), f)
        by = np.uint32(_TURNS[turn][i % 4])
        np.left_shift(f, by, g)
        np.right_shift(f, np.uint32(32) - by, f)
        np.bitwise_or(f, g, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    for x, y in zip((a, b, c, d), _STATE, strict=True):
        x += np.uint32(y)
    return a, b, c, d


def _words(keys: list[bytes], prefixes: list[bytes]) -> list[np.ndarray | None]:
    """The padded blocks of each key, all of one length, behind each prefix, word by word."""
    size, start, out = len(keys[0]), 0, [None] * 16
    for length, group in itertools.groupby(prefixes, len):  # they come by length
        own = [p.ljust(64, b"\0") for p in group]
        ends = [(b"\0" * length + k + b"\x80").ljust(56, b"\0") + (8 * (length + size)).to_bytes(8, "little") for k in keys]
        head, tail = (np.frombuffer(b"".join(x), "<u4").reshape(-1, 16).T for x in (own, ends))
        for i in range(16):
            if head[i].any() or tail[i].any():
                if out[i] is None:
                    out[i] = np.zeros((len(keys), len(prefixes)), np.uint32)
                np.bitwise_or(head[i], tail[i][:, None], out[i][:, start : start + len(own)])
        start += len(own)
    return out


def _counts(unit: np.ndarray) -> np.ndarray:
    """How often a quarter counts. Few reach the later steps; only these are held against them."""
    steps = _STEPS[_STEPS < 2**32].astype(np.uint32)
    out = (unit >= steps[0]).view(np.uint8)
    for step in steps[1:5]:
        out += unit >= step
    rare = np.nonzero(unit >= steps[5])
    out[rare] += np.searchsorted(steps[5:], unit[rare], "right").astype(np.uint8)
    return out


def _weights(keys: list[bytes], prefixes: list[bytes]) -> np.ndarray:
    """How often each row counts in each draw: quarters of the digests of each prefix and key."""
    out = np.empty((len(keys), len(prefixes), QUARTERS), np.uint8)
    sizes = np.array([len(k) for k in keys])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        own = [keys[i] for i in at.tolist()]
        if size + len(prefixes[-1]) <= _LONGEST:
            quarters = _digests(_words(own, prefixes))
        else:
            quarters = np.frombuffer(b"".join([hashlib.md5(p + k).digest() for k in own for p in prefixes]), "<u4").reshape(len(own), -1, QUARTERS).transpose(2, 0, 1)
        at = slice(None) if len(at) == len(keys) else at
        for i, quarter in enumerate(quarters):
            out[at, :, i] = _counts(quarter.byteswap())
    return out.reshape(len(keys), -1)


def drawn(rows: DataFrame, key: str, sums: dict[str, Column], draws: int, seed: int) -> DataFrame:
    """draw, w and the weighted sums of columns for each of so many draws, in which each row counts as often as a Poisson variable of
    mean 1 says. A hash of draw and key decides, four draws a digest. A task adds up all its rows' weights into one vector of draws;
    these are added element by element."""
    digests = -(-draws // QUARTERS)
    names = list(sums)
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names) + 1, draws))
        prefixes = [f"{seed}:{d}".encode() for d in range(digests)]
        block = max(1, BLOCK // digests)
        for batch in batches:
            keys = [b"" if k is None else b":" + k.encode() for k in batch.column("key").to_pylist()]
            held = [np.ones(len(keys)), *(np.nan_to_num(batch.column(n).to_numpy(zero_copy_only=False), nan=0.0) if batch.column(n).null_count else batch.column(n).to_numpy(zero_copy_only=False) for n in names)]
            order = sorted(range(len(keys)), key=lambda i: len(keys[i]))  # keys of one length have the same words empty
            keys, values = [keys[i] for i in order], np.stack([np.asarray(h, np.float64) for h in held])[:, order]
            for at in range(0, len(keys), block):
                total += values[:, at : at + block] @ _weights(keys[at : at + block], prefixes)[:, :draws].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *map(pa.array, total)], names=["draw", "w", *names])

    own = rows.select(F.col(key).cast("string").alias("key"), *[c.cast("double").alias(n) for n, c in sums.items()]).repartition(tasks)
    parts = own.mapInArrow(run, "draw bigint, w double, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("draw").agg(F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in names])


def bootstrap(rows: DataFrame, key: str, value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Interval of a mean by resampling, for tables of any size."""
    rows = rows.where(F.col(value).isNotNull())
    means = drawn(rows, key, {"v": F.col(value).cast("double")}, draws, seed).select((F.col("v") / F.nullif(F.col("w"), F.lit(0))).alias("m")).where("m IS NOT NULL")
    place = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # a number for each draw
    low, high = F.greatest(F.lit(0), F.floor(F.size("m") * alpha / 2)), F.greatest(F.lit(0), F.floor(F.size("m") * (1 - alpha / 2)) - 1)
    whole = rows.agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("estimate"))
    bounds = place.select(F.get("m", low.cast("int")).alias("lower"), F.get("m", high.cast("int")).alias("upper"))
    return whole.join(bounds)


def bootstrap_recovery(rows: DataFrame, key: str, stale: Column, refreshed: Column, arm: Column, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: recovery and its interval by resampling queries, 4 digits, and how many draws had nothing to recover (degenerate)."""
    arms = {n: truth(c).cast("long") for n, c in (("s", stale), ("f", refreshed), ("a", arm))}
    got = drawn(rows, key, arms, draws, seed).select(recovery(F.col("s").cast("double"), F.col("f").cast("double"), F.col("a").cast("double")).alias("m"))
    place = got.agg(F.array_sort(F.collect_list("m")).alias("m"), F.count_if(F.col("m").isNull()).alias("degenerate"))  # a number for each draw
    at = lambda share: F.get("m", F.least(F.size("m") - 1, F.floor(F.size("m") * share)).cast("int"))
    whole = rows.agg(F.round(recovery(*[F.sum(c).cast("double") for c in arms.values()]), 4).alias("point"))
    return whole.join(place.select("degenerate", F.round(at(0.025), 4).alias("lower"), F.round(at(0.975), 4).alias("upper")))


def bootstrap_recovery_exact(rows: list[tuple[int, int, int]], draws: int = 10_000, seed: int = 0) -> dict:
    """The interval that resampling a run's queries (stale, refreshed, arm: 1 or 0) with Python's generator gives; for a run's few rows."""
    held = np.asarray(rows, np.float64).reshape(-1, 3)
    out: dict = {"n_boot": draws, "degenerate": 0, "point": None, "lower": None, "upper": None}
    if not len(held):
        return out | {"degenerate": draws}
    share = lambda m: (m[2] - m[0]) / (m[1] - m[0]) if m[1] != m[0] else None
    found = [share(held[i].sum(0) / len(held)) for i in itertools.islice(choices(len(held), seed), draws)]
    good = sorted(x for x in found if x is not None)
    if not good:
        return out | {"degenerate": draws}
    point = share(held.sum(0) / len(held))
    at = lambda p: round(good[min(len(good) - 1, int(p * len(good)))], 4)
    return out | {"degenerate": draws - len(good), "point": None if point is None else round(point, 4), "lower": at(0.025), "upper": at(0.975)}


def choices(n: int, seed: int) -> Iterator[np.ndarray]:
    """Without end, the n places that n calls of choice() of Python's generator take of n values."""
    bits, (*key, pos) = np.random.MT19937(), random.Random(seed).getstate()[1]
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
    shift, left = np.uint64(32 - n.bit_length()), np.zeros(0, np.uint64)
    while True:
        while len(left) < n:
            raw = bits.random_raw(2 * n) >> shift
            left = np.concatenate((left, raw[raw < n]))
        yield left[:n]
        left = left[n:]


def bootstrap_exact(rows: DataFrame, group: str, value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """The interval that resampling a group's sorted values with Python's generator gives, group by group; for groups that fit
    one task."""

    def run(names: tuple, x: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(x[value].dropna().to_numpy(np.float64))
        if not len(values):
            return pd.DataFrame([(names[0], 0, None, None, None)], columns=[group, "n", "estimate", "lower", "upper"])
        mean = lambda v: math.fsum(v.tolist()) / len(v)
        means = sorted(mean(values[i]) for i in itertools.islice(choices(len(values), seed), max(1, draws)))
        at = lambda i: round(means[max(0, min(len(means) - 1, i))], 6)
        return pd.DataFrame([(names[0], len(values), round(mean(values), 6), at(int(alpha / 2 * len(means))), at(int((1 - alpha / 2) * len(means)) - 1))], columns=[group, "n", "estimate", "lower", "upper"])

    kind = rows.schema[group].dataType.simpleString()
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, n bigint, estimate double, lower double, upper double")
