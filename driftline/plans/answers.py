"""What queries answer, each run once: a digest of its rows in any order, from the run that shows whether it runs at all."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..sources import catalog

Tables = dict[str, DataFrame]
#: Seeds of the two hashes of a row.
SEEDS = ("a", "b")
#: Queries that run side by side; each is in a scheduler pool of its own.
AT_ONCE = 4


@contextmanager
def views(spark: SparkSession, tables: Tables):
    """The tables, and no others of an evaluation, under their names. A frame made inside keeps its plan after."""
    catalog.register(tables)
    try:
        yield
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


@dataclass(frozen=True)
class Answer:
    """Either an error's text, or the columns' types, the number of rows, and the sums of two hashes of each row, low and high halves
    apart. Answers with the same types, number and sums have the same rows, repeats counted, but for one chance in 2^100 or so."""

    error: str | None = None
    types: tuple[str, ...] = ()
    n: int = 0
    sums: tuple[int, ...] = ()
    #: The value of a result of one column, as text, if it has one row.
    only: str | None = None

    def same(self, other: Answer) -> bool:
        return self.error is None and other.error is None and (self.types, self.n, self.sums) == (other.types, other.n, other.sums)

    def first(self) -> list[Row]:
        """Rows that stand for the first ones: as many as there are, two at most; a lone value as it is."""
        return [Row(self.only if self.n == 1 and len(self.types) == 1 else None)] * min(self.n, 2)


def _shown(c: Column, kind: DataType) -> list[Column]:
    """What a row's hash takes of a column. The functions pass nulls over, so whether there is one is hashed too; of nested values, their
    text with its nulls. Zeros are equal whatever their sign."""
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return [c.isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"})]
    return [c.isNull(), c + F.lit(0).cast(kind) if isinstance(kind, (DoubleType, FloatType)) else c]


def digest(frame: DataFrame) -> Answer:
    """One aggregate over the whole result."""
    kinds = [f.dataType for f in frame.schema]
    own = frame.toDF(*[f"c{i}" for i in range(len(kinds))])
    shown = [x for i, k in enumerate(kinds) for x in _shown(F.col(f"c{i}"), k)]
    hashes = own.select(*[F.xxhash64(F.lit(seed), *shown).alias(f"h{seed}") for seed in SEEDS], (F.col("c0").cast("string") if len(kinds) == 1 else F.lit(None).cast("string")).alias("only"))
    halves = [F.sum(part(F.col(f"h{seed}"))) for seed in SEEDS for part in (lambda h: F.shiftright(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    n, only, *sums = hashes.agg(F.count("*"), F.max("only"), *[F.coalesce(s, F.lit(0)) for s in halves]).first()
    return Answer(None, tuple(t for _, t in frame.dtypes), n, tuple(sums), only)


@dataclass
class Answers:
    """The answers of queries over some tables; a text is run once."""

    spark: SparkSession
    tables: Tables
    known: dict[str, Answer] = field(default_factory=dict)

    def plan(self, sql: str | None) -> DataFrame | Answer:
        """The query as a frame, or its answer if it has one already: an error, or what is known."""
        if not sql or not sql.strip():
            return Answer("there is no query")
        if sql in self.known:
            return self.known[sql]
        try:
            with views(self.spark, self.tables):
                return self.spark.sql(sql)
        except Exception as e:
            self.known[sql] = Answer(str(e))
            return self.known[sql]

    def answer(self, sql: str | None) -> Answer:
        planned = self.plan(sql)
        return planned if isinstance(planned, Answer) else self.run(sql, planned)

    def run(self, sql: str, frame: DataFrame) -> Answer:
        try:
            self.known[sql] = digest(frame)
        except Exception as e:
            self.known[sql] = Answer(str(e))
        return self.known[sql]

    def same(self, sql: str | None, other: str | None) -> bool:
        """Whether both queries run and have the same rows, in any order."""
        return self.answer(sql).same(self.answer(other))


def ahead(spark: SparkSession, wanted: Iterable[tuple[Answers, str | None]]) -> None:
    """Runs queries of an item side by side. They are planned one after the other, as views have one name at a time, and run each in a
    pool of its own, which a fair scheduler serves in turns."""
    planned = {(id(held), sql): (held, held.plan(sql)) for held, sql in wanted if sql}
    jobs = [(held, sql, frame) for (_, sql), (held, frame) in planned.items() if not isinstance(frame, Answer)]

    def run(k: int) -> None:
        held, sql, frame = jobs[k]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"answers-{k % AT_ONCE}")
        held.run(sql, frame)

    if len(jobs) < 2:
        for k in range(len(jobs)):
            run(k)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return
    with ThreadPoolExecutor(min(AT_ONCE, len(jobs))) as pool:
        list(pool.map(run, range(len(jobs))))
