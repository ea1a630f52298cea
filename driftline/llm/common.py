"""Shared pieces of the corpus operators: word splitting, scratch tables, graph components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words everywhere in this subpackage.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows in one Arrow batch. Texts can be very long, so batches hold few rows.
ARROW_ROWS = 256
#: Has Spark delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How scratch tables are laid out. Rows can be blocks of megabytes, and Parquet's writer would first look at the size of a page or row
#: group after 100 of them, so that a task wrote, and read at once, all of its input. It takes values in a dictionary for small, and
#: would then look thousands of rows later; hence the most.
LAYOUT = {"parquet.block.size": 8 << 20} | {f"parquet.{kind}.size.row.check.{end}": rows for kind in ("block", "page") for end, rows in (("min", 1), ("max", 8))}


def python_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8. bytes.split() separates at exactly the six blanks above, unlike str.split()."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, so that a worker's memory doesn't follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches have so many rows while this lasts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where the session names none and they are one process, as in
    tests; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    except Exception:  # the session may have ended; the shared folder's owner clears what is left
        pass


class Scratch:
    """Tables that one operator call writes to the shared folder between its phases.

    A written table cuts lineage and survives the loss of any executor. drop() removes a table that no later phase
    reads; what the returned DataFrame still reads goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.frames = 0
        atexit.register(_remove, spark, self.root)

    def keep(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        """Writes df and gives it back as a plain scan. The shuffle files of this write go as soon as it has ended."""
        path = f"{self.root}/{self.frames}"
        self.frames += 1
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**LAYOUT).parquet(path, compression=compression)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _remove(self.spark, df._scratch_path)


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a and b of one orderable type, any direction, repeats and loops allowed. Returns node and root,
    root being the least node that can be reached, for every node that has an edge to another; no edges give no rows.
    Each round only takes minima (combined before the shuffle) and joins; no neighbour list is ever gathered, and the
    number of edges never grows. The minima are written before they are joined, so that both sides of a join come straight from a
    shuffle and a node with any number of edges can be split. Rows with a null end are ignored.
    """
    now = scratch.keep(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    digest = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: larger neighbours go to the least one
        large = scratch.keep(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # small star: smaller neighbours and the node itself go to the least of them
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("x"), "m")
            .unionByName(low.select(F.col("u").alias("x"), "m"))
            .where("x != m")
            .select(F.col("x").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        following = scratch.keep(small)
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(now, least, large, low)
        now = following
        if seen == digest or not seen[0]:
            break
        digest = seen
    else:
        raise RuntimeError("the components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).distinct()
