"""Shared helpers of the corpus operators: tables, written intermediates, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything between the six ASCII white-space characters.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Rows per Arrow batch handed to Python; keeps a worker's batch near 10 MB of usual text.
ARROW_ROWS = 2000
#: Bytes of input for one file of a written intermediate.
FILE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch can hold before it reaches a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master (tests) may fall back to a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='loom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_folders: dict[str, list[str]] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str = "part") -> str:
    """A new path in this application's part of the shared folder, which goes when the driver ends."""
    home = f"{shared_dir(spark)}/loom-{spark.sparkContext.applicationId}"
    if home not in _folders:
        _folders[home] = []

        def end() -> None:
            with contextlib.suppress(Exception):  # the session may have been stopped
                remove(spark, home)

        atexit.register(end)
    _folders[home].append(f"{home}/{name}-{uuid.uuid4().hex}")
    return _folders[home][-1]


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediates that were written inside; their readers must be done."""
    before = {home: len(paths) for home, paths in _folders.items()}
    yield
    for home, paths in _folders.items():
        for path in paths[before.get(home, 0) :]:
            remove(spark, path)
        del paths[before.get(home, 0) :]


def files_for(df: DataFrame) -> int:
    """How many files an intermediate of this input gets: one for each FILE_BYTES, two for each core at least."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return min(1_000_000, max(2 * df.sparkSession.sparkContext.defaultParallelism, size // FILE_BYTES))


def materialise(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    At most files tasks write it, each streaming over several partitions: many tiny files
    cost more than they carry. None is for tables that do not grow with the input, 0 leaves the
    partitions as they are (for large rows, since merged partitions may come out uneven). The
    files stay until discard(), the end of cleared(), or the end of the driver.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    (df if files == 0 else df.coalesce(files or 2 * spark.sparkContext.defaultParallelism)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a superseded result of materialise()."""
    remove(df.sparkSession, df._loom_path)
    for paths in _folders.values():
        if df._loom_path in paths:
            paths.remove(df._loom_path)


def _hung(edges: DataFrame, large: bool, files: int | None) -> DataFrame:
    """One star step over (a, b) with a > b: hang neighbours below the least one.

    The minima are written first: the join then reads both its sides through shuffles of its
    own, and AQE may split a vertex with very many neighbours over many tasks.
    """
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ends.groupBy("a").agg(F.min("b").alias("m"))
    least = materialise(least.select("a", F.least("a", "m").alias("m")) if large else least, files)
    if large:
        out = ends.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    else:
        out = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    out = materialise(out, files)
    discard(least)
    return out


def _unsettled(edges: DataFrame) -> bool:
    """Whether some vertex hangs below two others, or hangs and carries others."""
    ends = edges.select("a", F.lit(1).alias("hangs"), F.lit(0).alias("carries")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("a").agg(F.sum("hangs").alias("n"), F.max("carries").alias("c"))
    return not each.where((F.col("n") > 1) | (F.col("n") + F.col("c") > 1)).isEmpty()


def components(edges: DataFrame, files: int | None = None, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) pairs of longs: one row (id, component) per linked id.

    Alternates large-star and small-star steps (joins and pre-aggregated minima only)
    until every vertex hangs directly below the least of its component; every round's
    edges go to the shared folder. A vertex with very many neighbours costs one row per
    neighbour, which AQE can split.
    """
    now = materialise(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b").distinct(), files)
    for _ in range(rounds):
        if not _unsettled(now):
            hung = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return hung.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        wide = _hung(now, True, files)
        discard(now)
        now = _hung(wide, False, files)
        discard(wide)
    raise RuntimeError("the components did not settle")
