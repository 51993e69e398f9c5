"""Session settings and the shared working folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> str:
    """Send this package to executors that do not have it on their Python path; the archive that was sent."""
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="shelfmark-"))  # on the driver, from where Spark sends it
    archive = shutil.make_archive(str(folder / "shelfmark"), "zip", root, "shelfmark")
    spark.sparkContext.addPyFile(archive)
    return archive


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder. On a cluster a
    machine-local folder would be lost with its executor, so the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfmark-"))
    return context.getCheckpointDir().rstrip("/")


_watched: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _watched:
        paths.append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Everything that is written to fresh paths inside is deleted at the end.

    A result is read from such files: write or collect it inside.
    """
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield
    finally:
        _watched.pop()
        for path in paths:
            _delete(spark, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside is deleted at the end, but for the tables given to the function that this yields.

    Nothing that is used later may be read from the others.
    """
    paths: list[str] = []
    kept: set[str] = set()

    def keep(staged: DataFrame) -> DataFrame:
        kept.add(staged.staged_path)
        return staged

    _watched.append(paths)
    try:
        yield keep
    finally:
        _watched.pop()
        for path in paths:
            if path not in kept:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write inside is deleted when that ends, and not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where an expensive intermediate feeds several later stages: the files survive a
    lost executor and give the optimizer true sizes.
    """
    path = fresh_path(df.sparkSession, label)
    with _shuffles_deleted(df.sparkSession):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read any more."""
    for df in staged:
        _delete(df.sparkSession, df.staged_path)


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread an input of fewer partitions than cores over all of them.

    Per-row text work is CPU-bound, and a small table may be one unsplittable file. Large inputs
    come in many splits, and are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)
