"""Session defaults, table readers and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "newsloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on; a cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long rows. A small one can come in fewer splits than there are cores (a Parquet row group isn't split); then
    it is dealt out anew, so that the work on its texts isn't left to a few of them."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, a file or a folder, as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    # a file source takes a single file by a pattern only
    source = path if folder else f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(source)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder set by setCheckpointDir, or,
    for a local master only, a temporary one; on a cluster that is an error, as its machines have no folder in common then."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "newsloom-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that its lineage ends there and a lost executor costs nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Like cut(), but as a Parquet table in the shared folder: for rows that compress well."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """In it, the files of an action's shuffles go as soon as the action is over, not when the driver happens to collect its garbage.
    A frame whose action is run a second time makes them anew."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def plain_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread: str | None = None) -> DataFrame:
    """left.join(right, keys, how) with an exchange right below the join on both sides, also where right was just aggregated by
    the keys and would come without one: adaptive execution splits a hot key only then. For left joins ``spread`` names a
    column of left that deals out its rows with a null key, which match nothing, instead of leaving them to one task."""
    mark = F.xxhash64(*keys)
    of_left = mark
    if spread:
        missing = F.lit(False)
        for k in keys:
            missing = missing | F.col(k).isNull()
        of_left = F.when(missing, F.xxhash64(spread)).otherwise(mark)
    return left.withColumn("_mark", of_left).join(right.withColumn("_mark", mark), [*keys, "_mark"], how).drop("_mark")
