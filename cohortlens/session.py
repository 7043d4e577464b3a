"""Session helpers: a tuned local session for tests/bench, and the shared folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark import RDD
from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench (the cluster supplies its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system path and is used
    as is.  Only when it is unset and the master is local do we pick a
    scratch folder; a cluster without a shared folder is an error, since
    executors could not read what another machine wrote.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (for written tables, sinks)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "cohortlens", *parts])


def unique_suffix() -> str:
    return f"{os.getpid()}-{os.urandom(4).hex()}"


def materialize(df):
    """Write ``df`` once as a reliable checkpoint in the shared folder.

    For multi-pass operators: later passes read the checkpoint instead of
    recomputing the lineage (joins), and a lost executor re-reads it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """(``df`` written once as Parquet in the shared folder and read back, its path); ``discard`` the path after its last reader."""
    path = shared_path(df.sparkSession, "fits", f"{name}-{unique_suffix()}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


class Trail:
    """What a state that passes renew again and again still rests on: its last checkpoint, and the broadcasts since.

    All of it is needed to make lost blocks again, until the next checkpoint
    is written.  Then it goes, so that it does not grow with the passes.
    """

    def __init__(self):
        self.folder, self.sent = None, []

    def broadcast(self, sc, value):
        self.sent.append(sc.broadcast(value))
        return self.sent[-1]

    def renewed(self, state: RDD, own: int = 1) -> RDD:
        """``state``, whose checkpoint has been written, without what came before it: Python, too, keeps the RDDs that one was made from.

        The last ``own`` broadcasts belong to the step that made ``state`` itself.
        """
        before, first = self.folder, max(0, len(self.sent) - own)
        sent, self.sent = self.sent[:first], self.sent[first:]
        self.folder = (state.ctx, state.getCheckpointFile())
        _release(before, sent)
        return RDD(state._jrdd, state.ctx, state._jrdd_deserializer)

    def end(self) -> None:
        """Nobody reads the state any more."""
        before, sent, self.folder, self.sent = self.folder, self.sent, None, []
        _release(before, sent)


def _release(checkpoint, sent) -> None:
    for b in sent:
        b.destroy()
    if checkpoint and checkpoint[1]:
        folder = checkpoint[0]._jvm.org.apache.hadoop.fs.Path(checkpoint[1])
        folder.getFileSystem(checkpoint[0]._jsc.hadoopConfiguration()).delete(folder, True)


def bound_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on tables go to Python tasks and back, and Parquet is read, in batches of ``rows`` rows at most; a smaller setting stays.

    A batch lies in the executor's buffers and in the worker at the same time;
    at Spark's 10,000 rows (4,096 for Parquet), whole texts fill tens of MB of each.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))


@contextmanager
def shuffles_freed(spark: SparkSession):
    """In the block a DataFrame's shuffle files go when its job ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
