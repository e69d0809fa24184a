"""Session helpers: UTC sessions, and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
ROWS_PER_TASK = 1 << 19


def build_session(app: str = "mediagraph", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config(CHECKPOINT_KEY, local_folder())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps in the data are UTC; naive text must never be read in another zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_folder() -> str:
    """Where a session on one machine keeps its written tables, if it names no other place."""
    return f"file://{tempfile.gettempdir()}/mediagraph"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session may do without."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        named = local_folder()
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_folder(spark: SparkSession) -> str:
    """This application's part of the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/cut-{spark.sparkContext.applicationId}"


def discard_cuts(spark: SparkSession) -> None:
    """Delete the tables that `cut` wrote. Call it when results are written; local sessions do it when Python ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cut_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_discarding: set[str] = set()


def _discard_at_exit(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.master.startswith("local[") and sc.applicationId not in _discarding:
        _discarding.add(sc.applicationId)

        def discard() -> None:
            import shutil

            shutil.rmtree(folder, ignore_errors=True)

        folder = cut_folder(spark).removeprefix("file:").replace("///", "/")
        atexit.register(discard)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and continue from there.

    Used once per round of an iterative job: the plan stays short, a lost executor costs one round at most, and the
    next round's joins are planned from the table's real size.
    """
    folder = f"{cut_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _discard_at_exit(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` (of about `rows` rows) dealt by `keys` over as many tasks as they need: what a task sorts or hashes doesn't grow with the input."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // ROWS_PER_TASK)), *keys)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
