"""Session helpers: table loading, checkpoint folder, scale-aware partition counts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "furrow", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as the tests and the bench use it; clusters bring their own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Only where that is unset and the master is local, as in tests, a temporary folder serves; on a cluster no machine's own folder
    would outlive its machine, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="furrow-checkpoint-"))


def shuffle_width(spark: SparkSession, df: DataFrame | None = None, mb_each: int = 64) -> int:
    """How many partitions a shuffle of `df` should have: the session's number, or more where
    the optimizer's size estimate says that partitions would outgrow `mb_each`."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < 1 << 60:  # an unknown size is reported as a huge one
            width = max(width, size // (mb_each << 20))
    return width


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by key before work that is heavy for each: a small file of them would be one task, however much it makes to do."""
    return df.repartition(shuffle_width(df.sparkSession, df), *keys)
