"""Session helpers: a configured session, reliable checkpoints, table access."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "helixmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``. Where none is set, a session inside one process gets a
    temporary one; a session with executors elsewhere, which could not read it, is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="helixmill-ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: cuts the lineage, keeps partitions and their order, survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = "spark.sql.constraintPropagation.enabled"
    was = spark.conf.get(name, "true")
    # the constraints of a union of earlier checkpoints may name columns that are gone: Spark fails to carry them over
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, was)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table that its scan reads with fewer tasks than there are cores, dealt evenly to all of them; others as they are.

    A scan makes no split smaller than ``spark.sql.files.openCostInBytes``. Only the layout differs, never the rows.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * least else df
