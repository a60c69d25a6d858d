"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Session setting: tasks that row-heavy scans are dealt out to; unset, scans keep their splits.
SCAN_PARTITIONS = "spark.tallyarc.scan.partitions"


def build_session(app: str = "tallyarc", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config(SCAN_PARTITIONS, str(cores) if str(cores).isdigit() else "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a temporary folder; on a
    cluster executors and driver would each see their own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; callers write, then read it."""
    return f"{shared_dir(spark).rstrip('/')}/tallyarc-{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Losing an executor then costs one read, not a replay of every round.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a scan to ``SCAN_PARTITIONS`` tasks, if the session asks for that.

    A file of one row group is one task however its splits are set. Who runs row-heavy
    work on a few such files says so; a large table is left as its splits are.
    """
    wanted = scan.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return scan.repartition(int(wanted)) if wanted else scan


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Few rows that many others are made of, in as many tasks as there are shuffle partitions: by their size they would share one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
