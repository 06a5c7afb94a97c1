"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "acervo", cpus: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle)} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data folder, as a plain scan (filters and column lists push down)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder named by spark.checkpoint.dir.

    The setting is read from the session. Where it is unset a folder is made for a session on one machine; on a cluster
    that is an error, since a folder of the driver is not one that executors reach. Files go when nothing refers to
    them any more where spark.cleaner.referenceTracking.cleanCheckpoints is set, as local_session() does.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="acervo-checkpoint-"))
    return df.checkpoint(eager=True)


def together(*steps: Callable[[], Any]) -> list[Any]:
    """What the steps give, which run at the same time: the jobs of one fill the cores that those of another leave."""
    inherits = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(steps)) as pool:
        return [x.result() for x in [pool.submit(inherits(step)) for step in steps]]
