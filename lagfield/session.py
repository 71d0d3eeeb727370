"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# All timestamps are naive UTC. Skew handling is left to adaptive execution, which
# splits an oversized join partition by map output and never changes results.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Static, so for the session builder: call-site capture costs milliseconds for each
# column expression built in Python, and feature tables have hundreds of columns.
BUILDER_SETTINGS = {**SETTINGS, "spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    A local session without that setting gets a fresh temporary folder; a cluster
    session without it is refused, since a machine-local folder would not be seen
    by the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    base = tempfile.mkdtemp(prefix="lagfield-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch_scope", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path below the shared folder, or below the innermost ``job_tables``."""
    return os.path.join(_scope.get() or shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@contextlib.contextmanager
def job_tables(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """Tables that operators write inside this block are removed when it ends, however it ends.

    Results must be written, collected or counted inside the block: what is still lazy afterwards
    has lost the tables it reads.
    """
    path = scratch(spark, name)
    token = _scope.set(path)
    try:
        yield path
    finally:
        _scope.reset(token)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
