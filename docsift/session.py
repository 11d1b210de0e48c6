"""Spark session helpers.

Cluster runs get their settings from the submitter; ``get_spark`` only fills
in defaults that are unset, so a cluster's ``spark.checkpoint.dir``,
shuffle-partition count or broadcast threshold always wins.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Defaults for local runs and tests.  AQE re-plans joins from measured sizes
# (so a runtime broadcast only happens behind a checked size), coalesces small
# shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
# Only for a new local session: a cluster sizes its own shuffles (AQE then
# coalesces small partitions and splits skewed ones).
LOCAL_CONF = {"spark.sql.shuffle.partitions": "8"}


# Settings only a new JVM can take.
STATIC_CONF = ("spark.ui.enabled", "spark.ui.showConsoleProgress", "spark.driver.memory")


def get_spark(master: str | None = None, app: str = "docsift", conf: dict | None = None) -> SparkSession:
    """A session with docsift's defaults for every setting the submitter did
    not set.  An existing (cluster) session keeps its own values: defaults are
    applied only to keys absent from its SparkConf."""
    from pyspark import SparkContext

    merged = dict(DEFAULT_CONF)
    active = SparkContext._active_spark_context
    if active is None and (master or "").startswith("local"):
        merged.update(LOCAL_CONF)
    merged.update(conf or {})
    if active is None:
        builder = SparkSession.builder.appName(app)
        if master:
            builder = builder.master(master)
        for k, v in merged.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    else:
        spark = SparkSession.builder.getOrCreate()
        given = active.getConf()
        for k, v in merged.items():
            if k not in STATIC_CONF and not given.contains(k) and k not in (conf or {}):
                spark.conf.set(k, v)
            elif k in (conf or {}) and k not in STATIC_CONF:
                spark.conf.set(k, v)
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect sessions have no context)
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session.  Only a local session
    without one (tests, local runs) gets a scratch folder of its own; a
    cluster session without one is refused, since a machine-local folder
    would not survive the loss of that machine.
    """
    sc = _context(spark)
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc is not None:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir() or configured
        return configured
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not str(master).startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder for cluster runs")
    local = tempfile.mkdtemp(prefix="docsift-ckpt-", dir=os.environ.get("DOCSIFT_SCRATCH", "/tmp"))
    if sc is not None:
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir() or local
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def short_rows(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """For a step that hands rows of ``n_bytes`` or fewer to Python.  Spark adds up
    a batch's bytes after every row, which takes most of the time if rows are
    short.  Where as many rows as a batch may have stay within the bound of its
    bytes, the sum is left out; the batches are the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        rows, most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), spark.conf.get(key)
    except Exception:  # noqa: BLE001  (a Spark without this bound adds up nothing)
        rows, most = 0, ""
    found = re.fullmatch(r"(\d+)b?", most)
    if not found or rows <= 0 or rows * n_bytes > int(found[1]):
        yield
        return
    spark.conf.set(key, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set(key, most)
