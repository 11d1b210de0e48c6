"""Retention of job runs.

``keep_last_n`` finds, per job, the n-th newest run with a top-n that never
holds a job's runs in one task (``top_k_per_group``: partial group limits
before the shuffle, or salted rounds for large n), then marks every older run
with a join on the per-job threshold table (one row per job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.vectors import top_k_per_group


def keep_last_n(runs: DataFrame, n: int, group: str = "job", ts: str = "started", id_col: str = "id",
                salts: int | None = None) -> DataFrame:
    """Runs older than the newest ``n`` of their job (newest = latest
    start, then highest id); ``n < 0`` keeps everything (returns no rows)."""
    if n < 0:
        return runs.limit(0)
    if n == 0:
        return runs
    order = [F.col(ts).desc(), F.col(id_col).desc()]
    top = top_k_per_group(runs.select(group, ts, id_col), [group], order, n, id_col, salts)
    # per job: the n-th newest (ts, id), one row per job; AQE broadcasts it
    # at run time when its measured size is small
    nth = (top.where(F.col("rank") == n)
           .select(group, F.struct(F.col(ts).alias("t"), F.col(id_col).alias("i")).alias("_nth")))
    j = runs.join(nth, group)
    older = F.struct(F.col(ts).alias("t"), F.col(id_col).alias("i")) < F.col("_nth")
    return j.where(older).drop("_nth")
