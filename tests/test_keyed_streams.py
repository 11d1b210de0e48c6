"""Keyed state: the same tags however edits arrive, restarts included; few folders."""

import random

from docsift.operators.tags import apply_tag_edits
from docsift.streaming import keyed as K


def edits(rng, n, first):
    return [(rng.randrange(30), rng.choice(["a", "b", "c.#112233"]), rng.choice(["add", "delete"]), first + i) for i in range(n)]


def test_runs_and_restarts_equal_one_batch(spark, tmp_path):
    rng = random.Random(1)
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    tags = spark.createDataFrame([(i % 30, t) for i, t in enumerate(["a", "b", "old"] * 20)], "id long, tag string").distinct()
    all_rows = edits(rng, 240, 0)
    rng.shuffle(all_rows)  # later files hold earlier edits too
    K.start_tag_edits(spark, work)
    for run in range(3):
        part = all_rows[run * 80:run * 80 + 80] + [(None, "a", "add", 999), (1, None, "add", 999), (1, "a", "add", None)]
        spark.createDataFrame(part, K.EDITS).repartition(2).write.mode("append").parquet(src)
        K.continue_tag_edits(spark, src, work, files_per_trigger=1 if run else None)  # a new query on the old checkpoint
    want = apply_tag_edits(tags, spark.createDataFrame(all_rows, K.EDITS))
    got = K.current_tags(spark, tags, work)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "tag").collect()))
    before = K.edit_log(spark, work).rows().count()
    K.continue_tag_edits(spark, src, work)  # nothing new
    assert K.edit_log(spark, work).rows().count() == before


def test_log_stays_small_and_retries_replace(spark, tmp_path):
    log = K.TieredLog(spark, str(tmp_path / "log"), K.EDITS, ["id", "tag"], "seq", fan=3)
    log.create()
    rng, rows, most = random.Random(2), [], 0
    for batch in range(20):
        new = edits(rng, 5, 5 * batch)
        rows += new
        log.append(spark.createDataFrame(new, K.EDITS), batch)
        most = max(most, log.folders())
    assert most <= 8 and log.folders() < 20
    newest = {}
    for i, t, op, s in rows:
        if (i, t) not in newest or s > newest[i, t][1]:
            newest[i, t] = (op, s)
    assert {(r.id, r.tag): (r.op, r.seq) for r in log.latest(log.rows()).collect()} == newest
    log.append(spark.createDataFrame(new, K.EDITS), 19)  # the last batch again
    assert {(r.id, r.tag): (r.op, r.seq) for r in log.latest(log.rows()).collect()} == newest


def test_state_is_kept_without_python_and_only_winners_are_logged(spark, tmp_path, monkeypatch):
    plans, append = [], K.TieredLog.append

    def noted(log, rows, batch):
        plans.append(spark.streams.active[0]._jsq.explainInternal(False))
        append(log, rows, batch)

    monkeypatch.setattr(K.TieredLog, "append", noted)
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    K.start_tag_edits(spark, work)
    logged = []
    for part in ([(1, "a", "add", 5), (1, "a", "delete", 3), (2, "a", "add", 1), (3, "a", None, 1), (4, "a", "add", 7)],
                 [(1, "a", "delete", 4), (2, "a", "delete", 2), (2, "a", "add", 0), (4, "a", "delete", 7), (5, "b", "add", 0)]):
        spark.createDataFrame(part, K.EDITS).write.mode("append").parquet(src)
        K.continue_tag_edits(spark, src, work)
        logged.append(sorted(map(tuple, spark.read.schema(K.EDITS).parquet(f"{work}/log/b{len(logged)}").collect())))
    assert logged == [[(1, "a", "add", 5), (2, "a", "add", 1), (3, "a", None, 1), (4, "a", "add", 7)],
                      [(2, "a", "delete", 2), (5, "b", "add", 0)]]
    assert len(plans) == 2  # the batch's own plan: a Python call for each key made its time grow with the keys
    assert all("StateStoreSave" in p and "Pandas" not in p and "Python" not in p for p in plans)
