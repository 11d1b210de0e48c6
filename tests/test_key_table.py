"""ST1: the key table has one file for each partition that a batch adds to."""

import glob

from docsift.streaming import upserts as U


def test_a_file_for_each_key_partition(spark, tmp_path):
    schema = "id long, path string, name string, mtime long, size long"
    base = spark.createDataFrame([(1, "a", "n1", 1, 1)], schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        U.start_documents(spark, base, str(tmp_path))
        batch = spark.createDataFrame([(None, "b", f"n{i}", 1, 1) for i in range(1500)], schema)
        U.upsert_documents_batch(spark, batch, 0, f"{tmp_path}/keys", f"{tmp_path}/log", 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = glob.glob(f"{tmp_path}/keys/batch=0/part=*")
    assert len(parts) > 200
    assert len(glob.glob(f"{tmp_path}/keys/batch=0/part=*/*.parquet")) == len(parts)
    keys = spark.read.parquet(f"{tmp_path}/keys").where("batch = 0")
    assert keys.count() == 1500 and keys.agg({"id": "min"}).first()[0] == 2 and keys.agg({"id": "max"}).first()[0] == 1501
