import zlib

from pyspark.sql import functions as F

from corpusloom.llm import common


def test_row_ids_do_not_depend_on_splits(spark, documents, tmp_path):
    documents([(i // 2, "same") for i in range(400)]).repartition(3).write.parquet(f"{tmp_path}/d")
    found = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = common.with_row_ids(spark.read.parquet(f"{tmp_path}/d").select("doc_id", F.col("text").cast("string")), "row")
        found.append(sorted(map(tuple, rows.select("row", "doc_id").collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({r for r, _ in found[0]}) == 400
    assert common.with_row_ids(spark.range(9), "row").select("row").distinct().count() == 9


def test_folds(spark):
    ids = [0, 7, -3, 10**12, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    want = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in ids]
    assert [r[0] for r in df.select(common.held_out(F.col("doc_id"))).collect()] == want


def test_written_tables_can_be_forgotten(spark):
    kept = common.written(spark.range(5), "test")
    assert kept.count() == 5
    path = kept.inputFiles()[0].removeprefix("file://")
    common.forget(kept)
    import os

    assert not os.path.exists(path)
