import os

import pytest
from pyspark.sql import functions as F

from blobtrail import session
from blobtrail.operators.pairs import minhash_pairs, set_pairs, simhash_pairs
from blobtrail.plans import registry
from blobtrail.session import ensure_checkpoint_dir, written


def test_checkpoint_folder_is_set_once(spark):
    first = ensure_checkpoint_dir(spark)
    assert all(ensure_checkpoint_dir(spark) == first for _ in range(200))


def test_written_tables_read_back(spark):
    df = written(spark.range(10).withColumn("x", F.array("id")))
    assert df.columns == ["id", "x"] and df.count() == 10


@pytest.mark.parametrize("threshold", [0, -0.1, 1.01])
def test_thresholds_outside_the_range_are_refused(spark, threshold):
    df = spark.createDataFrame([(1, [1], 1)], "key long, items array<long>, fp long")
    for join in (lambda: set_pairs(df, None, threshold), lambda: minhash_pairs(df, None, threshold, 1, sig="items"), lambda: simhash_pairs(df, None, threshold)):
        with pytest.raises(ValueError):
            join()


def test_written_tables_can_be_dropped(spark):
    registry.forget()  # what it holds may read such tables
    session.drop_written(spark)
    table = session.written(spark.range(5))
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert table.count() == 5 and os.path.isdir(path)
    assert session.drop_written(spark) == 1 and not os.path.exists(path)
    assert session.drop_written(spark) == 0
