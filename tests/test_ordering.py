"""Global numbering against a plain sort."""

import random

from lattis.operators.ordering import global_index


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    found = sorted((r["i"], r["a"], r["b"]) for r in global_index(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).collect())
    assert found == [(k, *x) for k, x in enumerate(sorted(rows), 1)]


def test_empty(spark):
    assert global_index(spark.createDataFrame([], "a int"), ["a"]).collect() == []


def test_shared_folder_is_cleared(spark, tmp_path):
    from lattis.session import clear_shared, materialize

    df = materialize(spark.range(3).toDF("id"))
    assert df.count() == 3
    (path,) = {f.rpartition("/")[0] for f in df.inputFiles()}
    clear_shared(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))
