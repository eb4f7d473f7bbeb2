"""Intermediates: where they lie, and that their owner can remove them."""

import os
from unittest import mock

import pytest

from trendloom import storage


def test_a_cluster_must_name_a_shared_folder():
    spark = mock.MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext.getConf().get.return_value = None
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    spark.sparkContext.master = "spark://there:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(spark)


def test_intermediates_are_read_again_and_removed(spark):
    df = storage.materialize(spark.range(5), "five")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert sorted(r.id for r in df.collect()) == list(range(5)) and spark.sparkContext.applicationId in folder
    other = storage.fresh_path(spark, "five")
    assert other != storage.fresh_path(spark, "five")
    storage.remove_intermediates(spark)
    assert not os.path.exists(folder)
    storage.remove_intermediates(spark)  # nothing there is no error
    assert storage.materialize(spark.range(2), "two").count() == 2
