import os
from types import SimpleNamespace

import pytest

from quarrylight.llm.common import fresh_dir, live, release, shared_dir


def session(master, configured=""):
    """A session as ``shared_dir`` sees it, with or without spark.checkpoint.dir."""
    get = lambda key, default: configured or default
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get), getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=context)


def test_shared_folder():
    assert shared_dir(session("yarn", "hdfs://x/tmp/")) == "hdfs://x/tmp"
    own = shared_dir(session("local[4]"))
    assert os.path.isdir(own.removeprefix("file://")) and shared_dir(session("local")) == own
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_release_keeps_what_is_read(spark):
    one, two = fresh_dir(spark, "one"), fresh_dir(spark, "two")
    spark.range(5).write.parquet(one)
    spark.range(7).write.parquet(two)
    df = spark.read.parquet(one)
    release(spark, keep=df, among=[one, two])
    assert one in live() and two not in live() and df.count() == 5
    release(spark, among=[one])
    assert one not in live()
