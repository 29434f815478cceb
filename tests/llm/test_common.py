import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from adjudica.llm import common


def session(master, folder=None):
    held = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)


def test_shared_folder():
    """The session's folder; one of our own on one machine only; an error on a cluster."""
    assert common.shared_dir(session("spark://x:7077", "hdfs://n/c/")) == "hdfs://n/c"
    own = session("local[2]")
    assert common.shared_dir(own).startswith("file:///") and common.shared_dir(own) == common.shared_dir(own)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(session("spark://x:7077"))


def test_leave_out(spark, monkeypatch):
    """The same rows stay by broadcast and by shuffle; null ids stay, and so do columns that clash."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "id long, doc_id string")
    gone = common.materialize(spark.createDataFrame([(2,), (2,), (9,), (None,)], "doc_id long"), "gone")
    want = sorted([(1, "a"), (None, "c")], key=str)
    assert sorted(map(tuple, common.leave_out(df, "id", gone).collect()), key=str) == want
    monkeypatch.setattr(common, "BROADCAST", 0)
    assert sorted(map(tuple, common.leave_out(df, "id", gone).collect()), key=str) == want
    assert common.leave_out(df, "id", gone).columns == ["id", "doc_id"]


def test_memory_goes_back():
    common.give_back()


def test_settings_while_writing(spark, tmp_path):
    """A smaller batch stays, a larger or boundless one is lowered, and all settings come back, after errors too."""
    name, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name)
    try:
        for given, within in (("10000", "2000"), ("50", "50"), ("0", "2000")):
            spark.conf.set(name, given)
            with pytest.raises(KeyError), common.writing(spark):
                assert (spark.conf.get(name), spark.conf.get(clean)) == (within, "true")
                raise KeyError
            assert (spark.conf.get(name), spark.conf.get(clean)) == (given, "false")
    finally:
        spark.conf.set(name, held)


def test_a_table_that_is_read_again_and_again(spark):
    """What a written table came from is gone; the table, and a source that is used twice, stay."""
    source = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    one, two = common.materialize(source, "one"), common.materialize(source, "two")
    assert one.join(two, "k").count() == source.count() == one.count() == 7


def test_scratch_tables_go(spark):
    """Tables of a scope go with it, those that are kept go with the scope around it, and after errors too."""
    df = spark.range(5)
    there = lambda t: os.path.exists(t._folder.removeprefix("file://"))
    with common.scratch(spark) as keep:
        with common.scratch(spark) as inner:
            one, two = common.materialize(df, "one"), inner(common.materialize(df, "two"))
        assert not there(one) and there(two) and two.count() == 5
        three = keep(common.materialize(df, "three"))
        with pytest.raises(KeyError), common.scratch(spark):
            four = common.materialize(df, "four")
            raise KeyError
        assert not there(four)
    assert not there(two) and there(three) and three.count() == 5 and common.SCRATCH == []
