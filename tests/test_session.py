import gc
import os
import weakref

from basketry import session


def test_named_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(f"{named}/basketry/")


def test_unset_folder_on_a_local_master(spark, monkeypatch):
    monkeypatch.setattr(session, "_named_dir", lambda _: None)
    first = session.shared_dir(spark)
    assert os.path.isdir(first) and session.shared_dir(spark) == first
    assert session.materialize(spark.range(5), "x").count() == 5
    session.drop_scratch(spark)
    assert os.listdir(f"{first}/basketry") == []


def test_spread_keeps_its_partitions(spark):
    grouped = session.spread(spark.range(100), "id").groupBy("id").count()
    grouped.collect()
    assert grouped.rdd.getNumPartitions() == 4


def test_dropped_frames_let_their_shuffles_go(spark):
    """A frame whose Java side was used is collected, though it lies in a cycle of references."""
    frame = spark.range(10).repartition(3)
    frame.rdd.map(lambda r: (r[0], 1)).partitionBy(2).count()
    seen = weakref.ref(frame._jdf)
    gc.disable()
    try:
        del frame
        session.drop_past_shuffles(spark)
        assert seen() is None
    finally:
        gc.enable()
