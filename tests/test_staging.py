import pytest

from lumenframe.plans import staging as st


def test_written_tables_are_read_back_and_discarded(spark):
    df = st.written(spark.range(5).toDF("n"), "numbers")
    assert df.count() == 5 and st.cut(df).count() == 5
    assert st.discard(spark) >= 1 and st.discard(spark) == 0


def test_an_own_folder_is_kept(spark):
    assert st.shared_folder(spark) == st.shared_folder(spark)


def test_small_inputs_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert st.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    assert st.spread(spark.range(10).repartition(cores + 3)).rdd.getNumPartitions() == cores + 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lumenframe.plans.staging import shared_folder

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda _: None), master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_the_library_is_sent_whole(spark):
    import zipfile

    from lumenframe.packages import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert {"lumenframe/__init__.py", "lumenframe/operators/images.py"} <= set(names) and not any("__pycache__" in n for n in names)
