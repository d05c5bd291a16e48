from types import SimpleNamespace

import pytest

from newsloom import session


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_plain_join_is_a_join(spark, how):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k long, w string")
    want = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, session.plain_join(left, right, ["k"], how).collect())) == want
    assert sorted(map(str, session.plain_join(left, right, ["k"], how, spread="v").collect())) == want


def fake(master, folder=None, conf=None, known=None):
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: conf), getCheckpointDir=lambda: known, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=context), made


def test_the_shared_folder_is_the_clusters():
    for spark, made in (fake("spark://a:1", "hdfs://x/cp"), fake("spark://a:1", None, "hdfs://x/cp"), fake("local[2]", "hdfs://x/cp")):
        assert session.shared_dir(spark) == "hdfs://x/cp" and made == ["hdfs://x/cp"]
    spark, made = fake("spark://a:1", None, None, "hdfs://x/own")
    assert session.shared_dir(spark) == "hdfs://x/own" and made == []
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(fake("spark://a:1")[0])
    assert "newsloom" in session.shared_dir(fake("local[2]")[0])
