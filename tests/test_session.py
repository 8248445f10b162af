from __future__ import annotations

from types import SimpleNamespace

import pytest

from lodework import session


def test_stored_and_release(spark):
    df = session.stored(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()
    session.release(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)
