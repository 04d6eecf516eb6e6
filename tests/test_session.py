"""The shared folder: where it comes from, and that nothing stays in it."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from daywatch import session


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.applicationId = master, folder, "app-1"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake(master, folder=None, **conf):
    return SimpleNamespace(sparkContext=FakeContext(master, folder), conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))


def test_a_set_folder_is_honoured():
    spark = fake("spark://host:7077", "hdfs://store/checkpoints/x", **{"spark.checkpoint.dir": "hdfs://store/other"})
    assert session.shared_dir(spark) == "hdfs://store/checkpoints/x"


def test_the_configured_folder_is_used():
    spark = fake("yarn", **{"spark.checkpoint.dir": "hdfs://store/checkpoints"})
    assert session.shared_dir(spark) == "hdfs://store/checkpoints"
    assert spark.sparkContext.folder == "hdfs://store/checkpoints"


@pytest.mark.parametrize("master", ["yarn", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_without_a_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake(master))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_gets_a_folder(master):
    assert Path(session.shared_dir(fake(master))).is_dir()


def test_stored_rows_are_removed(spark):
    path = session.scratch_path(spark, "rows")
    spark.range(10).write.parquet(path)
    local = Path(path.removeprefix("file:"))
    assert local.is_dir()
    session.clear_scratch(spark)
    assert not local.exists()
