"""The shared folder, bounded tables, and a broadcast that is refused."""

import pytest

from lexicrux import staging
from lexicrux.staging import KEY, bounded, shared_dir, stage, unstage


def test_stage_and_unstage(spark):
    df = stage(spark.range(10))
    assert df.count() == 10 and shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    unstage(df)


class Session:
    """As much of a session as the folder is read from."""

    def __init__(self, master, there=None):
        self.conf = {KEY: there} if there else {}
        self.sparkContext, self.master, self.applicationId = self, master, f"app-{master}"

    def getConf(self):
        return self.conf


def test_the_cluster_names_the_folder():
    assert shared_dir(Session("spark://x", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(Session("local[2]", "file:///x")) == "file:///x"


def test_an_own_folder_only_in_local_mode():
    own = shared_dir(Session("local[2]"))
    assert own.startswith("file:///") and own == shared_dir(Session("local[2]")) == staging._OWN["app-local[2]"]
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            shared_dir(Session(master))


def test_bounded(spark):
    assert len(bounded(spark.range(5), 5, "five")) == 5
    with pytest.raises(ValueError):
        bounded(spark.range(6), 5, "five")
