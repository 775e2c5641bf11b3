"""The shared folder: the cluster's where it names one, a local one for tests only."""

import pytest

from driftwork import shared


class Session:
    """As much of a session as folder() asks."""

    def __init__(self, master, app, given=None, start=None):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: given or default)})
        conf = type("Start", (), {"get": staticmethod(lambda key: start)})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": app, "getConf": staticmethod(lambda: conf)})


def test_folder_of_the_cluster():
    assert shared.folder(Session("yarn", "a", given="hdfs://x/shared/")) == "hdfs://x/shared"
    assert shared.folder(Session("yarn", "a", start="s3a://x/shared")) == "s3a://x/shared"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_one(master):
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.folder(Session(master, "b"))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]", "local[2,3]"])
def test_tests_have_their_own(master):
    assert shared.folder(Session(master, "c")).startswith("file:/") and shared.folder(Session(master, "c")) == shared.folder(Session("local", "c"))


def test_tables_are_written(spark):
    rows = shared.written(spark.range(5).selectExpr("id", "cast(null as string) as text"), "t")
    assert rows.count() == 5 and rows.dtypes == [("id", "bigint"), ("text", "string")] and len(rows.inputFiles()) > 0
