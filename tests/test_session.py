"""The scratch folder: the shared one where it is set, an own one for a local master without it."""

import pytest

from hitledger import session


class Conf(dict):
    def set(self, *_):
        raise AssertionError("the caller's session is not changed")


class Fake:
    def __init__(self, master, **conf):
        self.conf, self.master, self.applicationId, self.sparkContext = Conf(conf), master, "app-1", self

    def getConf(self):
        return self.conf


def test_scratch_dir():
    shared = Fake("spark://host", **{"spark.checkpoint.dir": "hdfs://shared/"})
    assert session.scratch_dir(shared, "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError):
        session.scratch_dir(Fake("spark://host"), "x")
    one, two = (session.scratch_dir(Fake("local[2]"), "x") for _ in range(2))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
