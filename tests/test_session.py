"""The shared checkpoint folder is read from the session; one is only created when
the session names none (the setting is static, so it is never changed at run time)."""

import pytest

from washbay.session import checkpoint_path, ensure_checkpoint_dir


def test_existing_checkpoint_dir_is_kept(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    d = ensure_checkpoint_dir(spark)
    assert d and (before is None or d == before)
    a, b = checkpoint_path(spark, "x"), checkpoint_path(spark, "x")
    assert a != b and a.startswith(d)


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self, master):
        self.dir, self.master = None, master

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master="local[2]"):
        self.conf, self.sparkContext = _Conf(), _Context(master)


def test_missing_checkpoint_dir_is_created_once():
    s = _Session()
    d = ensure_checkpoint_dir(s)
    assert d and s.sparkContext.dir == d
    assert ensure_checkpoint_dir(s) == d


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_missing_checkpoint_dir_is_an_error_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session(master))
