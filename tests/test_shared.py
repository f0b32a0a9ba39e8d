from types import SimpleNamespace

import pytest

from ledgerloom import shared


def session(master, conf=None, held=None):
    directory = SimpleNamespace(isDefined=lambda: held is not None, get=lambda: held)
    context = SimpleNamespace(master=master, applicationId="app-test", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: directory)))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: conf or default))


@pytest.fixture(autouse=True)
def no_exit_hooks(monkeypatch):
    monkeypatch.setattr(shared.atexit, "register", lambda *a: None)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="shared folder"):
        shared.shared_dir(session(master))


def test_the_named_folder_comes_first():
    assert shared.shared_dir(session("yarn", "hdfs://a/b/", "hdfs://c")) == "hdfs://a/b/ledgerloom-app-test"
    assert shared.shared_dir(session("yarn", None, "hdfs://c/d")) == "hdfs://c/d/ledgerloom-app-test"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_master_gets_a_folder_of_its_own(master):
    assert shared.shared_dir(session(master)).startswith("file:///")
